"""Quality gates as ordered rule tables.

The reference contract is known from examples only, so the rules below are ours;
each names the case it stands for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_text, squeeze, text_of, tokenize
from ..functions.vocab import RELATED_IDEA_MIN
from .concepts import canonical_method_name

# own rules: (rule, pattern); a text that matches is rejected for that rule
REJECT_RULES = [
    ("license", r"(?i)licensed under|creative commons|all rights reserved|copyright (?:\(c\)|©)"),
    ("objective", r"(?i)^\s*\((?:[ivx]+|[a-z]|\d+)\)\s*to\s"),
    ("discourse", r"(?i)^\s*(?:thus|hence|therefore|moreover|furthermore|however|in addition|as a result),"),
    ("caption", r"(?i)^\s*(?:figure|fig\.|table|algorithm)\s*\d+"),
    ("fragment", r"^\s*[a-zà-öø-ÿ]"),
    ("paper_summary", r"(?i)^\s*(?:this|the|our)\s+(?:paper|work|article|study)\s+(?:introduces|presents|proposes|describes|studies)\b"),
    ("announcement", r"(?i)^\s*(?:in this (?:paper|work)|we (?:introduce|present|propose))\b"),
    ("template", r"(?i)use the source result|reusable lesson for|the principle is that"),
    ("dangling_citation", r"\([A-Z][A-Za-z\-]+ et al\.?\s*$"),
]
# own rules: required fields per concept type
REQUIRED = {
    "existed_idea": ["core_idea", "mechanism", "discussion", "evidence"],
    "principle": ["argument", "discussion", "evidence"],
    "takeaway_message": ["main_results", "condition", "discussion", "evidence"],
    "benchmark": ["benchmark_name", "metric"],
    "baseline": ["baseline_name", "performance", "discussion"],
}
# own rules: author voice to objective voice
VOICE_RULES = [
    (r"(?i)\bwe do not claim that (.+?) is always (?:a )?(\w+)", "$1 is not always $2"),
    (r"(?i)\bwe (?:show|find|observe|demonstrate) that\s+", ""),
    (r"(?i)\bour (method|approach|model|framework)\b", "the $1"),
]
GENERIC_BASELINES = "ablation baseline baselines method methods comparison ours proposed variant control none".split()
GROUNDING_SHARE, GROUNDING_TOKENS = 0.2, 2
NUMBER = r"\d+(?:\.\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?\s*%?"
NUMBER_STANDIN = "an amount to be set by a measured validation protocol"


def failed_rules(text: Column | str, rules: Sequence[tuple[str, str]] = REJECT_RULES) -> Column:
    value = text_of(text)
    return F.array_compact(F.array(*[F.when(value.rlike(pattern), F.lit(name)) for name, pattern in rules]))


def gate(df: DataFrame, text: str, rules: Sequence[tuple[str, str]] = REJECT_RULES) -> DataFrame:
    """Add ``failed``: names of the rules a text breaks; empty when it passes."""
    return df.withColumn("failed", failed_rules(text, rules))


def passes_contract(concepts: DataFrame, concept_type: str) -> DataFrame:
    """Rows with every required field, no dangling citation, and no mechanism that repeats the argument."""
    needed = REQUIRED[concept_type]
    rows = concepts
    for field in needed:
        rows = rows.filter(squeeze(field) != "")
        rows = rows.filter(F.size(failed_rules(field, [r for r in REJECT_RULES if r[0] == "dangling_citation"])) == 0)
    if {"argument", "mechanism"} <= set(concepts.columns):
        same = canonical_text("argument") == canonical_text("mechanism")
        rows = rows.withColumn("mechanism", F.when(same, F.lit("")).otherwise(text_of("mechanism")))
    return rows


def grounding(concepts: DataFrame, works: DataFrame, text: str, work_text: str) -> DataFrame:
    """Share of a concept's distinct words that occur in its own work, and whether that grounds it.

    Words are compared in the row that joins the two texts. Works join by key; the
    word sets stay inside one row.
    """
    right = works.select("work_id", F.array_distinct(tokenize(work_text)).alias("_w"))
    rows = concepts.withColumn("_c", F.array_distinct(tokenize(text))).join(right, "work_id", "left")
    rows = rows.withColumn("n_shared", F.size(F.array_intersect("_c", F.coalesce("_w", F.array().cast("array<string>")))))
    share = F.when(F.size("_c") > 0, F.col("n_shared") / F.size("_c")).otherwise(F.lit(0.0))
    rows = rows.withColumn("share", share).drop("_c", "_w")
    return rows.withColumn("grounded", (F.col("share") >= GROUNDING_SHARE) & (F.col("n_shared") >= GROUNDING_TOKENS))


def grounded_sentences(texts: DataFrame, works: DataFrame, said: str, work_text: str) -> DataFrame:
    """(work_id, pos, n_shared, share, grounded) of every sentence of the array ``said``, as ``grounding`` tells it.

    A text and its work meet once, and their common words are found once; a sentence is held against these only.
    """
    right = works.select("work_id", F.array_distinct(tokenize(work_text)).alias("_w"))
    left = texts.select("work_id", F.transform(said, lambda s: F.array_distinct(tokenize(s))).alias("_c"))
    none = F.array().cast("array<string>")
    rows = left.join(right, "work_id", "left").withColumn("_both", F.array_intersect(F.array_distinct(F.flatten("_c")), F.coalesce("_w", none)))
    counts = F.transform("_c", lambda c: F.struct(F.size(c).alias("n"), F.size(F.array_intersect(c, F.col("_both"))).alias("n_shared")))
    rows = rows.select("work_id", F.posexplode(counts).alias("pos", "_s")).select("work_id", "pos", "_s.n", "_s.n_shared")
    rows = rows.withColumn("share", F.when(F.col("n") > 0, F.col("n_shared") / F.col("n")).otherwise(F.lit(0.0))).drop("n")
    return rows.withColumn("grounded", (F.col("share") >= GROUNDING_SHARE) & (F.col("n_shared") >= GROUNDING_TOKENS))


def scrub_numbers(text: Column | str, evidence: Column | str) -> Column:
    """Replace numbers and ranges that the evidence does not contain; other numbers stay, whatever digits they share."""
    numbers = lambda c: F.transform(F.regexp_extract_all(text_of(c), F.lit(NUMBER), F.lit(0)), lambda v: F.trim(v))
    found = F.regexp_extract_all(text_of(text), F.lit(NUMBER), F.lit(0))
    known = numbers(evidence)
    # a match may end in white space, which stays
    said = F.transform(found, lambda v: F.when(F.array_contains(known, F.trim(v)), v).otherwise(F.concat(F.lit(NUMBER_STANDIN), F.substr(v, F.length(F.rtrim(v)) + F.lit(1)))))
    between = F.split(text_of(text), NUMBER, -1)
    return F.array_join(F.transform(F.arrays_zip(between.alias("between"), said.alias("said")), lambda x: F.concat(x["between"], F.coalesce(x["said"], F.lit("")))), "")


def objective_voice(text: Column | str) -> Column:
    value = text_of(text)
    for pattern, replacement in VOICE_RULES:
        value = F.regexp_replace(value, pattern, replacement)
    return F.trim(value)


def repaired_title(title: Column | str, message: Column | str, evidence: Column | str) -> tuple[Column, Column]:
    """Template titles and messages are replaced by what the evidence says."""
    rules = [r for r in REJECT_RULES if r[0] == "template"]
    said = objective_voice(evidence)
    bad_title = F.size(failed_rules(title, rules)) > 0
    bad_message = F.size(failed_rules(message, rules)) > 0
    return (
        F.when(bad_title & (said != ""), said).otherwise(text_of(title)),
        F.when(bad_message & (said != ""), said).otherwise(text_of(message)),
    )


def official_only(records: DataFrame, catalogue: DataFrame, name: str) -> DataFrame:
    """Records whose name is in a public catalogue (name_key, official_name, official_url)."""
    keyed = records.withColumn("name_key", canonical_text(name))
    return keyed.join(catalogue, "name_key").drop("name_key")


def supported_baselines(baselines: DataFrame) -> DataFrame:
    """Named methods with performance and discussion; not generic, not the proposed method."""
    name = F.lower(canonical_method_name("baseline_name"))
    return baselines.filter(
        (name != "")
        & ~name.isin(GENERIC_BASELINES)
        & ~name.rlike(r"^(?:a |the )?comparison of ")
        & (F.coalesce("baseline_type", F.lit("")) != "proposed_method")
        & (F.coalesce("n_performance", F.lit(0)) > 0)
        & (squeeze("discussion") != "")
    )


def with_model(rows: DataFrame, mode: str) -> DataFrame:
    """Rows of one model mode; an empty result stays empty."""
    return rows.filter(F.col("model_mode") == mode)


def domain_flags(df: DataFrame, text: Column | str, terms: dict[str, list[str]]) -> DataFrame:
    """Add ``domains``: domains whose terms occur in a text. ``terms`` is a parameter table."""
    lower = F.lower(text_of(text))
    flags = [F.when(lower.rlike("|".join(words)), F.lit(domain)) for domain, words in terms.items()]
    return df.withColumn("domains", F.array_compact(F.array(*flags)))


def domain_compatible(records: DataFrame, goal_domains: list[str], terms: dict[str, list[str]], text: str) -> DataFrame:
    """Records about no domain in particular or about one the goal is about."""
    flagged = domain_flags(records, text, terms)
    wanted = F.array(*map(F.lit, goal_domains)) if goal_domains else F.array().cast("array<string>")
    return flagged.filter((F.size("domains") == 0) | F.arrays_overlap("domains", wanted))


def related_ideas(ideas: DataFrame, goal_ids: DataFrame, principle_ids: DataFrame, idea_principles: DataFrame) -> DataFrame:
    """Ideas linked to the goal, or directly relevant (``lexical`` at least the threshold).

    A link to a retrieved principle counts only together with relevance, which already
    admits the idea; it is kept as a column.
    """
    goal = goal_ids.select("goal_id").distinct().withColumn("_g", F.lit(True))
    linked = idea_principles.join(principle_ids.select("principle_id").distinct(), "principle_id", "left_semi")
    linked = linked.select("idea_id").distinct().withColumn("_p", F.lit(True))
    rows = ideas.join(goal, "goal_id", "left").join(linked, "idea_id", "left")
    rows = rows.withColumn("linked_to_principle", F.coalesce("_p", F.lit(False)))
    return rows.filter(F.coalesce("_g", F.lit(False)) | (F.col("lexical") >= RELATED_IDEA_MIN)).drop("_g", "_p")


def compact_record(df: DataFrame, keep: int = 6) -> DataFrame:
    """Heavy rows for a list view: first results and their total, variants dropped."""
    out = df.withColumn("performance_total", F.size("performance")).withColumn("performance", F.slice("performance", 1, keep))
    return out.drop("model_variants")


