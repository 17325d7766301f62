"""Quality rules as weak supervision.

Each rule looks at one statistic of a text and votes for good, votes for bad, or abstains. A
latent-class model (is the text good?) explains the votes: expectation and maximisation
estimates how often each rule's votes are right on good and on bad texts, and a text is kept if the
posterior probability that it is good is at least a half. Statistics that see the same thing (repeated lines,
repeated windows, few distinct words) cast one vote together. If only one rule ever votes bad, votes alone can't
tell how many texts are bad; the classes then stay where the start puts them. Two base limits stay hard. All of it
is column expressions and aggregates; only the model's few parameters reach the driver.

Rules for odd rows: null and empty texts have no word and fail the base limits; repeated rows
are judged alike; a null id stays null; an empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

BLANKS = " \t\n\x0b\f\r"
BLANK = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
KEEP_FROM = 0.5
ROUNDS = 40
START_ODDS = 20
PRIOR_VOTES = 0.5
CAPITALS = "[A-ZÀ-ÖØ-Þ]"


def _count_of(text: str, characters: str) -> Column:
    return F.regexp_count(text, F.lit(characters)).cast("bigint")


def _repeated_words(windows: Column) -> Column:
    """Words in windows whose hash is there twice or more, from the array of the windows' hashes in order."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # a window with an equal hash beside it in the sorted array is repeated
    edge = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(-1).alias("i")))
    before = F.concat(edge, F.slice(placed, 1, F.size(placed) - 1))
    after = F.concat(F.slice(placed, 2, F.size(placed)), edge)
    flags = F.zip_with(F.zip_with(placed, before, lambda x, b: F.struct(x["i"].alias("i"), x["h"].alias("h"), (x["h"] == b["h"]).alias("b"))), after,
                       lambda x, a: F.when(F.coalesce(x["b"], F.lit(False)) | F.coalesce(x["h"] == a["h"], F.lit(False)), x["i"]))
    at = F.sort_array(F.array_compact(flags))
    nothing = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(at, nothing, lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["to"])).alias("n"), (p + WINDOW).alias("to")))["n"]


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics that the rules look at; every column is exact over the whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"), F.btrim(t, F.lit(BLANKS)).alias("core"))
    words = F.when(F.col("core") == "", F.array().cast("array<string>")).otherwise(F.split("core", BLANK + "+"))
    rows = rows.withColumn("split", words)
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    rows = rows.select(
        "doc_id", F.length(F.array_join("split", "")).cast("bigint").alias("word_chars"), _count_of("text", SYMBOLS).alias("n_symbols"),
        _count_of("text", CAPITALS).alias("n_capitals"), _count_of("text", "!").alias("n_exclaims"), _count_of("text", "[0-9]").alias("n_digits"),
        lines.alias("lines"), F.transform("split", lambda w: F.xxhash64(w)).alias("words"),
    )
    # a window's hash from those of its halves; windows that reach beyond the text are cut off at the end
    for reach, name in ((1, "twos"), (2, "fours"), (4, "windows")):
        last = rows.columns[-1]
        rows = rows.withColumn(name, F.transform(last, lambda h, i: F.xxhash64(h, F.get(last, i + reach))))
    windows = F.when(F.size("words") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.slice("windows", 1, F.size("words") - WINDOW + 1))
    rows = rows.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_capitals", "n_exclaims", "n_digits",
        F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"), windows.alias("windows"),
    )
    repeated = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("bigint")).otherwise(_repeated_words(F.col("windows")))
    return rows.select(*[c for c in rows.columns if c != "windows"], repeated.alias("n_repeat_words"))


def rule_votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))

    def vote(value: Column, good, bad, speaks: Column | None = None) -> Column:
        v = F.when(bad(value), -1).when(good(value), 1).otherwise(0)
        return v if speaks is None else F.when(speaks, v).otherwise(0)

    repetition = [
        vote(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), lambda v: v == 0, lambda v: v > 0.5, F.col("n_lines") >= 3),
        vote(F.col("n_repeat_words") / n, lambda v: v <= 0.02, lambda v: v > MOST_REPEATED / 100, F.col("n_words") >= WINDOW),
        vote(F.col("n_distinct") / n, lambda v: v >= 0.4, lambda v: v < 0.15, F.col("n_words") >= LEAST_WORDS),
    ]
    return {
        "length": vote(F.col("n_words"), lambda v: v >= 40, lambda v: v < LEAST_WORDS),
        "word_length": vote(chars / n, lambda v: v.between(3, 9), lambda v: (v < 2) | (v > 14)),
        "symbols": vote(F.col("n_symbols") / n, lambda v: v <= 0.01, lambda v: v > 0.1),
        "capitals": vote(F.col("n_capitals") / chars, lambda v: v <= 0.1, lambda v: v > 0.25),
        "exclaims": vote(F.col("n_exclaims") / n, lambda v: v <= 0.02, lambda v: v > 0.2),
        "digits": vote(F.col("n_digits") / chars, lambda v: v <= 0.05, lambda v: v > 0.25),
        "repetition": F.when(F.least(*repetition) == -1, -1).otherwise(F.greatest(*repetition)),
    }


class RuleModel:
    """Share of good texts, and each rule's share of good votes among its votes on good and on bad ones.

    An abstention tells nothing about a text, so only votes count. A rule's two shares lean
    weakly (``PRIOR_VOTES``) on its share of good votes over all texts: what the votes don't tell
    apart stays equal in both classes and has no say. Which class is the good one is fixed by the start
    alone, where a bad vote is ``START_ODDS`` times as frequent on bad texts; no later round is bounded.
    """

    def __init__(self, names: list[str], overall: dict[str, float], good: float = 0.7):
        self.names, self.good, self.overall = names, good, overall
        self.rates = {}
        for n in names:
            on_bad = 1 - min(START_ODDS * (1 - overall[n]) / 2, 0.9)
            self.rates[n] = (1 - (1 - on_bad) / START_ODDS, on_bad)

    def posterior(self) -> Column:
        """Probability of good given the votes in columns named like the rules."""
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for name in self.names:
            up, bad_up = self.rates[name]
            odds = odds + F.when(F.col(name) == 1, math.log(up / bad_up)).when(F.col(name) == -1, math.log((1 - up) / (1 - bad_up))).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """How often a rule's vote is right on good texts, and on bad ones."""
        return {n: (up, 1 - bad_up) for n, (up, bad_up) in self.rates.items()}

    def refit(self, patterns: DataFrame) -> float:
        """One round over the table of vote patterns; the largest change of a parameter."""
        p, n = F.col("_p"), F.col("_n")
        sums = [F.sum(n * p).alias("good"), F.sum(n).alias("all")]
        for name in self.names:
            for v in (1, -1):
                hit = F.when(F.col(name) == v, n).otherwise(0)
                sums += [F.sum(hit * p).alias(f"{name}_{v}_g"), F.sum(hit * (1 - p)).alias(f"{name}_{v}_b")]
        s = patterns.withColumn("_p", self.posterior()).agg(*sums).first()
        if not s["all"]:
            return 0.0
        good = (s["good"] + 2) / (s["all"] + 3)
        change, self.good = abs(good - self.good), good
        for name in self.names:
            # shares stay inside doubles, however many texts there are
            share = lambda c: (s[f"{name}_1_{c}"] + PRIOR_VOTES * self.overall[name]) / (s[f"{name}_1_{c}"] + s[f"{name}_-1_{c}"] + PRIOR_VOTES)
            new = tuple(min(max(share(c), 1e-12), 1 - 1e-12) for c in "gb")
            change = max(change, *(abs(x - y) for x, y in zip(new, self.rates[name])))
            self.rates[name] = new
        return change


def fit_rules(votes: DataFrame, names: list[str], rounds: int = ROUNDS, least_change: float = 1e-4) -> RuleModel:
    """Learn from all texts' votes, summed up by pattern: three to the number of rules at most, whatever the input."""
    patterns = durable(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).coalesce(1))
    count = lambda name, v: F.sum(F.when(F.col(name) == v, F.col("_n")).otherwise(0)).alias(f"{name}_{v}")
    seen = patterns.agg(*[count(n, v) for n in names for v in (1, -1)]).first()
    up = {n: seen[f"{n}_1"] or 0 for n in names}
    model = RuleModel(names, {n: (up[n] + 1) / (up[n] + (seen[f"{n}_-1"] or 0) + 2) for n in names})
    for _ in range(rounds):
        if model.refit(patterns) < least_change:
            break
    return model


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base statistics, base_failed, p_good and kept of each document row."""
    votes = rule_votes()
    names = list(votes)
    stats = durable(text_statistics(docs, doc_id, text).withColumns(votes))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    model = fit_rules(stats.filter(~failed).select(*names), names)  # the base limits need no model
    rows = stats.withColumn("p_good", model.posterior()).withColumn("base_failed", failed)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select(*base, (~F.col("base_failed") & (F.col("p_good") >= KEEP_FROM)).alias("kept"), "p_good")
