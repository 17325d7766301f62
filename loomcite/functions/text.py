"""Column expressions over text. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocab import (
    AGGREGATORS,
    DEFAULT_PRICE,
    PRICE_TIERS,
    SPACE_CLASS,
    STOPWORDS,
    TOKEN_PATTERN,
    TOP_VENUES,
    VENUE_NAMES,
)

SPACES = SPACE_CLASS + "+"
# all letters of the class, for trimming without a pattern
SPACE_LETTERS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_of(value: Column | str) -> Column:
    return F.coalesce(col_of(value).cast("string"), F.lit(""))


def strip(value: Column | str) -> Column:
    """White space of any kind removed at both ends."""
    return F.btrim(text_of(value), F.lit(SPACE_LETTERS))


def squeeze(value: Column | str) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text_of(value), SPACES, " "))


def compact_text(value: Column | str, limit: int = 900) -> Column:
    clean = squeeze(value)
    cut = F.concat(F.rtrim(F.substring(clean, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(clean) <= limit, clean).otherwise(cut)


def canonical_text(value: Column | str) -> Column:
    """Lower-case ASCII letters and digits only, other runs become one blank."""
    return F.trim(F.regexp_replace(F.lower(text_of(value)), "[^a-z0-9]+", " "))


def slugify(value: Column | str, max_len: int = 72, default: str = "item") -> Column:
    dashed = F.btrim(F.regexp_replace(F.lower(text_of(value)), "[^a-z0-9]+", "-"), F.lit("-"))
    slug = F.btrim(F.substring(dashed, 1, max_len), F.lit("-"))
    return F.when(slug == "", F.lit(default)).otherwise(slug)


def raw_tokens(value: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text_of(value)), F.lit(TOKEN_PATTERN), F.lit(0))


def tokenize(value: Column | str) -> Column:
    """Tokens in order with repeats, stopwords removed."""
    return F.filter(raw_tokens(value), lambda t: ~t.isin(STOPWORDS))


def sentences(value: Column | str) -> Column:
    clean = squeeze(value)
    parts = F.split(clean, r"(?<=[.!?])\s+")
    return F.filter(parts, lambda s: s != "")


def text_hash(value: Column | str, length: int = 16) -> Column:
    return F.substring(F.sha2(F.lower(squeeze(value)), 256), 1, length)


def validation_number(value: Column | str) -> Column:
    digit = F.regexp_extract(text_of(value), r"\d", 0)
    return F.when(digit == "", F.lit(0)).otherwise(digit.cast("int"))


def strip_tags(value: Column | str) -> Column:
    return squeeze(F.regexp_replace(text_of(value), "<[^>]+>", " "))


def html_to_text(value: Column | str, limit: int | None = None) -> Column:
    """Drop script/style/noscript blocks and tags; whole text unless a limit is given."""
    blocks = F.regexp_replace(text_of(value), r"(?is)<(script|style|noscript).*?</\1>", " ")
    clean = strip_tags(blocks)
    return clean if limit is None else compact_text(clean, limit)


def peer_reviewed_venue(*values: Column | str) -> Column:
    """First known venue named in the text, with the first 20xx year when there is one."""
    text = F.concat_ws(" ", *[text_of(v) for v in values])
    year = F.regexp_extract(text, r"\b(20\d{2})\b", 1)
    names = [F.when(text.rlike(rf"(?i)\b{name}\b"), F.lit(name)) for name in VENUE_NAMES]
    name = F.coalesce(*names)
    return F.when(name.isNull(), F.lit("")).when(year == "", name).otherwise(F.concat(name, F.lit(" "), year))


def venue_rank(value: Column | str) -> Column:
    venue = F.lower(squeeze(value))
    return (
        F.when(venue == "", F.lit(0))
        .when(venue.rlike("|".join(TOP_VENUES)), F.lit(4))
        .when(venue.isin(AGGREGATORS), F.lit(1))
        .otherwise(F.lit(3))
    )


def clean_external_id(value: Column | str) -> Column:
    no_doi = F.regexp_replace(strip(value), r"^https://doi\.org/", "")
    return F.trim(F.regexp_replace(no_doi, r"^http://dx\.doi\.org/", ""))


def arxiv_id(arxiv: Column | str, url: Column | str, urls: Column | str) -> Column:
    """Versionless id from the first candidate that carries an abs or pdf link."""
    pattern = r"(?i)arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5}(?:v\d+)?)"
    candidates = F.concat(
        F.array(text_of(arxiv), text_of(url)), F.coalesce(col_of(urls), F.array().cast("array<string>"))
    )
    found = F.filter(
        F.transform(candidates, lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1)), lambda c: c != ""
    )
    return F.regexp_replace(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")), "v.*$", "")


def clean_title_prefix(value: Column | str) -> Column:
    """Drop a leading model name such as ``GPT-5.5:`` or ``OpenAI GPT5.5 -``."""
    pattern = r"(?i)^\s*(?:openai\s+)?(?:gpt|claude|gemini|deepseek|qwen|kimi|glm)[\w.\-]*\s*(?::|\s-)\s*"
    return F.trim(F.regexp_replace(text_of(value), pattern, ""))


def repair_hyphens(value: Column | str) -> Column:
    return F.regexp_replace(text_of(value), "([a-z])- ([a-z])", "$1$2")


def estimate_tokens(*values: Column | str) -> Column:
    total = reduce(lambda a, b: a + b, [F.length(text_of(v)) for v in values])
    return F.greatest(F.lit(1), F.floor(total / 4)).cast("bigint")


def price_per_million(model: Column | str) -> Column:
    name = F.lower(text_of(model))
    rules = None
    for needles, price in PRICE_TIERS:
        hit = reduce(lambda a, b: a | b, [name.contains(n) for n in needles])
        rules = F.when(hit, F.lit(price)) if rules is None else rules.when(hit, F.lit(price))
    return rules.otherwise(F.lit(DEFAULT_PRICE))


def summary_key(value: Column | str, words: int) -> Column:
    found = F.regexp_extract_all(F.lower(text_of(value)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_join(F.slice(found, 1, words), " ")


def split_list_text(value: Column | str, limit: int = 520) -> Column:
    """A text turned into list items: newlines, or sentence ends before a capital."""
    parts = F.split(text_of(value), r"\n+|(?<=[.;])\s+(?=[A-Z0-9])")
    return clean_list(parts, limit)


def clean_list(items: Column, limit: int = 520) -> Column:
    clean = F.transform(items, lambda p: F.rtrim(compact_text(p, limit)))
    return F.array_distinct(F.filter(clean, lambda p: p != ""))


def ordered_union(*lists: Column) -> Column:
    """Trimmed, non-empty values in first-seen order."""
    empty = F.array().cast("array<string>")
    joined = F.concat(*[F.coalesce(item, empty) for item in lists])
    trimmed = F.transform(joined, strip)
    return F.array_distinct(F.filter(trimmed, lambda v: v != ""))


def inverted_index(df: DataFrame, text: str, name: str = "index") -> DataFrame:
    """Add ``map<word, positions>`` of a squeezed text. Made in its row, as no index goes beyond one text.

    Words are sorted with their positions and each run of equal words is an entry.
    """
    words = F.transform(F.split(squeeze(text), " "), lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    rows = df.withColumn("_s", F.array_sort(words))
    # each step is a column of its own, so that it is made once per row
    new = lambda i: (i == 0) | (F.get("_s", i)["word"] != F.get("_s", i - 1)["word"])
    rows = rows.withColumn("_b", F.filter(F.sequence(F.lit(0), F.size("_s") - 1), new))
    end = lambda k: F.coalesce(F.get("_b", k + 1), F.size("_s"))
    entry = lambda b, k: F.struct(F.get("_s", b)["word"].alias("key"), F.slice("_s", b + 1, end(k) - b)["pos"].alias("value"))
    return rows.withColumn(name, F.map_from_entries(F.transform("_b", entry))).drop("_s", "_b")


def inverted_index_text(index: Column | str) -> Column:
    """``map<word, positions>`` back to text, words in position order."""
    entries = F.map_entries(col_of(index))
    pairs = F.flatten(
        F.transform(
            entries,
            lambda e: F.transform(
                F.coalesce(e["value"], F.array().cast("array<int>")),
                lambda p: F.struct(p.alias("pos"), e["key"].alias("word")),
            ),
        )
    )
    words = F.transform(F.array_sort(pairs), lambda s: s["word"])
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def goal_kind(value: Column | str) -> Column:
    return F.when(text_of(value).rlike(r"(?i)^\s*my idea draft\s*[:：]"), "idea_draft").otherwise("task")
