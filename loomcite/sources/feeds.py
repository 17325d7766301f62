"""Landed provider payloads to common work rows. Nothing is fetched here."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import stable_id
from ..functions.text import canonical_text, compact_text, inverted_index_text, peer_reviewed_venue, squeeze, strip_tags, text_of
from ..operators.ranking import ordinal
from ..session import durable

#: Conditions that say that a feed's files can't be read; any other failure is the job's.
UNREADABLE = r"\[((?:FAILED_READ_FILE|MALFORMED_RECORD|PATH_NOT_FOUND|UNABLE_TO_INFER_SCHEMA)[A-Z_.]*)\]"

# fixed values: limits of a work row
MAX_AUTHORS, MAX_ABSTRACT = 12, 1800

_NAME = T.StructType([T.StructField("display_name", T.StringType())])
OPENALEX_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("doi", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("display_name", T.StringType()), T.StructField("publication_year", T.IntegerType()),
    T.StructField("abstract_inverted_index", T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))),
    T.StructField("primary_location", T.StructType([
        T.StructField("landing_page_url", T.StringType()), T.StructField("is_oa", T.BooleanType()), T.StructField("source", _NAME)])),
    T.StructField("host_venue", _NAME),
    T.StructField("authorships", T.ArrayType(T.StructType([T.StructField("author", _NAME)]))),
    T.StructField("cited_by_count", T.LongType()), T.StructField("updated_date", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("_corrupt", T.StringType()),
])
_DATE = T.StructType([T.StructField("date-parts", T.ArrayType(T.ArrayType(T.IntegerType())))])
CROSSREF_SCHEMA = T.StructType([
    T.StructField("DOI", T.StringType()), T.StructField("URL", T.StringType()), T.StructField("title", T.ArrayType(T.StringType())),
    T.StructField("container-title", T.ArrayType(T.StringType())), T.StructField("publisher", T.StringType()),
    T.StructField("published-print", _DATE), T.StructField("published-online", _DATE), T.StructField("issued", _DATE),
    T.StructField("author", T.ArrayType(T.StructType([T.StructField("given", T.StringType()), T.StructField("family", T.StringType())]))),
    T.StructField("abstract", T.StringType()), T.StructField("is-referenced-by-count", T.LongType()), T.StructField("type", T.StringType()),
    T.StructField("resource", T.StructType([T.StructField("primary", T.StructType([T.StructField("URL", T.StringType())]))])),
    T.StructField("indexed", T.StructType([T.StructField("date-time", T.StringType())])), T.StructField("_corrupt", T.StringType()),
])
ATOM_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("summary", T.StringType()),
    T.StructField("published", T.StringType()), T.StructField("updated", T.StringType()),
    T.StructField("arxiv:comment", T.StringType()), T.StructField("arxiv:journal_ref", T.StringType()),
    T.StructField("author", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))), T.StructField("_corrupt", T.StringType()),
])

WORK_COLUMNS = [
    "work_id", "title", "authors", "year", "venue", "url", "source_type", "validation_level", "abstract", "citation_count",
    "provider", "source_urls", "source_updated_at",
]


def _filled(value: Column | str) -> Column:
    """NULL for empty text, so that ``coalesce`` picks the first non-empty one."""
    return F.nullif(text_of(value), F.lit(""))


def _names(names: Column) -> Column:
    return F.filter(F.slice(F.coalesce(names, F.array().cast("array<string>")), 1, MAX_AUTHORS), lambda n: n != "")


def _links(*urls: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*[F.nullif(text_of(u), F.lit("")) for u in urls])))


def _works(rows: DataFrame, provider: str, work_id: Column, **columns: Column) -> DataFrame:
    out = rows.select(
        squeeze(columns.pop("title")).alias("title"), F.lit("paper").alias("source_type"), F.lit("L1").alias("validation_level"),
        F.lit(provider).alias("provider"), *[c.alias(n) for n, c in columns.items()],
    )
    return out.filter("title <> ''").withColumn("work_id", work_id).select(*WORK_COLUMNS)


def openalex_works(rows: DataFrame) -> DataFrame:
    landing = F.coalesce(_filled("primary_location.landing_page_url"), _filled("doi"), _filled("id"), F.lit(""))
    venue = F.coalesce(_filled("primary_location.source.display_name"), _filled("host_venue.display_name"), F.lit("OpenAlex"))
    return _works(
        rows, "openalex", stable_id("W", canonical_text("title")),
        title=F.coalesce(_filled("title"), _filled("display_name"), F.lit("")),
        authors=_names(F.transform(F.col("authorships.author.display_name"), squeeze)),
        year=F.col("publication_year"), venue=F.coalesce(_filled(squeeze(venue)), F.lit("OpenAlex")), url=landing,
        abstract=compact_text(inverted_index_text("abstract_inverted_index"), MAX_ABSTRACT),
        citation_count=F.col("cited_by_count"), source_urls=_links(landing, F.col("id")), source_updated_at=text_of("updated_date"),
    )


def crossref_works(rows: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.coalesce(F.col(f"`{c}`"), F.array().cast("array<string>")), " ")
    dates = F.coalesce(F.col("`published-print`"), F.col("`published-online`"), F.col("issued"))
    year = F.try_element_at(F.try_element_at(dates["date-parts"], F.lit(1)), F.lit(1))
    doi = F.when(_filled("DOI").isNotNull(), F.concat(F.lit("https://doi.org/"), "DOI"))
    url = F.coalesce(_filled("URL"), doi, F.lit(""))
    venue = F.coalesce(_filled(joined("container-title")), _filled("publisher"), F.lit("Crossref"))
    name = lambda a: F.trim(F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit(""))))
    return _works(
        rows, "crossref", stable_id("W", canonical_text("title")),
        title=joined("title"), authors=_names(F.transform("author", name)), year=year,
        venue=F.coalesce(_filled(squeeze(venue)), F.lit("Crossref")), url=url, abstract=compact_text(strip_tags("abstract"), MAX_ABSTRACT),
        citation_count=F.col("`is-referenced-by-count`"), source_urls=_links(url, F.col("resource.primary.URL")),
        source_updated_at=text_of("indexed.date-time"),
    )


def atom_works(rows: DataFrame) -> DataFrame:
    year = F.regexp_extract(text_of("published"), r"^(\d{4})", 1)
    venue = peer_reviewed_venue(squeeze("`arxiv:comment`"), squeeze("`arxiv:journal_ref`"))
    title = F.coalesce(_filled(squeeze("title")), F.lit("Untitled arXiv work"))
    out = rows.withColumn("_first", squeeze("title")).select(
        stable_id("W", "_first", "id").alias("work_id"), title.alias("title"), _names(F.transform("author.name", squeeze)).alias("authors"),
        F.when(year != "", year.cast("int")).alias("year"), F.coalesce(_filled(venue), F.lit("arXiv")).alias("venue"), text_of("id").alias("url"),
        F.lit("paper").alias("source_type"), F.lit("L1").alias("validation_level"), compact_text("summary", MAX_ABSTRACT).alias("abstract"),
        F.lit(None).cast("bigint").alias("citation_count"), F.lit("arxiv").alias("provider"),
        F.array().cast("array<string>").alias("source_urls"),
        F.coalesce(_filled("updated"), text_of("published")).alias("source_updated_at"),
    )
    return out.select(*WORK_COLUMNS)


def read_json_feed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One payload item per line; a line that does not parse goes to ``_corrupt``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return spark.read.schema(schema).options(**options).json(path)


def read_atom_feed(spark: SparkSession, path: str) -> DataFrame:
    options = {"rowTag": "entry", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return spark.read.format("xml").schema(ATOM_SCHEMA).options(**options).load(path)


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken rows) of a feed."""
    return rows.filter("_corrupt is null").drop("_corrupt"), rows.filter("_corrupt is not null").select("_corrupt")


def read_feeds(feeds: Sequence[tuple[str, Callable[[], DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    """(rows of all feeds that can be read, with ``feed`` and ``seq``; an outcome per feed: feed, n_rows, error).

    A feed is read and written before it counts, so one that fails on its path, on its schema or on a
    later line is left out whole and named among the outcomes. ``seq`` is the exact order of arrival: feed by
    feed, and within a feed by the names of its files and as each file has the rows; Spark reads the largest file first.
    """
    read, outcomes = [], []
    for place, (name, load) in enumerate(feeds):
        try:
            at = {"_file": F.input_file_name(), "_block": F.input_file_block_start(), "_line": F.monotonically_increasing_id()}
            rows = durable(load().withColumns({"feed": F.lit(name), "_feed": F.lit(place), **at}))
            outcomes.append((name, rows.count(), None))
            read.append(rows)
        except (PySparkException, Py4JJavaError) as failure:
            found = re.search(UNREADABLE, str(failure))
            if not found:
                raise
            outcomes.append((name, None, found[1]))
    if not read:
        raise ValueError("no feed could be read")
    spark = read[0].sparkSession
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read).withColumn("_all", F.lit(0))
    rows = ordinal(every, ["_all"], ["_feed", "_file", "_block", "_line"], "seq").drop("_all", "_feed", "_file", "_block", "_line")
    return rows, spark.createDataFrame(outcomes, "feed string, n_rows bigint, error string")


def union_feeds(*feeds: DataFrame | None) -> DataFrame:
    """All feeds that are there, in order, with ``feed`` and ``seq``; a missing one, or one that can't be read, is skipped."""
    given = [(str(place), lambda f=f: f) for place, f in enumerate(f for f in feeds if f is not None)]
    if not given:
        raise ValueError("no feed was given")
    return read_feeds(given)[0]
