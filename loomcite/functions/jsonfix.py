"""Clean-up of JSON written in free text, as a cascade of column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip


def repair(value: Column) -> Column:
    """Straight quotes, no trailing commas, quoted keys."""
    plain = F.translate(value, "“”‘’", "\"\"''")
    no_comma = F.regexp_replace(plain, r",\s*([}\]])", "$1")
    return F.regexp_replace(no_comma, r"([{\[,]\s*)([A-Za-z_][A-Za-z0-9_\-]*)(\s*:)", '$1"$2"$3')


def outermost(value: Column) -> Column:
    """From the first brace or bracket to the last one that closes it; NULL when incomplete."""
    brace, bracket = F.instr(value, "{"), F.instr(value, "[")
    start = F.when(brace == 0, bracket).when(bracket == 0, brace).otherwise(F.least(brace, bracket))
    closing = F.when(F.substr(value, start, F.lit(1)) == "{", F.lit("}")).otherwise(F.lit("]"))
    end = F.length(value) - F.instr(F.reverse(value), F.lit("}")) + 1
    end_bracket = F.length(value) - F.instr(F.reverse(value), F.lit("]")) + 1
    last = F.when(closing == "}", F.when(value.contains("}"), end)).otherwise(F.when(value.contains("]"), end_bracket))
    return F.when((start > 0) & (last > start), F.substr(value, start, last - start + 1))


def is_json(value: Column) -> Column:
    """Whether a whole text is one JSON value.

    The parser stops after the first value, so the text is placed in an array before
    an end mark: the mark is the second item only when nothing else follows the value.
    """
    wrapped = F.concat(F.lit("["), value, F.lit(', "end-of-text"]'))
    mark = F.try_variant_get(F.try_parse_json(wrapped), "$[1]", "string")
    return F.coalesce(mark == "end-of-text", F.lit(False))


def clean_json(df: DataFrame, column: str) -> DataFrame:
    """Add ``json`` (clean text) and ``repair_step``; rows that stay broken get step ``error``.

    Steps are separate columns, each tried only when the ones before it failed.
    """
    valid = is_json
    rows = df.withColumn("_raw", strip(column))
    fence = r"(?is)```(?:json)?\s*(.*?)```"
    fenced = F.when(F.col("_raw").rlike(fence), strip(F.regexp_extract("_raw", fence, 1)))
    inner = F.coalesce(fenced, outermost(F.col("_raw")))
    where = F.when(fenced.isNotNull(), F.lit("fenced")).otherwise(F.lit("outermost"))
    step = (
        F.when(F.col("_raw") == "", F.lit("error"))
        .when(valid(F.col("_raw")), F.lit("parsed"))
        .when(valid(repair(F.col("_raw"))), F.lit("repaired"))
        .when(valid(inner), where)
        .when(valid(repair(inner)), F.concat(where, F.lit("_repaired")))
        .otherwise(F.lit("error"))
    )
    rows = rows.withColumn("repair_step", step)
    picked = (
        F.when(F.col("repair_step") == "parsed", F.col("_raw"))
        .when(F.col("repair_step") == "repaired", repair(F.col("_raw")))
        .when(F.col("repair_step").isin("fenced", "outermost"), inner)
        .when(F.col("repair_step") != "error", repair(inner))
    )
    return rows.withColumn("json", picked).drop("_raw")
