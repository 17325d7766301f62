"""Outcome feedback folded into ideas and principles, in the order in which it came.

The size of a step is our own choice. A step adds and clamps: x becomes min(high, max(low, x +
shift)). Two such steps one after the other are one such step, so the fold of any run of steps is
three numbers, and runs are folded piece by piece: pieces of bounded size first, then pieces of
their results, until one step per principle is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .folds import list_rows
from .ranking import ordinal

# own choice: confidence steps by outcome
STEPS = {"supported": 0.12, "contradicted": -0.18, "implementation_failed": -0.06}
SUPPORTED_LEVEL = "L4"
LOWEST, HIGHEST = 0.05, 0.99
#: Steps that are folded in one row.
PIECE = 4096


def step() -> Column:
    pairs = [F.lit(x) for pair in STEPS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("outcome_label")), F.lit(0.0))


def idea_status(feedback: DataFrame) -> DataFrame:
    """Latest outcome of every idea."""
    return feedback.groupBy("idea_id").agg(F.max_by("outcome_label", "seq").alias("feedback_status"), F.count(F.lit(1)).alias("n_feedback"))


def _then(a: Column, b: Column) -> Column:
    """The step that does ``a`` and then ``b``."""
    clamped = lambda x: F.least(b["high"], F.greatest(b["low"], x + b["shift"]))
    return F.struct((a["shift"] + b["shift"]).alias("shift"), clamped(a["low"]).alias("low"), clamped(a["high"]).alias("high"))


def folded_steps(steps: DataFrame, key: str, piece: int = PIECE) -> DataFrame:
    """One step (key, shift, low, high) for all steps of a key in the order of ``seq``; no task holds more than ``piece`` of them together."""
    rows = ordinal(steps.select(key, "seq", "shift", "low", "high"), [key], ["seq"], "at").drop("seq")
    first = F.struct(F.lit(0.0).alias("shift"), F.lit(LOWEST - 2.0).alias("low"), F.lit(HIGHEST + 2.0).alias("high"))
    while True:
        listed = F.array_sort(F.collect_list(F.struct("at", "shift", "low", "high")))
        pieces = rows.groupBy(key, F.floor((F.col("at") - 1) / piece).alias("piece")).agg(F.aggregate(listed, first, _then).alias("s"))
        rows = durable(pieces.select(key, (F.col("piece") + 1).alias("at"), "s.*"))
        if rows.filter("at > 1").isEmpty():
            return rows.drop("at")


def principle_state(principles: DataFrame, feedback: DataFrame, idea_principles: DataFrame) -> DataFrame:
    """Confidence and level of principles after all feedback on the ideas built on them, each outcome clamped in its turn."""
    links = idea_principles.select("idea_id", "principle_id").distinct()
    met = feedback.select("idea_id", "seq", "outcome_label", step().alias("shift")).join(links, "idea_id")
    steps = folded_steps(met.select("principle_id", "seq", "shift", F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high")), "principle_id")
    supported = met.groupBy("principle_id").agg(F.bool_or(F.col("outcome_label") == "supported").alias("_ok"))
    joined = principles.join(steps, "principle_id", "left").join(supported, "principle_id", "left")
    moved = F.greatest(F.col("low"), F.least(F.col("high"), F.col("confidence") + F.col("shift")))
    return (
        joined.withColumn("confidence", F.when(F.col("shift").isNull(), F.col("confidence")).otherwise(moved))
        .withColumn("validation_level", F.when(F.col("_ok"), SUPPORTED_LEVEL).otherwise(F.col("validation_level")))
        .drop("shift", "low", "high", "_ok")
    )


def failure_modes(feedback: DataFrame, idea_principles: DataFrame) -> DataFrame:
    """Failure modes that contradicting feedback adds to principles, in order of arrival."""
    bad = feedback.filter("outcome_label = 'contradicted'").join(idea_principles, "idea_id")
    return list_rows(bad, ["principle_id"], ["failure_modes"])
