"""Token and price estimates and the spend guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import estimate_tokens, price_per_million
from ..session import durable
from .ranking import ordinal

FOLD_ROWS = 4096
#: Parts of a price unit that are told apart.
MICRO = 1_000_000


def call_cost(model: Column | str, prompt: Column | str, max_tokens: Column) -> Column:
    return (estimate_tokens(prompt) + max_tokens) / 1_000_000 * price_per_million(model)


def spend_totals(calls: DataFrame) -> DataFrame:
    return calls.groupBy("run_id", "model").agg(F.sum("cost").alias("spent"), F.count(F.lit(1)).alias("n_calls"))


def guard(calls: DataFrame, limit: float, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Add ``accepted`` for costs in money: fractions count, to the millionth.

    The sums run over whole millionths, so they are exact and don't depend on an order of
    additions. ``cost`` comes back in its own type.
    """
    kind = calls.schema["cost"].dataType
    units = calls.withColumn("cost", F.round(F.col("cost") * MICRO).cast("bigint"))
    return guard_units(units, round(limit * MICRO), fold_rows).withColumn("cost", (F.col("cost") / MICRO).cast(kind))


def guard_units(calls: DataFrame, limit: int, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Add ``accepted``: a call passes when accepted-so-far plus its cost stays within the limit.

    ``calls`` holds run_id, seq and a positive whole-number ``cost``. A rejected call
    adds nothing, so this is not a running sum. Runs of up to ``fold_rows`` calls are
    folded inside one row; longer runs go through ``guard_long``, which never brings
    a run together.
    """
    sizes = calls.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    large = durable(sizes.filter(F.col("_n") > fold_rows).select("run_id"))
    if large.isEmpty():
        return guard_short(calls, limit)
    # long runs are at most calls / fold_rows
    short = calls.join(large, "run_id", "left_anti")
    long = calls.join(large, "run_id", "left_semi")
    return guard_short(short, limit).unionByName(guard_long(long, limit))


def guard_short(calls: DataFrame, limit: int) -> DataFrame:
    """The fold for runs of a checked size."""
    items = F.array_sort(F.collect_list(F.struct("seq", "cost")))
    start = F.struct(F.lit(0).cast("bigint").alias("spent"), F.array().cast("array<boolean>").alias("ok"))

    def take(state: Column, item: Column) -> Column:
        fits = state["spent"] + item["cost"] <= F.lit(limit)
        spent = state["spent"] + F.when(fits, item["cost"]).otherwise(F.lit(0).cast("bigint"))
        return F.struct(spent.alias("spent"), F.array_append(state["ok"], fits).alias("ok"))

    runs = calls.select("run_id", "seq", F.col("cost").cast("bigint").alias("cost")).groupBy("run_id").agg(items.alias("_i"))
    flagged = runs.withColumn("_ok", F.aggregate("_i", start, take)["ok"])
    rows = flagged.select("run_id", F.inline(F.arrays_zip(F.col("_i.seq").alias("seq"), F.col("_i.cost").alias("cost"), F.col("_ok").alias("accepted"))))
    return rows.select("run_id", "seq", "cost", "accepted")


def guard_long(calls: DataFrame, limit: int) -> DataFrame:
    """The same result for runs of any length, in about log2(limit) rounds.

    While the remaining budget is between 2^k and 2^(k+1), every call of at most 2^k
    fits and of the larger ones at most one can be taken. So a round needs only
    prefix sums of the small calls and the first large call that still fits; then the
    budget has dropped below 2^k and the round for the next smaller k starts behind
    that call. Prefix sums come from pieces, so no run is brought together.
    """
    rows = ordinal(calls.select("run_id", "seq", F.col("cost").cast("bigint").alias("cost")), ["run_id"], ["seq"], "_at")
    rows = durable(rows)
    state = durable(rows.select("run_id").distinct().select("run_id", F.lit(limit).cast("bigint").alias("_left"), F.lit(0).cast("bigint").alias("_done")))
    taken = None
    for k in range(limit.bit_length() - 1, -1, -1):
        floor = 1 << k
        scale = state.filter(F.col("_left") >= floor)
        todo = rows.join(scale, "run_id").filter((F.col("_at") > F.col("_done")) & (F.col("cost") <= F.col("_left")))
        small = todo.filter(F.col("cost") <= floor)
        sums = durable(prefix_sums(small))
        # the small call that brings the budget below the floor ends the round
        stop_small = sums.filter(F.col("_left") - F.col("_sum") < floor).groupBy("run_id").agg(F.min("_at").alias("_small"))
        # a large call sees the budget after the small calls before it
        large = todo.filter(F.col("cost") > floor)
        seen = budget_before(large, sums)
        stop_large = seen.filter("cost <= _budget").groupBy("run_id").agg(F.min_by(F.struct("_at", "cost"), "_at").alias("_l"))
        ends = scale.join(stop_small, "run_id", "left").join(stop_large, "run_id", "left")
        ends = ends.select("run_id", "_left", "_small", F.col("_l._at").alias("_large"), F.col("_l.cost").alias("_large_cost"))
        end = F.least("_small", "_large")
        ends = ends.withColumn("_end", end).withColumn("_by_large", F.coalesce(F.col("_large") < F.coalesce("_small", F.col("_large") + 1), F.lit(False)))
        ends = durable(ends)
        cut = F.col("_end").isNull() | (F.col("_at") <= F.col("_end"))
        won = sums.drop("_left").join(ends, "run_id").filter(cut).select("run_id", "_at", "cost")
        won = won.unionByName(ends.filter("_by_large").select("run_id", F.col("_large").alias("_at"), F.col("_large_cost").alias("cost")))
        won = durable(won)
        taken = won if taken is None else taken.unionByName(won)
        spent = won.groupBy("run_id").agg(F.sum("cost").alias("_spent"))
        # without an end every later call was looked at: the run is finished
        moved = ends.join(spent, "run_id", "left").select(
            "run_id", (F.col("_left") - F.coalesce("_spent", F.lit(0))).alias("_l2"), F.col("_end").alias("_d2"), F.lit(True).alias("_hit")
        )
        state = state.join(moved, "run_id", "left").select(
            "run_id",
            F.when(F.col("_hit") & F.col("_d2").isNull(), F.lit(0)).otherwise(F.coalesce("_l2", "_left")).alias("_left"),
            F.coalesce("_d2", "_done").alias("_done"),
        )
        state = durable(state)
    accepted = taken.select("run_id", "_at").withColumn("accepted", F.lit(True))
    return rows.join(accepted, ["run_id", "_at"], "left").select("run_id", "seq", "cost", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def prefix_sums(rows: DataFrame, piece: int = 4096) -> DataFrame:
    """Add ``_sum``: cost up to and including each row of a run, in pieces of bounded position range."""
    placed = rows.withColumn("_piece", F.col("_at") - F.col("_at") % piece)
    inside = Window.partitionBy("run_id", "_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_part", F.sum("cost").over(inside))
    totals = placed.groupBy("run_id", "_piece").agg(F.sum("cost").alias("_total"))
    offsets = piece_offsets(totals, piece)
    joined = local.join(offsets, ["run_id", "_piece"])
    return joined.withColumn("_sum", F.col("_part") + F.col("_before")).drop("_piece", "_part", "_before")


def piece_offsets(totals: DataFrame, piece: int) -> DataFrame:
    """Sum of the pieces before each piece, by the same two steps one level up."""
    block = piece * piece
    placed = totals.withColumn("_block", F.col("_piece") - F.col("_piece") % block)
    inside = Window.partitionBy("run_id", "_block").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_part", F.coalesce(F.sum("_total").over(inside), F.lit(0)))
    blocks = placed.groupBy("run_id", "_block").agg(F.sum("_total").alias("_sum"))
    # a block covers 16 million calls, so a run has few of them
    over = Window.partitionBy("run_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")
    joined = local.join(blocks, ["run_id", "_block"])
    return joined.select("run_id", "_piece", (F.col("_part") + F.col("_base")).alias("_before"))


def budget_before(large: DataFrame, sums: DataFrame, piece: int = 4096) -> DataFrame:
    """Add ``_budget``: what the small calls placed before each large call have left."""
    marked = large.select("run_id", "_at", "cost", "_left", F.lit(0).cast("bigint").alias("_c"), F.lit(True).alias("_is_large"))
    small = sums.select("run_id", "_at", "cost", "_left", F.col("cost").alias("_c"), F.lit(False).alias("_is_large"))
    both = marked.unionByName(small).withColumn("cost", F.col("cost"))
    summed = prefix_sums(both.withColumnRenamed("cost", "_own").withColumnRenamed("_c", "cost"), piece)
    rows = summed.filter("_is_large").withColumn("_budget", F.col("_left") - F.col("_sum"))
    return rows.select("run_id", "_at", F.col("_own").alias("cost"), "_budget")


def first_breach(calls: DataFrame, limit: int) -> DataFrame:
    """Where the plain running sum of each run first passes the limit."""
    rows = ordinal(calls.select("run_id", "seq", F.col("cost").cast("bigint").alias("cost")), ["run_id"], ["seq"], "_at")
    summed = prefix_sums(rows.withColumn("_left", F.lit(limit).cast("bigint")))
    over = summed.filter(F.col("_sum") > limit)
    return over.groupBy("run_id").agg(F.min_by(F.struct("seq", F.col("_sum").alias("spent")), "seq").alias("_b")).select("run_id", "_b.seq", "_b.spent")
