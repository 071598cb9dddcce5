"""Exact grouped quantiles that hold when one group owns a large share of all rows.

The built-in exact `percentile` keeps every distinct value of a group in one task. Here a
group is spread over many tasks instead:

1. equal values of a group are counted (partial aggregation before the shuffle, and the
   value is part of the shuffle key);
2. a group's value axis is cut into slots by a monotone function, and the few slot totals of
   a group are added up, which gives every slot its first rank;
3. only the slots that hold a wanted position are joined back to the distinct values, and only
   their values are sorted; those whose rank interval covers a wanted position are picked.

Nothing is sampled or approximated; the result is `lo + (hi - lo) * fraction` as in SQL's
`percentile_cont`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS_PER_OCTAVE = 64
_NO_VALUE = -(2**31)


def _slot(value: Column) -> Column:
    """Monotone in `value`; about 64 slots for each doubling, so a few hundred per group."""
    size = F.floor(F.log2(F.abs(value) + 1.0) * SLOTS_PER_OCTAVE).cast("int")
    return F.coalesce(F.when(value < 0, -1 - size).otherwise(size), F.lit(_NO_VALUE))


def grouped_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, float],
    counts: dict[str, Column] | None = None,
    maximum: str | None = None,
    counted: str | None = None,
) -> DataFrame:
    """One row per `keys` with exact interpolated quantiles of `value`.

    `counts` are conditions whose rows are counted (also rows without a value), `maximum`
    names the greatest value and `counted` the number of rows with a value. NULL in a key
    column is a group like any other: the keys travel as one struct, which joins on NULL fields too.

    The conditions travel as bits of one number that is part of the first grouping. Both
    users of that grouping then need exactly the same columns of it, so Spark computes its
    input and shuffles it once.
    """
    counts = counts or {}
    bits = F.lit(0)
    for i, condition in enumerate(counts.values()):
        bits = bits + F.when(condition, F.lit(1 << i)).otherwise(F.lit(0))
    fed = df.select(F.struct(*keys).alias("_k"), F.col(value).cast("double").alias("_v"), bits.alias("_bits"))
    fed = fed.withColumn("_slot", _slot(F.col("_v")))
    distinct = fed.groupBy("_k", "_slot", "_v", "_bits").agg(F.count("*").alias("_n"))

    def with_bit(i: int) -> Column:
        is_set = F.col("_bits").bitwiseAND(F.lit(1 << i)) != 0
        return F.sum(F.when(is_set, F.col("_n")).otherwise(F.lit(0)))

    slots = distinct.groupBy("_k", "_slot").agg(
        F.sum(F.when(F.col("_slot") != _NO_VALUE, F.col("_n")).otherwise(F.lit(0))).alias("_slot_n"),
        F.max("_v").alias("_slot_max"),
        *[with_bit(i).alias(f"_c{i}") for i in range(len(counts))],
    )
    of_key = Window.partitionBy("_k")
    so_far = of_key.orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = [F.sum(f"_c{i}").over(of_key).alias(f"_c{i}") for i in range(len(counts))]
    slots = slots.select(
        "_k",
        "_slot",
        "_slot_n",
        (F.sum("_slot_n").over(so_far) - F.col("_slot_n")).alias("_before"),
        F.sum("_slot_n").over(of_key).alias("_total"),
        F.max("_slot_max").over(of_key).alias("_max"),
        *totals,
    )

    positions = [F.lit(p) * (F.col("_total") - 1) for p in quantiles.values()]

    def holds(position: Column) -> Column:
        return (F.col("_before") <= position) & (position < F.col("_before") + F.col("_slot_n"))

    # A group without values has one slot, which carries its counts.
    wanted = F.col("_total") == 0
    for position in positions:
        wanted = wanted | holds(F.floor(position)) | holds(F.ceil(position))
    chosen = slots.filter(wanted).drop("_slot_n")
    placed = distinct.drop("_bits").join(chosen, ["_k", "_slot"])

    # Equal values with other bits may stand in any order: the picks only see the value.
    in_slot = (
        Window.partitionBy("_k", "_slot")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last = F.col("_before") + F.sum("_n").over(in_slot)
    placed = placed.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_n"))

    def at(position: Column) -> Column:
        covers = (F.col("_first") <= position) & (position < F.col("_last"))
        return F.max(F.when(covers, F.col("_v")))

    picked = []
    for name, position in zip(quantiles, positions):
        picked += [
            at(F.floor(position)).alias(f"_lo_{name}"),
            at(F.ceil(position)).alias(f"_hi_{name}"),
        ]
    grouped = placed.groupBy("_k").agg(
        *[F.max(f"_c{i}").alias(n) for i, n in enumerate(counts)],
        F.max("_total").alias("_total"),
        F.max("_max").alias("_max"),
        *picked,
    )

    def lerp(name: str, p: float) -> Column:
        position = F.lit(p) * (F.col("_total") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return low + (high - low) * (position - F.floor(position))

    out = ["_k.*", *counts, *[lerp(n, p).alias(n) for n, p in quantiles.items()]]
    if maximum:
        out.append(F.col("_max").alias(maximum))
    if counted:
        out.append(F.col("_total").alias(counted))
    return grouped.select(*out)
