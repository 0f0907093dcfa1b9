"""Exact percentiles of groups of any size, by selecting ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.tables import written

#: Accuracy of the sketches that bound a rank's value, and how far from a percentile the bounds are taken at first, as a share of the group.
ACCURACY, MARGIN = 10_000, 0.0005


def exact_percentiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], *, accuracy: int = ACCURACY, margin: float = MARGIN) -> DataFrame:
    """``keys`` and, under each name of ``wanted``, the interpolated percentile of the values that aren't null: what ``F.percentile`` gives, which holds all distinct values of a group in one place.

    A sketch of each group, which is merged before the shuffle and of bounded size, gives two values
    between which a rank lies. Then the rows below the first are counted, and those between the two
    by value, which are a thousandth of the group (and equal values are one row); a running sum over
    them finds the rank. Where a rank isn't between its bounds, the group is done again with wider
    ones; with the whole group between them the rank is found for certain. Rows are read twice.
    """
    numbers, on = {n: k for k, n in enumerate(wanted)}, [*keys, "_m"]
    every = F.array(*(F.struct(F.lit(numbers[n]).alias("_m"), c.cast("double").alias("_v")) for n, (c, _) in wanted.items()))
    # A value that several names ask for is told once for each.
    values = rows.select(*keys, F.explode(every).alias("_x")).select(*keys, "_x._m", "_x._v").where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    share = F.element_at(F.array(*(F.lit(p) for _, p in wanted.values())), F.col("_m") + 1)
    found, left = None, None
    while True:
        at = values if left is None else _matching(values, left, on)
        low, high = (F.percentile_approx("_v", F.array(*(F.lit(min(max(p + way, 0.0), 1.0)) for _, p in wanted.values())), accuracy) for way in (-margin, margin))
        groups = at.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), low.alias("_low"), high.alias("_high"))
        place = share * (F.col("_n") - 1)
        reach = lambda c, whole: F.lit(whole) if margin >= 1 else F.element_at(c, F.col("_m") + 1)
        bounds = groups.select(*on, place.alias("_place"), reach("_low", float("-inf")).alias("_low"), reach("_high", float("inf")).alias("_high"))
        near = _matching(at, bounds, on).where("_v <= _high")
        counted = near.groupBy(*on, "_place", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_w")).agg(F.count(F.lit(1)).alias("_c"))
        line = Window.partitionBy(*on).orderBy("_w").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counted.withColumn("_upto", F.sum("_c").over(line)).where(F.col("_w").isNotNull())
        holds = lambda rank: (F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto"))
        value = lambda rank: F.max(F.when(holds(rank), F.col("_w")))
        down, up, place = F.floor("_place"), F.ceil("_place"), F.col("_place")
        ends = ranked.groupBy(*on, "_place").agg(value(down).alias("_a"), value(up).alias("_b"))
        mixed = F.when(down == up, F.col("_a")).otherwise((up - place) * F.col("_a") + (place - down) * F.col("_b"))
        told = written(ends.select(*on, mixed.alias("_value")), "ranks")  # a row for each group and name
        found = told if found is None else _unmatched(found, left, on).unionByName(told)
        left = told.where(F.col("_value").isNull()).select(*on)
        if margin >= 1 or left.isEmpty():
            break
        margin *= 20
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("_m") == k, F.col("_value"))).alias(n) for n, k in numbers.items()))


def _matching(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of ``other``, a row for each group; null keys match. Which side is sent where is left to the size that Spark sees."""
    return rows.join(*_on(rows, other, on)).drop(*(f"_on{k}" for k in range(len(on))))


def _unmatched(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(*_on(rows, other, on), "left_anti")


def _on(rows: DataFrame, other: DataFrame, on: list[str]) -> tuple[DataFrame, Column]:
    renamed = other.select(*(F.col(c).alias(f"_on{k}") for k, c in enumerate(on)), *(c for c in other.columns if c not in on))
    same = F.lit(True)
    for k, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"_on{k}"))
    return renamed, same
