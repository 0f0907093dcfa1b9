"""Joins in time, without joining: windows over one timeline cut in bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Length of a time bin. Windows are partitioned by the keys and the bin, so that one key with most of the rows is work for as many tasks as it has bins.
BIN_MS = 600_000


def bin_of(time: Column, bin_ms: int = BIN_MS) -> Column:
    return F.floor(time / F.lit(bin_ms)).cast("long")


def in_bins(rows: DataFrame, time: str, *, back_ms: int = 0, on_ms: int = 0, bin_ms: int = BIN_MS) -> DataFrame:
    """``rows`` with ``_bin`` and ``_own``: each in its own bin, and a copy (not ``_own``) in every other bin that holds a time up to ``back_ms`` before or ``on_ms`` after its own. Rows without a time have a null bin."""
    t = F.col(time)
    bins = F.sequence(bin_of(t - back_ms, bin_ms), bin_of(t + on_ms, bin_ms))
    return rows.withColumn("_bin", F.explode_outer(bins)).withColumn("_own", F.coalesce(F.col("_bin") == bin_of(t, bin_ms), F.lit(True)))


def last_before_bin(rows: DataFrame, keys: list[str], time: str, value: Column, out: str, bin_ms: int = BIN_MS) -> DataFrame:
    """``keys``, ``_bin`` and the last known ``value`` of all earlier bins, of each bin that has rows. Only one row for each bin goes through the window over a key."""
    known = F.when(value.isNotNull(), F.col(time))
    of_bin = rows.groupBy(*keys, bin_of(F.col(time), bin_ms).alias("_bin")).agg(F.max_by(value, known).alias("_last"))
    line = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return of_bin.select(*keys, "_bin", F.last("_last", ignorenulls=True).over(line).alias(out))


def first_within(value: Column, keys: list[str], order: str, from_ms: int, to_ms: int) -> Column:
    """The first value of the same keys whose time is ``from_ms`` to ``to_ms`` after the row's."""
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(from_ms, to_ms))


def last_within(value: Column, keys: list[str], order: str, from_ms: int, to_ms: int) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(from_ms, to_ms))


def asof_backward(rows: DataFrame, states: DataFrame, keys: list[str], columns: list[str], *, time: str = "timestamp_ms", longest_ms: int | None = None, prefix: str = "", bin_ms: int = BIN_MS) -> DataFrame:
    """``rows`` with the ``columns`` of the last of ``states`` at or before their time.

    ``longest_ms``: older states don't count. Both tables go on one timeline, cut in bins: a row
    takes part in one sort within its key and bin and in no join with states. A state is copied into
    the bins that it reaches; without ``longest_ms``, each bin begins with the last state before it.
    States of one time: any of them.
    """
    bin_ms = max(bin_ms, longest_ms or 0)
    given = states.select(*keys, F.col(time).alias("_t"), F.struct(F.col(time).alias("_at"), *columns).alias("_state"))
    left = rows.select(F.struct(*rows.columns).alias("_row"), *keys, F.col(time).alias("_t"), bin_of(F.col(time), bin_ms).alias("_bin"), F.lit(1).alias("_kind"), F.lit(None).cast(given.schema["_state"].dataType).alias("_state"))
    right = in_bins(given, "_t", on_ms=longest_ms or 0, bin_ms=bin_ms).select(F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), *keys, "_t", "_bin", F.lit(0).alias("_kind"), "_state")
    line = left.unionByName(right)
    if longest_ms is None:
        both = given.unionByName(rows.select(*keys, F.col(time).alias("_t"), F.lit(None).cast(given.schema["_state"].dataType).alias("_state")))
        before = last_before_bin(both, keys, "_t", F.col("_state"), "_state", bin_ms).where(F.col("_state").isNotNull())
        line = line.unionByName(before.select(F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), *keys, F.col("_state._at").alias("_t"), "_bin", F.lit(0).alias("_kind"), "_state"))
    upto = Window.partitionBy(*keys, "_bin").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = line.withColumn("_seen", F.last("_state", ignorenulls=True).over(upto)).where("_kind = 1")
    fresh = F.lit(True) if longest_ms is None else F.col("_t") - F.col("_seen._at") <= longest_ms
    return seen.select("_row.*", *(F.when(fresh, F.col(f"_seen.{c}")).alias(prefix + c) for c in columns))


def nearest_forward_then_backward(rows: DataFrame, states: DataFrame, keys: list[str], value: str, *, target: str, tolerance_ms: int, out: str, time: str = "timestamp_ms", bin_ms: int = BIN_MS) -> DataFrame:
    """``rows`` with the first value at ``target`` or up to ``tolerance_ms`` later, else the last up to ``tolerance_ms`` earlier."""
    bin_ms = max(bin_ms, tolerance_ms)
    left = rows.select(F.struct(*rows.columns).alias("_row"), *keys, F.col(target).alias("_t"), bin_of(F.col(target), bin_ms).alias("_bin"), F.lit(None).cast("double").alias("_value"))
    near = in_bins(states.select(*keys, F.col(time).alias("_t"), F.col(value).cast("double").alias("_value")), "_t", back_ms=tolerance_ms, on_ms=tolerance_ms, bin_ms=bin_ms)
    line = left.unionByName(near.drop("_own").withColumn("_row", F.lit(None).cast(left.schema["_row"].dataType)))
    forward, backward = first_within(F.col("_value"), [*keys, "_bin"], "_t", 0, tolerance_ms), last_within(F.col("_value"), [*keys, "_bin"], "_t", -tolerance_ms, 0)
    return line.withColumn(out, F.coalesce(forward, backward)).where(F.col("_row").isNotNull()).select("_row.*", out)


def running(rows: DataFrame, keys: list[str], order: tuple[str, ...], *, sums: dict[str, Column] | None = None, highs: dict[str, Column] | None = None, before: dict[str, str] | None = None, after: dict[str, str] | None = None, bin: Column | None = None) -> DataFrame:
    """``rows`` with running values along a line of rows, as a window over ``keys`` in ``order`` would give them; but no task holds the whole line.

    ``sums`` and ``highs``: the sum and the largest value of an expression up to and with the row;
    ``before`` and ``after``: a column's value in the row before and after it. The line is cut in
    bins (of time: the first column of ``order``; else ``bin``, which must not fall along the line).
    Each bin is summed up by an aggregation, those rows, one for each bin, go through the window over
    the keys, and what comes before a bin is added to the windows within it. ``order`` should tell
    all rows apart. Null keys and times are keys and a bin like others.
    """
    sums, highs, before, after = sums or {}, highs or {}, before or {}, after or {}
    binned = rows.withColumn("_bin", bin if bin is not None else bin_of(F.col(order[0])))
    # A number where it will do: aggregations by structs have to sort.
    at = F.struct(*order) if len(order) > 1 else F.coalesce(F.col(order[0]), F.lit(-(2**63)))
    parts = {f"_v{k}": F.sum(c) for k, c in enumerate(sums.values())} | {f"_h{k}": F.max(c) for k, c in enumerate(highs.values())}
    parts |= {f"_b{k}": F.max_by(c, at) for k, c in enumerate(before.values())} | {f"_a{k}": F.min_by(c, at) for k, c in enumerate(after.values())}
    line = Window.partitionBy(*keys).orderBy("_bin")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"_v{k}").over(earlier).alias(f"_v{k}") for k in range(len(sums))] + [F.max(f"_h{k}").over(earlier).alias(f"_h{k}") for k in range(len(highs))]
    carried += [F.lag(f"_b{k}").over(line).alias(f"_b{k}") for k in range(len(before))] + [F.lead(f"_a{k}").over(line).alias(f"_a{k}") for k in range(len(after))]
    on = [*keys, "_bin"]
    carry = binned.groupBy(*on).agg(*(c.alias(n) for n, c in parts.items())).select(*(F.col(k).alias(f"_on{n}") for n, k in enumerate(on)), *carried)
    same = F.lit(True)
    for n, k in enumerate(on):
        same = same & F.col(k).eqNullSafe(F.col(f"_on{n}"))
    within = Window.partitionBy(*on).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    out = {n: F.coalesce(F.col(f"_v{k}") + F.coalesce(F.sum(c).over(upto), F.lit(0)), F.sum(c).over(upto), F.lit(0)) for k, (n, c) in enumerate(sums.items())}
    out |= {n: F.greatest(F.col(f"_h{k}"), F.max(c).over(upto)) for k, (n, c) in enumerate(highs.items())}
    near = lambda beside, other, c: F.when(beside.isNotNull(), beside[c]).otherwise(F.col(other))
    out |= {n: near(F.lag(F.struct(c)).over(within), f"_b{k}", c) for k, (n, c) in enumerate(before.items())}
    out |= {n: near(F.lead(F.struct(c)).over(within), f"_a{k}", c) for k, (n, c) in enumerate(after.items())}
    return binned.join(carry, same).withColumns(out).select(*rows.columns, *out)


def previous(rows: DataFrame, keys: list[str], order: tuple[str, ...], value: str, out: str, bin_ms: int = BIN_MS) -> DataFrame:
    """``rows`` with the ``value`` of the row before, by ``order`` (a time, then what tells equal times apart)."""
    return running(rows, keys, order, before={out: value}, bin=bin_of(F.col(order[0]), bin_ms))


def interval_join(starts: DataFrame, points: DataFrame, keys: list[str], horizon_ms: int, *, time: str = "timestamp_ms") -> DataFrame:
    """Pairs of a row of ``starts`` and a row of ``points`` with the same keys at most ``horizon_ms`` later (not at the same time).

    Both are dealt in bins as long as the horizon, so a start meets two bins of points and not all
    points of its key. Columns of ``points`` get the prefix ``p_``.
    """
    binned = lambda c: F.floor(F.col(c) / F.lit(horizon_ms)).cast("long")
    left = starts.withColumn("_bin", F.explode(F.array(binned(time), binned(time) + 1)))
    right = points.select(*(F.col(c).alias(c if c in keys else f"p_{c}") for c in points.columns)).withColumn("_bin", binned(f"p_{time}"))
    after = (F.col(f"p_{time}") > F.col(time)) & (F.col(f"p_{time}") <= F.col(time) + horizon_ms)
    return left.join(right, [*keys, "_bin"]).where(after).drop("_bin")


def slot_spine(bounds: DataFrame, first: str, last: str, out: str) -> DataFrame:
    """One row for each whole number from ``first`` to ``last``."""
    return bounds.withColumn(out, F.explode(F.sequence(first, last)))


def islands(rows: DataFrame, keys: list[str], order: str, inside: Column, out: str = "island") -> DataFrame:
    """Rows where ``inside`` holds, with the time of the last row before them where it doesn't (null: none): the same for all rows of an unbroken run, and for no other."""
    marked = rows.withColumn("_in", F.coalesce(inside, F.lit(False)))
    return running(marked, keys, (order,), highs={out: F.when(~F.col("_in"), F.col(order))}).where("_in").drop("_in")
