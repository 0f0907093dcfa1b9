"""Order books rebuilt from level updates: ``market_id``, ``timestamp_ms``, ``nonce``, ``begin_nonce``, ``kind``, ``side``, ``price``, ``size``.

The rows of one market and nonce are the levels of one message; one without a price says only that
the message was empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import Sampling
from tickloom.functions.columns import safe_mid
from tickloom.operators.temporal import running

#: Messages are put in order in stretches of so many nonces.
BIN_NONCES = 4096
#: A book is written out at the begin of each bin of so many grid points, and its changes within.
BIN_POINTS = 12


def _told(updates: DataFrame) -> DataFrame:
    """One row for each message, with its ``levels``, its ``episode``, whether it is ``applied`` and ``out_of_step``; ``closed_ms``: when the episode's book ends; ``heard_to_ms``: the next applied message."""
    level = F.when(F.col("price").isNotNull(), F.struct("side", "price", "size"))
    each = updates.where(F.col("nonce").isNotNull()).groupBy("market_id", "nonce").agg(F.min("timestamp_ms").alias("timestamp_ms"), F.max("begin_nonce").alias("begin_nonce"), F.max("kind").alias("kind"), F.collect_list(level).alias("levels"))
    snapshot = F.col("kind") == "snapshot"
    line = running(each, ["market_id"], ("nonce",), sums={"episode": F.when(snapshot, 1).otherwise(0)}, before={"_before": "nonce"}, after={"_after": "nonce", "_after_ms": "timestamp_ms"}, bin=F.floor(F.col("nonce") / BIN_NONCES))
    line = line.withColumn("_gap", (F.col("episode") > 0) & ~snapshot & F.coalesce(F.col("begin_nonce") != F.col("_before"), F.lit(True)))
    at = lambda c: F.min(F.when(F.col("_gap"), F.struct("nonce", "timestamp_ms")))[c]
    episodes = line.groupBy("market_id", "episode").agg(at("nonce").alias("_gap_nonce"), at("timestamp_ms").alias("_gap_ms"), F.min("timestamp_ms").alias("_starts"))
    # A row for each snapshot.
    episodes = episodes.withColumn("_next", F.lead("_starts").over(Window.partitionBy("market_id").orderBy("episode")))
    rows = line.join(episodes, ["market_id", "episode"])
    applied = (F.col("episode") > 0) & F.coalesce(F.col("nonce") < F.col("_gap_nonce"), F.lit(True))
    heard_to = F.when(F.col("_after") == F.col("_gap_nonce"), F.col("_next")).otherwise(F.col("_after_ms"))
    return rows.select("market_id", "nonce", "timestamp_ms", "kind", "episode", "levels", applied.alias("applied"), (F.col("_gap") & (F.col("nonce") == F.col("_gap_nonce"))).alias("out_of_step"), F.least("_gap_ms", "_next").alias("closed_ms"), heard_to.alias("heard_to_ms"))


def messages(updates: DataFrame) -> DataFrame:
    """One row for each message: its ``episode``, whether it is ``applied``, and whether it is the first one ``out_of_step`` of its episode.

    A snapshot begins an episode with an empty book. A delta must begin at the nonce before it; the
    first that doesn't ends the book, and no more is applied until the next snapshot. Deltas before
    the first snapshot (episode 0) aren't applied either. A message without a nonce can't be put in
    order and is left out.
    """
    return _told(updates).select("market_id", "nonce", "timestamp_ms", "kind", "episode", "applied", "out_of_step")


def level_intervals(updates: DataFrame) -> DataFrame:
    """From when to when each level had which size (``to_ms`` null: to the end). Size 0 ends a level, as do a message out of step and the next snapshot."""
    return _intervals(_told(updates))


def _intervals(told: DataFrame) -> DataFrame:
    level = Window.partitionBy("market_id", "episode", "side", "price").orderBy("nonce")
    rows = told.where("applied").select("market_id", "episode", "nonce", "timestamp_ms", "closed_ms", F.explode("levels").alias("_l")).select("*", "_l.side", "_l.price", "_l.size").withColumn("_changed", F.lead("timestamp_ms").over(level))
    out = rows.withColumn("to_ms", F.least("_changed", "closed_ms")).where((F.col("size") > 0) & (F.col("to_ms").isNull() | (F.col("to_ms") > F.col("timestamp_ms"))))
    return out.select("market_id", "episode", "side", "price", "size", F.col("timestamp_ms").alias("from_ms"), "to_ms")


def _points(rows: DataFrame, step: int, end_ms: int) -> DataFrame:
    """The first and the last multiple of ``step`` in ``from_ms`` (included) to ``to_ms`` (not included; null: to ``end_ms``, included), of rows that have one."""
    first = F.ceil(F.col("from_ms") / F.lit(step)).cast("long") * step
    last = F.ceil(F.least(F.coalesce("to_ms", F.lit(end_ms + 1)), F.lit(end_ms + 1)) / F.lit(step)).cast("long") * step - step
    return rows.withColumns({"_first": first, "_last": last}).where("_last >= _first")


def _grid(rows: DataFrame, step: int, end_ms: int) -> DataFrame:
    """A row for each of those multiples, as ``grid_ms``."""
    return _points(rows, step, end_ms).withColumn("grid_ms", F.explode(F.sequence("_first", "_last", F.lit(step).cast("long"))))


def _heard(told: DataFrame) -> DataFrame:
    """Times between a market's messages: ``heard_ms``, the last applied message (null before the first)."""
    since = told.where("applied").select("market_id", F.col("timestamp_ms").alias("from_ms"), F.col("heard_to_ms").alias("to_ms"), F.col("timestamp_ms").alias("heard_ms"))
    first = told.groupBy("market_id").agg(F.min("timestamp_ms").alias("from_ms"), F.min(F.when(F.col("applied"), F.col("timestamp_ms"))).alias("to_ms"))
    return since.unionByName(first.withColumn("heard_ms", F.lit(None).cast("long")))


def book_sample_grid(updates: DataFrame, end_ms: int, sampling: Sampling = Sampling(), *, bin_points: int = BIN_POINTS) -> DataFrame:
    """Each market's book at every multiple of ``interval_ms`` from its first message on: touch, mid, spread, depth by distance, flags and the age of the last applied message.

    A book that is empty, one-sided, crossed or out of step has a row too: not usable, with depth 0.
    Time is cut in bins. A bin has a row for each level that stands at its begin and for each change
    within; they meet in a list, from which each of the bin's grid points takes its levels.
    """
    step, told = sampling.interval_ms, _told(updates)
    spine = _grid(_heard(told), step, end_ms).select("market_id", "grid_ms", "heard_ms")
    level = _points(_intervals(told), step, end_ms)
    of_bin = lambda c: F.floor(F.col(c) / F.lit(step * bin_points)).cast("long")
    placed = level.withColumn("_bin", F.explode(F.sequence(of_bin("_first"), of_bin("_last"))))
    books = placed.groupBy("market_id", "_bin").agg(F.collect_list(F.struct("_first", "_last", (F.col("side") == "bid").alias("bid"), "price", "size")).alias("_levels"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    begin, width = F.col("_bin") * (step * bin_points), step * bin_points - step
    at = F.sequence(F.greatest(F.col("_first"), F.ceil(begin / F.lit(step)).cast("long") * step), F.least(F.col("_last"), F.floor((begin + width) / F.lit(step)).cast("long") * step), F.lit(step).cast("long"))
    open_at = F.transform(at, lambda g: F.struct(g.alias("grid_ms"), F.filter("_levels", lambda x: (x["_first"] <= g) & (x["_last"] >= g)).alias("open")))
    rows = books.select("market_id", F.explode(open_at).alias("_g")).select("market_id", "_g.grid_ms", F.filter("_g.open", lambda x: x["bid"]).alias("bid"), F.filter("_g.open", lambda x: ~x["bid"]).alias("ask"))
    prices = lambda side: F.transform(side, lambda x: x["price"])
    touch = rows.withColumns({"best_bid": F.array_max(prices("bid")), "best_ask": F.array_min(prices("ask"))}).withColumn("mid", safe_mid(F.col("best_bid"), F.col("best_ask")))
    near = lambda side, b: F.aggregate(F.filter(side, lambda x: F.abs(x["price"] - F.col("mid")) <= F.col("mid") * b / 10000.0 + 1e-12), F.lit(0.0), lambda a, x: a + x["price"] * x["size"])
    names = {f"{side}_depth_{b}bps_usd": F.when(F.col("mid").isNotNull(), near(side, b)) for b in sampling.depth_bps for side in ("bid", "ask")}
    size_at = lambda side: F.array_max(F.transform(F.filter(side, lambda x: x["price"] == F.col(f"best_{side}")), lambda x: x["size"]))
    found = touch.select("market_id", "grid_ms", "best_bid", "best_ask", "mid", size_at("bid").alias("best_bid_size_base"), size_at("ask").alias("best_ask_size_base"), *(c.alias(n) for n, c in names.items()))
    out = spine.join(found, ["market_id", "grid_ms"], "left").withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})
    age = F.col("grid_ms") - F.col("heard_ms")
    two = {f"two_sided_depth_{b}bps_usd": F.least(f"bid_depth_{b}bps_usd", f"ask_depth_{b}bps_usd") for b in sampling.depth_bps}
    usd_at = {f"best_{s}_size_usd": F.col(f"best_{s}") * F.col(f"best_{s}_size_base") for s in ("bid", "ask")}
    flags = {"spread_bps": (F.col("best_ask") - F.col("best_bid")) / F.col("mid") * 10000.0, "is_usable": F.col("mid").isNotNull(), "book_update_age_ms": age, "is_inactive": F.coalesce(age > sampling.inactive_ms, F.lit(True))}
    return out.withColumns(flags | two | usd_at).drop("heard_ms")
