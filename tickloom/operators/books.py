"""Book samples: deduplication, coverage, spreads, depth, persistence and volatility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import Sampling
from tickloom.functions.columns import effective_spread, metrics_good, observed
from tickloom.operators.selection import exact_percentiles
from tickloom.operators.temporal import BIN_MS, first_within, in_bins, islands, last_before_bin, previous

PERCENTILES = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def dedup_books(books: DataFrame) -> DataFrame:
    """One row for each market and time; any of equal ones."""
    return books.dropDuplicates(["market_id", "timestamp_ms"])


def observed_books(books: DataFrame) -> DataFrame:
    """Deduplicated observed rows with ``effective_spread_bps``."""
    return books.where(observed()).withColumn("effective_spread_bps", effective_spread())


def market_windows(books: DataFrame, start_ms: int, end_ms: int, lifecycle: DataFrame | None = None) -> DataFrame:
    """First and last sample, effective window and its seconds, of each market.

    A market of the lifecycle table is expected from its first activity to its removal; another one
    from its first sample to the end.
    """
    seen = books.groupBy("market_id").agg(F.max("symbol").alias("symbol"), F.min("timestamp_ms").alias("first_observed_ms"), F.max("timestamp_ms").alias("last_observed_ms"))
    if lifecycle is None:
        known = seen.withColumns({"_first": F.col("first_observed_ms"), "_removed": F.lit(None).cast("long")})
    else:
        # A row for each market: a dimension.
        life = lifecycle.select(F.col("market_id").cast("int").alias("market_id"), "first_active_at_ms", "removed_at_ms", F.lit(True).alias("_known"))
        known = seen.join(life, "market_id", "left").withColumns({"_first": F.when(F.col("_known"), F.col("first_active_at_ms")).otherwise(F.col("first_observed_ms")), "_removed": F.col("removed_at_ms")})
    begins = F.greatest(F.lit(start_ms), F.col("_first"))
    ends = F.greatest(begins, F.least(F.lit(end_ms), F.coalesce("_removed", F.lit(end_ms))))
    out = known.select("market_id", "symbol", "first_observed_ms", "last_observed_ms", begins.alias("effective_start_ms"), ends.alias("effective_end_ms"))
    return out.withColumn("market_observation_seconds", (F.col("effective_end_ms") - F.col("effective_start_ms")).cast("double") / 1000.0)


def coverage_counts(books: DataFrame) -> DataFrame:
    return books.groupBy("market_id").agg(
        F.count(F.lit(1)).alias("observed_samples"),
        F.count_if(observed()).alias("usable_samples"),
        F.count_if(observed() & effective_spread().isNotNull()).alias("spread_samples"),
    )


def spread_distribution(books: DataFrame, *, by_selection: bool = False) -> DataFrame:
    """Mean and exact percentiles of the effective spread over observed rows. ``by_selection``: for markets whose distinct spreads are too many for one task; the same values in two passes."""
    spread = F.col("effective_spread_bps")
    if by_selection:
        known = observed_books(books).where(spread.isNotNull())
        ranks = exact_percentiles(known, ["market_id"], {f"{name}_spread_bps": (spread, p) for name, p in PERCENTILES.items()})
        return known.groupBy("market_id").agg(F.avg(spread).alias("mean_spread_bps")).join(ranks, "market_id")
    levels = observed_books(books).where(spread.isNotNull()).groupBy("market_id").agg(F.avg(spread).alias("mean_spread_bps"), F.percentile(spread, F.array(*map(F.lit, PERCENTILES.values()))).alias("_p"))
    return levels.select("market_id", "mean_spread_bps", *(F.col("_p")[k].alias(f"{name}_spread_bps") for k, name in enumerate(PERCENTILES)))


def _depth(condition) -> list:
    at = lambda c: F.percentile(F.when(condition, c), 0.5)
    bbo = F.least("best_bid_size_usd", "best_ask_size_usd")
    return [at(bbo).alias("median_bbo_depth_usd"), *(at(F.col(f"two_sided_depth_{b}bps_usd")).alias(f"median_two_sided_depth_{b}bps_usd") for b in (5, 10, 25))]


def depth_medians(books: DataFrame, *, by_selection: bool = False) -> DataFrame:
    """Median depths of rows fit for metrics. ``by_selection``: as for ``spread_distribution``."""
    if by_selection:
        depths = {"median_bbo_depth_usd": F.least("best_bid_size_usd", "best_ask_size_usd")} | {f"median_two_sided_depth_{b}bps_usd": F.col(f"two_sided_depth_{b}bps_usd") for b in (5, 10, 25)}
        return exact_percentiles(books.where(metrics_good()), ["market_id"], {n: (c, 0.5) for n, c in depths.items()})
    return books.where(metrics_good()).groupBy("market_id").agg(*_depth(F.lit(True)))


LATEST = {"current_funding_rate": "current_funding_rate", "funding_rate": "funding_rate", "open_interest": "open_interest", "daily_quote_token_volume": "daily_quote_volume_usd"}


def _latest(condition) -> list:
    at = lambda c: F.max_by(c, F.when(condition & F.col(c).isNotNull(), F.col("timestamp_ms")))
    return [at(c).alias(name) for c, name in LATEST.items()]


def latest_values(books: DataFrame) -> DataFrame:
    """The last value of each kind that isn't null."""
    return books.where(metrics_good()).groupBy("market_id").agg(*_latest(F.lit(True)))


def _update_age() -> list:
    age = F.col("book_update_age_ms")
    return [
        (F.max_by(age, F.when(age.isNotNull(), F.col("timestamp_ms"))) / 1000.0).alias("latest_book_update_age_seconds"),
        F.percentile(age / 1000.0, 0.95).alias("p95_book_update_age_seconds"),
    ]


def book_update_age(books: DataFrame) -> DataFrame:
    return books.where(F.col("book_update_age_ms").isNotNull()).groupBy("market_id").agg(*_update_age())


def coverage_pct(counted: DataFrame, sampling: Sampling = Sampling()) -> DataFrame:
    """Expected samples and the four coverages, from counts and ``market_observation_seconds``."""
    expected = F.greatest(F.lit(1.0), F.col("market_observation_seconds") * 1000 / sampling.interval_ms + 1)
    n = F.coalesce("observed_samples", F.lit(0))
    share = lambda c: F.when(n > 0, F.least(F.lit(100.0), 100.0 * F.coalesce(c, F.lit(0)) / n)).otherwise(0.0)
    seen = F.least(F.lit(100.0), 100.0 * n / expected)
    return counted.withColumns({"expected_samples": F.rint(expected).cast("long"), "observation_coverage_pct": seen, "usable_quote_coverage_pct": share("usable_samples"), "spread_coverage_pct": share("spread_samples"), "data_coverage_pct": seen})


def _book_aggregates(spread) -> list:
    """Conditions inside the aggregates take the place of joins of filtered copies."""
    good = metrics_good()
    return [
        F.count(F.lit(1)).alias("observed_samples"),
        F.count_if(observed()).alias("usable_samples"),
        F.count(spread).alias("spread_samples"),
        F.avg(spread).alias("mean_spread_bps"),
        F.percentile(spread, F.array(*map(F.lit, PERCENTILES.values()))).alias("_p"),
        *_depth(good),
        *_latest(good),
        *_update_age(),
    ]


def _with_windows(counted: DataFrame, windows: DataFrame, sampling: Sampling) -> DataFrame:
    named = counted.select("*", *(F.col("_p")[k].alias(f"{name}_spread_bps") for k, name in enumerate(PERCENTILES))).drop("_p")
    return coverage_pct(windows.join(named, "market_id", "left"), sampling)


def book_metrics(books: DataFrame, windows: DataFrame, sampling: Sampling = Sampling()) -> DataFrame:
    """Coverage, spread distribution, depth, latest values and update age of each market in one aggregation."""
    return _with_windows(books.groupBy("market_id").agg(*_book_aggregates(F.when(observed(), effective_spread()))), windows, sampling)


def _held(next_ms, sampling: Sampling):
    """Seconds for which a row's value held: to the next one, or one interval where there is none within the longest gap."""
    gap = (next_ms - F.col("timestamp_ms")) / 1000.0
    return F.coalesce(gap, F.lit(sampling.interval_ms / 1000.0))


def _spread_steps(books: DataFrame, sampling: Sampling) -> DataFrame:
    """Observed spreads and for how long each held."""
    longest = sampling.longest_gap_s * 1000
    rows = observed_books(books).where(F.col("effective_spread_bps").isNotNull()).select("market_id", "timestamp_ms", F.col("effective_spread_bps").alias("spread"))
    after = first_within(F.col("timestamp_ms"), ["market_id", "_bin"], "timestamp_ms", 1, longest)
    return in_bins(rows, "timestamp_ms", back_ms=longest).withColumn("dt", _held(after, sampling)).where("_own").drop("_bin", "_own")


def _shares(sampling: Sampling, spread, dt) -> list:
    share = lambda t: F.sum(F.when(spread >= t, dt).otherwise(0.0)) / F.sum(dt)
    return [share(t).alias(f"pct_time_spread_ge_{t}bps") for t in sampling.spread_thresholds]


def spread_persistence(books: DataFrame, sampling: Sampling = Sampling()) -> DataFrame:
    """Share of time for which the spread was at least so wide."""
    return _spread_steps(books, sampling).groupBy("market_id").agg(*_shares(sampling, F.col("spread"), F.col("dt")))


def spread_episodes(books: DataFrame, sampling: Sampling = Sampling()) -> DataFrame:
    """Unbroken runs of samples at or above each threshold: how many, and their median, p90 and longest seconds."""
    steps = _spread_steps(books, sampling).withColumn("threshold_bps", F.explode(F.array(*map(F.lit, sampling.spread_thresholds))))
    keys = ["market_id", "threshold_bps"]
    runs = islands(steps, keys, "timestamp_ms", F.col("spread") >= F.col("threshold_bps")).groupBy(*keys, "island").agg(F.sum("dt").alias("seconds"))
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"), F.percentile("seconds", 0.5).alias("median_duration_seconds"), F.percentile("seconds", 0.9).alias("p90_duration_seconds"), F.max("seconds").alias("max_duration_seconds"))


def thin_mids(books: DataFrame) -> DataFrame:
    """Market, time and positive mid of observed rows."""
    return books.where(observed() & (F.col("mid") > 0)).select("market_id", "timestamp_ms", "mid")


def _moves(label: str, move) -> list:
    p = F.percentile(move, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    return [p[k].alias(f"{name}_abs_mid_move_{label}_bps") for k, name in enumerate(("p50", "p90", "p95"))]


def volatility_consecutive(mids: DataFrame) -> DataFrame:
    """Absolute log moves between neighbouring mids."""
    rows = previous(mids, ["market_id"], ("timestamp_ms",), "mid", "_before")
    moved = rows.withColumn("move", _move(F.col("mid"), F.col("_before"))).where(F.col("move").isNotNull())
    return moved.groupBy("market_id").agg(F.count(F.lit(1)).alias("mid_move_1s_count"), *_moves("1s", "move"))


def _move(mid, before):
    return F.abs(F.log(mid / before)) * 10000.0


def _horizon(h: int, value, sampling: Sampling):
    return first_within(value, ["market_id", "_bin"], "timestamp_ms", h * 1000, h * 1000 + sampling.move_tolerance_ms)


def forward_horizon_pairs(mids: DataFrame, horizons_s: tuple[int, ...] = (5, 30, 60), sampling: Sampling = Sampling()) -> DataFrame:
    """Mids with ``mid_<h>s``: the first mid at the horizon or within the tolerance after it. A range frame, no join."""
    reach = max(horizons_s) * 1000 + sampling.move_tolerance_ms
    at = {f"mid_{h}s": _horizon(h, F.col("mid"), sampling) for h in horizons_s}
    return in_bins(mids, "timestamp_ms", back_ms=reach, bin_ms=max(BIN_MS, reach)).withColumns(at).where("_own").drop("_bin", "_own")


def _horizon_moves(horizons_s: tuple[int, ...], mid) -> list:
    move = lambda h: _move(F.col(f"mid_{h}s"), mid)
    return [c for h in horizons_s for c in (F.count(move(h)).alias(f"mid_move_{h}s_count"), *_moves(f"{h}s", move(h)))]


def volatility_horizons(mids: DataFrame, horizons_s: tuple[int, ...] = (5, 30, 60), sampling: Sampling = Sampling(), *, by_selection: bool = False) -> DataFrame:
    """Absolute log moves to each horizon. ``by_selection``: as for ``spread_distribution``."""
    if by_selection:
        pairs, move = forward_horizon_pairs(mids, horizons_s, sampling), lambda h: _move(F.col(f"mid_{h}s"), F.col("mid"))
        ranks = exact_percentiles(pairs, ["market_id"], {f"{name}_abs_mid_move_{h}s_bps": (move(h), p) for h in horizons_s for name, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95))})
        return pairs.groupBy("market_id").agg(*(F.count(move(h)).alias(f"mid_move_{h}s_count") for h in horizons_s)).join(ranks, "market_id", "left")
    return forward_horizon_pairs(mids, horizons_s, sampling).groupBy("market_id").agg(*_horizon_moves(horizons_s, F.col("mid")))


def market_metrics(books: DataFrame, windows: DataFrame, horizons_s: tuple[int, ...] = (5, 30, 60), sampling: Sampling = Sampling()) -> DataFrame:
    """``book_metrics``, ``spread_persistence`` and both volatilities of each market, in one pass over ``books`` (deduplicated) and one aggregation."""
    longest = sampling.longest_gap_s * 1000
    reach = max(longest, max(horizons_s) * 1000 + sampling.move_tolerance_ms)
    keys, bin_ms = ["market_id"], max(BIN_MS, reach)
    rows = books.withColumns({"_spread": F.when(observed(), effective_spread()), "_mid": F.when(observed() & (F.col("mid") > 0), F.col("mid"))})
    binned = in_bins(rows, "timestamp_ms", back_ms=reach, bin_ms=bin_ms).join(last_before_bin(rows, keys, "timestamp_ms", F.col("_mid"), "_earlier", bin_ms), [*keys, "_bin"], "left")
    before = Window.partitionBy(*keys, "_bin").orderBy("timestamp_ms").rowsBetween(Window.unboundedPreceding, -1)
    at = {f"mid_{h}s": _horizon(h, F.col("_mid"), sampling) for h in horizons_s}
    after = first_within(F.when(F.col("_spread").isNotNull(), F.col("timestamp_ms")), [*keys, "_bin"], "timestamp_ms", 1, longest)
    steps = binned.withColumns(at | {"_after": after, "_before": F.coalesce(F.last("_mid", ignorenulls=True).over(before), "_earlier")}).where("_own")
    dt = F.when(F.col("_spread").isNotNull(), _held(F.col("_after"), sampling))
    consecutive = _move(F.col("_mid"), F.col("_before"))
    counted = steps.groupBy("market_id").agg(*_book_aggregates(F.col("_spread")), *_shares(sampling, F.col("_spread"), dt), F.count(consecutive).alias("mid_move_1s_count"), *_moves("1s", consecutive), *_horizon_moves(horizons_s, F.col("_mid")))
    return _with_windows(counted, windows, sampling)
