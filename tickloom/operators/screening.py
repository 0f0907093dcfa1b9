"""The light first pass over all markets, and joining it with the full analysis of the selected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import Sampling, Screening
from tickloom.functions.columns import effective_spread, metrics_good, observed
from tickloom.operators.books import dedup_books, market_windows, spread_persistence
from tickloom.operators.markouts import dedup_markouts
from tickloom.operators.scoring import mid_ranks
from tickloom.operators.trades import dedup_trades, trades_per_minute


def stage1(books: DataFrame, trades: DataFrame, markouts: DataFrame, start_ms: int, end_ms: int, lifecycle: DataFrame | None = None, sampling: Sampling = Sampling()) -> DataFrame:
    """A few metrics of each market. Coverage is of the whole number of expected samples, unlike the full analysis."""
    deduped = dedup_books(books)
    windows = market_windows(books, start_ms, end_ms, lifecycle)  # the same with repeated rows
    spread = F.when(observed(), effective_spread())
    light = deduped.groupBy("market_id").agg(
        F.count(F.lit(1)).alias("book_observation_count"),
        F.percentile(spread, 0.5).alias("median_spread_bps"),
        F.percentile(F.when(metrics_good(), F.col("two_sided_depth_10bps_usd")), 0.5).alias("median_two_sided_depth_10bps_usd"),
    )
    regular = dedup_trades(trades)
    marks = dedup_markouts(markouts).where("horizon_s = 5").groupBy("market_id").agg(F.percentile("maker_markout_bps", 0.5).alias("maker_markout_5s_median_bps"))
    n = regular.groupBy("market_id").agg(F.count(F.lit(1)).alias("trade_count"))
    expected = F.rint(F.greatest(F.lit(1.0), F.col("market_observation_seconds") * 1000 / sampling.interval_ms + 1)).cast("long")
    joined = windows.join(light, "market_id", "left").join(spread_persistence(deduped, sampling).select("market_id", "pct_time_spread_ge_5bps"), "market_id", "left").join(n, "market_id", "left")
    joined = joined.join(trades_per_minute(regular, windows).drop("trades_per_minute_p90"), "market_id", "left").join(marks, "market_id", "left")
    return joined.select(
        "market_id", "symbol", "first_observed_ms", "last_observed_ms", "book_observation_count", F.coalesce("trade_count", F.lit(0)).cast("long").alias("trade_count"),
        "median_spread_bps", "median_two_sided_depth_10bps_usd", "pct_time_spread_ge_5bps", "trades_per_minute_mean", "trades_per_minute_median", "maker_markout_5s_median_bps",
        F.least(F.lit(1.0), F.col("book_observation_count") / expected).alias("observation_coverage"), (F.col("market_observation_seconds") / 3600.0).alias("observation_hours"),
    )


def screening_score(first: DataFrame, config: Screening = Screening()) -> DataFrame:
    """``eligible``, and for those ``screening_score``: the mean of three mid-ranks among all markets, from 0 to 1."""
    able = (F.col("observation_coverage") >= config.coverage) & (F.col("trade_count") >= config.trades) & (F.col("median_spread_bps") >= config.spread_bps)
    ranked = mid_ranks(first, {"median_spread_bps": "_s", "trade_count": "_t", "observation_coverage": "_c"})
    return ranked.withColumn("eligible", F.coalesce(able, F.lit(False))).withColumn("screening_score", F.when(F.col("eligible"), (F.col("_s") + F.col("_t") + F.col("_c")) / 300.0)).drop("_s", "_t", "_c")


def select_top_n(screened: DataFrame, top: int = Screening.top, forced: tuple[int, ...] = ()) -> DataFrame:
    """Ids of the ``top`` eligible markets by score, lower ids first on ties, and the forced ones."""
    best = screened.where("eligible").orderBy(F.desc("screening_score"), "market_id").limit(top).select("market_id")
    if not forced:
        return best
    return best.union(screened.where(F.col("market_id").isin(*forced)).select("market_id")).distinct()


def market_set_filter(rows: DataFrame, ids: tuple[int, ...] | None) -> DataFrame:
    """All rows if no set is given, none for an empty set."""
    return rows if ids is None else rows.where(F.col("market_id").isin(*ids)) if ids else rows.where(F.lit(False))


FULL_ONLY = {"score": "double", "letter_rank": "string", "markout_5s_count": "long", "markout_30s_count": "long", "estimated_maker_fill_rate_30s_conservative": "double", "estimated_maker_fill_samples": "long", "recommended_max_order_usd": "double"}
MISSING_FULL = "Selected for Stage 2 but full analysis produced no scored row"


def screened_rows(screened: DataFrame, selected: Column) -> DataFrame:
    """Rows of markets without a full analysis: what it would have measured is null, not zero. ``selected``: it had been chosen."""
    return screened.select(
        "market_id", "symbol", F.when(selected, "selected_incomplete").otherwise("screened").alias("analysis_stage"), F.lit(False).alias("candidate"),
        "median_spread_bps", "pct_time_spread_ge_5bps", "median_two_sided_depth_10bps_usd", "trades_per_minute_median", "trades_per_minute_mean", F.col("trade_count").alias("total_trade_count"),
        F.when(selected, F.col("maker_markout_5s_median_bps")).alias("maker_markout_5s_median_bps"), (F.col("observation_coverage") * 100.0).alias("observation_coverage_pct"), "observation_hours",
        *(F.lit(None).cast(t).alias(c) for c, t in FULL_ONLY.items()), F.when(selected, F.array(F.lit(MISSING_FULL))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def merge_stages(screened: DataFrame, selected: DataFrame, full: DataFrame) -> DataFrame:
    """Markets with a full row keep it; the others are screened, or chosen and incomplete."""
    chosen = selected.select("market_id").distinct().withColumn("_chosen", F.lit(True))
    rest = screened.join(full.select("market_id"), "market_id", "left_anti").join(chosen, "market_id", "left")
    light = screened_rows(rest, F.coalesce("_chosen", F.lit(False)))
    shared = [c for c in light.columns if c != "analysis_stage"]
    return full.withColumn("analysis_stage", F.lit("full")).select("analysis_stage", *shared).unionByName(light)


def peer_enrichment(peers: DataFrame, full: DataFrame, column: str = "estimated_maker_fill_rate_30s_conservative") -> DataFrame:
    """Peers with the fill rate of those that were analysed in full."""
    return peers.drop(column).join(full.select("market_id", column), "market_id", "left")


def market_set_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids added and removed between two sets."""
    a, b = before.select("market_id").distinct(), after.select("market_id").distinct()
    return b.join(a, "market_id", "left_anti").withColumn("change", F.lit("added")).union(a.join(b, "market_id", "left_anti").withColumn("change", F.lit("removed")))


def market_lifecycle(snapshots: DataFrame) -> DataFrame:
    """From membership snapshots (``at_ms``, ``market_id``) the latest episode of each market: first seen, and the first snapshot without it."""
    members = snapshots.select("at_ms", "market_id").distinct()
    # One row for each snapshot.
    times = members.select("at_ms").distinct().select("at_ms", F.row_number().over(Window.orderBy("at_ms")).alias("_k"), F.lead("at_ms").over(Window.orderBy("at_ms")).alias("_next"))
    line = Window.partitionBy("market_id").orderBy("_k")
    placed = members.join(times, "at_ms").withColumn("_run", F.col("_k") - F.row_number().over(line))
    runs = placed.groupBy("market_id", "_run").agg(F.min("at_ms").alias("first_active_at_ms"), F.max_by("_next", "at_ms").alias("removed_at_ms"))
    return runs.groupBy("market_id").agg(F.max_by(F.struct("first_active_at_ms", "removed_at_ms"), "_run").alias("_r"), F.count(F.lit(1)).alias("episodes")).select("market_id", "_r.*", "episodes")


def live_top_n(live: DataFrame, n: int) -> DataFrame:
    """The usable markets with the highest live score."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = F.least(zero("spread_bps"), F.lit(50.0)) * 0.4 + F.least(zero("depth_10bps") / 1000.0, F.lit(30.0)) + F.least(zero("tpm"), F.lit(40.0)) * 0.5 + F.coalesce(F.greatest("markout_5s", F.lit(-10.0)), F.lit(-5.0))
    return live.where("is_usable").withColumn("live_score", score).orderBy(F.desc("live_score"), "market_id").limit(n)
