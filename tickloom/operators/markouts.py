"""Markouts: what a maker gained by later mids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import Markouts
from tickloom.functions.columns import markout_bps, sample_quality
from tickloom.operators.selection import exact_percentiles
from tickloom.operators.temporal import asof_backward, nearest_forward_then_backward
from tickloom.operators.trades import earliest


def dedup_markouts(markouts: DataFrame) -> DataFrame:
    return earliest(markouts, ["market_id", "trade_id", "horizon_s"])


def markout_stats(markouts: DataFrame, horizons_s: tuple[int, ...] = (1, 5, 30, 60), *, by_selection: bool = False) -> DataFrame:
    """Count, mean, median and (5 and 30 s) share above 0, by horizon in columns; ``markouts``: deduplicated. ``by_selection``: medians in two passes, for markets whose distinct markouts are too many for one task."""
    if by_selection:
        medians = exact_percentiles(markouts, ["market_id"], {f"maker_markout_{h}s_median_bps": (F.when(F.col("horizon_s") == h, F.col("maker_markout_bps")), 0.5) for h in horizons_s})
        counted = markouts.groupBy("market_id").agg(*_markout_columns(horizons_s, lambda x: None))
        return counted.join(medians, "market_id", "left")
    return markouts.groupBy("market_id").agg(*_markout_columns(horizons_s, lambda x: F.percentile(x, 0.5)))


def _markout_columns(horizons_s: tuple[int, ...], median) -> list:
    out = []
    for h in horizons_s:
        x = F.when((F.col("horizon_s") == h), F.col("maker_markout_bps"))
        out += [F.count(x).alias(f"markout_{h}s_count"), F.avg(x).alias(f"maker_markout_{h}s_mean_bps")]
        out += [] if median(x) is None else [median(x).alias(f"maker_markout_{h}s_median_bps")]
        if h in (5, 30):
            out.append(F.avg((x > 0).cast("double")).alias(f"maker_markout_{h}s_positive_ratio"))
    return out


def reference_mids(trades: DataFrame, mids: DataFrame, config: Markouts = Markouts()) -> DataFrame:
    """Trades with ``reference_mid``, the last mid at or before them and not too old."""
    return asof_backward(trades, mids, ["market_id"], ["mid"], longest_ms=config.reference_age_ms).withColumnRenamed("mid", "reference_mid")


def future_mids(trades: DataFrame, mids: DataFrame, config: Markouts = Markouts()) -> DataFrame:
    """A row for each trade and horizon with ``future_mid``; horizons without a near mid are dropped."""
    aimed = trades.withColumn("horizon_s", F.explode(F.array(*map(F.lit, config.horizons_s)))).withColumn("target_ms", F.col("timestamp_ms") + F.col("horizon_s") * 1000)
    found = nearest_forward_then_backward(aimed, mids, ["market_id"], "mid", target="target_ms", tolerance_ms=config.tolerance_ms, out="future_mid")
    return found.where(F.col("future_mid").isNotNull())


def compute_markouts(trades: DataFrame, mids: DataFrame, config: Markouts = Markouts()) -> DataFrame:
    """The markout table from trades and mids."""
    found = future_mids(reference_mids(trades, mids, config).where(F.col("reference_mid").isNotNull()), mids, config)
    value = markout_bps(F.col("price"), F.col("future_mid"), F.col("reference_mid"), F.col("is_maker_ask"))
    return found.select("timestamp_ms", "market_id", "trade_id", "horizon_s", F.col("price").alias("trade_price"), "reference_mid", "future_mid", value.alias("maker_markout_bps"), "is_maker_ask")


def recent_markout_mean(markouts: DataFrame, horizon_s: int = 5, rows: int = 200) -> DataFrame:
    """Mean of each market's last ``rows`` markouts of the horizon."""
    order = Window.partitionBy("market_id").orderBy(F.desc("timestamp_ms"), F.desc("trade_id"))
    last = markouts.where(F.col("horizon_s") == horizon_s).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows)
    return last.groupBy("market_id").agg(F.avg("maker_markout_bps").alias("recent_markout_mean_bps"), F.count(F.lit(1)).alias("recent_markouts"))


def markout_quality(stats: DataFrame) -> DataFrame:
    return stats.withColumn("markout_sample_quality", sample_quality(F.least("markout_5s_count", "markout_30s_count")))
