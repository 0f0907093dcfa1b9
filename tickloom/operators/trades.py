"""Trades: deduplication, totals, activity by minute, bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import regular_trade
from tickloom.operators.temporal import BIN_MS, bin_of, in_bins, last_before_bin, previous, slot_spine

MINUTE_MS = 60_000


def earliest(rows: DataFrame, keys: list[str], time: str = "timestamp_ms") -> DataFrame:
    """The earliest row of each key (no time: earliest of all); of several at one time any one, whole. Aggregated before the shuffle, so repeats aren't moved; column by column, so that columns nobody reads aren't kept and what is kept fits a hash aggregation."""
    at = F.coalesce(F.col(time), F.lit(-(2**63)))
    first = [F.min_by(c, at).alias(c) for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*first).select(rows.columns)


def dedup_trades(trades: DataFrame) -> DataFrame:
    """The earliest row of each regular trade; liquidations and the like are left out."""
    return earliest(trades.where(regular_trade()), ["market_id", "trade_id"])


def _totals() -> list:
    return [F.count(F.lit(1)).alias("total_trade_count"), F.sum("usd_amount").alias("total_quote_volume"), F.percentile("usd_amount", 0.5).alias("median_trade_size_usd")]


def trade_totals(trades: DataFrame) -> DataFrame:
    """``trades``: deduplicated."""
    return trades.groupBy("market_id").agg(*_totals())


def _with_gaps(trades: DataFrame) -> DataFrame:
    """``gap``: time since the trade before, null where that isn't known."""
    rows = previous(trades, ["market_id"], ("timestamp_ms", "trade_id"), "timestamp_ms", "_before")
    gap = F.col("timestamp_ms") - F.col("_before")
    return rows.withColumn("gap", F.when(gap >= 0, gap))


def intertrade_gap(trades: DataFrame) -> DataFrame:
    """Median time between trades that follow one another."""
    rows = _with_gaps(trades.select("market_id", "timestamp_ms", "trade_id"))
    return rows.where(F.col("gap").isNotNull()).groupBy("market_id").agg(F.percentile("gap", 0.5).alias("median_intertrade_ms"))


def minute_slots(trades: DataFrame, windows: DataFrame) -> DataFrame:
    """Trades in each wall-clock minute of a market's window, 0 where there were none; both end minutes count."""
    minute = lambda c: F.floor(F.col(c) / F.lit(MINUTE_MS)).cast("long")
    bounds = windows.select("market_id", minute("effective_start_ms").alias("_first"), minute("effective_end_ms").alias("_last"))
    spine = slot_spine(bounds, "_first", "_last", "minute_idx").select("market_id", "minute_idx")
    return spine.join(_by_minute(trades), ["market_id", "minute_idx"], "left").select("market_id", "minute_idx", F.coalesce("_n", F.lit(0)).cast("long").alias("trade_count"))


def _by_minute(trades: DataFrame) -> DataFrame:
    return trades.groupBy("market_id", F.floor(F.col("timestamp_ms") / F.lit(MINUTE_MS)).cast("long").alias("minute_idx")).agg(F.count(F.lit(1)).alias("_n"))


def trades_per_minute(trades: DataFrame, windows: DataFrame) -> DataFrame:
    """Mean over the window's minutes, median and p90 over its minute slots."""
    slots = minute_slots(trades, windows).groupBy("market_id").agg(F.percentile("trade_count", 0.5).alias("trades_per_minute_median"), F.percentile("trade_count", 0.9).alias("trades_per_minute_p90"))
    n = _by_minute(trades).groupBy("market_id").agg(F.sum("_n").alias("_n"))
    minutes = F.greatest(F.col("market_observation_seconds") / 60.0, F.lit(1.0 / 60.0))
    out = windows.select("market_id", "market_observation_seconds").join(slots, "market_id").join(n, "market_id", "left")
    return out.select("market_id", (F.coalesce("_n", F.lit(0)) / minutes).alias("trades_per_minute_mean"), "trades_per_minute_median", "trades_per_minute_p90")


def trade_metrics(trades: DataFrame, windows: DataFrame) -> DataFrame:
    """All trade metrics of each market with a window or trades; without a window, no activity by minute is known and it is 0."""
    rows = _with_gaps(trades.select("market_id", "timestamp_ms", "trade_id", "usd_amount"))
    totals = rows.groupBy("market_id").agg(*_totals(), F.percentile("gap", 0.5).alias("median_intertrade_ms"))
    joined = totals.join(trades_per_minute(trades, windows), "market_id", "full_outer")
    zero = ["total_trade_count", "total_quote_volume", "trades_per_minute_mean", "trades_per_minute_median", "trades_per_minute_p90"]
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast(joined.schema[c].dataType)) for c in zero})


def minute_bars(trades: DataFrame) -> DataFrame:
    """Bars of one minute: counts, volumes, sides, sizes, gaps, and other trade types apart."""
    regular = F.col("_regular")
    on = lambda condition, c: F.when(condition, F.col(c))
    usd, buy = F.when(regular, F.col("usd_amount")), regular & F.col("is_maker_ask")
    sell = regular & ~F.col("is_maker_ask")
    rows = earliest(trades.select("market_id", "trade_id", "timestamp_ms", "price", "usd_amount", "is_maker_ask", regular_trade().alias("_regular")), ["market_id", "trade_id"])
    # The regular trade before: in the bin, else the last of an earlier one.
    before = last_before_bin(rows, ["market_id"], "timestamp_ms", F.when(regular, F.col("timestamp_ms")), "_earlier")
    line = Window.partitionBy("market_id", "_bin").orderBy("timestamp_ms", "trade_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_bin", bin_of(F.col("timestamp_ms"))).join(before, ["market_id", "_bin"], "left")
    seen = seen.withColumn("gap", F.when(regular, F.col("timestamp_ms") - F.coalesce(F.last(F.when(regular, F.col("timestamp_ms")), ignorenulls=True).over(line), "_earlier")))
    return seen.groupBy("market_id", (F.floor(F.col("timestamp_ms") / F.lit(MINUTE_MS)).cast("long") * MINUTE_MS).alias("minute_ms")).agg(
        F.count_if(regular).alias("trade_count"),
        F.coalesce(F.sum(usd), F.lit(0.0)).alias("trade_quote_volume_usd"),
        F.coalesce(F.sum(usd / F.col("price")), F.lit(0.0)).alias("trade_base_volume"),
        F.count_if(buy).alias("buy_taker_count"),
        F.count_if(sell).alias("sell_taker_count"),
        F.coalesce(F.sum(on(buy, "usd_amount")), F.lit(0.0)).alias("buy_taker_volume_usd"),
        F.coalesce(F.sum(on(sell, "usd_amount")), F.lit(0.0)).alias("sell_taker_volume_usd"),
        F.percentile(usd, 0.5).alias("median_trade_size_usd"),
        F.avg(usd).alias("mean_trade_size_usd"),
        F.percentile("gap", 0.5).alias("median_intertrade_ms"),
        F.count_if(~regular).alias("liquidation_count"),
        F.coalesce(F.sum(on(~regular, "usd_amount")), F.lit(0.0)).alias("liquidation_volume_usd"),
    )


def rolling_tpm(trades: DataFrame, window_ms: int = MINUTE_MS) -> DataFrame:
    """At each trade, trades of the minute before it (its own included), per minute."""
    line = Window.partitionBy("market_id", "_bin").orderBy("timestamp_ms").rangeBetween(-window_ms + 1, 0)
    binned = in_bins(trades.select("market_id", "trade_id", "timestamp_ms"), "timestamp_ms", on_ms=window_ms, bin_ms=max(BIN_MS, window_ms))
    return binned.withColumn("tpm", F.count(F.lit(1)).over(line) * (60_000.0 / window_ms)).where("_own").drop("_bin", "_own")
