"""Estimated maker fills: how much aggressive volume would have reached the touch after a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.config import FillPolicy
from tickloom.functions.columns import fee_rate_to_bps, observed, sample_quality, snapshot_bucket
from tickloom.operators.temporal import interval_join

TOUCH = ["best_bid", "best_ask", "best_bid_size_usd", "best_ask_size_usd"]
MODES = ("optimistic", "conservative")


def downsample_snapshots(books: DataFrame, policy: FillPolicy = FillPolicy()) -> DataFrame:
    """The first observed row with a whole touch in each bucket; ``books`` may hold repeated rows, which an aggregation before the shuffle takes away."""
    whole = observed()
    for c in TOUCH:
        whole = whole & F.col(c).isNotNull()
    rows = books.where(whole).groupBy("market_id", snapshot_bucket(F.col("timestamp_ms"), policy.bucket_ms).alias("_bucket"))
    first = [F.min_by(c, "timestamp_ms").alias(c) for c in ("symbol", *TOUCH)]  # column by column: those that nobody reads aren't kept
    return rows.agg(F.min("timestamp_ms").alias("timestamp_ms"), *first).select("market_id", "symbol", "timestamp_ms", *TOUCH)


def touch_flow(snapshots: DataFrame, trades: DataFrame, policy: FillPolicy = FillPolicy()) -> DataFrame:
    """Pairs of a snapshot and a trade within the longest horizon after it that would have met a maker at the touch: ``side`` says which one."""
    fields = trades.where(F.col("price").isNotNull() & F.col("usd_amount").isNotNull()).select("market_id", "timestamp_ms", "price", "usd_amount", "is_maker_ask")
    pairs = interval_join(snapshots, fields, ["market_id"], max(policy.horizons_s) * 1000)
    bid = ~F.col("p_is_maker_ask") & (F.col("p_price") <= F.col("best_bid"))
    ask = F.col("p_is_maker_ask") & (F.col("p_price") >= F.col("best_ask"))
    return pairs.withColumn("side", F.when(bid, "bid").when(ask, "ask")).where(F.col("side").isNotNull())


def touch_flow_eligible(snapshots: DataFrame, trades: DataFrame, policy: FillPolicy = FillPolicy()) -> DataFrame:
    """Each snapshot with the volume that reached either side within each horizon, 0 where none did."""
    within = lambda side, h: F.sum(F.when((F.col("side") == side) & (F.col("p_timestamp_ms") <= F.col("timestamp_ms") + h * 1000), F.col("p_usd_amount")).otherwise(0.0))
    names = [(side, h, f"{side}_eligible_usd_{h}s") for side in ("bid", "ask") for h in policy.horizons_s]
    flow = touch_flow(snapshots, trades, policy).groupBy("market_id", "timestamp_ms").agg(*(within(s, h).alias(n) for s, h, n in names))
    return snapshots.join(flow, ["market_id", "timestamp_ms"], "left").withColumns({n: F.coalesce(n, F.lit(0.0)) for _, _, n in names})


def _rate(side: str, mode: str, horizon: int, size: int) -> Column:
    need = F.lit(float(size)) if mode == "optimistic" else F.col(f"best_{side}_size_usd") + float(size)
    return F.avg(F.when(F.col(f"{side}_eligible_usd_{horizon}s") >= need, 1.0).otherwise(0.0))


def fill_rates(eligible: DataFrame, policy: FillPolicy = FillPolicy()) -> DataFrame:
    """Samples, and for each size, horizon and mode the rates of bid, ask and market (the lower)."""
    out = [F.count(F.lit(1)).alias("estimated_maker_fill_samples")]
    for size in policy.sizes_usd:
        for h in policy.horizons_s:
            for mode in MODES:
                bid, ask = _rate("bid", mode, h, size), _rate("ask", mode, h, size)
                out += [bid.alias(f"bid_{mode}_{h}s_{size}"), ask.alias(f"ask_{mode}_{h}s_{size}"), F.least(bid, ask).alias(f"mkt_{mode}_{h}s_{size}")]
    return eligible.groupBy("market_id").agg(*out)


def fill_stats(rates: DataFrame, policy: FillPolicy = FillPolicy()) -> DataFrame:
    """Rates are null below the least samples; the default size has columns, all sizes a map of size and horizon."""
    samples = F.col("estimated_maker_fill_samples")
    known = lambda c: F.when(samples >= policy.meaningful, F.col(c))
    named = [known(f"mkt_{mode}_{h}s_{policy.default_usd}").alias(f"estimated_maker_fill_rate_{h}s_{mode}") for h in policy.horizons_s for mode in MODES]

    def rate(h: int, size: int) -> Column:
        sides = [(mode if side == "mkt" else f"{side}_{mode}", f"{side}_{mode}_{h}s_{size}") for side in ("mkt", "bid", "ask") for mode in MODES]
        return F.struct(*(known(c).alias(name) for name, c in sides))

    by_horizon = lambda size: F.create_map(*(x for h in policy.horizons_s for x in (F.lit(f"{h}s"), rate(h, size))))
    by_size = F.create_map(*(x for size in policy.sizes_usd for x in (F.lit(str(size)), by_horizon(size))))
    return rates.select("market_id", "estimated_maker_fill_samples", sample_quality(samples, policy).alias("estimated_maker_fill_sample_quality"), *named, by_size.alias("estimated_maker_fill_by_size"))


def maker_edge(rows: DataFrame, fee_rate: Column | None = None) -> DataFrame:
    """Fill rate times the median markout less the fee; null where either is."""
    fee = fee_rate_to_bps(fee_rate) if fee_rate is not None else F.lit(0.0)
    edge = lambda h: F.col(f"estimated_maker_fill_rate_{h}s_conservative") * (F.col(f"maker_markout_{h}s_median_bps") - fee)
    return rows.withColumns({"estimated_maker_edge_5s_bps": edge(5), "estimated_maker_edge_30s_bps": edge(30), "estimated_maker_edge_fee_included": F.lit(False) if fee_rate is None else fee_rate.isNotNull()})


def field_availability(trades: DataFrame) -> DataFrame:
    """One row: whether price and side are known for any trade. A table without rows is measured, as zero."""
    n = F.count(F.lit(1))
    return trades.agg(n.alias("rows"), F.count("price").alias("with_price"), F.count("is_maker_ask").alias("with_side"), ((n == 0) | ((F.count("price") > 0) & (F.count("is_maker_ask") > 0))).alias("available"))
