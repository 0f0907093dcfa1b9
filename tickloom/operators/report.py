"""Tables for publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import SIZE_LADDER
from tickloom.operators.scoring import COMPONENTS

METRICS = {
    "median_spread_bps": "spread",
    "pct_time_spread_ge_5bps": "persistence",
    "trades_per_minute_median": "activity",
    "median_two_sided_depth_10bps_usd": "depth",
    "maker_markout_5s_median_bps": "markout_5s",
    "maker_markout_30s_median_bps": "markout_30s",
    "estimated_maker_fill_rate_30s_conservative": "fill",
}


def market_row_projection(scored: DataFrame) -> DataFrame:
    """The published row: rounded, six pros and cons at most, and a warning for markouts without trades."""
    odd = F.when(F.col("maker_markout_5s_median_bps").isNotNull() & (F.coalesce("total_trade_count", F.lit(0)) == 0), "markout exists but trade count is zero; possible trade aggregation inconsistency")
    return scored.select("market_id", "symbol", "rank", F.round("score", 2).alias("score"), F.round("effective_score", 2).alias("effective_score"), F.round("confidence", 4).alias("confidence"), "confidence_label", "letter_rank", "candidate", F.slice("pros", 1, 6).alias("pros"), F.slice("cons", 1, 6).alias("cons"), F.array_compact(F.concat("warnings", F.array(odd))).alias("warnings"))


def market_card(scored: DataFrame) -> DataFrame:
    """What a list of candidates shows of a market: score and grade, three figures, and how far the score is to be trusted and why."""
    rounded = {"score": 2, "effective_score": 2, "confidence": 4}
    return scored.select("market_id", "symbol", "letter_rank", *(F.round(c, n).alias(c) for c, n in rounded.items()), "confidence_label", "confidence_reasons", "confidence_breakdown", "median_spread_bps", "maker_markout_5s_median_bps", "maker_markout_30s_median_bps")


def market_table_query(scored: DataFrame, *, candidates_only: bool = False, symbol: str = "", sort: str = "effective") -> DataFrame:
    """Filtered and sorted as a market table is shown; nulls sort as each key's default."""
    low = float("-inf")
    keys = {
        "effective": F.coalesce("effective_score", "score", F.lit(low)),
        "score": F.coalesce("score", F.lit(low)),
        "spread": F.coalesce("median_spread_bps", F.lit(low)),
        "fill30": F.coalesce("estimated_maker_fill_rate_30s_conservative", F.lit(-1.0)),
        "tpm": F.coalesce("trades_per_minute_median", F.lit(low)),
        "tpm_avg": F.coalesce("trades_per_minute_mean", F.lit(low)),
        "m5": F.coalesce("maker_markout_5s_median_bps", F.lit(low)),
        "edge30": F.coalesce("estimated_maker_edge_30s_bps", F.lit(-999.0)),
    }
    rows = scored.where("candidate") if candidates_only else scored
    rows = rows.where(F.lower("symbol").contains(symbol.strip().lower())) if symbol.strip() else rows
    return rows.orderBy(keys[sort].desc(), "market_id")


def metric_leaders(scored: DataFrame, top: int = 15) -> DataFrame:
    """The first markets by each metric, nulls last."""
    tall = scored.select("market_id", "symbol", F.stack(F.lit(len(METRICS)), *(x for c, name in METRICS.items() for x in (F.lit(name), F.col(c).cast("double")))).alias("metric", "value"))
    line = Window.partitionBy("metric").orderBy(F.desc_nulls_last("value"), "market_id")
    return tall.withColumn("place", F.row_number().over(line)).where(F.col("place") <= top)


def avoid_list(scored: DataFrame, top: int = 10) -> DataFrame:
    """Wide spreads on markets that are otherwise weak."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    weak = F.col("letter_rank").isin("C", "D") | (zero("maker_markout_5s_median_bps") < 0) | (zero("trades_per_minute_median") < 0.5) | (zero("median_two_sided_depth_10bps_usd") < 300)
    return scored.where((zero("median_spread_bps") >= 5) & weak).orderBy(F.desc("median_spread_bps"), "rank").limit(top)


def executive_answers(scored: DataFrame) -> DataFrame:
    """One row: whether there are suitable markets, whether to go on, and which symbols fit each size."""
    strong = F.count_if(F.col("candidate") & F.col("letter_rank").isin("A", "B"))
    n = F.count_if("candidate")
    best = F.max(F.when(F.col("rank") == 1, F.col("score")))
    exists = (strong > 0) | ((n >= 3) & F.coalesce(best >= 55, F.lit(False)))
    first = lambda cond, k: F.slice(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("rank", "symbol")))), lambda x: x["symbol"]), 1, k)
    # Lists are as long as there are markets.
    sized = []
    for size in (100, 500, 1000):
        fits = first(F.col("candidate") & F.col("size_fit")[f"fit_{size}"], 5)
        sized.append(F.when(F.size(fits) > 0, fits).otherwise(first(F.col("rank") <= 3, 3)).alias(f"symbols_{size}"))
    return scored.agg(n.alias("candidates"), exists.alias("exists"), (exists & (F.count_if(F.col("candidate") & (F.col("letter_rank") == "A")) > 0)).alias("proceed"), *sized)


DETAIL = {"spread": ("mean_spread_bps", "median_spread_bps", "p95_spread_bps"), "depth": ("median_bbo_depth_usd", "median_two_sided_depth_5bps_usd", "median_two_sided_depth_10bps_usd", "median_two_sided_depth_25bps_usd"), "activity": ("total_trade_count", "total_quote_volume", "trades_per_minute_mean", "trades_per_minute_median"), "markouts": ("maker_markout_5s_median_bps", "maker_markout_30s_median_bps", "markout_5s_count", "markout_30s_count"), "fill": ("estimated_maker_fill_samples", "estimated_maker_fill_rate_30s_conservative", "estimated_maker_edge_30s_bps"), "coverage": ("observation_hours", "observation_coverage_pct", "usable_quote_coverage_pct", "spread_coverage_pct")}


def market_detail(scored: DataFrame) -> DataFrame:
    """One document for each market: its published row, all its texts and its metrics by subject."""
    row = [c for c in market_row_projection(scored).columns if c not in ("market_id", "symbol", "pros", "cons", "warnings")]
    ranks = F.struct(*(F.round(f"rank_{c}", 2).alias(c) for c in COMPONENTS)).alias("rank_components")
    subjects = [F.struct(*cols).alias(name) for name, cols in DETAIL.items()]
    return scored.select("market_id", "symbol", *(F.round(c, 4).alias(c) if c in ("score", "effective_score", "confidence") else F.col(c) for c in row), "pros", "cons", "warnings", "penalties", "confidence_reasons", "recommended_max_order_usd", "size_fit", ranks, *subjects)


def ranking_export(scored: DataFrame) -> DataFrame:
    """Flat rows, each the whole record of a market: lists joined, sizes and components as columns."""
    join = lambda c: F.concat_ws(" | ", c).alias(c)
    lists, maps = ("pros", "cons", "warnings", "penalties", "confidence_reasons"), ("size_fit", "confidence_breakdown", "estimated_maker_fill_by_size")
    plain = [c for c in scored.columns if c not in (*lists, *maps) and not (c.startswith("rank_"))]
    return scored.select(*plain, *map(join, lists), *(F.col("size_fit")[f"fit_{int(n)}"].alias(f"fit_{int(n)}") for n in SIZE_LADDER), *(F.col(f"rank_{c}").alias(f"pct_{c}") for c in COMPONENTS))


def overview_rollup(scored: DataFrame, least_coverage: float = 90.0) -> DataFrame:
    """One row about all markets."""
    cover = F.coalesce("observation_coverage_pct", "data_coverage_pct")
    odd = F.count_if(F.col("maker_markout_5s_median_bps").isNotNull() & (F.coalesce("total_trade_count", F.lit(0)) == 0))
    rows = scored.agg(F.count(F.lit(1)).alias("markets"), F.count_if("candidate").alias("candidates"), F.avg(cover).alias("mean_coverage_pct"), F.min_by("symbol", F.when(F.col("candidate"), F.col("rank"))).alias("top_candidate"), odd.alias("inconsistent_markets"))
    warned = F.array_compact(F.array(F.when(F.col("mean_coverage_pct") < 80.0, "low data coverage"), F.when(F.col("mean_coverage_pct") < least_coverage, "candidate ranking is provisional"), F.when(F.col("inconsistent_markets") > 0, "markout without trades")))
    return rows.withColumns({"warnings": warned, "status": F.when(F.col("markets") == 0, "DEGRADED").otherwise("OK")})


def event_timeline(trades: DataFrame, books: DataFrame) -> DataFrame:
    """Trades (priority 0) and observed books (1) of each market, in order within their partition."""
    t = trades.where(F.col("price").isNotNull() & F.col("is_maker_ask").isNotNull() & F.col("usd_amount").isNotNull()).select("market_id", "timestamp_ms", F.lit(0).alias("priority"), "trade_id", "price", "usd_amount")
    b = books.select("market_id", "timestamp_ms", F.lit(1).alias("priority"), "best_bid", "best_ask", "mid")
    return t.unionByName(b, allowMissingColumns=True).repartition("market_id").sortWithinPartitions("market_id", "timestamp_ms", "priority", "trade_id")
