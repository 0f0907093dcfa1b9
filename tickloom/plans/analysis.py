"""The whole analysis: three event tables to one wide row for each market, and the ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.config import FillPolicy, Sampling
from tickloom.operators import books, fills, markouts, scoring, trades


@dataclass
class Inputs:
    """Inputs that the metric families share, all but ``book_rows`` deduplicated."""

    book_rows: DataFrame
    books: DataFrame
    trades: DataFrame
    markouts: DataFrame
    windows: DataFrame

    @classmethod
    def of(cls, book_rows: DataFrame, trade_rows: DataFrame, markout_rows: DataFrame, start_ms: int, end_ms: int, lifecycle: DataFrame | None = None) -> Inputs:
        # First and last times and the first row of a bucket are the same with repeated rows: no shuffle of rows for them.
        return cls(book_rows, books.dedup_books(book_rows), trades.dedup_trades(trade_rows), markouts.dedup_markouts(markout_rows), books.market_windows(book_rows, start_ms, end_ms, lifecycle))


def market_rows(x: Inputs, sampling: Sampling = Sampling(), policy: FillPolicy = FillPolicy()) -> DataFrame:
    """One wide row for each market that any table knows; what a family doesn't know of a market has its default."""
    book = books.market_metrics(x.books, x.windows, sampling=sampling).withColumn("observation_hours", F.col("market_observation_seconds") / 3600.0)
    fill = fills.fill_stats(fills.fill_rates(fills.touch_flow_eligible(fills.downsample_snapshots(x.book_rows, policy), x.trades, policy), policy), policy)
    rows = book
    for family in (trades.trade_metrics(x.trades, x.windows), markouts.markout_stats(x.markouts), fill):
        rows = rows.join(family, "market_id", "full_outer")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total_trade_count", "markout_1s_count", "markout_5s_count", "markout_30s_count", "markout_60s_count", "estimated_maker_fill_samples")}
    none = {c: F.coalesce(c, F.lit(0.0)) for c in ("data_coverage_pct", "observation_hours", "trades_per_minute_mean", "trades_per_minute_median", "total_quote_volume")}
    quality = {"estimated_maker_fill_sample_quality": F.coalesce("estimated_maker_fill_sample_quality", F.lit("insufficient"))}
    return fills.maker_edge(markouts.markout_quality(rows.withColumns(zero | none | quality)))


def ranked_markets(x: Inputs) -> DataFrame:
    return scoring.score_markets(market_rows(x))
