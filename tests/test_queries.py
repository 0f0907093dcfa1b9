"""Registered queries against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tickloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
CHOSEN = [
    "scan_market_table", "conform_schema", "partitioned_sink", "feed_ingest", "effective_spread", "dedup_books", "dedup_trades", "forward_horizon_pairs", "touch_flow_join", "reference_mid_asof",
    "future_mid_asof", "assemble_book_row", "spread_persistence", "spread_episodes", "volatility_horizons", "trades_per_minute", "markout_stats", "fill_rates", "minute_bars", "screening_score",
    "market_lifecycle", "score_markets", "book_sample_grid", "fifo_realized_pnl", "round_trips", "pnl_summary", "snapshot_compare", "freshness_label", "stream_dedup_trades", "live_metrics_stream", "stream_markouts", "stream_rolling_tpm", "stream_feed_tables", "stream_dq_counters", "stream_partitioned_sink", "dataset_event_watermark", "market_card", "spread_percentiles_selected",
    "book_rebuild", "stream_book_rebuild", "dq_counters", "feed_market_stats", "feed_books", "discover_layout", "file_health_scan", "publish_generation", "narratives", "redact_text",
    "snapshot_score_deltas", "analysis_runs", "connection_warnings", "market_detail", "output_quality_checks",
]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = duck.execute(ORACLES[name])
    given = [d[0] for d in result.description]
    want = sorted(tuple(plain(row[given.index(c)]) for c in names) for row in result.fetchall())
    assert sorted(given) == names
    assert found == want


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
