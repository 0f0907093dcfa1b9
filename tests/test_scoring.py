import pytest
from pyspark.sql import functions as F

from tickloom.operators.scoring import market_confidence, mid_ranks, score_markets

ROW = {
    "symbol": "CAND", "market_id": 1, "observation_hours": 24.0, "data_coverage_pct": 98.0, "observation_coverage_pct": 98.0, "median_spread_bps": 5.0, "pct_time_spread_ge_5bps": 0.4,
    "median_two_sided_depth_10bps_usd": 2000.0, "median_two_sided_depth_5bps_usd": 1000.0, "trades_per_minute_median": 5.0, "trades_per_minute_mean": 5.0, "total_trade_count": 10_000,
    "maker_markout_5s_median_bps": 0.5, "maker_markout_30s_median_bps": 0.2, "markout_5s_count": 200, "markout_30s_count": 200, "estimated_maker_fill_samples": 500,
    "estimated_maker_fill_rate_30s_conservative": 0.4, "p95_abs_mid_move_5s_bps": None, "current_funding_rate": None,
}
SCHEMA = ", ".join(f"{k} {'string' if k == 'symbol' else 'long' if k in ('market_id', 'total_trade_count', 'markout_5s_count', 'markout_30s_count', 'estimated_maker_fill_samples') else 'double'}" for k in ROW)
# Seven markets, and the scores, letters and candidates expected of them.
CHANGES = [
    {"symbol": "HEALTHY", "estimated_maker_fill_rate_30s_conservative": 0.45},
    {"symbol": "INSUFF_FILL", "estimated_maker_fill_samples": 99, "estimated_maker_fill_rate_30s_conservative": None},
    {"symbol": "ZERO_FILL", "estimated_maker_fill_rate_30s_conservative": 0.0},
    {"symbol": "NEG_MARKOUT", "maker_markout_5s_median_bps": -2.0, "maker_markout_30s_median_bps": -1.0, "estimated_maker_fill_rate_30s_conservative": 0.5},
    {"symbol": "POOR_COV", "data_coverage_pct": 70.0, "observation_coverage_pct": 70.0},
    {"symbol": "THIN_DEPTH", "median_two_sided_depth_10bps_usd": 100.0, "median_two_sided_depth_5bps_usd": 50.0},
    {"symbol": "LOW_ACT", "trades_per_minute_median": 0.1, "trades_per_minute_mean": 0.1, "total_trade_count": 5},
]
EXPECTED = {
    "HEALTHY": (59.285714, "C", True), "INSUFF_FILL": (55.357143, "C", False), "ZERO_FILL": (39.059524, "D", True), "NEG_MARKOUT": (36.833333, "D", True),
    "THIN_DEPTH": (33.839286, "D", False), "POOR_COV": (26.190476, "D", False), "LOW_ACT": (22.559524, "D", False),
}


def frame(spark, rows):
    return spark.createDataFrame([tuple((ROW | {"market_id": k + 1} | r).values()) for k, r in enumerate(rows)], SCHEMA)


def test_seven_markets(spark):
    found = {r.symbol: r for r in score_markets(frame(spark, CHANGES)).collect()}
    for symbol, (score, letter, candidate) in EXPECTED.items():
        assert found[symbol].score == pytest.approx(score, abs=1e-6)
        assert (found[symbol].letter_rank, found[symbol].candidate) == (letter, candidate), symbol
    assert found["HEALTHY"].pros[0] == "SPREAD: median 5.00bp"
    assert found["POOR_COV"].penalties == ["strong penalty: observation coverage < 90%"]
    assert sorted(r.rank for r in found.values()) == [1, 2, 3, 4, 5, 6, 7]


def test_ranks_among_other_peers(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None)], "market_id int, x double")
    peers = spark.createDataFrame([(7, 1.0), (8, 5.0), (9, 9.0), (10, None)], "market_id int, x double")
    got = {r.market_id: r.r for r in mid_ranks(rows, {"x": "r"}, peers).collect()}
    assert got == {1: 50.0, 2: 0.0}


def test_own_rows_as_peers_change_nothing(spark):
    rows = frame(spark, CHANGES)
    scores = lambda df: [(r.symbol, round(r.score, 9), r.candidate) for r in df.orderBy("rank").collect()]
    assert scores(score_markets(rows)) == scores(score_markets(rows, rows))


def test_confidence_tells_missing_from_zero(spark):
    rows = frame(spark, [{"symbol": "A"}, {"symbol": "B", "markout_5s_count": 0}, {"symbol": "C", "markout_5s_count": None}]).withColumn("score", F.lit(50.0))
    got = {r.symbol: r for r in market_confidence(rows).collect()}
    assert got["B"].confidence_breakdown.markout_5s == 0.0 and got["C"].confidence_breakdown.markout_5s is None
    assert got["B"].confidence < got["C"].confidence < got["A"].confidence <= 1
    assert got["C"].confidence_reasons[-1] == "missing_markout_samples"
    assert got["A"].effective_score == pytest.approx(50 * got["A"].confidence)
