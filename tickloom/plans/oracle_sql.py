"""DuckDB SQL that the oracles are put together from: named queries, each used where another one names it."""

from __future__ import annotations

import re

from tickloom.config import Sampling
from tickloom.sources.fixtures import VIEWS

T = Sampling().spread_thresholds
_PCT = (("p10", 0.10), ("p25", 0.25), ("median", 0.50), ("p75", 0.75), ("p90", 0.90), ("p95", 0.95))


def _moves(label: str, x: str) -> str:
    return ", ".join(f"quantile_cont({x}, {q}) AS {n}_abs_mid_move_{label}_bps" for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95)))


def _rates() -> str:
    out = ["count(*) AS estimated_maker_fill_samples"]
    for size in (25, 50, 100):
        for h in (5, 30):
            for mode in ("optimistic", "conservative"):
                r = {s: f"avg(CASE WHEN {s}_eligible_usd_{h}s >= {size}e0{'' if mode == 'optimistic' else f' + best_{s}_size_usd'} THEN 1e0 ELSE 0e0 END)" for s in ("bid", "ask")}
                out += [f"{r['bid']} AS bid_{mode}_{h}s_{size}", f"{r['ask']} AS ask_{mode}_{h}s_{size}", f"least({r['bid']}, {r['ask']}) AS mkt_{mode}_{h}s_{size}"]
    return ", ".join(out)


_MEDIAN_FIELDS = "quantile_cont(least(best_bid_size_usd, best_ask_size_usd), 0.5) AS median_bbo_depth_usd, " + ", ".join(f"quantile_cont(two_sided_depth_{b}bps_usd, 0.5) AS median_two_sided_depth_{b}bps_usd" for b in (5, 10, 25))
_LATEST_FIELDS = ", ".join(f"arg_max({c}, timestamp_ms) AS {n}" for c, n in (("current_funding_rate", "current_funding_rate"), ("funding_rate", "funding_rate"), ("open_interest", "open_interest"), ("daily_quote_token_volume", "daily_quote_volume_usd")))
_RANKED = {
    "trade_activity": "coalesce(0.7e0 * trades_per_minute_mean + 0.3e0 * trades_per_minute_median, trades_per_minute_mean, trades_per_minute_median)",
    "estimated_maker_fill": "estimated_maker_fill_rate_30s_conservative",
    "spread": "CASE WHEN median_spread_bps > 20e0 THEN 20e0 ELSE median_spread_bps END",
    "two_sided_depth": "median_two_sided_depth_10bps_usd",
    "maker_markout": "maker_markout_5s_median_bps",
    "data_quality_persistence": "coalesce(pct_time_spread_ge_5bps * 100e0 * 0.6e0 + coalesce(observation_coverage_pct, data_coverage_pct) * 0.4e0, observation_coverage_pct, data_coverage_pct)",
}
WEIGHTS = {"trade_activity": 15, "estimated_maker_fill": 20, "spread": 20, "two_sided_depth": 15, "maker_markout": 20, "data_quality_persistence": 10}


def _rank_of(c: str, x: str) -> str:
    peers = f"(SELECT count(*) FILTER (v < {x}) + 0.5e0 * count(*) FILTER (v = {x}) FROM pv WHERE name = '{c}')"
    n = f"(SELECT count(v) FROM pv WHERE name = '{c}')"
    rank = f"{peers} / {n} * 100e0"
    empty = "NULL" if c == "estimated_maker_fill" else "0e0"
    return f"CASE WHEN {x} IS NULL THEN {empty} ELSE {rank} END AS rank_{c}"


def _known(name: str) -> str:
    return f"CASE WHEN rank_{name} IS NOT NULL THEN {WEIGHTS[name]}e0 ELSE 0e0 END"


_HILL = "CASE WHEN {x} IS NULL OR {x} < 0 THEN NULL ELSE {x} / ({x} + {k}e0) END"
_COVER = "least(CASE WHEN data_coverage_pct BETWEEN 0 AND 100 THEN data_coverage_pct END, CASE WHEN observation_coverage_pct BETWEEN 0 AND 100 THEN observation_coverage_pct END)"
_LEAF_WEIGHTS = {"c5": 0.245, "c30": 0.105, "cf": 0.25, "ct": 0.1, "cc": 0.2, "cd": 0.1}

PARTS: dict[str, str] = VIEWS | {
    "win": "SELECT 1704067200000 AS s, 1704067200000 + 1000 * max(event_id) AS e FROM events",
    "bk": "SELECT DISTINCT ON (market_id, timestamp_ms) * FROM fx_books",
    "bo": """SELECT *, CASE WHEN spread_bps IS NOT NULL THEN spread_bps
        WHEN best_bid > 0 AND best_ask > 0 AND mid > 0 AND best_ask >= best_bid THEN (best_ask - best_bid) / mid * 10000e0 END AS effective_spread_bps
        FROM bk WHERE is_usable OR (is_usable IS NULL AND mid IS NOT NULL)""",
    "bg": "SELECT * FROM bk WHERE is_usable OR (is_usable IS NULL AND NOT is_stale AND mid IS NOT NULL)",
    "mids": "SELECT market_id, timestamp_ms, mid FROM bo WHERE mid > 0",
    "mw": """SELECT *, (effective_end_ms - effective_start_ms)::DOUBLE / 1000e0 AS market_observation_seconds FROM (
        SELECT market_id, symbol, first_observed_ms, last_observed_ms, begins AS effective_start_ms, greatest(begins, least(e, coalesce(removed_at_ms, e))) AS effective_end_ms FROM (
          SELECT b.*, l.removed_at_ms, e, greatest(s, CASE WHEN l.market_id IS NULL THEN first_observed_ms ELSE first_active_at_ms END) AS begins
          FROM (SELECT market_id, max(symbol) AS symbol, min(timestamp_ms) AS first_observed_ms, max(timestamp_ms) AS last_observed_ms FROM bk GROUP BY market_id) b
          LEFT JOIN fx_lifecycle l ON l.market_id = b.market_id CROSS JOIN win))""",
    "cov": """SELECT b.market_id, count(*) AS observed_samples, count(o.market_id) AS usable_samples, count(o.effective_spread_bps) AS spread_samples
        FROM bk b LEFT JOIN bo o ON o.market_id = b.market_id AND o.timestamp_ms = b.timestamp_ms GROUP BY b.market_id""",
    "sprd": "SELECT market_id, avg(effective_spread_bps) AS mean_spread_bps, " + ", ".join(f"quantile_cont(effective_spread_bps, {q}) AS {n}_spread_bps" for n, q in _PCT) + " FROM bo WHERE effective_spread_bps IS NOT NULL GROUP BY market_id",
    "dep": f"SELECT market_id, {_MEDIAN_FIELDS} FROM bg GROUP BY market_id",
    "lat": f"SELECT market_id, {_LATEST_FIELDS} FROM bg GROUP BY market_id",
    "age": "SELECT market_id, arg_max(book_update_age_ms, timestamp_ms) / 1000e0 AS latest_book_update_age_seconds, quantile_cont(book_update_age_ms / 1000e0, 0.95) AS p95_book_update_age_seconds FROM bk WHERE book_update_age_ms IS NOT NULL GROUP BY market_id",
    "covp": """SELECT mw.*, observed_samples, usable_samples, spread_samples, greatest(1e0, market_observation_seconds * 1000e0 / 5000e0 + 1) AS expected,
        least(100e0, 100e0 * observed_samples / greatest(1e0, market_observation_seconds * 1000e0 / 5000e0 + 1)) AS observation_coverage_pct,
        least(100e0, 100e0 * usable_samples / observed_samples) AS usable_quote_coverage_pct, least(100e0, 100e0 * spread_samples / observed_samples) AS spread_coverage_pct
        FROM mw JOIN cov USING (market_id)""",
    "steps": """SELECT market_id, timestamp_ms, spread, CASE WHEN gap > 0 AND gap <= 60 THEN gap ELSE 5e0 END AS dt FROM (
        SELECT market_id, timestamp_ms, effective_spread_bps AS spread, (lead(timestamp_ms) OVER (PARTITION BY market_id ORDER BY timestamp_ms) - timestamp_ms) / 1000e0 AS gap FROM bo WHERE effective_spread_bps IS NOT NULL)""",
    "pers": "SELECT market_id, " + ", ".join(f"sum(CASE WHEN spread >= {t} THEN dt ELSE 0 END) / sum(dt) AS pct_time_spread_ge_{t}bps" for t in T) + " FROM steps GROUP BY market_id",
    "volc": "SELECT market_id, count(*) AS mid_move_1s_count, " + _moves("1s", "m") + " FROM (SELECT market_id, abs(ln(mid / lag(mid) OVER (PARTITION BY market_id ORDER BY timestamp_ms))) * 10000e0 AS m FROM mids) WHERE m IS NOT NULL GROUP BY market_id",
    "pairs": " UNION ALL ".join(f"SELECT a.market_id, a.timestamp_ms, a.mid, {h} AS h, (SELECT arg_min(b.mid, b.timestamp_ms) FROM mids b WHERE b.market_id = a.market_id AND b.timestamp_ms BETWEEN a.timestamp_ms + {h * 1000} AND a.timestamp_ms + {h * 1000 + 7500}) AS later FROM mids a" for h in (5, 30, 60)),
    "volh": "SELECT market_id, " + ", ".join(f"count(later) FILTER (h = {h}) AS mid_move_{h}s_count, " + _moves(f"{h}s", f"CASE WHEN h = {h} THEN abs(ln(later / mid)) * 10000e0 END") for h in (5, 30, 60)) + " FROM pairs GROUP BY market_id",
    "td": "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY market_id, trade_id ORDER BY timestamp_ms) AS n FROM fx_trades WHERE type = 'trade') WHERE n = 1",
    "tall": "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY market_id, trade_id ORDER BY timestamp_ms) AS n FROM fx_trades) WHERE n = 1",
    "tot": "SELECT market_id, count(*) AS total_trade_count, sum(usd_amount) AS total_quote_volume, quantile_cont(usd_amount, 0.5) AS median_trade_size_usd FROM td GROUP BY market_id",
    "gap": "SELECT market_id, quantile_cont(g, 0.5) AS median_intertrade_ms FROM (SELECT market_id, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY market_id ORDER BY timestamp_ms, trade_id) AS g FROM td) WHERE g >= 0 GROUP BY market_id",
    "slots": """SELECT market_id, minute_idx, count(t) AS trade_count FROM (
        SELECT market_id, unnest(range(effective_start_ms // 60000, effective_end_ms // 60000 + 1)) AS minute_idx FROM mw)
        LEFT JOIN (SELECT market_id, timestamp_ms // 60000 AS minute_idx, 1 AS t FROM td) USING (market_id, minute_idx) GROUP BY market_id, minute_idx""",
    "tpm": """SELECT market_id, coalesce(n, 0) / greatest(market_observation_seconds / 60e0, 1e0 / 60e0) AS trades_per_minute_mean, trades_per_minute_median, trades_per_minute_p90
        FROM mw JOIN (SELECT market_id, quantile_cont(trade_count, 0.5) AS trades_per_minute_median, quantile_cont(trade_count, 0.9) AS trades_per_minute_p90 FROM slots GROUP BY market_id) USING (market_id)
        LEFT JOIN (SELECT market_id, count(*) AS n FROM td GROUP BY market_id) USING (market_id)""",
    "md": "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY market_id, trade_id, horizon_s ORDER BY timestamp_ms) AS n FROM fx_markouts) WHERE n = 1",
    "mk": "SELECT market_id, " + ", ".join(f"count(*) FILTER (horizon_s = {h}) AS markout_{h}s_count, avg(maker_markout_bps) FILTER (horizon_s = {h}) AS maker_markout_{h}s_mean_bps, quantile_cont(maker_markout_bps, 0.5) FILTER (horizon_s = {h}) AS maker_markout_{h}s_median_bps" + (f", avg(CASE WHEN maker_markout_bps > 0 THEN 1e0 ELSE 0e0 END) FILTER (horizon_s = {h}) AS maker_markout_{h}s_positive_ratio" if h in (5, 30) else "") for h in (1, 5, 30, 60)) + " FROM md GROUP BY market_id",
    "snap": """SELECT market_id, symbol, timestamp_ms, best_bid, best_ask, best_bid_size_usd, best_ask_size_usd FROM (
        SELECT *, row_number() OVER (PARTITION BY market_id, timestamp_ms // 30000 ORDER BY timestamp_ms) AS n FROM bo WHERE best_bid IS NOT NULL AND best_ask IS NOT NULL AND best_bid_size_usd IS NOT NULL AND best_ask_size_usd IS NOT NULL) WHERE n = 1""",
    "flow": """SELECT s.*, t.timestamp_ms AS t_ms, t.usd_amount, CASE WHEN t.is_maker_ask THEN 'ask' ELSE 'bid' END AS side FROM snap s JOIN td t ON t.market_id = s.market_id AND t.timestamp_ms > s.timestamp_ms AND t.timestamp_ms <= s.timestamp_ms + 30000
        AND ((NOT t.is_maker_ask AND t.price <= s.best_bid) OR (t.is_maker_ask AND t.price >= s.best_ask))""",
    "elig": "SELECT s.*, " + ", ".join(f"coalesce({side}{h}, 0e0) AS {side}_eligible_usd_{h}s" for side in ("bid", "ask") for h in (5, 30)) + " FROM snap s LEFT JOIN (SELECT market_id, timestamp_ms, " + ", ".join(f"sum(usd_amount) FILTER (side = '{side}' AND t_ms <= timestamp_ms + {h * 1000}) AS {side}{h}" for side in ("bid", "ask") for h in (5, 30)) + " FROM flow GROUP BY market_id, timestamp_ms) f USING (market_id, timestamp_ms)",
    "rates": f"SELECT market_id, {_rates()} FROM elig GROUP BY market_id",
    "fst": "SELECT market_id, estimated_maker_fill_samples, CASE WHEN estimated_maker_fill_samples < 100 THEN 'insufficient' WHEN estimated_maker_fill_samples < 500 THEN 'preliminary' ELSE 'reliable' END AS estimated_maker_fill_sample_quality, " + ", ".join(f"CASE WHEN estimated_maker_fill_samples >= 100 THEN mkt_{m}_{h}s_50 END AS estimated_maker_fill_rate_{h}s_{m}" for h in (5, 30) for m in ("optimistic", "conservative")) + " FROM rates",
    "mr": """SELECT market_id, covp.symbol, observed_samples, coalesce(observation_coverage_pct, NULL) AS observation_coverage_pct, coalesce(observation_coverage_pct, 0e0) AS data_coverage_pct, usable_quote_coverage_pct, spread_coverage_pct,
        coalesce(market_observation_seconds / 3600e0, 0e0) AS observation_hours, median_spread_bps, mean_spread_bps, pct_time_spread_ge_5bps, median_two_sided_depth_5bps_usd, median_two_sided_depth_10bps_usd, current_funding_rate,
        p95_abs_mid_move_5s_bps, coalesce(total_trade_count, 0) AS total_trade_count, coalesce(total_quote_volume, 0e0) AS total_quote_volume, coalesce(trades_per_minute_mean, 0e0) AS trades_per_minute_mean, coalesce(trades_per_minute_median, 0e0) AS trades_per_minute_median,
        coalesce(markout_5s_count, 0) AS markout_5s_count, coalesce(markout_30s_count, 0) AS markout_30s_count, maker_markout_5s_median_bps, maker_markout_30s_median_bps,
        coalesce(estimated_maker_fill_samples, 0) AS estimated_maker_fill_samples, estimated_maker_fill_rate_5s_conservative, estimated_maker_fill_rate_30s_conservative, estimated_maker_fill_rate_5s_optimistic, estimated_maker_fill_rate_30s_optimistic,
        estimated_maker_fill_rate_5s_conservative * maker_markout_5s_median_bps AS estimated_maker_edge_5s_bps, estimated_maker_fill_rate_30s_conservative * maker_markout_30s_median_bps AS estimated_maker_edge_30s_bps
        FROM covp FULL JOIN sprd USING (market_id) FULL JOIN dep USING (market_id) FULL JOIN lat USING (market_id) FULL JOIN pers USING (market_id) FULL JOIN volh USING (market_id) FULL JOIN tot USING (market_id) FULL JOIN tpm USING (market_id) FULL JOIN mk USING (market_id) FULL JOIN fst USING (market_id)""",
    "pv": " UNION ALL ".join(f"SELECT '{c}' AS name, {x} AS v FROM mr" for c, x in _RANKED.items()),
    "rk": "SELECT *, " + ", ".join(_rank_of(c, f"({x})") for c, x in _RANKED.items()) + " FROM mr",
    "ws": "SELECT *, (" + " + ".join(f"coalesce(rank_{c} * {w}e0, 0e0)" for c, w in WEIGHTS.items()) + ") / (" + " + ".join(_known(c) for c in WEIGHTS) + ") AS weighted_score, coalesce(observation_coverage_pct, data_coverage_pct, 0e0) AS cover, greatest(observation_hours, 0.01e0) AS hrs FROM rk",
    "pen": """SELECT *, cover < 90 AS p1, total_trade_count < 7.5e0 * hrs AS p2, coalesce(median_two_sided_depth_10bps_usd, 0) < 200 AS p3, coalesce(maker_markout_5s_median_bps < 0, false) AS p4, coalesce(maker_markout_30s_median_bps < -15, false) AS p5,
        coalesce(estimated_maker_fill_rate_30s_conservative <= 0 AND estimated_maker_fill_samples >= 100, false) AS p6 FROM ws""",
    "scr": """SELECT *, greatest(0e0, least(100e0, weighted_score * CASE WHEN p1 THEN 0.55e0 ELSE 1e0 END * CASE WHEN p2 THEN 0.5e0 ELSE 1e0 END * CASE WHEN p3 THEN 0.75e0 ELSE 1e0 END * CASE WHEN p4 THEN 0.7e0 ELSE 1e0 END * CASE WHEN p5 THEN 0.55e0 ELSE 1e0 END * CASE WHEN p6 THEN 0.85e0 ELSE 1e0 END)) AS score,
        p1 OR p2 OR p5 AS hard_penalty,
        list_filter([CASE WHEN p1 THEN 'strong penalty: observation coverage < 90%' END, CASE WHEN p2 THEN 'strong penalty: extremely low trade count' END, CASE WHEN p3 THEN 'penalty: two-sided depth very thin' END, CASE WHEN p4 THEN 'penalty: median 5s maker markout < 0' END, CASE WHEN p5 THEN 'strong penalty: 30s markout largely negative' END, CASE WHEN p6 THEN 'penalty: Estimated Maker Fill ~0 @30s conservative ($50)' END], lambda x: x IS NOT NULL) AS penalties FROM pen""",
    "can": """SELECT *, coalesce(cover >= 90 AND (total_trade_count / hrs >= 30 OR trades_per_minute_mean * 60 >= 30) AND observation_hours >= 1 AND coalesce(median_two_sided_depth_10bps_usd, 0) >= 200 AND coalesce(median_spread_bps, 0) >= 1
        AND maker_markout_5s_median_bps >= -5 AND maker_markout_30s_median_bps >= -15 AND markout_5s_count >= 20 AND markout_30s_count >= 20 AND estimated_maker_fill_samples >= 100
        AND NOT ((SELECT count(*) FROM mr) >= 10 AND rank_trade_activity < 20), false) AS candidate FROM scr""",
    "ltr": """SELECT *, CASE WHEN NOT candidate OR hard_penalty THEN CASE WHEN score >= 55 THEN 'C' ELSE 'D' END WHEN score >= 75 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 45 THEN 'C' ELSE 'D' END AS letter_rank FROM can""",
    "lvs": f"""SELECT *, {_HILL.format(x="markout_5s_count", k=200)} AS c5, {_HILL.format(x="markout_30s_count", k=200)} AS c30, {_HILL.format(x="estimated_maker_fill_samples", k=200)} AS cf, {_HILL.format(x="total_trade_count", k=300)} AS ct,
        {_COVER} AS covered, CASE WHEN observation_hours >= 0 THEN 1e0 - exp(-observation_hours / 24e0) END AS cd,
        CASE WHEN {_COVER} >= 99 THEN 1e0 WHEN {_COVER} <= 80 THEN {_COVER} / 80e0 * 0.5e0 WHEN {_COVER} <= 90 THEN 0.5e0 + ({_COVER} - 80e0) / 10e0 * 0.3e0 WHEN {_COVER} <= 95 THEN 0.8e0 + ({_COVER} - 90e0) / 5e0 * 0.15e0 WHEN {_COVER} < 99 THEN 0.95e0 + ({_COVER} - 95e0) / 4e0 * 0.05e0 END AS cc FROM ltr""",
    "cnf": "SELECT *, CASE WHEN aw > 0 THEN exp(lg / aw) * aw ELSE 0e0 END AS confidence FROM (SELECT *, " + " + ".join(f"CASE WHEN {c} IS NULL THEN 0e0 ELSE {w}e0 END" for c, w in _LEAF_WEIGHTS.items()) + " AS aw, " + " + ".join(f"CASE WHEN {c} IS NULL THEN 0e0 ELSE {w}e0 * ln(greatest({c}, 0.05e0)) END" for c, w in _LEAF_WEIGHTS.items()) + " AS lg FROM lvs)",
    "fin": """SELECT *, CASE WHEN confidence < 0.3 THEN 'low' WHEN confidence < 0.8 THEN 'medium' ELSE 'high' END AS confidence_label, least(100e0, score * confidence) AS effective_score,
        list_slice(list_filter([CASE WHEN c5 < 0.25 OR c30 < 0.25 THEN 'low_markout_samples' END, CASE WHEN cf < 0.25 THEN 'low_fill_samples' END, CASE WHEN ct < 0.25 THEN 'low_trade_observations' END, CASE WHEN covered < 95 THEN 'low_coverage' END, CASE WHEN cd < 0.3 THEN 'short_observation_duration' END,
          CASE WHEN (c5 IS NULL OR c30 IS NULL) AND NOT coalesce(c5 < 0.25, false) AND NOT coalesce(c30 < 0.25, false) THEN 'missing_markout_samples' END, CASE WHEN cf IS NULL THEN 'missing_fill_samples' END, CASE WHEN ct IS NULL THEN 'missing_trade_observations' END, CASE WHEN covered IS NULL THEN 'missing_coverage' END, CASE WHEN cd IS NULL THEN 'missing_observation_duration' END], lambda x: x IS NOT NULL), 1, 3) AS confidence_reasons FROM cnf""",
    "rnk": "SELECT *, row_number() OVER (ORDER BY effective_score DESC, score DESC, coalesce(symbol, ''), market_id) AS rank FROM fin",
    # The texts.
    "nar": """SELECT *, list_filter([
          CASE WHEN median_spread_bps IS NOT NULL THEN printf('SPREAD: median %.2fbp', median_spread_bps) ELSE 'SPREAD: n/a' END,
          CASE WHEN median_two_sided_depth_10bps_usd IS NOT NULL THEN format('DEPTH: ${:,} within ±10bp', round_even(median_two_sided_depth_10bps_usd, 0)::BIGINT) ELSE 'DEPTH: n/a' END,
          CASE WHEN trades_per_minute_median IS NOT NULL THEN printf('ACTIVITY: %.2f trades/min (market-level)', trades_per_minute_median) ELSE 'ACTIVITY: n/a' END,
          CASE WHEN maker_markout_5s_median_bps IS NOT NULL AND maker_markout_30s_median_bps IS NOT NULL THEN printf('MARKOUT: %+.2fbp @5s / %+.2fbp @30s', maker_markout_5s_median_bps, maker_markout_30s_median_bps) ELSE 'MARKOUT: n/a' END,
          CASE WHEN fill IS NOT NULL THEN printf('EST. FILL: %.0f%% @30s cons. ($50)', fill * 100) ELSE 'EST. FILL: n/a' END,
          printf('PERSISTENCE: spread >=5bp for %.0f%% of observed time', coalesce(pct_time_spread_ge_5bps, 0) * 100),
          CASE WHEN median_spread_bps >= 3 AND coalesce(pct_time_spread_ge_5bps, 0) >= 0.25 THEN 'persistent/usable spread' WHEN median_spread_bps >= 3 THEN 'meaningful median spread' END,
          CASE WHEN coalesce(pct_time_spread_ge_5bps, 0) >= 0.35 THEN 'spread >=5bp for substantial fraction of time' END,
          CASE WHEN trades_per_minute_median >= 5 THEN 'high trade frequency (market-level; not Estimated Maker Fill)' END,
          CASE WHEN fill >= 0.3 THEN 'meaningful Estimated Maker Fill @30s conservative ($50)' END,
          CASE WHEN median_two_sided_depth_10bps_usd >= 1000 THEN 'sufficient two-sided depth within ±10bp' END,
          CASE WHEN maker_markout_5s_median_bps > 0 THEN 'positive 5s maker markout' END,
          CASE WHEN maker_markout_30s_median_bps > 0 THEN 'positive 30s maker markout' END], lambda x: x IS NOT NULL) AS pros,
        list_filter([CASE WHEN median_spread_bps < 1.5 THEN 'tight spread — limited edge after fees/latency' END, CASE WHEN coalesce(trades_per_minute_median, 0) < 1 THEN 'low trade activity' END,
          CASE WHEN p6 THEN 'Estimated Maker Fill ~0 @30s conservative (touch rarely clears)' END, CASE WHEN coalesce(median_two_sided_depth_10bps_usd, 0) < 500 THEN 'thin two-sided depth' END, CASE WHEN maker_markout_5s_median_bps < 0 THEN 'negative 5s maker markout (adverse selection)' END,
          CASE WHEN p95_abs_mid_move_5s_bps > median_spread_bps * 2 THEN 'elevated 5s volatility vs spread' END], lambda x: x IS NOT NULL) AS cons,
        list_concat(list_filter([CASE WHEN NOT p6 AND estimated_maker_fill_samples < 100 THEN 'Estimated Maker Fill sample insufficient (<100)' END, CASE WHEN abs(current_funding_rate) > 0.01 THEN 'funding relatively high' END, CASE WHEN cover >= 90 AND cover < 95 THEN 'data coverage below 95%' END], lambda x: x IS NOT NULL), penalties) AS warnings
        FROM (SELECT *, estimated_maker_fill_rate_30s_conservative AS fill FROM rnk)""",
    "st1": """SELECT mw.market_id, mw.symbol, first_observed_ms, last_observed_ms, observed_samples AS book_observation_count, coalesce(total_trade_count, 0) AS trade_count, median_spread_bps, median_two_sided_depth_10bps_usd, pct_time_spread_ge_5bps, trades_per_minute_mean, trades_per_minute_median, maker_markout_5s_median_bps,
        least(1e0, observed_samples / round_even(greatest(1e0, mw.market_observation_seconds * 1000e0 / 5000e0 + 1), 0)) AS observation_coverage, mw.market_observation_seconds / 3600e0 AS observation_hours
        FROM mw LEFT JOIN cov USING (market_id) LEFT JOIN sprd USING (market_id) LEFT JOIN dep USING (market_id) LEFT JOIN pers USING (market_id) LEFT JOIN tot USING (market_id) LEFT JOIN tpm USING (market_id) LEFT JOIN mk USING (market_id)""",
    "sc1": """SELECT *, CASE WHEN eligible THEN (""" + " + ".join(f"(SELECT count(*) FILTER (y.{c} < x.{c}) + 0.5e0 * count(*) FILTER (y.{c} = x.{c}) FROM st1 y) / (SELECT count({c}) FROM st1) * 100e0" for c in ("median_spread_bps", "trade_count", "observation_coverage")) + """) / 300e0 END AS screening_score
        FROM (SELECT *, coalesce(observation_coverage >= 0.9 AND trade_count >= 20 AND median_spread_bps >= 0.5, false) AS eligible FROM st1) x""",
    "refm": "SELECT t.*, CASE WHEN t.timestamp_ms - m.timestamp_ms <= 3000 THEN m.mid END AS reference_mid FROM td t ASOF LEFT JOIN mids m ON m.market_id = t.market_id AND m.timestamp_ms <= t.timestamp_ms",
    "futm": """SELECT t.market_id, t.trade_id, h AS horizon_s, t.timestamp_ms, t.price, t.is_maker_ask, t.reference_mid, coalesce(
          (SELECT arg_min(m.mid, m.timestamp_ms) FROM mids m WHERE m.market_id = t.market_id AND m.timestamp_ms BETWEEN t.timestamp_ms + h * 1000 AND t.timestamp_ms + h * 1000 + 2500),
          (SELECT arg_max(m.mid, m.timestamp_ms) FROM mids m WHERE m.market_id = t.market_id AND m.timestamp_ms BETWEEN t.timestamp_ms + h * 1000 - 2500 AND t.timestamp_ms + h * 1000)) AS future_mid
        FROM refm t CROSS JOIN (SELECT unnest([1, 5, 30, 60]) AS h)""",
    "cum": "SELECT *, sum(qty_base) OVER (PARTITION BY market_id, side ORDER BY timestamp_ms, fill_id ROWS UNBOUNDED PRECEDING) AS upto FROM (SELECT * REPLACE (qty_base::DECIMAL(28,12) AS qty_base) FROM fx_fills)",
    "fifo": """SELECT b.market_id, (least(b.upto, s.upto) - greatest(b.upto - b.qty_base, s.upto - s.qty_base))::DOUBLE AS qty, b.fill_id AS buy_id, s.fill_id AS sell_id, b.price AS buy_price, s.price AS sell_price,
        (s.price - b.price) * (least(b.upto, s.upto) - greatest(b.upto - b.qty_base, s.upto - s.qty_base))::DOUBLE AS pnl, greatest(b.timestamp_ms, s.timestamp_ms) AS closed_ms
        FROM cum b JOIN cum s ON s.market_id = b.market_id AND b.side = 'bid' AND s.side = 'ask' AND b.upto > s.upto - s.qty_base AND s.upto > b.upto - b.qty_base""",
    "lastmid": "SELECT market_id, arg_max(mid, timestamp_ms) AS last_mid FROM mids GROUP BY market_id",
    "opn": """SELECT market_id, sum(sg * still) AS open_qty, sum(sg * still * (last_mid - price)) AS unrealized_pnl_usd, max(last_mid) AS last_mid FROM (
        SELECT c.*, last_mid, CASE WHEN side = 'bid' THEN 1e0 ELSE -1e0 END AS sg, greatest(0::DECIMAL(38,12), upto - greatest(upto - qty_base, least(bought, sold)))::DOUBLE AS still FROM cum c
        JOIN (SELECT market_id, coalesce(sum(qty_base) FILTER (side = 'bid'), 0) AS bought, coalesce(sum(qty_base) FILTER (side = 'ask'), 0) AS sold FROM cum GROUP BY market_id) USING (market_id) JOIN lastmid USING (market_id)) GROUP BY market_id""",
    "pos": "SELECT *, (sum(CASE WHEN side = 'bid' THEN qty_base::DECIMAL(28,12) ELSE -qty_base::DECIMAL(28,12) END) OVER (PARTITION BY market_id ORDER BY timestamp_ms, fill_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS position FROM fx_fills",
    "ledg": """SELECT market_id, bid_fills, ask_fills, filled_notional_usd, realized_pnl_usd, coalesce(unrealized_pnl_usd, 0e0) AS unrealized_pnl_usd, filled_notional_usd * 1e0 / 10000e0 AS fees_usd, realized_pnl_usd + coalesce(unrealized_pnl_usd, 0e0) AS gross_pnl_usd,
        realized_pnl_usd + coalesce(unrealized_pnl_usd, 0e0) - filled_notional_usd / 10000e0 AS total_pnl_usd FROM (
        SELECT market_id, count(*) FILTER (side = 'bid') AS bid_fills, count(*) FILTER (side = 'ask') AS ask_fills, sum(qty_base * price) AS filled_notional_usd FROM fx_fills GROUP BY market_id)
        LEFT JOIN (SELECT market_id, sum(pnl) AS realized_pnl_usd FROM fifo GROUP BY market_id) USING (market_id) LEFT JOIN opn USING (market_id)""",
    "msg": "SELECT *, lag(nonce) OVER (PARTITION BY market_id ORDER BY nonce) AS before, count(*) FILTER (kind = 'snapshot') OVER (PARTITION BY market_id ORDER BY nonce) AS episode FROM (SELECT DISTINCT market_id, nonce, timestamp_ms, begin_nonce, kind FROM fx_level_updates)",
    "eps": """SELECT *, lead(starts) OVER w AS next, lead(first_nonce) OVER w AS next_nonce FROM (SELECT market_id, episode, min(timestamp_ms) AS starts, min(nonce) AS first_nonce,
          min(CASE WHEN kind = 'delta' AND begin_nonce IS DISTINCT FROM before THEN timestamp_ms END) AS gap_ms, min(CASE WHEN kind = 'delta' AND begin_nonce IS DISTINCT FROM before THEN nonce END) AS gap_nonce FROM msg WHERE episode > 0 GROUP BY market_id, episode) WINDOW w AS (PARTITION BY market_id ORDER BY episode)""",
    "lvn": """SELECT market_id, episode, side, price, size, u.timestamp_ms AS from_ms, u.nonce AS from_nonce, lead(u.timestamp_ms) OVER w AS changed, lead(u.nonce) OVER w AS changed_nonce,
        least(coalesce(gap_ms, next), coalesce(next, gap_ms)) AS closed, least(coalesce(gap_nonce, next_nonce), coalesce(next_nonce, gap_nonce)) AS closed_nonce
        FROM fx_level_updates u JOIN (SELECT market_id, nonce, episode FROM msg) USING (market_id, nonce) JOIN eps USING (market_id, episode)
        WHERE price IS NOT NULL AND (gap_nonce IS NULL OR u.nonce < gap_nonce) WINDOW w AS (PARTITION BY market_id, episode, side, price ORDER BY u.nonce)""",
    "lvl": """SELECT market_id, episode, side, price, size, from_ms, to_ms FROM (SELECT *, least(coalesce(changed, closed), coalesce(closed, changed)) AS to_ms FROM lvn) WHERE size > 0 AND (to_ms IS NULL OR to_ms > from_ms)""",
    "app": "SELECT m.market_id, m.nonce, m.timestamp_ms FROM msg m JOIN eps USING (market_id, episode) WHERE gap_nonce IS NULL OR m.nonce < gap_nonce",
}


def oracle(sql: str, doubles: str = "", places: int = 6) -> str:
    """``sql`` with the named parts that it needs, and the ``doubles`` rounded."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b[a-z_0-9]+\b", text):
            if name in PARTS and name not in used and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need(PARTS[name])
                if name not in used:
                    used.append(name)

    need(sql)
    rounded = ", ".join(f"round({c}, {places}) + 0e0 AS {c}" for c in doubles.split())
    body = f"SELECT * REPLACE ({rounded}) FROM (\n{sql}\n)" if rounded else sql
    return (f"WITH {', '.join(f'{n} AS ({PARTS[n].strip()})' for n in used)}\n" if used else "") + body
