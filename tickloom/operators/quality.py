"""Checks of inputs and outputs, comparisons of results, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.rebuild import messages

COVERAGES = ("data_coverage_pct", "observation_coverage_pct", "usable_quote_coverage_pct", "spread_coverage_pct")


def output_quality_checks(rows: DataFrame, required: tuple[str, ...] = ("market_id", "symbol", "score")) -> DataFrame:
    """``check_name``, ``level`` (FAIL, WARN, PASS) and the number of rows, of each check."""
    bad_number = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    checks: list[tuple[str, str, Column]] = [(f"coverage.schema.{c}", "FAIL", F.col(c).isNull()) for c in required]
    for c in COVERAGES:
        checks.append((f"coverage.{c}", "FAIL", bad_number(c) | (F.col(c) < 0) | (F.col(c) > 100)))
    checks.append(("coverage.obs_vs_data", "WARN", F.abs(F.col("observation_coverage_pct") - F.col("data_coverage_pct")) > 2.0))
    counted = rows.agg(*(F.count_if(F.coalesce(cond, F.lit(False))).alias(f"_{k}") for k, (_, _, cond) in enumerate(checks)), F.count(F.lit(1)).alias("n"))
    tall = counted.select("n", F.stack(F.lit(len(checks)), *(x for k, (name, level, _) in enumerate(checks) for x in (F.lit(name), F.lit(level), F.col(f"_{k}")))).alias("check_name", "_level", "found"))
    return tall.select("check_name", F.when(F.col("found") > 0, F.col("_level")).otherwise("PASS").alias("level"), "found", F.col("n").alias("checked"))


# The metrics that two results are compared by, and those that are counts.
COMPARED = (
    "median_spread_bps", "median_two_sided_depth_10bps_usd", "trades_per_minute_mean", "trades_per_minute_median", "pct_time_spread_ge_5bps", "data_coverage_pct", "observation_coverage_pct", "maker_markout_5s_median_bps",
    "maker_markout_30s_median_bps", "markout_5s_count", "markout_30s_count", "estimated_maker_fill_rate_5s_conservative", "estimated_maker_fill_rate_30s_conservative", "estimated_maker_fill_rate_5s_optimistic",
    "estimated_maker_fill_rate_30s_optimistic", "estimated_maker_fill_samples",
)
COUNTS = ("markout_5s_count", "markout_30s_count", "estimated_maker_fill_samples")


def snapshot_compare(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = COMPARED, *, exact: tuple[str, ...] = COUNTS, abs_tol: float = 1e-9, rel_tol: float = 1e-6) -> DataFrame:
    """One row for each market and column: both values, their difference, whether they match, and the ``side`` that has the market (``both``, ``before`` or ``after``); one missing on a side matches nowhere."""
    tall = lambda df, name: df.select("market_id", F.stack(F.lit(len(columns)), *(x for c in columns for x in (F.lit(c), F.col(c).cast("double")))).alias("metric", name))
    both = tall(before, "before").withColumn("_l", F.lit(True)).join(tall(after, "after").withColumn("_r", F.lit(True)), ["market_id", "metric"], "full_outer")
    a, b = F.col("before"), F.col("after")
    close = F.greatest(F.lit(abs_tol), rel_tol * F.greatest(F.abs(a), F.abs(b)))
    tolerance = F.when(F.col("metric").isin(*exact), 0.0).otherwise(close) if exact else close
    side = F.when(F.col("_l").isNull(), "after").when(F.col("_r").isNull(), "before").otherwise("both")
    same = F.when(F.col("side") != "both", False).when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.abs(a - b) <= tolerance)
    return both.withColumn("side", side).select("market_id", "metric", "before", "after", F.abs(a - b).alias("difference"), same.alias("matches"), "side")


def score_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of each market with a ``score`` on both sides: the differences of score and of rank by score, after less before."""
    # One row for each market.
    ranked = lambda df, name: df.select("market_id", F.col("score").alias(f"score_{name}"), F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "market_id")).alias(f"rank_{name}"))
    both = ranked(before, "before").join(ranked(after, "after"), "market_id").where(F.col("score_before").isNotNull() & F.col("score_after").isNotNull())
    return both.select("market_id", "score_before", "score_after", (F.col("score_after") - F.col("score_before")).alias("score_delta"), (F.col("rank_after") - F.col("rank_before")).alias("rank_delta"))


def comparison_verdict(compared: DataFrame, deltas: DataFrame, counts: DataFrame, *, large_delta: float = 5.0) -> DataFrame:
    """One row: mismatches of the markets of the later result, score and rank differences, whether the row ``counts`` (``before`` and ``after`` of each table) agree, and the verdict.

    Mismatches, row counts that differ or are zero, and nothing to compare fail; large score
    differences warn.
    """
    ours = F.col("side") != "before"
    bad = F.count_if(ours & ~F.col("matches"))
    d = F.percentile("difference", F.array(F.lit(0.5), F.lit(0.95)))
    one = compared.agg(F.count_if(ours).alias("compared"), bad.alias("mismatches"), d.alias("_d"), F.max("difference").alias("max_difference"))
    score, rank = F.abs("score_delta"), F.abs("rank_delta")
    two = deltas.agg(F.percentile(score, 0.5).alias("median_score_delta"), F.percentile(score, 0.95).alias("p95_score_delta"), F.max(score).alias("max_score_delta"), F.percentile(rank, 0.5).alias("median_rank_delta"), F.max(rank).alias("max_rank_delta"))
    three = counts.agg(F.coalesce(F.every((F.col("before") == F.col("after")) & (F.col("before") > 0)), F.lit(False)).alias("row_counts_match"))
    # One row each.
    rows = one.join(F.broadcast(two), F.lit(True)).join(F.broadcast(three), F.lit(True))
    failed = (F.col("mismatches") > 0) | ~F.col("row_counts_match") | (F.col("compared") == 0)
    verdict = F.when(failed, "FAIL").when(F.col("p95_score_delta") > large_delta, "PASS_WITH_WARNINGS").otherwise("PASS")
    return rows.select("compared", "mismatches", F.col("_d")[0].alias("p50_difference"), F.col("_d")[1].alias("p95_difference"), "max_difference", *two.columns, "row_counts_match", verdict.alias("verdict"))


def event_watermark(tables: dict[str, DataFrame], time: str = "timestamp_ms") -> DataFrame:
    """Latest event of each table and of all (``all``)."""
    each = [df.agg(F.max(time).alias("latest_ms")).withColumn("dataset", F.lit(name)) for name, df in tables.items()]
    union = each[0]
    for x in each[1:]:
        union = union.unionByName(x)
    return union.select("dataset", "latest_ms").union(union.agg(F.max("latest_ms")).select(F.lit("all"), "max(latest_ms)"))


def footer_watermarks(files: dict[str, DataFrame]) -> DataFrame:
    """Latest event of each data set and of all (``all``), from ``sources.tables.footer_watermark`` of each; ``from_footers``: no column had to be read."""
    each = [df.agg(F.max("latest_ms").alias("latest_ms"), F.every("from_statistics").alias("from_footers")).select(F.lit(name).alias("dataset"), "latest_ms", "from_footers") for name, df in files.items()]
    union = each[0]
    for x in each[1:]:
        union = union.unionByName(x)
    return union.union(union.agg(F.max("latest_ms").alias("latest_ms"), F.every("from_footers").alias("from_footers")).select(F.lit("all"), "latest_ms", "from_footers"))


def advance_watermark(stored: DataFrame, uploaded: DataFrame, keys: tuple[str, ...] = ("market_id",), column: str = "durable_ms") -> DataFrame:
    """The stored marks with those of an upload merged in; a mark never goes back, and a key of either side has one."""
    both = stored.select(*keys, column).unionByName(uploaded.select(*keys, column))
    return both.groupBy(*keys).agg(F.max(column).alias(column))


def rolling_window_bounds(latest: DataFrame, run_start_ms: int, *, hours: float | None = 24.0, ended_at_ms: int | None = None) -> DataFrame:
    """Start and end of the analysis from the durable watermark (``latest_ms``, one row); without one the job fails. No hours: the whole run."""
    mark = F.coalesce("latest_ms", F.raise_error(F.lit("no durable watermark")).cast("long"))
    end = F.least(mark, F.lit(ended_at_ms).cast("long"))
    begin = F.lit(run_start_ms) if not hours else F.greatest(F.lit(run_start_ms), end - int(hours * 3_600_000))
    return latest.select(begin.cast("long").alias("start_ms"), end.alias("end_ms"))


def freshness_label(rows: DataFrame, *, ok_minutes: float = 20, warn_minutes: float = 40, grace_minutes: float = 5) -> DataFrame:
    """Status of a source from ``status``, ``started_age``, ``event_age`` (minutes, null: no event), ``sync_failures`` and ``degraded``."""
    age, running = F.col("event_age"), F.col("status") == "running"
    failing = F.col("sync_failures") > 0
    weak = F.col("degraded") | failing
    silent = F.when(running & (F.col("started_age") <= grace_minutes), F.when(weak, "DEGRADED").otherwise("COLLECTING")).when(running & failing, "DEGRADED").when(running, "STALE").otherwise("ERROR")
    label = (
        F.when(F.col("status") == "completed", "COMPLETED").when(F.col("status") == "error", "ERROR").when(age.isNull(), silent)
        .when(age > warn_minutes, F.when(running, "OFFLINE").otherwise(F.upper("status"))).when(age > ok_minutes, "STALE").when(weak & running, "DEGRADED").when(running, "COLLECTING").otherwise(F.upper("status"))
    )
    return rows.withColumn("label", label)


def watermark_gap_check(rows: DataFrame, rotation_s: int = 900) -> DataFrame:
    """Distance of ``durable_ms`` and ``table_ms``: PASS to 300 s, WARN to the rotation, else FAIL."""
    gap = F.abs(F.col("durable_ms") - F.col("table_ms")) / 1000.0
    return rows.withColumn("gap_s", gap).withColumn("level", F.when(gap <= 300, "PASS").when(gap <= max(900, rotation_s), "WARN").otherwise("FAIL"))


def status_rollup(rows: DataFrame, *, error: str | None = None, corrupt_files: int = 0) -> DataFrame:
    """One row: the status of an analysis with its counts."""
    n = F.count(F.lit(1))
    bad = F.lit(error is not None)
    return rows.agg(n.alias("markets"), F.count_if("candidate").alias("candidates"), F.when(bad, "ERROR").when((n == 0) | F.lit(corrupt_files > 0), "DEGRADED").otherwise("OK").alias("status"))


def run_states(runs: DataFrame, now_ms: int, stale_minutes: float = 45.0) -> DataFrame:
    """``runs`` (``status``, ``heartbeat_ms``, ``started_ms``, ``generated_ms``, ``last_success_ms``) with the minutes since a run was last heard of, whether it is running but silent too long, and whether it counts as a success."""
    heard = F.coalesce("heartbeat_ms", "started_ms", "generated_ms")
    age, running = (F.lit(now_ms) - heard) / 60_000.0, F.col("status") == "RUNNING"
    done = F.col("status").isin("OK", "DEGRADED") & F.col("last_success_ms").isNotNull()
    return runs.withColumns({"heard_minutes_ago": age, "stale_running": F.coalesce(running & F.coalesce(age > stale_minutes, F.lit(True)), F.lit(False)), "success": F.coalesce(done, F.lit(False))})


def connection_warnings(shards: DataFrame) -> DataFrame:
    """One row: shards (``connected``, ``planned`` and ``acked`` channels) in numbers, and what is wrong with them."""
    sums = shards.agg(F.count(F.lit(1)).alias("shards"), F.count_if("connected").alias("connected"), F.coalesce(F.sum("planned"), F.lit(0)).alias("planned"), F.coalesce(F.sum("acked"), F.lit(0)).alias("acked"))
    said = [
        F.when(F.col("shards") == 0, "No WebSocket shards planned.").when(F.col("connected") < F.col("shards"), F.format_string("WebSocket degraded: %d/%d shards connected.", "connected", "shards")),
        F.when(F.col("planned") == 0, "No WebSocket subscriptions planned.").when(F.col("acked") < F.col("planned"), F.format_string("Subscription ACK incomplete: %d/%d channels acked.", "acked", "planned")),
    ]
    return sums.withColumn("warnings", F.array_compact(F.array(*said)))


def feed_health_warnings(books: DataFrame, now_ms: int, interval_ms: int = 5_000) -> DataFrame:
    """Of each market, warnings where its usable samples are missing or old."""
    limit = max(3 * interval_ms, 30_000)
    last = books.groupBy("market_id").agg(F.max("timestamp_ms").alias("last_sample_ms"), F.max(F.when(F.col("is_usable"), F.col("timestamp_ms"))).alias("last_usable_ms"))
    old = lambda c: F.lit(now_ms) - F.col(c) > limit
    found = F.array_compact(F.array(F.when(F.col("last_usable_ms").isNull(), "no usable book sample"), F.when(old("last_usable_ms"), "usable book samples are stale"), F.when(old("last_sample_ms"), "book samples are stale")))
    return last.withColumn("warnings", found)


def dq_counters(books: DataFrame, updates: DataFrame) -> DataFrame:
    """Samples, stale samples, resynchronisations (snapshots after the first) and messages out of step of each market."""
    n = books.groupBy("market_id").agg(F.count(F.lit(1)).alias("actual_samples"), F.count_if("is_stale").alias("stale_count"))
    u = messages(updates).groupBy("market_id").agg(F.greatest(F.count_if(F.col("kind") == "snapshot") - 1, F.lit(0)).alias("resync_count"), F.count_if("out_of_step").alias("nonce_gap_count"))
    joined = n.join(u, "market_id", "full_outer")
    return joined.select("market_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("actual_samples", "stale_count", "resync_count", "nonce_gap_count")))


def partition_growth(rows: DataFrame, time: str = "timestamp_ms") -> DataFrame:
    """Rows of each hour of events, and what the mean rate makes in 24 h, 72 h and 30 days."""
    per = rows.groupBy(F.date_format(F.timestamp_millis(F.col(time)), "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("rows"))
    total = rows.agg(F.count(F.lit(1)).alias("_n"), ((F.max(time) - F.min(time)) / 3_600_000.0).alias("_h"))
    rate = F.col("_n") / F.greatest(F.col("_h"), F.lit(1 / 60))
    # One row of totals.
    return per.join(F.broadcast(total), F.lit(True)).select("hour", "rows", *((rate * h).alias(f"rows_{name}") for h, name in ((24, "24h"), (72, "72h"), (720, "30d"))))
