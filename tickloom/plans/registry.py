"""The registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.config import Sampling
from tickloom.functions import columns as C
from tickloom.operators import books, fills, ledger, markouts, quality, rebuild, report, scoring, screening, temporal, trades
from tickloom.plans.analysis import Inputs, market_rows, ranked_markets
from tickloom.plans.oracle_sql import WEIGHTS, T, oracle
from tickloom.sources import tables
from tickloom.sources.fixtures import START_MS, Market
from tickloom.streaming import feed, jobs, stateful

FLAGSHIP = "score_markets"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a few places, as sums of doubles depend on their order."""
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, doubles: str = "", places: int = 6):
    """Register a function of the market tables under its name, with its oracle. ``places``: 9 for stored values, which may end in a 5 at the seventh."""

    def add(f: Callable[[Market], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(Market(spark, sf_dir)), places)
        if sql:
            ORACLES[f.__name__] = oracle(sql, doubles, places)
        return f

    return add


def inputs(m: Market) -> Inputs:
    return Inputs.of(m.books, m.trades, m.markouts, m.start_ms, m.end_ms, m.lifecycle)


def deduped(m: Market) -> DataFrame:
    return books.dedup_books(m.books)


def windows(m: Market) -> DataFrame:
    return books.market_windows(deduped(m), m.start_ms, m.end_ms, m.lifecycle)


def mids(m: Market) -> DataFrame:
    return books.thin_mids(deduped(m))


def regular(m: Market) -> DataFrame:
    return trades.dedup_trades(m.trades)


# Sources and sinks

HALF = f"{START_MS + 120_000} AND {START_MS + 900_000}"


@query(f"SELECT market_id, timestamp_ms, mid, best_bid FROM fx_books WHERE timestamp_ms BETWEEN {HALF} AND market_id IN (1, 3, 5)", "mid best_bid")
def scan_market_table(m):
    return tables.scan_market_table(m.books, START_MS + 120_000, START_MS + 900_000, columns=["market_id", "timestamp_ms", "mid", "best_bid"], market_ids=(1, 3, 5))


@query(f"SELECT 2 - (timestamp_ms >= {START_MS + 600_000})::INT AS layout_depth, count(*) AS rows, max(timestamp_ms) AS latest_ms FROM fx_trades GROUP BY 1")
def discover_layout(m):
    root = jobs.scratch(m.spark, "layout")
    split = START_MS + 600_000
    tables.write_partitioned(m.trades.where(F.col("timestamp_ms") < split), root)
    m.trades.where(F.col("timestamp_ms") >= split).withColumn("date", F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd")).write.mode("append").partitionBy("date").parquet(root)
    return tables.discover_layout(m.spark, root).groupBy("layout_depth").agg(F.count(F.lit(1)).alias("rows"), F.max("timestamp_ms").alias("latest_ms"))


@query("SELECT market_id, timestamp_ms, price, NULL::DOUBLE AS size, NULL::DOUBLE AS reference_mid, ['size', 'reference_mid'] AS absent_columns FROM fx_trades", "price")
def conform_schema(m):
    return tables.conform_schema(m.trades, {"market_id": "int", "timestamp_ms": "long", "price": "double", "size": "double", "reference_mid": "double"})


def _damaged(m: Market) -> str:
    """A folder with a file of trades for each market, and one file of text under a Parquet name."""
    root = jobs.scratch(m.spark, "health")
    m.trades.repartition("market_id").write.partitionBy("market_id").parquet(root)
    m.trades.where("market_id = 0").select(F.lit("PAR1 no Parquet PAR1").alias("value")).coalesce(1).write.text(f"{root}/not")
    tables.rename_files(m.spark, f"{root}/not", f"{root}/bad", ".txt", ".parquet")
    return root


@query("SELECT count(DISTINCT market_id) + 1 AS files, count(DISTINCT market_id) AS valid_files, 1 AS corrupt_files, 'degraded' AS status, ['unreadable footer'] AS reasons FROM fx_trades")
def file_health_scan(m):
    health = tables.file_health(m.spark, _damaged(m))
    reasons = tables.quarantine_list(health).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return tables.file_health_summary(health).join(F.broadcast(reasons), F.lit(True))  # one row each


@query("""SELECT 'books' AS dataset, max(timestamp_ms) AS latest_ms, true AS from_footers FROM fx_books UNION ALL SELECT 'trades', max(timestamp_ms), false FROM fx_trades UNION ALL SELECT 'markouts', max(timestamp_ms), false FROM fx_markouts
  UNION ALL SELECT 'all', greatest((SELECT max(timestamp_ms) FROM fx_books), (SELECT max(timestamp_ms) FROM fx_trades), (SELECT max(timestamp_ms) FROM fx_markouts)), false""")
def dataset_event_watermark(m):
    """From files: those of the books have statistics, those of the trades have none, those of the markouts are of both kinds."""
    root, split = jobs.scratch(m.spark, "footers"), START_MS + 600_000
    write = lambda rows, name, known: rows.write.mode("append").option("parquet.column.statistics.enabled", str(known).lower()).parquet(f"{root}/{name}")
    write(m.books, "books", True)
    write(m.trades, "trades", False)
    write(m.markouts.where(F.col("timestamp_ms") < split), "markouts", True)
    write(m.markouts.where(F.col("timestamp_ms") >= split), "markouts", False)
    return quality.footer_watermarks({name: tables.footer_watermark(m.spark, f"{root}/{name}") for name in ("books", "trades", "markouts")})


@query("SELECT market_id, max(timestamp_ms) AS durable_ms FROM fx_books GROUP BY market_id")
def durable_watermark(m):
    """Marks of four uploads in an order that isn't that of time: a mark never goes back."""
    uploads = [m.books.where((F.floor(F.col("timestamp_ms") / 60_000) % 4) == k).groupBy("market_id").agg(F.max("timestamp_ms").alias("durable_ms")) for k in (3, 0, 2, 1)]
    mark = uploads[0]
    for u in uploads[1:]:
        mark = quality.advance_watermark(mark, u)
    return mark


@query("SELECT strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d') AS day, strftime(make_timestamp(timestamp_ms * 1000), '%H') AS hour, count(*) AS rows, count(DISTINCT market_id) AS markets FROM fx_books GROUP BY 1, 2")
def partitioned_sink(m):
    path = jobs.scratch(m.spark, "sink")
    tables.write_partitioned(m.books, path)
    return m.spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("day"), F.lpad(F.col("hour").cast("string"), 2, "0").alias("hour")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("market_id").alias("markets"))


@query("SELECT strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d') AS day, strftime(make_timestamp(timestamp_ms * 1000), '%H') AS hour, count(*) AS rows, count(DISTINCT market_id) AS markets FROM fx_books GROUP BY 1, 2")
def stream_partitioned_sink(m):
    """A stream appended batch by batch, one of them twice."""
    path, source = jobs.scratch(m.spark, "stream-sink"), jobs.as_stream(m.books, "sink-in")

    def twice(batch: DataFrame, number: int) -> None:
        for _ in range(1 + number % 2):
            feed.append_once(batch, path, number)

    jobs.finish(m.spark, source.writeStream.option("checkpointLocation", jobs.scratch(m.spark, "sink-log")).foreachBatch(twice).trigger(availableNow=True))
    return m.spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("day"), F.lpad(F.col("hour").cast("string"), 2, "0").alias("hour")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("market_id").alias("markets"))


_FED = "CASE WHEN event_id % 23 = 0 THEN user_id % 7 ELSE user_id % 5 END::INT AS market_id, event_id AS trade_id, 1704067200000 + event_id AS timestamp_ms, 100.5e0 + event_id % 9 AS price, 2e0 AS size, CASE WHEN event_id % 4 = 0 THEN 0e0 ELSE 7.25e0 END AS usd_amount, event_id % 2 = 0 AS is_maker_ask, CASE WHEN event_id % 5 = 0 THEN 'liquidation' ELSE 'trade' END AS type, event_id % 19 = 0 AS snapshot, false AS corrupt"
_UNFED = "NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, event_id % 19 = 0, true"


_FEED_SQL = f"""SELECT {_FED} FROM events, (SELECT unnest([1, 2, 3]) AS copy) WHERE event_id % 3 = 0 AND NOT (copy = 3 AND event_id % 6 = 0) UNION ALL SELECT {_FED} FROM events WHERE event_id % 3 = 1 AND event_id % 29 <> 0
  UNION ALL SELECT {_UNFED} FROM events WHERE event_id % 6 = 0 OR (event_id % 3 = 1 AND event_id % 29 = 0) UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false, true FROM region"""


@query(_FEED_SQL, "price size usd_amount")
def feed_ingest(m):
    bad = m.table("region").select(F.lit("{not json").alias("value"))
    others = m.messages.select(F.col("stats_message").alias("value"))
    return tables.feed_trades(m.messages.select(F.col("trade_message").alias("value")).union(bad).union(others))


_STATS_SQL = "SELECT user_id % 5 AS market_id, 'M' || user_id % 5 AS symbol, 100.25e0 + event_id % 9 AS mark_price, NULL::DOUBLE AS index_price, -1.5e0 AS daily_price_change, 1704067200000 + event_id AS updated_at_ms FROM events"


@query(_STATS_SQL, "mark_price daily_price_change")
def feed_market_stats(m):
    return tables.feed_stats(m.messages.select(F.col("stats_message").alias("value"))).select("market_id", "symbol", "mark_price", "index_price", "daily_price_change", "updated_at_ms")


_LEVELS_SQL = """SELECT user_id % 5 AS market_id, 1704067200000 + event_id AS timestamp_ms, event_id AS nonce, CASE WHEN event_id % 7 <> 0 THEN event_id - 1 END AS begin_nonce, CASE WHEN event_id % 11 = 0 THEN 'snapshot' ELSE 'delta' END AS kind, l.side, l.price,
  CASE WHEN l.price = 99.5e0 THEN event_id % 4 WHEN l.price = 100.5e0 THEN 2e0 WHEN l.price = 101e0 THEN 0e0 END::DOUBLE AS size
  FROM (SELECT *, unnest(CASE WHEN event_id % 5 = 0 THEN [NULL] ELSE [{'side': 'bid', 'price': 99.5e0}, {'side': 'ask', 'price': 100.5e0}, {'side': 'ask', 'price': 101e0}] END) AS l FROM events)"""


@query(_LEVELS_SQL, "price size")
def feed_books(m):
    return tables.feed_book_updates(m.messages.select(F.col("book_message").alias("value")))


@query(f"""SELECT 'trades' AS name, count(*) AS rows, sum(price)::DOUBLE AS total, count(*) AS counted FROM ({_FEED_SQL}) WHERE NOT corrupt UNION ALL SELECT 'bad_rows', count(*), NULL, count(*) FROM ({_FEED_SQL}) WHERE corrupt
  UNION ALL SELECT 'market_stats', count(*), sum(mark_price), count(*) FROM ({_STATS_SQL}) UNION ALL SELECT 'book_updates', count(*), sum(price), count(*) FROM ({_LEVELS_SQL})""", "total")
def stream_feed_tables(m):
    """All messages in one stream, to a table of each kind below date and hour; the run is cut in two by a restart, and a batch is written twice."""
    root, log = jobs.scratch(m.spark, "feed"), jobs.scratch(m.spark, "feed-log")
    bad = m.table("region").select(F.lit(0).cast("long").alias("event_id"), F.lit("{not json").alias("value"))
    every = m.messages.select("event_id", F.explode(F.array("trade_message", "stats_message", "book_message")).alias("value")).union(bad)
    source = jobs.as_stream(every, "feed-in", order="event_id")
    feed.feed_to_tables(source.select("value"), root, log)
    feed.write_feed_batch(jobs.batch_of(source, 1).select("value"), 1, root)  # as after a failure
    feed.feed_to_tables(source.select("value"), root, log)
    told = lambda name, value: m.spark.read.parquet(f"{root}/{name}").agg(F.count(F.lit(1)).alias("rows"), F.sum(value).cast("double").alias("total")).withColumn("name", F.lit(name))
    found = told("trades", F.col("price")).union(told("bad_rows", F.lit(None))).union(told("market_stats", F.col("mark_price"))).union(told("book_updates", F.col("price")))
    counted = m.spark.read.parquet(f"{root}/counts").groupBy("name").agg(F.sum("rows").alias("counted"))
    return found.join(counted, "name").select("name", "rows", "total", "counted")


@query("SELECT n_nationkey AS market_id, n_name AS symbol, 'perp' AS market_type, 'active' AS status FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 0")
def market_dimension(m):
    raw = m.table("nation").select(F.col("n_nationkey").alias("market_id"), F.col("n_name").alias("symbol"), F.when(F.col("n_nationkey") % 3 == 0, "spot").otherwise("perp").alias("market_type"), F.when(F.col("n_nationkey") % 4 == 0, "frozen").otherwise("active").alias("status"))
    return tables.market_dimension(raw)


# The whole record of a market; ``nar`` has the texts too.
_EXPORT = ", ".join(f"rank_{c} AS pct_{c}" for c in WEIGHTS)


_EXPORT_D = "score confidence effective_score recommended_max_order_usd median_spread_bps " + " ".join(f"pct_{c}" for c in WEIGHTS)
_LADDER = "[25e0, 50e0, 100e0, 250e0, 500e0, 1000e0]"


@query(f"""SELECT rank, market_id, symbol, score, confidence, effective_score, letter_rank, candidate, total_trade_count, median_spread_bps, list_max(list_filter({_LADDER}, lambda x: x <= 0.25e0 * coalesce(median_two_sided_depth_10bps_usd, median_two_sided_depth_5bps_usd))) AS recommended_max_order_usd,
  array_to_string(pros, ' | ') AS pros, array_to_string(cons, ' | ') AS cons, array_to_string(warnings, ' | ') AS warnings, array_to_string(penalties, ' | ') AS penalties, {', '.join(f'coalesce(median_two_sided_depth_10bps_usd, 0) >= {n * 4} AS fit_{n}' for n in (25, 50, 100, 250, 500, 1000))}, {_EXPORT} FROM nar""", _EXPORT_D)
def export_ranking_csv(m):
    """Written as CSV and read back, with its types; an empty ranking is one row that says so."""
    rows, root = report.ranking_export(ranked_markets(inputs(m))), jobs.scratch(m.spark, "export")
    kept = rows.select("rank", "market_id", "symbol", "letter_rank", "candidate", "total_trade_count", "pros", "cons", "warnings", "penalties", *(f"fit_{n}" for n in (25, 50, 100, 250, 500, 1000)), *_EXPORT_D.split())
    tables.export_csv(kept, f"{root}/some")
    tables.export_csv(kept.where(F.lit(False)), f"{root}/none")
    said = m.spark.read.option("header", True).csv(f"{root}/none").agg(F.count_if(F.col("message") == "no data").alias("_said"))
    back = m.spark.read.schema(kept.schema).option("header", True).option("emptyValue", "").csv(f"{root}/some").fillna("", ["pros", "cons", "warnings", "penalties"])
    return back.join(F.broadcast(said), F.lit(True)).where("_said = 1").drop("_said")  # one row


@query("SELECT 'g1' AS generation, (SELECT count(*) FROM nar) AS markets, (SELECT count(*) FROM nar WHERE candidate) AS candidates, (SELECT count(DISTINCT symbol) FROM nar) AS documents, (SELECT round(sum(round(score, 2)), 1) FROM nar) AS scores, (SELECT symbol FROM nar WHERE rank = 1) AS best", "scores")
def publish_generation(m):
    # Written first: each of the tables would compute it again.
    x, root = tables.written(ranked_markets(inputs(m)), "ranked"), jobs.scratch(m.spark, "published")
    rows = report.market_row_projection(x)
    pointer = tables.publish_generation({"overview": report.overview_rollup(x), "markets": rows, "candidates": rows.where("candidate"), "market": report.market_detail(x)}, root, "g1", by={"market": "symbol"})
    at = f"{root}/generations/g1"
    markets, candidates, documents = (m.spark.read.schema(rows.schema).json(f"{at}/markets"), m.spark.read.schema(rows.schema).json(f"{at}/candidates"), m.spark.read.schema("symbol string, market_id int").json(f"{at}/market"))
    found = markets.agg(F.count(F.lit(1)).alias("markets"), F.round(F.sum("score"), 1).alias("scores"), F.max(F.when(F.col("rank") == 1, F.col("symbol"))).alias("best"))
    for df in (candidates.agg(F.count(F.lit(1)).alias("candidates")), documents.agg(F.countDistinct("symbol").alias("documents")), pointer.select("generation")):
        found = found.join(F.broadcast(df), F.lit(True))  # one row each
    return found


# Projections and filters


@query("SELECT market_id, timestamp_ms FROM fx_books WHERE is_usable OR (is_usable IS NULL AND mid IS NOT NULL)")
def filter_observed_books(m):
    return m.books.where(C.observed()).select("market_id", "timestamp_ms")


@query("SELECT market_id, timestamp_ms FROM fx_books WHERE is_usable OR (is_usable IS NULL AND is_stale = false AND mid IS NOT NULL)")
def filter_metrics_good(m):
    return m.books.where(C.metrics_good()).select("market_id", "timestamp_ms")


_EFF = "CASE WHEN spread_bps IS NOT NULL THEN spread_bps WHEN best_bid > 0 AND best_ask > 0 AND mid > 0 AND best_ask >= best_bid THEN (best_ask - best_bid) / mid * 10000e0 END"


@query(f"SELECT market_id, timestamp_ms, {_EFF} AS effective_spread_bps FROM fx_books", "effective_spread_bps")
def effective_spread(m):
    return m.books.select("market_id", "timestamp_ms", C.effective_spread().alias("effective_spread_bps"))


@query("SELECT market_id, count(*) FILTER (best_bid > 0 AND best_ask > 0 AND mid > 0 AND best_ask >= best_bid) AS valid, count(*) AS rows FROM fx_books GROUP BY market_id")
def valid_bid_ask(m):
    return m.books.groupBy("market_id").agg(F.count_if(C.valid_bid_ask()).alias("valid"), F.count(F.lit(1)).alias("rows"))


@query("SELECT market_id, trade_id, timestamp_ms FROM fx_trades WHERE market_id IN (2, 4)")
def market_set_filter(m):
    rows = m.trades.select("market_id", "trade_id", "timestamp_ms")
    return screening.market_set_filter(rows, (2, 4)).union(screening.market_set_filter(rows, ()))


@query("SELECT market_id, trade_id, timestamp_ms, usd_amount FROM fx_trades WHERE type = 'trade'", "usd_amount")
def regular_trades(m):
    return m.trades.where(C.regular_trade()).select("market_id", "trade_id", "timestamp_ms", "usd_amount")


@query(f"SELECT greatest({START_MS}, max(timestamp_ms) - 3600000) AS start_ms, max(timestamp_ms) AS end_ms FROM fx_books")
def rolling_window_bounds(m):
    latest = m.books.agg(F.max("timestamp_ms").alias("latest_ms"))
    return quality.rolling_window_bounds(latest, START_MS, hours=1.0)


@query("SELECT market_id, timestamp_ms, mid FROM mids", "mid")
def thin_mids(m):
    return mids(m)


def stage1(m: Market) -> DataFrame:
    return screening.stage1(m.books, m.trades, m.markouts, m.start_ms, m.end_ms, m.lifecycle)


_ST1 = "market_id, symbol, first_observed_ms, last_observed_ms, book_observation_count, trade_count, median_spread_bps, median_two_sided_depth_10bps_usd, pct_time_spread_ge_5bps, trades_per_minute_mean, trades_per_minute_median, maker_markout_5s_median_bps, observation_coverage, observation_hours"
_ST1_D = "median_spread_bps median_two_sided_depth_10bps_usd pct_time_spread_ge_5bps trades_per_minute_mean trades_per_minute_median maker_markout_5s_median_bps observation_coverage observation_hours"


@query("""SELECT market_id, symbol, CASE WHEN market_id % 2 = 0 THEN 'selected_incomplete' ELSE 'screened' END AS analysis_stage, median_spread_bps, trade_count AS total_trade_count, CASE WHEN market_id % 2 = 0 THEN maker_markout_5s_median_bps END AS maker_markout_5s_median_bps, NULL::DOUBLE AS score, NULL::BIGINT AS markout_5s_count,
  CASE WHEN market_id % 2 = 0 THEN ['Selected for Stage 2 but full analysis produced no scored row'] ELSE [] END AS warnings FROM st1""", "median_spread_bps maker_markout_5s_median_bps")
def screened_rows(m):
    rows = screening.screened_rows(stage1(m), F.col("market_id") % 2 == 0)
    return rows.select("market_id", "symbol", "analysis_stage", "median_spread_bps", "total_trade_count", "maker_markout_5s_median_bps", "score", "markout_5s_count", "warnings")


_ODD = "CASE WHEN maker_markout_5s_median_bps IS NOT NULL AND total_trade_count = 0 THEN ['markout exists but trade count is zero; possible trade aggregation inconsistency'] ELSE [] END"


@query(f"SELECT market_id, symbol, rank, round(score, 2) AS score, round(effective_score, 2) AS effective_score, round(confidence, 4) AS confidence, confidence_label, letter_rank, candidate, list_slice(pros, 1, 6) AS pros, list_slice(cons, 1, 6) AS cons, list_concat(warnings, {_ODD}) AS warnings FROM nar", "score effective_score confidence")
def market_row_projection(m):
    return report.market_row_projection(ranked_markets(inputs(m)))


@query("SELECT market_id, symbol, letter_rank, round(score, 2) AS score, round(effective_score, 2) AS effective_score, round(confidence, 4) AS confidence, confidence_label, confidence_reasons, median_spread_bps, maker_markout_5s_median_bps, maker_markout_30s_median_bps FROM nar WHERE candidate", "score effective_score confidence median_spread_bps maker_markout_5s_median_bps maker_markout_30s_median_bps")
def market_card(m):
    return report.market_card(ranked_markets(inputs(m)).where("candidate")).drop("confidence_breakdown")


@query("SELECT market_id, symbol, median_spread_bps FROM rnk WHERE contains(lower(symbol), 'm') AND market_id <> 99", "median_spread_bps")
def market_table_query(m):
    return report.market_table_query(ranked_markets(inputs(m)), symbol=" M ", sort="spread").select("market_id", "symbol", "median_spread_bps")


# Deduplication


@query("SELECT market_id, timestamp_ms, mid, spread_bps FROM bk", "mid spread_bps")
def dedup_books(m):
    return deduped(m).select("market_id", "timestamp_ms", "mid", "spread_bps")


@query("SELECT market_id, trade_id, timestamp_ms, price, usd_amount FROM td", "price usd_amount")
def dedup_trades(m):
    return regular(m).select("market_id", "trade_id", "timestamp_ms", "price", "usd_amount")


@query("SELECT market_id, trade_id, horizon_s, timestamp_ms, maker_markout_bps FROM md", "maker_markout_bps")
def dedup_markouts(m):
    return markouts.dedup_markouts(m.markouts).select("market_id", "trade_id", "horizon_s", "timestamp_ms", "maker_markout_bps")


@query("SELECT market_id, trade_id, price FROM td WHERE trade_id % 11 <> 0", "price")
def stream_dedup_trades(m):
    """Of every eleventh trade a snapshot comes five seconds before it, of every seventh one comes three seconds after it."""
    at = lambda rows, ms, snapshot: rows.withColumns({"arrival_ms": F.col("timestamp_ms") + ms, "snapshot": F.lit(snapshot)})
    live = m.trades.where(C.regular_trade())
    told = at(live, 0, False).unionByName(at(live.where("trade_id % 11 = 0"), -5_000, True)).unionByName(at(live.where("trade_id % 7 = 0"), 3_000, True))
    return jobs.run_to_end(feed.dedup_with_warmup(jobs.as_stream(told, "dedup", order="arrival_ms")), "dedup").select("market_id", "trade_id", "price")


# Joins

_PAIRED = ", ".join(f"max(CASE WHEN h = {h} THEN later END) AS mid_{h}s" for h in (5, 30, 60))


@query(f"SELECT market_id, timestamp_ms, mid, {_PAIRED} FROM pairs GROUP BY market_id, timestamp_ms, mid", "mid mid_5s mid_30s mid_60s")
def forward_horizon_pairs(m):
    return books.forward_horizon_pairs(mids(m))


def snapshots(m: Market) -> DataFrame:
    return fills.downsample_snapshots(deduped(m))


@query("SELECT market_id, timestamp_ms, t_ms AS trade_ms, side, usd_amount FROM flow", "usd_amount")
def touch_flow_join(m):
    return fills.touch_flow(snapshots(m), regular(m)).select("market_id", "timestamp_ms", F.col("p_timestamp_ms").alias("trade_ms"), "side", F.col("p_usd_amount").alias("usd_amount"))


@query("SELECT market_id, trade_id, timestamp_ms, reference_mid FROM refm", "reference_mid")
def reference_mid_asof(m):
    return markouts.reference_mids(regular(m), mids(m)).select("market_id", "trade_id", "timestamp_ms", "reference_mid")


@query("SELECT market_id, trade_id, horizon_s, future_mid FROM futm WHERE future_mid IS NOT NULL", "future_mid")
def future_mid_asof(m):
    return markouts.future_mids(regular(m), mids(m)).select("market_id", "trade_id", "horizon_s", "future_mid")


@query("SELECT market_id, minute_idx, trade_count FROM slots")
def minute_slot_spine(m):
    return trades.minute_slots(regular(m), windows(m))


_BOOK_D = "mean_spread_bps median_spread_bps p95_spread_bps median_bbo_depth_usd median_two_sided_depth_10bps_usd funding_rate open_interest latest_book_update_age_seconds p95_book_update_age_seconds observation_coverage_pct usable_quote_coverage_pct spread_coverage_pct"


@query(f"SELECT market_id, symbol, observed_samples, usable_samples, spread_samples, round_even(expected, 0)::BIGINT AS expected_samples, {', '.join(_BOOK_D.split())} FROM covp LEFT JOIN sprd USING (market_id) LEFT JOIN dep USING (market_id) LEFT JOIN lat USING (market_id) LEFT JOIN age USING (market_id)", _BOOK_D)
def assemble_book_row(m):
    return books.book_metrics(deduped(m), windows(m)).select("market_id", "symbol", "observed_samples", "usable_samples", "spread_samples", "expected_samples", *_BOOK_D.split())


_ROW = "observation_coverage_pct data_coverage_pct observation_hours median_spread_bps pct_time_spread_ge_5bps median_two_sided_depth_10bps_usd total_quote_volume trades_per_minute_mean trades_per_minute_median maker_markout_5s_median_bps maker_markout_30s_median_bps estimated_maker_fill_rate_30s_conservative estimated_maker_edge_5s_bps estimated_maker_edge_30s_bps"
_ROW_ALL = ["market_id", "symbol", "total_trade_count", "markout_5s_count", "markout_30s_count", "estimated_maker_fill_samples", *_ROW.split()]


@query(f"SELECT {', '.join(_ROW_ALL)} FROM mr", _ROW)
def assemble_market_row(m):
    return market_rows(inputs(m)).select(*_ROW_ALL)


@query("SELECT market_id, timestamp_ms, bid_eligible_usd_30s, ask_eligible_usd_30s FROM elig", "bid_eligible_usd_30s ask_eligible_usd_30s")
def bid_ask_fill_join(m):
    return fills.touch_flow_eligible(snapshots(m), regular(m)).select("market_id", "timestamp_ms", "bid_eligible_usd_30s", "ask_eligible_usd_30s")


_MW = "market_id, symbol, first_observed_ms, last_observed_ms, effective_start_ms, effective_end_ms, market_observation_seconds"


@query(f"SELECT {_MW} FROM mw", "market_observation_seconds")
def lifecycle_windows(m):
    return windows(m)


@query("SELECT st1.market_id, trade_count, estimated_maker_fill_rate_30s_conservative FROM st1 LEFT JOIN (SELECT market_id, estimated_maker_fill_rate_30s_conservative FROM mr WHERE market_id < 5) USING (market_id)", "estimated_maker_fill_rate_30s_conservative")
def peer_enrichment(m):
    full = market_rows(inputs(m)).where("market_id < 5")
    peers = stage1(m).withColumn("estimated_maker_fill_rate_30s_conservative", F.lit(None).cast("double"))
    return screening.peer_enrichment(peers, full).select("market_id", "trade_count", "estimated_maker_fill_rate_30s_conservative")


@query("SELECT market_id, CASE WHEN market_id < 4 THEN 'full' WHEN market_id < 6 THEN 'selected_incomplete' ELSE 'screened' END AS analysis_stage, st1.median_spread_bps FROM st1", "median_spread_bps")
def merge_stages(m):
    # One row for each market. Written, as the plan of all stages in one is too large for a small driver.
    first = tables.written(stage1(m), "screened")
    measured = tables.written(market_rows(inputs(m)), "measured")
    full = tables.written(scoring.score_markets(measured), "ranked").where("market_id < 4")
    return screening.merge_stages(first, first.where("market_id < 6"), full).select("market_id", "analysis_stage", "median_spread_bps")


@query("SELECT b.market_id, b.timestamp_ms, CASE WHEN b.timestamp_ms - t.timestamp_ms <= 60000 THEN t.usd_amount END AS last_trade_usd FROM bk b ASOF LEFT JOIN td t ON t.market_id = b.market_id AND t.timestamp_ms <= b.timestamp_ms", "last_trade_usd")
def attach_latest_stats(m):
    stats = regular(m).select("market_id", "timestamp_ms", F.col("usd_amount").alias("last_trade_usd"))
    rows = deduped(m).select("market_id", "timestamp_ms")
    return temporal.asof_backward(rows, stats, ["market_id"], ["last_trade_usd"], longest_ms=60_000)


@query("SELECT market_id, 'added' AS change FROM (SELECT DISTINCT market_id::BIGINT AS market_id FROM fx_books) WHERE market_id NOT IN (SELECT market_id FROM fx_lifecycle WHERE market_id <> 4) UNION ALL SELECT market_id, 'removed' FROM fx_lifecycle WHERE market_id NOT IN (SELECT market_id FROM fx_books WHERE market_id <> 2) AND market_id <> 4")
def market_set_diff(m):
    before = m.lifecycle.where("market_id <> 4")
    after = m.books.where("market_id <> 2").select(F.col("market_id").cast("long").alias("market_id"))
    return screening.market_set_diff(before, after.union(m.spark.range(0).select("id")))


ORACLES["market_set_diff"] = oracle("SELECT * FROM (SELECT DISTINCT market_id::BIGINT AS market_id, 'added' AS change FROM fx_books WHERE market_id <> 2 AND market_id NOT IN (SELECT market_id FROM fx_lifecycle WHERE market_id <> 4)) UNION ALL SELECT market_id, 'removed' FROM fx_lifecycle WHERE market_id <> 4 AND market_id NOT IN (SELECT market_id FROM fx_books WHERE market_id <> 2)")


def _two_results(m: Market) -> tuple[DataFrame, DataFrame]:
    """A result, and one that lacks market 8, has a market 77, another spread in market 3, no markout in market 4, one more sample in market 5 and other scores."""
    path = jobs.scratch(m.spark, "result")
    ranked_markets(inputs(m)).select("market_id", "score", *quality.COMPARED).write.parquet(path)
    rows = m.spark.read.parquet(path)
    at = lambda k, c, x: F.when(F.col("market_id") == k, x).otherwise(F.col(c)).alias(c)
    changed = {"median_spread_bps": at(3, "median_spread_bps", F.col("median_spread_bps") + 0.5), "maker_markout_5s_median_bps": at(4, "maker_markout_5s_median_bps", None), "estimated_maker_fill_samples": at(5, "estimated_maker_fill_samples", F.col("estimated_maker_fill_samples") + 1), "trades_per_minute_mean": F.col("trades_per_minute_mean") * (1 + 1e-7)}
    after = rows.where("market_id <> 8").select(at(2, "market_id", F.lit(77)).cast("int").alias("market_id"), (F.col("score") + F.col("market_id") % 4).alias("score"), *(changed.get(c, F.col(c)).alias(c) for c in quality.COMPARED))
    return rows, after


_TALL_METRICS = ", ".join(f"{{'metric': '{c}', 'v': {c}::DOUBLE}}" for c in quality.COMPARED)
_COMPARE_SQL = f"""SELECT market_id, metric, before, after, abs(after - before) AS difference, side,
  CASE WHEN side <> 'both' THEN false WHEN before IS NULL OR after IS NULL THEN before IS NULL AND after IS NULL WHEN metric IN ('markout_5s_count', 'markout_30s_count', 'estimated_maker_fill_samples') THEN before = after ELSE abs(after - before) <= greatest(1e-9, 1e-6 * greatest(abs(before), abs(after))) END AS matches
  FROM (SELECT coalesce(a.market_id, b.market_id) AS market_id, coalesce(a.metric, b.metric) AS metric, a.v AS before, b.v AS after, CASE WHEN a.metric IS NULL THEN 'after' WHEN b.metric IS NULL THEN 'before' ELSE 'both' END AS side
    FROM (SELECT market_id, x.metric, x.v FROM (SELECT market_id, unnest([{_TALL_METRICS}]) AS x FROM rnk)) a
    FULL JOIN (SELECT CASE WHEN market_id = 2 THEN 77 ELSE market_id END AS market_id, x.metric,
        CASE WHEN market_id = 3 AND x.metric = 'median_spread_bps' THEN x.v + 0.5e0 WHEN market_id = 4 AND x.metric = 'maker_markout_5s_median_bps' THEN NULL WHEN market_id = 5 AND x.metric = 'estimated_maker_fill_samples' THEN x.v + 1 WHEN x.metric = 'trades_per_minute_mean' THEN x.v * (1 + 1e-7) ELSE x.v END AS v
      FROM (SELECT market_id, unnest([{_TALL_METRICS}]) AS x FROM rnk WHERE market_id <> 8)) b ON a.market_id = b.market_id AND a.metric = b.metric)"""
_DELTA_SQL = """SELECT market_id, a.score AS score_before, b.score AS score_after, b.score - a.score AS score_delta, b.r - a.r AS rank_delta FROM (SELECT market_id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, market_id) AS r FROM rnk) a
  JOIN (SELECT market_id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, market_id) AS r FROM (SELECT CASE WHEN market_id = 2 THEN 77 ELSE market_id END AS market_id, score + market_id % 4 AS score FROM rnk WHERE market_id <> 8)) b USING (market_id)"""


@query(_COMPARE_SQL, "before after difference")
def snapshot_compare_join(m):
    return quality.snapshot_compare(*_two_results(m))


@query(_DELTA_SQL, "score_before score_after score_delta")
def snapshot_score_deltas(m):
    return quality.score_deltas(*_two_results(m))


# Aggregations


@query("SELECT market_id, observed_samples, usable_samples, spread_samples FROM cov")
def book_coverage_counts(m):
    return books.coverage_counts(deduped(m))


@query("SELECT * FROM sprd", "mean_spread_bps p10_spread_bps p25_spread_bps median_spread_bps p75_spread_bps p90_spread_bps p95_spread_bps")
def spread_distribution(m):
    return books.spread_distribution(deduped(m))


@query("SELECT * FROM sprd", "mean_spread_bps p10_spread_bps p25_spread_bps median_spread_bps p75_spread_bps p90_spread_bps p95_spread_bps")
def spread_percentiles_selected(m):
    """By selection of ranks, which no market is too large for; so are the three queries named alike."""
    return books.spread_distribution(deduped(m), by_selection=True)


@query("SELECT * FROM dep", "median_bbo_depth_usd median_two_sided_depth_5bps_usd median_two_sided_depth_10bps_usd median_two_sided_depth_25bps_usd")
def depth_medians(m):
    return books.depth_medians(deduped(m))


@query("SELECT * FROM dep", "median_bbo_depth_usd median_two_sided_depth_5bps_usd median_two_sided_depth_10bps_usd median_two_sided_depth_25bps_usd")
def depth_medians_selected(m):
    return books.depth_medians(deduped(m), by_selection=True)


@query("SELECT * FROM lat", "current_funding_rate funding_rate open_interest daily_quote_volume_usd")
def latest_values(m):
    return books.latest_values(deduped(m))


@query("SELECT * FROM age", "latest_book_update_age_seconds p95_book_update_age_seconds")
def book_update_age(m):
    return books.book_update_age(deduped(m))


@query(f"SELECT {_MW} FROM mw", "market_observation_seconds")
def market_windows(m):
    return windows(m)


@query("SELECT market_id, round_even(expected, 0)::BIGINT AS expected_samples, observation_coverage_pct, usable_quote_coverage_pct, spread_coverage_pct, observation_coverage_pct AS data_coverage_pct FROM covp", "observation_coverage_pct usable_quote_coverage_pct spread_coverage_pct data_coverage_pct")
def coverage_pct(m):
    counted = windows(m).join(books.coverage_counts(deduped(m)), "market_id")
    return books.coverage_pct(counted).select("market_id", "expected_samples", "observation_coverage_pct", "usable_quote_coverage_pct", "spread_coverage_pct", "data_coverage_pct")


@query("SELECT * FROM pers", " ".join(f"pct_time_spread_ge_{t}bps" for t in T))
def spread_persistence(m):
    return books.spread_persistence(deduped(m))


@query("""SELECT market_id, threshold_bps, count(*) AS event_count, quantile_cont(seconds, 0.5) AS median_duration_seconds, quantile_cont(seconds, 0.9) AS p90_duration_seconds, max(seconds) AS max_duration_seconds FROM (
  SELECT market_id, threshold_bps, run, sum(dt) AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY market_id, threshold_bps ORDER BY timestamp_ms) - row_number() OVER (PARTITION BY market_id, threshold_bps, spread >= threshold_bps ORDER BY timestamp_ms) AS run
    FROM steps CROSS JOIN (SELECT unnest([1, 2, 3, 5, 10, 20, 50]) AS threshold_bps)) WHERE spread >= threshold_bps GROUP BY 1, 2, 3) GROUP BY 1, 2""", "median_duration_seconds p90_duration_seconds max_duration_seconds")
def spread_episodes(m):
    return books.spread_episodes(deduped(m))


@query("SELECT * FROM volc", "p50_abs_mid_move_1s_bps p90_abs_mid_move_1s_bps p95_abs_mid_move_1s_bps")
def volatility_consecutive(m):
    return books.volatility_consecutive(mids(m))


@query("SELECT * FROM volh", " ".join(f"p{p}_abs_mid_move_{h}s_bps" for p in (50, 90, 95) for h in (5, 30, 60)))
def volatility_horizons(m):
    return books.volatility_horizons(mids(m))


@query("SELECT * FROM volh", " ".join(f"p{p}_abs_mid_move_{h}s_bps" for p in (50, 90, 95) for h in (5, 30, 60)))
def volatility_selected(m):
    return books.volatility_horizons(mids(m), by_selection=True)


@query("SELECT * FROM tot", "total_quote_volume median_trade_size_usd")
def trade_totals(m):
    return trades.trade_totals(regular(m))


@query("SELECT * FROM gap", "median_intertrade_ms")
def intertrade_gap(m):
    return trades.intertrade_gap(regular(m))


@query("SELECT market_id, trades_per_minute_mean, trades_per_minute_median, trades_per_minute_p90 FROM tpm", "trades_per_minute_mean trades_per_minute_median trades_per_minute_p90")
def trades_per_minute(m):
    return trades.trades_per_minute(regular(m), windows(m))


_MK_D = " ".join(f"maker_markout_{h}s_mean_bps maker_markout_{h}s_median_bps" for h in (1, 5, 30, 60)) + " maker_markout_5s_positive_ratio maker_markout_30s_positive_ratio"


@query("SELECT * FROM mk", _MK_D)
def markout_stats(m):
    return markouts.markout_stats(markouts.dedup_markouts(m.markouts))


@query("SELECT * FROM mk", _MK_D)
def markout_medians_selected(m):
    return markouts.markout_stats(markouts.dedup_markouts(m.markouts), by_selection=True)


@query("SELECT * FROM snap", "best_bid best_ask best_bid_size_usd best_ask_size_usd", 9)
def downsample_snapshots(m):
    return snapshots(m)


@query("SELECT * FROM elig", "best_bid best_ask best_bid_size_usd best_ask_size_usd bid_eligible_usd_5s bid_eligible_usd_30s ask_eligible_usd_5s ask_eligible_usd_30s", 9)
def touch_flow_eligible(m):
    return fills.touch_flow_eligible(snapshots(m), regular(m))


_RATE_D = " ".join(f"{s}_{o}_{h}s_{z}" for z in (25, 50, 100) for h in (5, 30) for o in ("optimistic", "conservative") for s in ("bid", "ask", "mkt"))


def rates(m: Market) -> DataFrame:
    return fills.fill_rates(fills.touch_flow_eligible(snapshots(m), regular(m)))


@query("SELECT * FROM rates", _RATE_D)
def fill_rates(m):
    return rates(m)


_FST_D = " ".join(f"estimated_maker_fill_rate_{h}s_{o}" for h in (5, 30) for o in ("optimistic", "conservative"))


@query("SELECT f.*, CASE WHEN estimated_maker_fill_samples >= 100 THEN ask_conservative_5s_25 END AS ask_conservative_5s_25 FROM fst f JOIN (SELECT market_id, ask_conservative_5s_25 FROM rates) USING (market_id)", _FST_D + " ask_conservative_5s_25")
def fill_stats_row(m):
    rows = fills.fill_stats(rates(m))
    return rows.withColumn("ask_conservative_5s_25", F.col("estimated_maker_fill_by_size")["25"]["5s"]["ask_conservative"]).drop("estimated_maker_fill_by_size")


@query("SELECT market_id, estimated_maker_fill_rate_5s_conservative * (maker_markout_5s_median_bps - 1.5e0) AS estimated_maker_edge_5s_bps, estimated_maker_fill_rate_30s_conservative * (maker_markout_30s_median_bps - 1.5e0) AS estimated_maker_edge_30s_bps, true AS estimated_maker_edge_fee_included FROM mr", "estimated_maker_edge_5s_bps estimated_maker_edge_30s_bps")
def maker_edge(m):
    rows = fills.maker_edge(market_rows(inputs(m)), F.lit(0.00015))
    return rows.select("market_id", "estimated_maker_edge_5s_bps", "estimated_maker_edge_30s_bps", "estimated_maker_edge_fee_included")


@query("SELECT count(*) AS rows, count(price) AS with_price, count(is_maker_ask) AS with_side, count(*) = 0 OR (count(price) > 0 AND count(is_maker_ask) > 0) AS available FROM fx_trades")
def field_availability_gate(m):
    return fills.field_availability(m.trades)


@query(f"SELECT {_ST1} FROM st1", _ST1_D)
def stage1_screening(m):
    return stage1(m)


_BARS_SQL = """SELECT market_id, timestamp_ms // 60000 * 60000 AS minute_ms, count(*) FILTER (type = 'trade') AS trade_count, coalesce(sum(usd_amount) FILTER (type = 'trade'), 0e0) AS trade_quote_volume_usd,
  coalesce(sum(usd_amount / price) FILTER (type = 'trade'), 0e0) AS trade_base_volume, count(*) FILTER (type = 'trade' AND is_maker_ask) AS buy_taker_count, count(*) FILTER (type = 'trade' AND NOT is_maker_ask) AS sell_taker_count,
  coalesce(sum(usd_amount) FILTER (type = 'trade' AND is_maker_ask), 0e0) AS buy_taker_volume_usd, coalesce(sum(usd_amount) FILTER (type = 'trade' AND NOT is_maker_ask), 0e0) AS sell_taker_volume_usd,
  quantile_cont(usd_amount, 0.5) FILTER (type = 'trade') AS median_trade_size_usd, avg(usd_amount) FILTER (type = 'trade') AS mean_trade_size_usd, quantile_cont(gap, 0.5) AS median_intertrade_ms,
  count(*) FILTER (type <> 'trade') AS liquidation_count, coalesce(sum(usd_amount) FILTER (type <> 'trade'), 0e0) AS liquidation_volume_usd
  FROM tall LEFT JOIN (SELECT market_id, trade_id, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY market_id ORDER BY timestamp_ms, trade_id) AS gap FROM tall WHERE type = 'trade') g USING (market_id, trade_id) GROUP BY 1, 2"""


@query(_BARS_SQL, "trade_quote_volume_usd trade_base_volume buy_taker_volume_usd sell_taker_volume_usd median_trade_size_usd mean_trade_size_usd median_intertrade_ms liquidation_volume_usd")
def minute_bars(m):
    return trades.minute_bars(m.trades)


_DQ_SQL = """SELECT coalesce(b.market_id, u.market_id) AS market_id, coalesce(actual_samples, 0) AS actual_samples, coalesce(stale_count, 0) AS stale_count, coalesce(resync_count, 0) AS resync_count, coalesce(nonce_gap_count, 0) AS nonce_gap_count FROM
  (SELECT market_id, count(*) AS actual_samples, count(*) FILTER (is_stale) AS stale_count FROM bk GROUP BY market_id) b FULL JOIN
  (SELECT market_id, greatest(max(episode) - 1, 0) AS resync_count, count(DISTINCT CASE WHEN episode > 0 AND kind = 'delta' AND begin_nonce IS DISTINCT FROM before THEN episode END) AS nonce_gap_count FROM msg GROUP BY market_id) u ON u.market_id = b.market_id"""


@query(_DQ_SQL)
def dq_counters(m):
    return quality.dq_counters(deduped(m), m.updates)


@query(_DQ_SQL)
def stream_dq_counters(m):
    return feed.dq_counters_stream(jobs.as_stream(m.books, "dq-books"), jobs.as_stream(m.updates, "dq-updates", order="nonce"), "dq")


@query("SELECT count(median_spread_bps) AS n, " + ", ".join(f"quantile_cont(median_spread_bps, {p / 100}) AS p{p}" for p in (10, 25, 50, 75, 90, 95)) + " FROM mr", "p10 p25 p50 p75 p90 p95")
def cross_section_stats(m):
    return scoring.cross_section_stats(market_rows(inputs(m)), "median_spread_bps")


@query("SELECT count(*) AS markets, count(*) FILTER (candidate) AS candidates, avg(coalesce(observation_coverage_pct, data_coverage_pct)) AS mean_coverage_pct, arg_min(symbol, rank) FILTER (candidate) AS top_candidate, count(*) FILTER (maker_markout_5s_median_bps IS NOT NULL AND total_trade_count = 0) AS inconsistent_markets, CASE WHEN count(*) = 0 THEN 'DEGRADED' ELSE 'OK' END AS status, list_filter([CASE WHEN avg(coalesce(observation_coverage_pct, data_coverage_pct)) < 80 THEN 'low data coverage' END, CASE WHEN avg(coalesce(observation_coverage_pct, data_coverage_pct)) < 90 THEN 'candidate ranking is provisional' END, CASE WHEN count(*) FILTER (maker_markout_5s_median_bps IS NOT NULL AND total_trade_count = 0) > 0 THEN 'markout without trades' END], lambda x: x IS NOT NULL) AS warnings FROM rnk", "mean_coverage_pct")
def overview_rollup(m):
    return report.overview_rollup(ranked_markets(inputs(m)))


@query("SELECT (SELECT count(*) FROM fx_books) AS raw_books, (SELECT count(*) FROM bk) AS dedup_books, (SELECT count(*) FROM fx_trades) AS raw_trades, (SELECT count(*) FROM td) AS dedup_trades, (SELECT max(timestamp_ms) FROM fx_books) AS latest_ms")
def window_row_stats(m):
    a = m.books.agg(F.count(F.lit(1)).alias("raw_books"), F.countDistinct("market_id", "timestamp_ms").alias("dedup_books"), F.max("timestamp_ms").alias("latest_ms"))
    kept = F.when(C.regular_trade(), F.struct("market_id", "trade_id"))
    b = m.trades.agg(F.count(F.lit(1)).alias("raw_trades"), F.countDistinct(kept).alias("dedup_trades"))
    return a.join(F.broadcast(b), F.lit(True))  # one row each


@query("SELECT strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d %H') AS hour, count(*) AS rows, any_value(rate) * 24 AS rows_24h, any_value(rate) * 72 AS rows_72h, any_value(rate) * 720 AS rows_30d FROM fx_books CROSS JOIN (SELECT count(*) / greatest((max(timestamp_ms) - min(timestamp_ms)) / 3600000e0, 1e0 / 60e0) AS rate FROM fx_books) GROUP BY 1", "rows_24h rows_72h rows_30d")
def partition_growth(m):
    return quality.partition_growth(m.books)


# Ranks and scores


@query("SELECT market_id, median_spread_bps, ((SELECT count(*) FILTER (y.median_spread_bps < x.median_spread_bps) + 0.5e0 * count(*) FILTER (y.median_spread_bps = x.median_spread_bps) FROM sprd y) / (SELECT count(*) FROM sprd)) * 100e0 AS spread_rank FROM sprd x", "median_spread_bps spread_rank")
def mid_rank_percentile(m):
    return scoring.mid_ranks(books.spread_distribution(deduped(m)).select("market_id", "median_spread_bps"), {"median_spread_bps": "spread_rank"})


_RK = [f"rank_{c}" for c in WEIGHTS]


@query(f"SELECT market_id, {', '.join(_RK)} FROM rk", " ".join(_RK))
def rank_components(m):
    return scoring.rank_components(market_rows(inputs(m))).select("market_id", *_RK)


@query("SELECT market_id, weighted_score FROM ws", "weighted_score")
def weighted_score(m):
    return scoring.weighted_score(scoring.rank_components(market_rows(inputs(m)))).select("market_id", "weighted_score")


@query("SELECT market_id, score, hard_penalty, penalties FROM scr", "score")
def score_penalties(m):
    return scoring.score_penalties(scoring.weighted_score(scoring.rank_components(market_rows(inputs(m))))).select("market_id", "score", "hard_penalty", "penalties")


@query("SELECT market_id, candidate FROM can")
def candidate_gate(m):
    return ranked_markets(inputs(m)).select("market_id", "candidate")


@query("SELECT market_id, letter_rank FROM ltr")
def letter_rank(m):
    return ranked_markets(inputs(m)).select("market_id", "letter_rank")


@query("SELECT market_id, confidence, confidence_label, confidence_reasons, c5 AS markout_5s, cf AS estimated_fill, cc AS coverage, cd AS duration FROM fin", "confidence markout_5s estimated_fill coverage duration")
def market_confidence(m):
    b = F.col("confidence_breakdown")
    return ranked_markets(inputs(m)).select("market_id", "confidence", "confidence_label", "confidence_reasons", b["markout_5s"].alias("markout_5s"), b["estimated_fill"].alias("estimated_fill"), b["coverage"].alias("coverage"), b["duration"].alias("duration"))


@query("SELECT market_id, rank, effective_score, score FROM rnk", "effective_score score")
def rank_markets(m):
    return ranked_markets(inputs(m)).select("market_id", "rank", "effective_score", "score")


@query("SELECT market_id, eligible, screening_score FROM sc1", "screening_score")
def screening_score(m):
    return screening.screening_score(stage1(m)).select("market_id", "eligible", "screening_score")


@query("SELECT market_id FROM (SELECT market_id FROM sc1 WHERE eligible ORDER BY screening_score DESC, market_id LIMIT 4) UNION SELECT market_id FROM st1 WHERE market_id IN (0, 9)")
def select_top_n(m):
    return screening.select_top_n(screening.screening_score(stage1(m)), 4, (0, 9))


@query("SELECT market_id, median_spread_bps, letter_rank FROM rnk WHERE coalesce(median_spread_bps, 0) >= 5 AND (letter_rank IN ('C', 'D') OR coalesce(maker_markout_5s_median_bps, 0) < 0 OR coalesce(trades_per_minute_median, 0) < 0.5 OR coalesce(median_two_sided_depth_10bps_usd, 0) < 300) ORDER BY median_spread_bps DESC, rank LIMIT 10", "median_spread_bps")
def avoid_list(m):
    return report.avoid_list(ranked_markets(inputs(m))).select("market_id", "median_spread_bps", "letter_rank")


@query(f"SELECT market_id, list_max(list_filter({_LADDER}, lambda x: x <= 0.25e0 * coalesce(median_two_sided_depth_10bps_usd, median_two_sided_depth_5bps_usd))) AS recommended_max_order_usd FROM dep", "recommended_max_order_usd")
def recommended_max_order(m):
    return books.depth_medians(deduped(m)).select("market_id", C.recommended_order(F.col("median_two_sided_depth_5bps_usd"), F.col("median_two_sided_depth_10bps_usd")).alias("recommended_max_order_usd"))


@query(f"SELECT market_id, {', '.join(f'median_two_sided_depth_10bps_usd >= {n * 4} AS fit_{n}' for n in (25, 50, 100, 250, 500, 1000))} FROM dep")
def size_fit(m):
    fit = C.size_fit(F.col("median_two_sided_depth_10bps_usd"))
    return books.depth_medians(deduped(m)).select("market_id", *(fit[f"fit_{n}"].alias(f"fit_{n}") for n in (25, 50, 100, 250, 500, 1000)))


@query("SELECT market_id, pros, cons, warnings FROM nar")
def narratives(m):
    return ranked_markets(inputs(m)).select("market_id", "pros", "cons", "warnings")


def live(m: Market) -> DataFrame:
    latest = deduped(m).groupBy("market_id").agg(F.max_by(F.struct("spread_bps", F.col("two_sided_depth_10bps_usd").alias("depth_10bps"), "is_usable"), F.when(F.col("mid").isNotNull(), F.col("timestamp_ms"))).alias("r")).select("market_id", "r.*")
    tpm = trades.trade_totals(regular(m)).select("market_id", (F.col("total_trade_count") / 60.0).alias("tpm"))
    marks = markouts.recent_markout_mean(markouts.dedup_markouts(m.markouts)).select("market_id", F.col("recent_markout_mean_bps").alias("markout_5s"))
    return latest.join(tpm, "market_id", "left").join(marks, "market_id", "left")


_LIVE_SQL = """SELECT market_id, least(coalesce(spread_bps, 0e0), 50e0) * 0.4e0 + least(coalesce(depth, 0e0) / 1000e0, 30e0) + least(coalesce(total_trade_count / 60e0, 0e0), 40e0) * 0.5e0 + coalesce(CASE WHEN recent < -10 THEN -10e0 ELSE recent END, -5e0) AS live_score FROM (
  SELECT market_id, arg_max(r, timestamp_ms).s AS spread_bps, arg_max(r, timestamp_ms).d AS depth, arg_max(r, timestamp_ms).u AS u FROM (SELECT market_id, timestamp_ms, {'s': spread_bps, 'd': two_sided_depth_10bps_usd, 'u': is_usable} AS r FROM bk WHERE mid IS NOT NULL) GROUP BY market_id)
  LEFT JOIN tot USING (market_id) LEFT JOIN (SELECT market_id, avg(maker_markout_bps) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY timestamp_ms DESC, trade_id DESC) AS n FROM md WHERE horizon_s = 5) WHERE n <= 200 GROUP BY market_id) USING (market_id) WHERE u ORDER BY live_score DESC, market_id LIMIT 5"""


@query(_LIVE_SQL, "live_score")
def live_top_n(m):
    return screening.live_top_n(live(m), 5).select("market_id", "live_score")


_TALL = " UNION ALL ".join(f"SELECT market_id, symbol, '{n}' AS metric, {c}::DOUBLE AS value FROM rnk" for c, n in report.METRICS.items())


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC NULLS LAST, market_id) AS place FROM ({_TALL})) WHERE place <= 15", "value")
def metric_leaders(m):
    return report.metric_leaders(ranked_markets(inputs(m)))


_EXISTS = "(count(*) FILTER (candidate AND letter_rank IN ('A', 'B')) > 0 OR (count(*) FILTER (candidate) >= 3 AND coalesce(max(CASE WHEN rank = 1 THEN score END) >= 55, false)))"
_SIZED = ", ".join(f"CASE WHEN count(*) FILTER (candidate AND coalesce(median_two_sided_depth_10bps_usd, 0) >= {n * 4}) > 0 THEN list_slice(list(symbol ORDER BY rank) FILTER (candidate AND coalesce(median_two_sided_depth_10bps_usd, 0) >= {n * 4}), 1, 5) ELSE list_slice(list(symbol ORDER BY rank) FILTER (rank <= 3), 1, 3) END AS symbols_{n}" for n in (100, 500, 1000))


@query(f"SELECT count(*) FILTER (candidate) AS candidates, {_EXISTS} AS \"exists\", {_EXISTS} AND count(*) FILTER (candidate AND letter_rank = 'A') > 0 AS proceed, {_SIZED} FROM rnk")
def executive_answers(m):
    return report.executive_answers(ranked_markets(inputs(m)))


_SC_D = "score confidence effective_score median_spread_bps " + " ".join(_RK)


@query(f"SELECT rank, market_id, symbol, candidate, letter_rank, confidence_label, penalties, {', '.join(_SC_D.split())} FROM rnk", _SC_D)
def score_markets(m):
    return ranked_markets(inputs(m)).select("rank", "market_id", "symbol", "candidate", "letter_rank", "confidence_label", "penalties", *_SC_D.split())


@query("SELECT market_id, rank, effective_score FROM rnk ORDER BY rank LIMIT 500", "effective_score")
def top_records(m):
    return ranked_markets(inputs(m)).orderBy("rank").limit(500).select("market_id", "rank", "effective_score")


@query("SELECT market_id, timestamp_ms, 0 AS priority, trade_id, price, usd_amount, NULL::DOUBLE AS best_bid, NULL::DOUBLE AS best_ask, NULL::DOUBLE AS mid FROM td UNION ALL SELECT market_id, timestamp_ms, 1, NULL, NULL, NULL, best_bid, best_ask, mid FROM bo", "price usd_amount best_bid best_ask mid", 9)
def event_timeline(m):
    return report.event_timeline(regular(m), books.observed_books(deduped(m)))


@query("SELECT DISTINCT market_id FROM (SELECT market_id FROM fx_books UNION SELECT market_id FROM fx_trades UNION SELECT market_id FROM fx_markouts)")
def market_id_union(m):
    return m.books.select("market_id").union(m.trades.select("market_id")).union(m.markouts.select("market_id")).distinct()


# Column functions


@query("SELECT market_id, timestamp_ms, CASE WHEN best_bid > 0 AND best_ask > 0 AND best_bid <= best_ask THEN (best_bid + best_ask) / 2e0 END AS safe_mid FROM fx_books", "safe_mid")
def safe_mid(m):
    return m.books.select("market_id", "timestamp_ms", C.safe_mid(F.col("best_bid"), F.col("best_ask")).alias("safe_mid"))


@query("SELECT market_id, timestamp_ms, CASE WHEN mid > 0 THEN (best_ask - best_bid) / mid * 10000e0 END AS move_bps FROM fx_books", "move_bps")
def bps_move(m):
    return m.books.select("market_id", "timestamp_ms", C.bps_move(F.col("best_ask") - F.col("best_bid"), F.col("mid")).alias("move_bps"))


@query("SELECT market_id, trade_id, horizon_s, CASE WHEN reference_mid > 0 THEN CASE WHEN is_maker_ask THEN price - future_mid ELSE future_mid - price END / reference_mid * 10000e0 END AS maker_markout_bps, is_maker_ask AS taker_is_buy FROM futm WHERE future_mid IS NOT NULL AND reference_mid IS NOT NULL", "maker_markout_bps")
def markout_bps(m):
    return markouts.compute_markouts(regular(m), mids(m)).select("market_id", "trade_id", "horizon_s", "maker_markout_bps", F.col("is_maker_ask").alias("taker_is_buy"))


@query("SELECT market_id, count(*) FILTER (is_maker_ask) AS buys, count(*) FILTER (NOT is_maker_ask) AS sells, coalesce(sum(usd_amount) FILTER (is_maker_ask), 0e0) AS bought_usd FROM fx_trades GROUP BY market_id", "bought_usd")
def taker_is_buy(m):
    buys = C.taker_is_buy(F.col("is_maker_ask"))
    return m.trades.groupBy("market_id").agg(F.count_if(buys).alias("buys"), F.count_if(~buys).alias("sells"), F.coalesce(F.sum(F.when(buys, F.col("usd_amount"))), F.lit(0.0)).alias("bought_usd"))


@query("SELECT market_id, estimated_maker_fill_samples AS n, estimated_maker_fill_sample_quality AS quality FROM fst")
def sample_quality(m):
    return rates(m).select("market_id", F.col("estimated_maker_fill_samples").alias("n"), C.sample_quality(F.col("estimated_maker_fill_samples")).alias("quality"))


@query("SELECT market_id, timestamp_ms, coalesce(funding_rate, 0e0) * 10000e0 AS fee_bps FROM fx_books", "fee_bps")
def fee_rate_to_bps(m):
    return m.books.select("market_id", "timestamp_ms", C.fee_rate_to_bps(F.col("funding_rate")).alias("fee_bps"))


@query("SELECT market_id, timestamp_ms, timestamp_ms // 30000 AS bucket FROM fx_books")
def snapshot_bucket(m):
    return m.books.select("market_id", "timestamp_ms", C.snapshot_bucket(F.col("timestamp_ms")).alias("bucket"))


@query("SELECT market_id, ceil(market_observation_seconds / 3600e0 * 3600000e0 / 30000e0)::BIGINT AS most FROM mw")
def max_snapshots(m):
    return windows(m).select("market_id", C.max_snapshots(F.col("market_observation_seconds") / 3600.0).alias("most"))


@query("SELECT market_id, total_trade_count / (total_trade_count + 300e0) AS confidence FROM tot", "confidence")
def hill_confidence(m):
    return trades.trade_totals(regular(m)).select("market_id", C.hill(F.col("total_trade_count"), 300.0).alias("confidence"))


@query("SELECT market_id, 1e0 - exp(-(market_observation_seconds / 3600e0) / 24e0) AS confidence FROM mw", "confidence")
def duration_confidence(m):
    return windows(m).select("market_id", C.duration_confidence(F.col("market_observation_seconds") / 3600.0, 24.0).alias("confidence"))


@query("SELECT market_id, x, CASE WHEN x >= 99 THEN 1e0 WHEN x <= 80 THEN x / 80e0 * 0.5e0 WHEN x <= 90 THEN 0.5e0 + (x - 80e0) / 10e0 * 0.3e0 WHEN x <= 95 THEN 0.8e0 + (x - 90e0) / 5e0 * 0.15e0 ELSE 0.95e0 + (x - 95e0) / 4e0 * 0.05e0 END AS confidence FROM (SELECT market_id, usable_quote_coverage_pct - 3e0 * market_id AS x FROM covp)", "x confidence")
def coverage_confidence(m):
    """The coverages less a few percent by market, so that all pieces of the line are met."""
    rows = books.book_metrics(deduped(m), windows(m)).select("market_id", (F.col("usable_quote_coverage_pct") - 3.0 * F.col("market_id")).alias("x"))
    return rows.withColumn("confidence", C.coverage_confidence(F.col("x")))


@query("SELECT market_id, " + ", ".join(f"CASE WHEN {c} IS NULL OR {c} < 0 THEN 'missing' WHEN {c} = 0 THEN 'zero' ELSE 'value' END AS {c}_state" for c in ("markout_5s_count", "markout_30s_count", "estimated_maker_fill_samples", "total_trade_count", "observation_hours")) + " FROM mr")
def sample_state(m):
    return scoring.sample_states(market_rows(inputs(m)))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.missing') AS DOUBLE), try_cast(value AS DOUBLE)) AS number FROM events", "number")
def first_present_number(m):
    return m.table("events").select("event_id", C.first_number(F.get_json_object("props", "$.missing"), F.col("value").cast("string")).alias("number"))


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN value::DOUBLE END AS number FROM events", "number")
def null_if_blank_decimal(m):
    text = F.when(F.col("event_id") % 7 == 0, " ").when(F.col("event_id") % 11 == 0, "x1").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return m.table("events").select("event_id", C.blank_to_null_number(text).alias("number"))


@query("SELECT l_returnflag, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_quantity, 0.25) AS p25 FROM lineitem GROUP BY l_returnflag", "p90 p25")
def percentile_linear(m):
    return m.table("lineitem").groupBy("l_returnflag").agg(F.percentile(F.col("l_extendedprice").cast("double"), 0.9).alias("p90"), F.percentile(F.col("l_quantity").cast("double"), 0.25).alias("p25"))


@query("SELECT market_id, trade_id, timestamp_ms, timestamp_ms AS back_ms, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad((timestamp_ms % 1000)::VARCHAR, 3, '0') || 'Z' AS iso FROM fx_trades")
def iso_ms(m):
    rows = m.trades.select("market_id", "trade_id", "timestamp_ms", C.ms_to_iso(F.col("timestamp_ms")).alias("iso"))
    return rows.withColumn("back_ms", C.iso_to_ms(F.col("iso")))


@query("SELECT market_id, timestamp_ms, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d') AS date, strftime(make_timestamp(timestamp_ms * 1000), '%H') AS hour, ((timestamp_ms // 60000 % 60) // 15 * 15)::INT AS bucket FROM fx_books")
def partition_key(m):
    return m.books.select("market_id", "timestamp_ms", *C.partition_key(F.col("timestamp_ms")))


def _redact_sql() -> tuple[str, str]:
    """The text with sensitive parts replaced, and whether ``r`` still has any."""
    out, again = "text", []
    for p in C.SENSITIVE:
        flags = "g"
        if p.startswith("(?i)"):
            p, flags = p[4:], "gi"
        p = p.replace("{0,2000}", r"{0,1000}[\s\S]{0,1000}").replace("'", "''")  # DuckDB repeats at most 1,000 times
        out = f"regexp_replace({out}, '{p}', '[redacted]', '{flags}')"
        again.append(f"regexp_matches(r, '{p}'{', ' + repr('i') if 'i' in flags else ''})")
    return f"regexp_replace(regexp_replace({out}, '\\s{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')", " OR ".join(again)


@query("SELECT doc_id, md5(CASE WHEN r = '' OR regexp_matches(r, '(?i)^[\\[\\]redacted\\s.,;:-]+$') OR {1} THEN '{2}' ELSE r END) AS redacted_md5 FROM (SELECT doc_id, {0} AS r FROM documents)".format(*_redact_sql(), C.FALLBACK))
def redact_text(m):
    return m.table("documents").select("doc_id", F.md5(C.redact_text(F.col("text")).cast("binary")).alias("redacted_md5"))


# Streaming forms and their batch twins


@query("SELECT market_id, timestamp_ms // 60000 * 60000 AS minute_ms, count(*) AS trade_count, sum(usd_amount) AS trade_quote_volume_usd FROM fx_trades WHERE type = 'trade' AND timestamp_ms // 60000 < (SELECT max(timestamp_ms) - 10000 FROM fx_trades WHERE type = 'trade') // 60000 GROUP BY 1, 2", "trade_quote_volume_usd")
def stream_minute_bars(m):
    return jobs.run_to_end(jobs.minute_bars_stream(jobs.as_stream(m.trades, "bars")), "bars")


@query("SELECT market_id, trade_id, timestamp_ms, count(*) OVER (PARTITION BY market_id ORDER BY timestamp_ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW)::DOUBLE AS tpm FROM td", "tpm")
def rolling_tpm(m):
    return trades.rolling_tpm(regular(m))


@query("SELECT * FROM (SELECT market_id, trade_id, timestamp_ms, count(*) OVER (PARTITION BY market_id ORDER BY timestamp_ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW)::DOUBLE AS tpm FROM td) WHERE timestamp_ms < (SELECT max(timestamp_ms) FROM td) - 20000", "tpm")
def stream_rolling_tpm(m):
    """Every fifth trade comes eight seconds late. What the watermark hasn't passed at the end still waits."""
    late = regular(m).withColumn("arrival_ms", F.col("timestamp_ms") + F.when(F.col("trade_id") % 5 == 0, 8000).otherwise(0))
    return jobs.run_to_end(stateful.rolling_tpm_stream(jobs.as_stream(late, "tpm", order="arrival_ms")), "tpm")


_NEAR = "(SELECT count(*) FROM mids m WHERE m.market_id = f.market_id AND m.timestamp_ms BETWEEN f.timestamp_ms + horizon_s * 1000 AND f.timestamp_ms + horizon_s * 1000 + 2500)"


@query(f"""SELECT market_id, trade_id, horizon_s, timestamp_ms, reference_mid, future_mid, CASE WHEN future_mid IS NULL THEN 'expired' WHEN {_NEAR} > 0 THEN 'forward' ELSE 'backward' END AS outcome,
  CASE WHEN is_maker_ask THEN price - future_mid ELSE future_mid - price END / reference_mid * 10000e0 AS maker_markout_bps FROM futm f
  WHERE timestamp_ms + horizon_s * 1000 + 2500 < greatest((SELECT max(timestamp_ms) FROM td), (SELECT max(timestamp_ms) FROM mids)) - 20000""", "reference_mid future_mid maker_markout_bps")
def stream_markouts(m):
    """Every seventh mid comes eight seconds late. What the watermark hasn't passed at the end still waits."""
    late = mids(m).withColumn("arrival_ms", F.col("timestamp_ms") + F.when(F.floor(F.col("timestamp_ms") / 1000) % 7 == 0, 8000).otherwise(0))
    found = stateful.markouts_stream(jobs.as_stream(regular(m), "marks-trades"), jobs.as_stream(late, "marks-mids", order="arrival_ms"))
    return jobs.run_to_end(found, "marks").select("market_id", "trade_id", "horizon_s", "timestamp_ms", "reference_mid", "future_mid", "outcome", "maker_markout_bps")


@query("SELECT market_id, episode, side, price, size, from_ms, to_ms FROM lvl", "price size")
def book_rebuild(m):
    return rebuild.level_intervals(m.updates)


@query("""SELECT m.market_id, m.timestamp_ms, m.nonce, max(CASE WHEN side = 'bid' THEN price END) AS best_bid, min(CASE WHEN side = 'ask' THEN price END) AS best_ask, any_value(a.nonce IS NOT NULL) AS in_step
  FROM msg m LEFT JOIN app a ON a.market_id = m.market_id AND a.nonce = m.nonce
  LEFT JOIN lvn l ON l.market_id = m.market_id AND size > 0 AND from_nonce <= m.nonce AND (changed_nonce IS NULL OR changed_nonce > m.nonce) AND (closed_nonce IS NULL OR closed_nonce > m.nonce) GROUP BY ALL""", "best_bid best_ask")
def stream_book_rebuild(m):
    return jobs.run_to_end(stateful.book_stream(jobs.as_stream(m.updates, "book", order="nonce")), "book").drop("kind", "out_of_step")


_GRID_SQL = """SELECT market_id, grid_ms, best_bid, best_ask, mid, (best_ask - best_bid) / mid * 10000e0 AS spread_bps, bid_size AS best_bid_size_base, coalesce(bid_depth, 0e0) AS bid_depth_25bps_usd, coalesce(ask_depth, 0e0) AS ask_depth_25bps_usd,
  least(coalesce(bid_depth, 0e0), coalesce(ask_depth, 0e0)) AS two_sided_depth_25bps_usd, mid IS NOT NULL AS is_usable, grid_ms - heard_ms AS book_update_age_ms, coalesce(grid_ms - heard_ms > 10000, true) AS is_inactive
  FROM (SELECT g.*, a.timestamp_ms AS heard_ms FROM (SELECT market_id, unnest(range((min(timestamp_ms) + 4999) // 5000 * 5000, (SELECT e + 1 FROM win), 5000)) AS grid_ms FROM msg GROUP BY market_id) g ASOF LEFT JOIN app a ON a.market_id = g.market_id AND a.timestamp_ms <= g.grid_ms)
  LEFT JOIN (SELECT market_id, grid_ms, max(b) AS best_bid, max(a) AS best_ask, max(mid) AS mid, max(CASE WHEN side = 'bid' AND price = b THEN size END) AS bid_size,
      sum(price * size) FILTER (side = 'bid' AND abs(price - mid) <= mid * 25e0 / 10000e0 + 1e-12) AS bid_depth, sum(price * size) FILTER (side = 'ask' AND abs(price - mid) <= mid * 25e0 / 10000e0 + 1e-12) AS ask_depth
    FROM (SELECT *, CASE WHEN b <= a THEN (b + a) / 2e0 END AS mid FROM (SELECT *, max(CASE WHEN side = 'bid' THEN price END) OVER (PARTITION BY market_id, grid_ms) AS b, min(CASE WHEN side = 'ask' THEN price END) OVER (PARTITION BY market_id, grid_ms) AS a
      FROM (SELECT *, unnest(range((from_ms + 4999) // 5000 * 5000, coalesce(to_ms, (SELECT e + 1 FROM win)), 5000)) AS grid_ms FROM lvl))) GROUP BY market_id, grid_ms) USING (market_id, grid_ms)"""


@query(_GRID_SQL, "best_bid best_ask mid spread_bps best_bid_size_base bid_depth_25bps_usd ask_depth_25bps_usd two_sided_depth_25bps_usd")
def book_sample_grid(m):
    rows = rebuild.book_sample_grid(m.updates, m.end_ms, Sampling(depth_bps=(25,), inactive_ms=10_000))
    return rows.drop("best_ask_size_base", "best_bid_size_usd", "best_ask_size_usd")


@query("""SELECT market_id, max(seen) FILTER (begins) AS first_active_at_ms, arg_max_null(nxt, seen) AS removed_at_ms, count(*) FILTER (begins) AS episodes FROM (
  SELECT market_id, seen, nxt, coalesce(k - lag(k) OVER (PARTITION BY market_id ORDER BY k) <> 1, true) AS begins FROM (SELECT DISTINCT market_id, timestamp_ms // 60000 * 60000 AS seen FROM fx_trades)
  JOIN (SELECT seen, row_number() OVER (ORDER BY seen) AS k, lead(seen) OVER (ORDER BY seen) AS nxt FROM (SELECT DISTINCT timestamp_ms // 60000 * 60000 AS seen FROM fx_trades)) USING (seen)) GROUP BY market_id""")
def market_lifecycle(m):
    at = (F.floor(F.col("timestamp_ms") / F.lit(60_000)).cast("long") * 60_000).alias("at_ms")
    return screening.market_lifecycle(m.trades.select(at, "market_id"))


@query("SELECT market_id, avg(maker_markout_bps) AS recent_markout_mean_bps, count(*) AS recent_markouts FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY timestamp_ms DESC, trade_id DESC) AS n FROM md WHERE horizon_s = 5) WHERE n <= 200 GROUP BY market_id", "recent_markout_mean_bps")
def recent_markout_mean(m):
    return markouts.recent_markout_mean(markouts.dedup_markouts(m.markouts))


@query("SELECT market_id, max(timestamp_ms) AS timestamp_ms, arg_max_null(spread_bps, timestamp_ms) AS spread_bps, arg_max(two_sided_depth_10bps_usd, timestamp_ms) AS two_sided_depth_10bps_usd FROM bk GROUP BY market_id", "spread_bps two_sided_depth_10bps_usd")
def live_metrics_stream(m):
    return feed.latest_by_market(jobs.as_stream(m.books, "live"), ["spread_bps", "two_sided_depth_10bps_usd"], "live")


# Ledgers


@query("SELECT market_id, qty, buy_id, sell_id, buy_price, sell_price, pnl, closed_ms FROM fifo", "qty buy_price sell_price pnl")
def fifo_realized_pnl(m):
    return ledger.fifo_matches(m.fills)


@query("SELECT market_id, open_qty, unrealized_pnl_usd, last_mid FROM opn", "open_qty unrealized_pnl_usd last_mid")
def unrealized_pnl(m):
    return ledger.unrealized_pnl(m.fills, mids(m))


@query("""SELECT market_id, count(*) AS round_trips, quantile_cont(seconds, 0.5) AS median_holding_seconds, quantile_disc(seconds, 0.9) AS p90_holding_seconds, max(seconds) AS max_holding_seconds FROM (
  SELECT market_id, trip, (max(CASE WHEN position = 0 THEN timestamp_ms END) - min(timestamp_ms)) / 1000e0 AS seconds FROM (SELECT *, coalesce(sum(CASE WHEN position = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY market_id ORDER BY timestamp_ms, fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS trip FROM pos) GROUP BY market_id, trip) WHERE seconds IS NOT NULL GROUP BY market_id""", "median_holding_seconds p90_holding_seconds max_holding_seconds")
def round_trips(m):
    return ledger.round_trips(m.fills)


@query("""SELECT market_id, sum(CASE WHEN position <> 0 THEN secs ELSE 0 END) / greatest((any_value(e) - any_value(s)) / 1000e0, 1e0) * 100e0 AS time_with_inventory_pct, max(abs(position) * coalesce(mid, price)) AS max_abs_inventory_usd, arg_max(position, fill_id) AS final_position FROM (
  SELECT p.*, m.mid, e, s, greatest((coalesce(lead(p.timestamp_ms) OVER (PARTITION BY p.market_id ORDER BY p.timestamp_ms, fill_id), e) - p.timestamp_ms) / 1000e0, 0e0) AS secs FROM pos p ASOF LEFT JOIN mids m ON m.market_id = p.market_id AND m.timestamp_ms <= p.timestamp_ms CROSS JOIN win) GROUP BY market_id""", "time_with_inventory_pct max_abs_inventory_usd final_position")
def inventory_exposure(m):
    return ledger.inventory_exposure(m.fills, mids(m), m.start_ms, m.end_ms)


_FILL_MARKS = ", ".join(f"quantile_cont(x, 0.5) FILTER (h = {h}) AS markout_{h}s_median_bps, count(x) FILTER (h = {h}) AS markout_{h}s_count" for h in (5, 30))


@query(f"""SELECT market_id, {_FILL_MARKS} FROM (SELECT market_id, h, CASE WHEN reference > 0 THEN CASE WHEN side = 'ask' THEN price - future ELSE future - price END / reference * 10000e0 END AS x FROM (
  SELECT f.*, h, m.mid AS reference, coalesce((SELECT arg_min(q.mid, q.timestamp_ms) FROM mids q WHERE q.market_id = f.market_id AND q.timestamp_ms BETWEEN f.timestamp_ms + h * 1000 AND f.timestamp_ms + h * 1000 + 2500), (SELECT arg_max(q.mid, q.timestamp_ms) FROM mids q WHERE q.market_id = f.market_id AND q.timestamp_ms BETWEEN f.timestamp_ms + h * 1000 - 2500 AND f.timestamp_ms + h * 1000)) AS future
  FROM fx_fills f ASOF LEFT JOIN mids m ON m.market_id = f.market_id AND m.timestamp_ms <= f.timestamp_ms CROSS JOIN (SELECT unnest([5, 30]) AS h) CROSS JOIN win WHERE f.timestamp_ms + h * 1000 <= e)) GROUP BY market_id""", "markout_5s_median_bps markout_30s_median_bps")
def fill_markouts(m):
    return ledger.fill_markouts(m.fills, mids(m), m.end_ms)


_PNL_D = "filled_notional_usd realized_pnl_usd unrealized_pnl_usd fees_usd gross_pnl_usd total_pnl_usd pnl_per_hour_usd pnl_bps_on_notional"


def summary(m: Market) -> DataFrame:
    return ledger.pnl_summary(m.fills, mids(m), m.start_ms, m.end_ms, fee_bps=1.0)


@query("SELECT ledg.*, total_pnl_usd / ((e - s) / 3600000e0) AS pnl_per_hour_usd, total_pnl_usd / filled_notional_usd * 10000e0 AS pnl_bps_on_notional FROM ledg CROSS JOIN win".replace("ledg.*", "market_id, bid_fills, ask_fills, filled_notional_usd, realized_pnl_usd, unrealized_pnl_usd, fees_usd, gross_pnl_usd, total_pnl_usd"), _PNL_D)
def pnl_summary(m):
    return summary(m)


@query("SELECT r.market_id, symbol, rank, CASE WHEN rank > 7 THEN 'not_simulated' WHEN total_pnl_usd IS NULL THEN 'unavailable' ELSE 'ok' END AS ledger_status, CASE WHEN rank <= 7 THEN total_pnl_usd END AS total_pnl_usd FROM rnk r LEFT JOIN ledg USING (market_id)", "total_pnl_usd")
def ledger_attach(m):
    return ledger.ledger_attach(ranked_markets(inputs(m)), summary(m), 7).select("market_id", "symbol", "rank", "ledger_status", "total_pnl_usd")


# Quality


@query("""SELECT c.check_name AS check_name, CASE WHEN c.found = 0 THEN 'PASS' WHEN c.check_name = 'coverage.obs_vs_data' THEN 'WARN' ELSE 'FAIL' END AS level, c.found AS found, checked FROM (SELECT unnest([
    {'check_name': 'coverage.schema.market_id', 'found': 0}, {'check_name': 'coverage.schema.symbol', 'found': count(*) FILTER (market_id = 1)}, {'check_name': 'coverage.schema.score', 'found': 0}, {'check_name': 'coverage.data_coverage_pct', 'found': count(*) FILTER (market_id = 2)},
    {'check_name': 'coverage.observation_coverage_pct', 'found': count(*) FILTER (market_id IN (3, 4))}, {'check_name': 'coverage.usable_quote_coverage_pct', 'found': 0}, {'check_name': 'coverage.spread_coverage_pct', 'found': 0},
    {'check_name': 'coverage.obs_vs_data', 'found': count(*) FILTER (market_id = 3 OR (market_id = 2 AND abs(observation_coverage_pct - 100.5) > 2) OR market_id = 4)}]) AS c, count(*) AS checked FROM mr)""")
def output_quality_checks(m):
    k, rows = F.col("market_id"), ranked_markets(inputs(m))
    bad = {"symbol": F.when(k != 1, F.col("symbol")), "data_coverage_pct": F.when(k == 2, 100.5).otherwise(F.col("data_coverage_pct")), "observation_coverage_pct": F.when(k == 3, -1.0).when(k == 4, float("nan")).otherwise(F.col("observation_coverage_pct"))}
    return quality.output_quality_checks(rows.withColumns(bad))


@query(f"""SELECT compared, mismatches, p50_difference, p95_difference, max_difference, d.*, true AS row_counts_match, CASE WHEN mismatches > 0 THEN 'FAIL' WHEN p95_score_delta > 5 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS verdict
  FROM (SELECT count(*) FILTER (side <> 'before') AS compared, count(*) FILTER (side <> 'before' AND NOT matches) AS mismatches, quantile_cont(difference, 0.5) AS p50_difference, quantile_cont(difference, 0.95) AS p95_difference, max(difference) AS max_difference FROM ({_COMPARE_SQL}))
  CROSS JOIN (SELECT quantile_cont(abs(score_delta), 0.5) AS median_score_delta, quantile_cont(abs(score_delta), 0.95) AS p95_score_delta, max(abs(score_delta)) AS max_score_delta, quantile_cont(abs(rank_delta)::DOUBLE, 0.5) AS median_rank_delta, max(abs(rank_delta)) AS max_rank_delta FROM ({_DELTA_SQL})) d""", "p50_difference p95_difference max_difference median_score_delta p95_score_delta max_score_delta median_rank_delta")
def snapshot_compare(m):
    before, after = _two_results(m)
    counts = m.books.agg(F.count(F.lit(1)).alias("before")).unionByName(m.trades.agg(F.count(F.lit(1)).alias("before"))).withColumn("after", F.col("before"))
    return quality.comparison_verdict(quality.snapshot_compare(before, after), quality.score_deltas(before, after), counts)


@query("""SELECT market_id, round((e - heard) / 60000e0, 6) AS heard_minutes_ago, status = 'RUNNING' AND coalesce((e - heard) / 60000e0 > 3, true) AS stale_running, status IN ('OK', 'DEGRADED') AND market_id % 5 <> 3 AS success FROM (
  SELECT market_id, CASE market_id % 4 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'OK' WHEN 2 THEN 'DEGRADED' ELSE 'ERROR' END AS status, CASE WHEN market_id = 4 THEN NULL WHEN market_id % 3 = 0 THEN max(timestamp_ms) - 200000 * market_id ELSE min(timestamp_ms) END AS heard FROM fx_trades GROUP BY market_id) CROSS JOIN win""", "heard_minutes_ago")
def analysis_runs(m):
    k = F.col("market_id")
    runs = m.trades.groupBy("market_id").agg(F.max("timestamp_ms").alias("_last"), F.min("timestamp_ms").alias("_first"))
    status = F.when(k % 4 == 0, "RUNNING").when(k % 4 == 1, "OK").when(k % 4 == 2, "DEGRADED").otherwise("ERROR")
    runs = runs.select(k, status.alias("status"), F.when((k % 3 == 0) & (k != 4), F.col("_last") - 200_000 * k).alias("heartbeat_ms"), F.when(k != 4, F.col("_first")).alias("started_ms"), F.lit(None).cast("long").alias("generated_ms"), F.when(k % 5 != 3, F.col("_last")).alias("last_success_ms"))
    return quality.run_states(runs, m.end_ms, 3.0).select("market_id", "heard_minutes_ago", "stale_running", "success")


@query("""SELECT shards, connected, planned, acked, list_filter([CASE WHEN connected < shards THEN printf('WebSocket degraded: %d/%d shards connected.', connected, shards) END, CASE WHEN acked < planned THEN printf('Subscription ACK incomplete: %d/%d channels acked.', acked, planned) END], lambda x: x IS NOT NULL) AS warnings FROM (
  SELECT count(*) AS shards, count(*) FILTER (shard <> 1) AS connected, sum(planned)::BIGINT AS planned, sum(acked)::BIGINT AS acked FROM (SELECT market_id % 3 AS shard, count(DISTINCT market_id) AS planned, count(DISTINCT CASE WHEN market_id <> 2 THEN market_id END) AS acked FROM fx_trades GROUP BY 1))""")
def connection_warnings(m):
    shards = m.trades.groupBy((F.col("market_id") % 3).alias("shard")).agg(F.countDistinct("market_id").alias("planned"), F.countDistinct(F.when(F.col("market_id") != 2, F.col("market_id"))).alias("acked"))
    return quality.connection_warnings(shards.withColumn("connected", F.col("shard") != 1))


@query("SELECT market_id, symbol, rank, round(score, 4) AS score, round(rank_spread, 2) AS pct_spread, mean_spread_bps, median_two_sided_depth_5bps_usd AS depth_5bps, total_quote_volume, markout_30s_count, estimated_maker_edge_30s_bps, spread_coverage_pct, cons, penalties, confidence_reasons FROM nar", "score pct_spread mean_spread_bps depth_5bps total_quote_volume estimated_maker_edge_30s_bps spread_coverage_pct")
def market_detail(m):
    x = report.market_detail(ranked_markets(inputs(m)))
    picked = {"pct_spread": "rank_components.spread", "mean_spread_bps": "spread.mean_spread_bps", "depth_5bps": "depth.median_two_sided_depth_5bps_usd", "total_quote_volume": "activity.total_quote_volume", "markout_30s_count": "markouts.markout_30s_count", "estimated_maker_edge_30s_bps": "fill.estimated_maker_edge_30s_bps", "spread_coverage_pct": "coverage.spread_coverage_pct"}
    return x.select("market_id", "symbol", "rank", "score", *(F.col(c).alias(n) for n, c in picked.items()), "cons", "penalties", "confidence_reasons")


def _sources(m: Market) -> DataFrame:
    age = (F.lit(m.end_ms) - F.col("last_ms")) / 60_000.0
    last = m.trades.groupBy("market_id").agg(F.max("timestamp_ms").alias("last_ms"), F.min("timestamp_ms").alias("first_ms"))
    return last.select("market_id", F.when(F.col("market_id") == 1, "completed").otherwise("running").alias("status"), ((F.lit(m.end_ms) - F.col("first_ms")) / 60_000.0).alias("started_age"), F.when(F.col("market_id") == 2, None).otherwise(age + F.col("market_id") * 6).alias("event_age"), F.when(F.col("market_id") == 0, 1).otherwise(0).alias("sync_failures"), F.lit(False).alias("degraded"))


@query("""SELECT market_id, CASE WHEN market_id = 1 THEN 'COMPLETED' WHEN market_id = 2 THEN CASE WHEN (e - first_ms) / 60000e0 <= 5 THEN 'COLLECTING' ELSE 'STALE' END WHEN (e - last_ms) / 60000e0 + market_id * 6 > 40 THEN 'OFFLINE' WHEN (e - last_ms) / 60000e0 + market_id * 6 > 20 THEN 'STALE' WHEN market_id = 0 THEN 'DEGRADED' ELSE 'COLLECTING' END AS label
  FROM (SELECT market_id, max(timestamp_ms) AS last_ms, min(timestamp_ms) AS first_ms FROM fx_trades GROUP BY market_id) CROSS JOIN win""")
def freshness_label(m):
    return quality.freshness_label(_sources(m)).select("market_id", "label")


@query("SELECT market_id, greatest(coalesce(b, t), coalesce(t, b)) AS latest_ms FROM (SELECT market_id, max(timestamp_ms) AS b FROM fx_books GROUP BY market_id) FULL JOIN (SELECT market_id, max(timestamp_ms) AS t FROM fx_trades GROUP BY market_id) USING (market_id)")
def latest_event_time(m):
    b = m.books.groupBy("market_id").agg(F.max("timestamp_ms").alias("b"))
    t = m.trades.groupBy("market_id").agg(F.max("timestamp_ms").alias("t"))
    return b.join(t, "market_id", "full_outer").select("market_id", F.greatest("b", "t").alias("latest_ms"))


@query("SELECT market_id, abs(d - t) / 1000e0 AS gap_s, CASE WHEN abs(d - t) / 1000e0 <= 300 THEN 'PASS' WHEN abs(d - t) / 1000e0 <= 900 THEN 'WARN' ELSE 'FAIL' END AS level FROM (SELECT market_id, max(timestamp_ms) AS t, max(timestamp_ms) - market_id * 150000 AS d FROM fx_books GROUP BY market_id)", "gap_s")
def watermark_gap_check(m):
    rows = m.books.groupBy("market_id").agg(F.max("timestamp_ms").alias("table_ms")).withColumn("durable_ms", F.col("table_ms") - F.col("market_id") * 150_000)
    return quality.watermark_gap_check(rows).select("market_id", "gap_s", "level")


@query("SELECT count(*) AS markets, count(*) FILTER (candidate) AS candidates, CASE WHEN count(*) = 0 THEN 'DEGRADED' ELSE 'OK' END AS status FROM rnk")
def analysis_status_rollup(m):
    return quality.status_rollup(ranked_markets(inputs(m)))


@query("""SELECT market_id, last_sample_ms, last_usable_ms, list_filter([CASE WHEN last_usable_ms IS NULL THEN 'no usable book sample' END, CASE WHEN e + 20000 - last_usable_ms > 30000 THEN 'usable book samples are stale' END, CASE WHEN e + 20000 - last_sample_ms > 30000 THEN 'book samples are stale' END], lambda x: x IS NOT NULL) AS warnings
  FROM (SELECT market_id, max(timestamp_ms) AS last_sample_ms, max(timestamp_ms) FILTER (is_usable) AS last_usable_ms FROM bk GROUP BY market_id) CROSS JOIN win""")
def feed_health_warnings(m):
    return quality.feed_health_warnings(deduped(m), m.end_ms + 20_000)
