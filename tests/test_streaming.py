"""Streams with state, sinks that write a batch once, tables by key."""

import pandas as pd
from pyspark.sql import functions as F

from tickloom.config import Markouts
from tickloom.operators import markouts
from tickloom.sources import tables
from tickloom.streaming import feed, jobs, stateful

TRADES = "market_id int, trade_id long, timestamp_ms long, price double, is_maker_ask boolean, type string"
MIDS = "market_id int, timestamp_ms long, mid double"
CONFIG = Markouts(horizons_s=(1, 5), reference_age_ms=3_000, tolerance_ms=2_500)


def test_markouts_wait_fall_back_and_expire(spark):
    trades = [(1, 1, 10_000, 101.0, True, "trade"), (1, 2, 40_000, 101.0, False, "trade"), (1, 3, 80_000, 99.0, False, "trade"), (2, 4, 10_000, 5.0, True, "trade"), (1, 5, 10_000, 1.0, True, "liquidation"), (1, 9, 400_000, 1.0, True, "trade")]
    mids = [(1, 9_000, 100.0), (1, 10_900, 100.5), (1, 11_000, 100.6), (1, 12_000, 100.7), (1, 17_400, 100.8), (1, 39_000, 102.0), (1, 40_900, 103.0), (1, 42_600, 0.0), (1, 80_500, 98.0), (1, 300_000, 90.0)]
    found = stateful.markouts_stream(jobs.as_stream(spark.createDataFrame(trades, TRADES), "t", batches=2), jobs.as_stream(spark.createDataFrame(mids, MIDS), "m", batches=3), CONFIG, "5 seconds")
    got = {(r.trade_id, r.horizon_s): (r.reference_mid, r.future_mid, r.outcome) for r in jobs.run_to_end(found, "x").collect()}
    assert got == {
        (1, 1): (100.0, 100.6, "forward"),
        (1, 5): (100.0, 100.8, "forward"),
        (2, 1): (102.0, 103.0, "backward"),
        (2, 5): (102.0, None, "expired"),
        (3, 1): (None, 98.0, "backward"),
        (3, 5): (None, None, "expired"),
        (4, 1): (None, None, "expired"),
        (4, 5): (None, None, "expired"),
    }


def test_streamed_markouts_equal_the_batch_form_after_a_restart(spark):
    trades = spark.range(400).select((F.col("id") % 3).cast("int").alias("market_id"), F.col("id").alias("trade_id"), (10_000 + F.col("id") * 700).alias("timestamp_ms"), (F.lit(100.0) + F.col("id") % 7).alias("price"), (F.col("id") % 2 == 0).alias("is_maker_ask"), F.lit("trade").alias("type"))
    mids = spark.range(300).select((F.col("id") % 3).cast("int").alias("market_id"), (10_000 + F.col("id") * 950 + (F.col("id") * 7919) % 400).alias("timestamp_ms"), (F.lit(100.0) + F.col("id") % 11).alias("mid"), (10_000 + (F.col("id") * 950) + F.when(F.col("id") % 5 == 0, 4_000).otherwise(0)).alias("late"))
    rows = stateful.markouts_stream(jobs.as_stream(trades, "t"), jobs.as_stream(mids, "m", order="late"), CONFIG, "15 seconds")
    path, log = jobs.scratch(spark, "out"), jobs.scratch(spark, "log")
    for _ in range(2):  # the second run finds nothing new, and repeats nothing
        jobs.finish(spark, rows.writeStream.option("checkpointLocation", log).format("parquet").option("path", path).trigger(availableNow=True))
    got = {(r.trade_id, r.horizon_s): (r.reference_mid, r.future_mid) for r in spark.read.parquet(path).collect()}
    assert spark.read.parquet(path).count() == len(got)
    batch = {(r.trade_id, r.horizon_s): (r.reference_mid, r.future_mid) for r in markouts.future_mids(markouts.reference_mids(trades, mids, CONFIG), mids, CONFIG).collect()}
    end = max(trades.agg(F.max("timestamp_ms")).first()[0], mids.agg(F.max("timestamp_ms")).first()[0]) - 15_000
    passed = {(t, h) for t in range(400) for h in (1, 5) if 10_000 + t * 700 + h * 1000 + 2_500 < end}
    assert set(got) == passed
    assert {k: v for k, v in got.items() if v[1] is not None} == {k: v for k, v in batch.items() if k in passed}


def test_a_watermark_that_stands_on_a_trade(spark):
    """The watermark after the first batch is the very time of the trade that waits."""
    rows = spark.createDataFrame([(1, 1, 30_000, 30_000, "trade"), (1, 2, 35_000, 35_000, "trade"), (1, 3, 30_000, 36_000, "trade"), (2, 4, 99_000, 99_000, "trade")], "market_id int, trade_id long, timestamp_ms long, arrival_ms long, type string")
    for delay in ("5 seconds", "10 seconds"):
        found = jobs.run_to_end(stateful.rolling_tpm_stream(jobs.as_stream(rows, "w", batches=3, order="arrival_ms"), delay=delay), "w")
        assert sorted((r.trade_id, r.tpm) for r in found.collect()) == [(1, 2.0), (2, 3.0), (3, 2.0)]


class _Map:
    """A map state that counts what is written to it."""

    def __init__(self):
        self.held, self.writes = {}, 0

    def iterator(self):
        return iter(list(self.held.items()))

    def updateValue(self, key, value):
        self.held[key], self.writes = value, self.writes + 1

    def removeKey(self, key):
        self.held.pop(key, None)
        self.writes += 1

    def clear(self):
        self.held.clear()


class _Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def test_a_message_writes_its_own_levels_only():
    book = stateful.BookProcessor()
    book.levels, book.head = _Map(), _Value()
    columns = ["nonce", "timestamp_ms", "begin_nonce", "kind", "side", "price", "size"]
    first = pd.DataFrame([(1, 0, None, "snapshot", "bid" if k % 2 else "ask", 50.0 - k if k % 2 else 50.0 + k, 1.0) for k in range(1_000)], columns=columns)
    (out,) = book.handleInputRows((7,), iter([first]), None)
    assert out.iloc[0].best_bid == 49.0 and book.levels.writes == 1_000
    for n in range(2, 12):
        change = pd.DataFrame([(n, n, n - 1, "delta", "bid", 49.0, float(n % 2)), (n, n, n - 1, "delta", "ask", 60.0 + n, 0.0)], columns=columns)
        before = book.levels.writes
        (out,) = book.handleInputRows((7,), iter([change]), None)
        assert book.levels.writes - before <= 2
        assert out.iloc[0].best_bid == (49.0 if n % 2 else 47.0)
    gap = pd.DataFrame([(20, 20, 18, "delta", "bid", 49.0, 1.0)], columns=columns)
    (out,) = book.handleInputRows((7,), iter([gap]), None)
    assert bool(out.iloc[0].out_of_step) and not book.levels.held


def test_a_batch_again_leaves_one_copy(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") * 100_000).alias("timestamp_ms"), "id")
    for number in (0, 1, 1, 0):
        feed.append_once(rows.where(F.col("id") % 2 == number), str(tmp_path / "t"), number)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == list(range(100))
    assert tables.discover_layout(spark, str(tmp_path / "t")).where("layout_depth = 2").count() == 100


def test_warm_up_trades_are_remembered_and_not_given_out(spark):
    schema = "market_id int, trade_id long, timestamp_ms long, snapshot boolean, arrival_ms long"
    rows = [(1, 1, 1_000, True, 900), (1, 1, 1_000, False, 1_000), (1, 2, 1_100, False, 1_100), (1, 2, 1_100, True, 2_000), (1, 2, 1_100, False, 2_500), (2, 1, 1_000, False, 3_000), (1, 3, 1_200, None, 3_100), (None, 3, 1_200, False, 3_200)]
    found = jobs.run_to_end(feed.dedup_with_warmup(jobs.as_stream(spark.createDataFrame(rows, schema), "w", order="arrival_ms", batches=3)), "w")
    assert sorted((r.market_id, r.trade_id) for r in found.collect()) == [(1, 2), (1, 3), (2, 1)]


def test_a_table_by_key_stays_as_large_as_its_keys(spark):
    rows = spark.range(2_000).select((F.col("id") % 5).cast("int").alias("market_id"), F.col("id").alias("timestamp_ms"), F.col("id").cast("double").alias("x"))
    root = jobs.scratch(spark, "by-key")
    last = lambda df: df.groupBy("market_id").agg(F.max_by(F.struct("timestamp_ms", "x"), "timestamp_ms").alias("r")).select("market_id", "r.*")
    table = feed.merged_by_batch(jobs.as_stream(rows, "k", batches=5), "k", last, root)
    assert sorted((r.market_id, r.timestamp_ms, r.x) for r in table.collect()) == [(k, 1_995 + k, 1_995.0 + k) for k in range(5)]
    kept = feed.versions(spark, root)
    assert len(kept) == 2 and all(spark.read.parquet(f"{root}/v={v}").count() == 5 for v in kept)


def test_marks_from_footers(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    root = tmp_path / "date=2024-01-01"
    root.mkdir()
    times = pa.table({"timestamp_ms": pa.array([5, None, 9], pa.int64()), "x": [1, 2, 3]})
    pq.write_table(times, root / "with.parquet")
    pq.write_table(times, root / "without.parquet", write_statistics=False)
    pq.write_table(times.slice(1, 1), root / "null.parquet")
    pq.write_table(times.drop_columns("timestamp_ms"), root / "other.parquet")
    pq.write_table(times.slice(0, 0), root / "none.parquet")
    (root / "broken.parquet").write_bytes(b"PAR1 not PAR1")
    got = {r.path.rsplit("/", 1)[1]: (r.latest_ms, r.from_statistics) for r in tables.footer_watermark(spark, str(tmp_path)).collect()}
    assert got == {"with.parquet": (9, True), "without.parquet": (9, False), "null.parquet": (None, got["null.parquet"][1]), "other.parquet": (None, True), "none.parquet": (None, True), "broken.parquet": (None, True)}
