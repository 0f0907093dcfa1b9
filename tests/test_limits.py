"""Plans and states that must stay small."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.test_queries import SF, TABLES, plain
from tickloom.config import Markouts
from tickloom.operators import markouts
from tickloom.plans.registry import ORACLES, QUERIES
from tickloom.sources import tables
from tickloom.streaming import feed, jobs, stateful


def leaves(df) -> int:
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


def equals_its_sql(df, name) -> bool:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    result = con.execute(ORACLES[name])
    given, names = [d[0] for d in result.description], sorted(df.columns)
    want = sorted(tuple(plain(row[given.index(c)]) for c in names) for row in result.fetchall())
    return sorted(given) == names and sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == want


def test_stages_are_merged_from_written_rows(spark):
    """Not from one plan that holds both stages, one of them several times."""
    df = QUERIES["merge_stages"](spark, SF)
    assert leaves(df) <= 4
    assert equals_its_sql(df, "merge_stages")


class Value:
    """A value state that counts its calls."""

    def __init__(self):
        self.held, self.calls = None, 0

    def exists(self):
        return self.held is not None

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.held, self.calls = value, self.calls + 1

    def clear(self):
        self.held = None


class Handle:
    """Of a processor: its states by name, and its timers."""

    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Value())

    def registerTimer(self, at):
        self.timers.append(at)

    def calls(self):
        return sum(s.calls for s in self.states.values()) + len(self.timers)


class Clock:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_a_batch_of_many_minutes_remembers_ids_at_once():
    handle, processor = Handle(), feed.DedupProcessor(["trade_id"], "arrival_ms")
    processor.init(handle)
    minutes = np.arange(5_000)
    rows = pd.DataFrame({"trade_id": minutes, "timestamp_ms": minutes * 60_000, "arrival_ms": minutes, "snapshot": False})
    (out,) = processor.handleInputRows((1, 0), iter([rows]), Clock(0))
    assert len(out) == 5_000 and handle.calls() <= 3
    again = pd.DataFrame({"trade_id": [4_990, 4_999, 5_000], "timestamp_ms": [4_999 * 60_000] * 3, "arrival_ms": [1, 2, 3], "snapshot": [False, False, True]})
    (out,) = processor.handleInputRows((1, 0), iter([again]), Clock(4_995 * 60_000))
    assert not len(out)
    assert set(np.frombuffer(handle.states["seen"].held[0], np.int64)) == {4_990, *range(4_995, 5_001)}
    assert not list(processor.handleExpiredTimer((1, 0), Clock(handle.timers[-1]), None)) and not handle.states["seen"].exists()


def test_a_repeat_in_another_minute_is_a_repeat(spark):
    schema = "market_id int, trade_id long, timestamp_ms long, snapshot boolean, arrival_ms long"
    rows = [(1, 1, 59_000, False, 59_000), (1, 1, 61_500, False, 61_500), (1, 2, 62_000, False, 62_000)]
    for batches in (1, 2):
        found = jobs.run_to_end(feed.dedup_with_warmup(jobs.as_stream(spark.createDataFrame(rows, schema), "r", order="arrival_ms", batches=batches)), "r")
        assert sorted((r.trade_id, r.timestamp_ms) for r in found.collect()) == [(1, 59_000), (2, 62_000)]


def test_markouts_hold_one_value_whatever_time_a_batch_spans():
    handle, processor = Handle(), stateful.MarkoutProcessor(Markouts(horizons_s=(1, 5)))
    processor.init(handle)
    at = np.arange(2_000) * 60_000
    line = pd.DataFrame({"timestamp_ms": at, "mid": 100.0, "trade_id": np.nan, "price": np.nan, "is_maker_ask": None})
    trades = pd.DataFrame({"timestamp_ms": at, "mid": np.nan, "trade_id": np.arange(2_000.0), "price": 101.0, "is_maker_ask": True})
    list(processor.handleInputRows((1, 0), iter([pd.concat([line, trades])]), Clock(0)))
    (out,) = processor.handleExpiredTimer((1, 0), Clock(int(at[-1]) + 60_000), None)
    assert len(out) == 4_000 and handle.calls() <= 12
    list(processor.handleExpiredTimer((1, 0), Clock(handle.timers[-1]), None))
    assert not any(s.exists() for s in handle.states.values())


def test_streams_by_bins_see_beyond_their_edges(spark):
    edge = 3 * stateful.BIN_MS
    trades = spark.range(200).select(F.lit(1).alias("market_id"), F.col("id").alias("trade_id"), (edge - 100_000 + F.col("id") * 1_000).alias("timestamp_ms"), F.lit(100.0).alias("price"), (F.col("id") % 2 == 0).alias("is_maker_ask"), F.lit("trade").alias("type"))
    mids = spark.range(90).select(F.lit(1).alias("market_id"), (edge - 110_300 + F.col("id") * 3_700).alias("timestamp_ms"), (F.col("id") + 100.0).alias("mid"))
    end = mids.agg(F.max("timestamp_ms")).first()[0] - 15_000
    found = jobs.run_to_end(stateful.markouts_stream(jobs.as_stream(trades, "t"), jobs.as_stream(mids, "m"), delay="15 seconds"), "x")
    got = {(r.trade_id, r.horizon_s): (r.reference_mid, r.future_mid) for r in found.collect()}
    batch = markouts.future_mids(markouts.reference_mids(trades, mids), mids)
    want = {(r.trade_id, r.horizon_s): (r.reference_mid, r.future_mid) for r in batch.where(F.col("timestamp_ms") + F.col("horizon_s") * 1000 + 2_500 < end).collect()}
    assert found.count() == len(got) and len(want) > 700
    assert {k: v for k, v in got.items() if None not in v} == {k: v for k, v in want.items() if None not in v}
    rolled = jobs.run_to_end(stateful.rolling_tpm_stream(jobs.as_stream(trades, "w"), delay="15 seconds"), "w")
    last = edge + 99_000 - 15_000
    assert sorted((r.trade_id, r.tpm) for r in rolled.collect()) == [(k, min(k + 1.0, 60.0)) for k in range(200) if edge - 100_000 + k * 1_000 < last]


def test_what_is_published_is_computed_once(spark, monkeypatch):
    given, write = {}, tables.publish_generation
    monkeypatch.setattr(tables, "publish_generation", lambda some, *a, **k: given.update(some) or write(some, *a, **k))
    QUERIES["publish_generation"](spark, SF)
    assert len(given) == 4 and all(leaves(df) == 1 for df in given.values())


def test_messages_are_parsed_once_for_all_sinks(spark):
    raw = spark.createDataFrame([('{"type":"update/trade","channel":"trade:1"}',)], "value string")
    parsed = tables.parsed_messages(raw).persist()
    try:
        for rows in feed.split_feed(parsed).values():
            assert "InMemoryRelation" in rows._jdf.queryExecution().withCachedData().toString()
    finally:
        parsed.unpersist()
