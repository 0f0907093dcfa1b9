"""From raw feed messages to tables: one source, several sinks, each batch once; and tables kept by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.columns import partition_key
from tickloom.sources import tables
from tickloom.streaming.jobs import finish, scratch, with_event_time
from tickloom.streaming.stateful import STRETCH_MS, book_stream

#: What ``feed_to_tables`` writes below its root.
FEED_TABLES = ("trades", "book_updates", "market_stats", "bad_rows")


def append_once(rows: DataFrame, path: str, batch: int, *, time: str | None = "timestamp_ms") -> None:
    """Append a batch's rows below ``date=/hour=/batch=`` (without a ``time``: ``batch=``). The batch's own folders are replaced, so a batch that comes again after a failure leaves one copy; no other batch's files are touched."""
    keys = ["batch"]
    keyed = rows.withColumn("batch", F.lit(batch).cast("long"))
    if time:
        date, hour, _ = partition_key(F.col(time))
        keyed, keys = keyed.withColumns({"date": date, "hour": hour}), ["date", "hour", "batch"]
        keyed = keyed.repartition("date", "hour")
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(path)


def split_feed(messages: DataFrame, column: str = "value") -> dict[str, DataFrame]:
    """Trades (``snapshot``: those of a subscription's begin), level updates, market statistics and what can't be read, of raw messages."""
    trades = tables.feed_trades(messages, column)
    return {
        "trades": trades.where("NOT corrupt").drop("corrupt"),
        "book_updates": tables.feed_book_updates(messages, column),
        "market_stats": tables.feed_stats(messages, column),
        "bad_rows": trades.where("corrupt").select(F.lit("trade").alias("kind"), "snapshot"),
    }


def write_feed_batch(messages: DataFrame, batch: int, root: str, column: str = "value") -> None:
    """One micro-batch to all tables below ``root``, and its row counts to ``counts``. Doing it again changes nothing."""
    parsed = tables.parsed_messages(messages, column).persist()
    try:
        timed = {"trades": "timestamp_ms", "book_updates": "timestamp_ms", "market_stats": "updated_at_ms", "bad_rows": None}
        counts = None
        for name, rows in split_feed(parsed, column).items():
            append_once(rows, f"{root}/{name}", batch, time=timed[name])
            # Counted from the footers of what was written; a batch without rows has no folder.
            at = f"{root}/{name}/{'date=*/hour=*/' if timed[name] else ''}batch={batch}"
            found = batch_folders(messages.sparkSession, at)
            n = messages.sparkSession.read.parquet(*found).agg(F.count(F.lit(1)).alias("rows")) if found else messages.sparkSession.range(1).select(F.lit(0).cast("long").alias("rows"))
            n = n.withColumn("name", F.lit(name))
            counts = n if counts is None else counts.unionByName(n)
        append_once(counts, f"{root}/counts", batch, time=None)
    finally:
        parsed.unpersist()


def batch_folders(spark: SparkSession, pattern: str) -> list[str]:
    """The folders that a pattern names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(pattern)
    return [x.getPath().toString() for x in at.getFileSystem(conf).globStatus(at) or []]


def feed_to_tables(messages: DataFrame, root: str, log: str, column: str = "value") -> None:
    """Run a stream of raw messages to its present end. ``log``: the checkpoint, by which a restart goes on where the last run ended; a batch that was cut off is written again in its place."""
    writer = messages.writeStream.option("checkpointLocation", log).foreachBatch(lambda df, n: write_feed_batch(df, n, root, column)).trigger(availableNow=True)
    finish(messages.sparkSession, writer)


#: Parts of a market's trades that are deduplicated apart, so that a busy market is many tasks.
PARTS = 16


class DedupProcessor(StatefulProcessor):
    """Ids seen and the last minute of event time of each, forgotten once the watermark has passed that minute.

    All of a key are one value, as packed numbers: a batch reads and writes it once, whatever time it
    spans, and it holds no more than came since the batch before and what the watermark's delay needs.
    """

    def __init__(self, columns: list[str], order: str):
        self.columns, self.order = columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ids binary, stretches binary")

    def _known(self) -> tuple[np.ndarray, np.ndarray]:
        ids, stretches = self.seen.get() if self.seen.exists() else (b"", b"")
        return np.frombuffer(bytes(ids), np.int64), np.frombuffer(bytes(stretches), np.int64)

    def _keep(self, ids: np.ndarray, stretches: np.ndarray, watermark: int) -> None:
        held = (stretches + 1) * STRETCH_MS > watermark
        if held.any():
            self.seen.update((ids[held].tobytes(), stretches[held].tobytes()))
            self.handle.registerTimer(int(stretches[held].max() + 1) * STRETCH_MS)  # for a key that nothing comes to any more
        else:
            self.seen.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Of rows that arrive at once the live one is first: what is told twice is better than what is lost.
        frame = pd.concat(list(rows)).sort_values([self.order, "snapshot"], kind="stable")
        ids, stretches = self._known()
        told = pd.DataFrame({"id": np.append(ids, frame["trade_id"].to_numpy(np.int64)), "stretch": np.append(stretches, frame["timestamp_ms"].to_numpy(np.int64) // STRETCH_MS)})
        fresh = ~told["id"].duplicated().to_numpy()[len(ids) :]
        yield frame[fresh & ~frame["snapshot"].to_numpy(bool)][self.columns]
        last = told.groupby("id", sort=False)["stretch"].max()
        self._keep(last.index.to_numpy(np.int64), last.to_numpy(np.int64), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            self._keep(*self._known(), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def dedup_with_warmup(trades: DataFrame, *, delay: str = "1 minute", order: str = "arrival_ms") -> DataFrame:
    """Live trades once each, in order of ``order`` (arrival). Those with ``snapshot`` are what a subscription begins with: they are remembered and not given out, so a trade told before or again by one comes out once if it came live first, and not at all if the snapshot came first.

    The memory of an id ends with the watermark: later repeats are late and dropped by it. Rows
    without a market, an id or a time are left out.
    """
    sound = F.col("market_id").isNotNull() & F.col("trade_id").isNotNull() & F.col("timestamp_ms").isNotNull()
    rows = trades.where(sound).withColumn("snapshot", F.coalesce("snapshot", F.lit(False))).withColumn("_part", F.pmod(F.col("trade_id"), F.lit(PARTS)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trades.schema)
    return with_event_time(rows, delay).groupBy("market_id", "_part").transformWithStateInPandas(DedupProcessor(trades.columns, order), schema, "append", "EventTime")


def merged_by_batch(stream: DataFrame, name: str, merge: Callable[[DataFrame], DataFrame], root: str | None = None) -> DataFrame:
    """A table by key, kept by a stream: each batch's rows and the table before it go through ``merge``, and the result is the next version; versions before the last two are deleted. So the table is as large as it has keys, and a batch done again gives the same version."""
    spark = stream.sparkSession
    root = root or scratch(spark, name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merge(spark.createDataFrame([], stream.schema)).schema)

    def step(batch: DataFrame, number: int) -> None:
        known = versions(spark, root)
        before = [v for v in known if v < number]
        new = merge(batch)
        if before:
            new = merge(spark.read.schema(fields).parquet(f"{root}/v={max(before)}").unionByName(new))
        new.write.mode("overwrite").parquet(f"{root}/v={number}")
        for v in sorted(before)[:-1]:
            tables.delete_folder(spark, f"{root}/v={v}")

    finish(spark, stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/log").foreachBatch(step).trigger(availableNow=True))
    found = versions(spark, root)
    return spark.read.schema(fields).parquet(f"{root}/v={max(found)}") if found else spark.createDataFrame([], fields)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished versions of a table by key."""
    return [int(p.rsplit("v=", 1)[1]) for p in tables.folders(spark, root, marked="_SUCCESS") if "/v=" in p]


def latest_by_market(stream: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The last row of each market, kept by batch."""
    last = lambda rows: rows.groupBy("market_id").agg(F.max_by(F.struct("timestamp_ms", *columns), "timestamp_ms").alias("r")).select("market_id", "r.*")
    return merged_by_batch(stream.select("market_id", "timestamp_ms", *columns), name, last)


COUNTERS = ("samples", "stale", "snapshots", "gaps")


def dq_counters_stream(books: DataFrame, updates: DataFrame, name: str, delay: str = "1 minute") -> DataFrame:
    """The counters of ``quality.dq_counters`` kept by batch: samples once each (of one market and time: the first), and what the books kept as state say of each message."""
    count = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("long")
    none = F.lit(0).cast("long")
    sampled = with_event_time(books.select("market_id", "timestamp_ms", "is_stale"), delay).dropDuplicates(["market_id", "event_time"])
    sampled = sampled.select("market_id", count(F.lit(True)).alias("samples"), count(F.col("is_stale")).alias("stale"), none.alias("snapshots"), none.alias("gaps"))
    told = book_stream(updates).select("market_id", none.alias("samples"), none.alias("stale"), count(F.col("kind") == "snapshot").alias("snapshots"), count(F.col("out_of_step")).alias("gaps"))
    sums = merged_by_batch(sampled.unionByName(told), name, lambda rows: rows.groupBy("market_id").agg(*(F.sum(c).alias(c) for c in COUNTERS)))
    return sums.select("market_id", F.col("samples").alias("actual_samples"), F.col("stale").alias("stale_count"), F.greatest(F.col("snapshots") - 1, F.lit(0)).alias("resync_count"), F.col("gaps").alias("nonce_gap_count"))
