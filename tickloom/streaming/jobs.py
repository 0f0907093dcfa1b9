"""Structured Streaming forms of the trade operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import regular_trade
from tickloom.sources.tables import scratch, written
from tickloom.streaming.stateful import STATE_STORE


def as_stream(rows: DataFrame, name: str, *, batches: int = 4, order: str = "timestamp_ms", file_rows: int = 1_000_000) -> DataFrame:
    """``rows`` cut in ``batches`` ranges of time, each written as equally many files, range after range, and read as a stream of one range a batch."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, name)
    rows = written(rows, f"{name}-all")  # computed once, not for each range
    bounds = rows.agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count(F.lit(1)).alias("n")).first()
    step = (bounds.b - bounds.a) // batches + 1 if bounds.a is not None else 1
    first = bounds.a or 0
    files = max(1, -(-bounds.n // (batches * file_rows)))
    none = spark.createDataFrame([], rows.schema).coalesce(1)
    for k in range(batches):  # the file source takes files in the order in which they were written
        # Bounds of the column itself, by which files skip what is outside; rows without a value are in the first range.
        within = (F.col(order) >= first + k * step) & (F.col(order) < first + (k + 1) * step)
        rows.where(within if k else within | F.col(order).isNull()).repartition(files).write.mode("append").parquet(path)
        # Partitions without rows have no files; empty ones keep the ranges to their batches.
        for _ in range((k + 1) * files - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
            none.write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    stream._replayed = (path, files)
    return stream


def batch_of(stream: DataFrame, number: int) -> DataFrame:
    """The rows of one batch of a stream that ``as_stream`` made."""
    path, files = stream._replayed
    jvm, conf = stream.sparkSession.sparkContext._jvm, stream.sparkSession.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    listed = [(x.getModificationTime(), x.getPath().toString()) for x in at.getFileSystem(conf).listStatus(at) if x.getPath().getName().startswith("part-")]
    return stream.sparkSession.read.schema(stream.schema).parquet(*[p for _, p in sorted(listed)[number * files : (number + 1) * files]])


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All output of a stream over what is there now, through an exactly-once file sink."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession, f"{name}-out")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, f"{name}-log")).format("parquet").option("path", path).trigger(availableNow=True)
    finish(spark, writer)
    return spark.read.schema(stream.schema).parquet(path)


def finish(spark: SparkSession, writer) -> None:
    """Start a stream with the state store that ``streaming.stateful`` needs, and wait for its end."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        query = writer.start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    query.awaitTermination()


def with_event_time(rows: DataFrame, delay: str, time: str = "timestamp_ms", out: str = "event_time") -> DataFrame:
    return rows.withColumn(out, F.timestamp_millis(F.col(time))).withWatermark(out, delay)


def dedup_trades_stream(trades: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Regular trades once each: the first that arrives, among those within the watermark's delay."""
    return with_event_time(trades.where(regular_trade()), delay).dropDuplicatesWithinWatermark(["market_id", "trade_id"])


def minute_bars_stream(trades: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Closed bars of one minute; a trade later than the watermark is dropped."""
    timed = with_event_time(trades.where(regular_trade()), delay)
    bars = timed.groupBy("market_id", F.window("event_time", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("trade_count"), F.sum("usd_amount").alias("trade_quote_volume_usd"))
    return bars.select("market_id", F.unix_millis("w.start").alias("minute_ms"), "trade_count", "trade_quote_volume_usd")
