"""Scans and sinks of market tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import blank_to_null_number, partition_key


_local: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names. Where that is unset: a temporary one if Spark runs in this process only, else an error, as executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tickloom-"))
    return f"{root.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to a fresh path and read again, which cuts their lineage."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def scan_market_table(rows: DataFrame, start_ms: int, end_ms: int, *, columns: list[str] | None = None, market_ids: tuple[int, ...] | None = None) -> DataFrame:
    """Rows of the closed window and the set of markets, with the columns asked for.

    Where the table is partitioned by ``date``, the window's days are a filter too, so that other
    folders aren't listed or read.
    """
    time = F.col("timestamp_ms")
    if "date" in rows.columns:
        day = lambda ms: F.date_format(F.timestamp_millis(F.lit(ms)), "yyyy-MM-dd")
        rows = rows.where(F.col("date").cast("string").between(day(start_ms), day(end_ms)))
    rows = rows.where(time.between(start_ms, end_ms))
    if market_ids is not None:
        rows = rows.where(F.col("market_id").isin(*market_ids) if market_ids else F.lit(False))
    return rows.select(*columns) if columns else rows


def conform_schema(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns, absent ones as typed nulls; the names of the absent are ``absent_columns`` of every row."""
    absent = [c for c in wanted if c not in rows.columns]
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()), F.array(*map(F.lit, absent)).cast("array<string>").alias("absent_columns"))


def discover_layout(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """All rows below ``root``, whether in ``date=/hour=`` or ``date=`` folders or both; unfinished files are left out. ``layout_depth``: 2 or 1.

    A root without files has no rows, of the given ``schema``; without one it is an error.
    """

    def read(pattern: str, depth: int) -> DataFrame | None:
        reader = spark.read.option("basePath", root).option("pathGlobFilter", "*.parquet").option("mergeSchema", True)
        try:
            found = (reader.schema(schema) if schema else reader).parquet(f"{root.rstrip('/')}/{pattern}")
        except Exception as e:  # no folder of this depth
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return found.withColumn("layout_depth", F.lit(depth))

    hourly, daily = read("date=*/hour=*", 2), read("date=*/*.parquet", 1)
    found = [x for x in (hourly, daily) if x is not None]
    if not found:
        if schema is None:
            raise ValueError(f"no Parquet files below {root}, and no schema given")
        return spark.createDataFrame([], schema).withColumn("layout_depth", F.lit(None).cast("int"))
    return found[0].unionByName(found[1], allowMissingColumns=True) if len(found) == 2 else found[0]


HEALTH = "path string, length long, valid boolean, reason string"


def file_health(spark: SparkSession, root: str, *, probe: bool = True) -> DataFrame:
    """Each Parquet file below ``root``: ``valid`` and, where it isn't, the ``reason``.

    The driver lists the first level of folders only. Tasks list what is below them, open the
    footers, which are the ends of the files, and with ``probe`` read the first row group of each.
    """

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            reasons = [_fault(system, path, n, probe) for path, n in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array([r is None for r in reasons], pa.bool_()), pa.array(reasons, pa.string())], ["path", "length", "valid", "reason"])

    return _files(spark, root).mapInArrow(checked, HEALTH)


def _files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` and ``length`` of the Parquet files below ``root``, dealt over the tasks. The driver lists the first level of folders, tasks what is below it."""
    system, base = fs.FileSystem.from_uri(root)
    first = [(e.path, e.type == fs.FileType.Directory) for e in system.get_file_info(fs.FileSelector(base, allow_not_found=True))]
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, folder in zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist(), strict=True):
                found = system.get_file_info(fs.FileSelector(path, recursive=True)) if folder else [system.get_file_info(path)]
                files = [e for e in found if e.type == fs.FileType.File and e.path.endswith(".parquet") and not e.base_name.startswith(("_", "."))]
                yield pa.RecordBatch.from_arrays([pa.array([e.path for e in files], pa.string()), pa.array([e.size for e in files], pa.int64())], ["path", "length"])

    return spark.createDataFrame(first, "path string, folder boolean").repartition(spread).mapInArrow(listed, "path string, length long").repartition(spread)


def _fault(system: fs.FileSystem, path: str, length: int, probe: bool) -> str | None:
    """Why a file can't be read, or none."""
    if not length:
        return "empty"
    step = "unreadable footer"
    try:
        with system.open_input_file(path) as source:
            file = pq.ParquetFile(source)
            step = "unreadable row group"
            if probe and file.metadata.num_row_groups:
                file.read_row_group(0)
    except (pa.ArrowException, OSError, ValueError):
        return step
    return None


def rename_files(spark: SparkSession, path: str, to: str, ending: str, new_ending: str) -> None:
    """Move the files of a folder whose names have the ending to another folder, with a new ending."""
    jvm = spark.sparkContext._jvm
    Path = jvm.org.apache.hadoop.fs.Path
    system = Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(Path(to))
    for x in system.listStatus(Path(path)):
        name = x.getPath().getName()
        if name.endswith(ending):
            system.rename(x.getPath(), Path(f"{to}/{name[: -len(ending)]}{new_ending}"))


def folders(spark: SparkSession, root: str, marked: str = "") -> list[str]:
    """Folders directly below ``root``; with ``marked``, those that hold a file of this name."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(Path(root)):
        return []
    found = [x.getPath().toString() for x in system.listStatus(Path(root)) if x.isDirectory()]
    return [f for f in found if not marked or system.exists(Path(f"{f}/{marked}"))]


def delete_folder(spark: SparkSession, path: str) -> None:
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(Path(path), True)


def footer_watermark(spark: SparkSession, root: str, column: str = "timestamp_ms") -> DataFrame:
    """``path``, ``latest_ms`` and ``from_statistics`` of each Parquet file below ``root``: the largest value of the column, by the footer's statistics of each row group, and by reading the column where a row group has none. A file that can't be read, or without the column, has none."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            paths = batch.column("path").to_pylist()
            found = [_latest(system, p, column) for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.bool_())], ["path", "latest_ms", "from_statistics"])

    return _files(spark, root).mapInArrow(marks, "path string, latest_ms long, from_statistics boolean")


def _latest(system: fs.FileSystem, path: str, column: str) -> tuple[int | None, bool]:
    latest, footer_alone = [], True
    try:
        with system.open_input_file(path) as source:
            file = pq.ParquetFile(source)
            names = file.schema.names
            if column not in names:
                return None, True
            for k in range(file.metadata.num_row_groups):
                known = file.metadata.row_group(k).column(names.index(column)).statistics
                if known is not None and known.has_min_max:
                    latest.append(int(known.max))
                elif file.metadata.row_group(k).num_rows and (known is None or known.num_values):
                    footer_alone = False
                    top = pc.max(file.read_row_group(k, columns=[column]).column(column)).as_py()
                    latest += [] if top is None else [int(top)]
    except (pa.ArrowException, OSError, ValueError):
        return None, footer_alone
    return max(latest, default=None), footer_alone


def quarantine_list(health: DataFrame) -> DataFrame:
    """The files to leave out, with reasons: what ``scan_market_table`` shouldn't be given."""
    return health.where(~F.col("valid")).select("path", "length", "reason")


def file_health_summary(health: DataFrame) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if("valid")
    return health.agg(n.alias("files"), ok.alias("valid_files"), (n - ok).alias("corrupt_files"), F.when(n == ok, "healthy").when(ok > 0, "degraded").otherwise("failed").alias("status"))


def write_partitioned(rows: DataFrame, path: str, *, mode: str = "append", salts: int = 1) -> None:
    """Files by ``date`` and ``hour`` (UTC) of the event, ``salts`` for each quarter of an hour, compressed with zstd; Spark's commit publishes whole files only."""
    date, hour, bucket = partition_key(F.col("timestamp_ms"))
    keyed = rows.withColumns({"date": date, "hour": hour})
    # A file for each rotation bucket and salt, so that no task writes a whole busy hour.
    dealt = keyed.repartition("date", "hour", bucket, F.pmod(F.xxhash64("timestamp_ms", "market_id"), F.lit(salts)))
    dealt.write.mode(mode).option("compression", "zstd").partitionBy("date", "hour").parquet(path)


# The kinds of trades, and the fields of a message and of what it holds.
TRADE_TYPES = ("trade", "liquidation", "deleverage", "market-settlement")
TRADE_FIELDS = ("trade_id", "market_id", "price", "size", "usd_amount", "is_maker_ask", "type", "timestamp")
STATS_PRICES = ("index_price", "mark_price", "mid_price", "best_bid_price", "best_ask_price", "open_interest", "last_trade_price", "current_funding_rate", "funding_rate")
STATS_DAILY = ("daily_base_token_volume", "daily_quote_token_volume", "daily_price_low", "daily_price_high", "daily_price_change")
MESSAGE_FIELDS = ("type", "channel", "timestamp", "trades", "liquidation_trades", "market_stats", "order_book")

_texts = lambda names: T.StructType([T.StructField(c, T.StringType()) for c in names])
TRADE, STATS, MESSAGE = _texts(TRADE_FIELDS), _texts(("market_id", "symbol", "funding_timestamp", *STATS_PRICES, *STATS_DAILY)), _texts(MESSAGE_FIELDS)
BOOK = T.StructType([*_texts(("nonce", "begin_nonce")), *(T.StructField(side, T.ArrayType(_texts(("price", "size")))) for side in ("bids", "asks"))])


def parsed_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    """Messages parsed once for all that ``feed_trades``, ``feed_stats`` and ``feed_book_updates`` take from them; these take either."""
    return _messages(messages, column)


def _messages(messages: DataFrame, column: str) -> DataFrame:
    """``_m``, the parsed message, and ``_market``, the number after the colon of its channel."""
    if messages.columns == ["_m", "_market"]:
        return messages
    parsed = messages.select(F.from_json(column, MESSAGE, {"mode": "PERMISSIVE"}).alias("_m"))
    return parsed.withColumn("_market", F.split_part("_m.channel", F.lit(":"), F.lit(2)).try_cast("int"))


def _items(text: Column) -> Column:
    """The texts of a list's objects; one object alone is an item too, anything else none."""
    alone = F.ltrim(text)
    listed = F.filter(F.from_json(text, T.ArrayType(T.StringType())), lambda x: F.ltrim(x).startswith("{"))
    return F.when(alone.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).when(alone.startswith("{"), F.array(text)).otherwise(F.array().cast("array<string>"))


def feed_trades(messages: DataFrame, column: str = "value") -> DataFrame:
    """Trades of raw feed messages (JSON texts), from lists or single objects.

    ``snapshot``: those that a subscription begins with, which only tell what was seen before. The
    market is the channel's, else the trade's own. A message or a trade that can't be read is a row
    with ``corrupt``, without its other fields. Messages of other kinds give no rows.
    """
    parsed = _messages(messages, column)
    kind = F.col("_m.type")
    unread = F.col("_m").isNull() | (kind.isNull() & F.col("_m.channel").isNull())
    about = parsed.where(unread | kind.isin("update/trade", "subscribed/trade"))
    rows = about.select("_market", (kind == "subscribed/trade").alias("snapshot"), unread.alias("_unread"), F.explode_outer(F.concat(_items(F.col("_m.trades")), _items(F.col("_m.liquidation_trades")))).alias("_text"))
    rows = rows.where("_unread OR _text IS NOT NULL").withColumn("_t", F.from_json("_text", TRADE))
    number = lambda c: blank_to_null_number(F.col(f"_t.{c}"))
    kind_of = F.coalesce(F.nullif(F.col("_t.type"), F.lit("")), F.lit("trade"))
    usd = F.coalesce(F.nullif(F.col("_t.usd_amount"), F.lit("")), F.lit("0")).try_cast("double")
    fields = {
        "market_id": F.coalesce("_market", F.col("_t.market_id").try_cast("int")),
        "trade_id": F.col("_t.trade_id").try_cast("long"),
        "timestamp_ms": F.col("_t.timestamp").try_cast("long"),
        "price": number("price"),
        "size": number("size"),
        "usd_amount": usd,
        "is_maker_ask": F.lower("_t.is_maker_ask").try_cast("boolean"),
        "type": F.when(kind_of.isin(*TRADE_TYPES), kind_of),
    }
    whole = ~F.col("_unread") & F.col("_t.market_id").try_cast("int").isNotNull()
    for c in fields.values():
        whole = whole & c.isNotNull()
    return rows.select(*(F.when(whole, c).alias(n) for n, c in fields.items()), F.coalesce("snapshot", F.lit(False)).alias("snapshot"), (~whole).alias("corrupt"))


def feed_stats(messages: DataFrame, column: str = "value") -> DataFrame:
    """Market statistics of raw feed messages: from an object, a map of objects or a list. Blank numbers are null; what has no market or symbol is left out."""
    parsed = _messages(messages, column).where(F.col("_m.type").isin("update/market_stats", "subscribed/market_stats"))
    text = F.col("_m.market_stats")
    one = F.from_json(text, STATS)
    by_key = F.map_values(F.coalesce(F.from_json(text, T.MapType(T.StringType(), T.StringType())), F.create_map().cast("map<string,string>")))
    items = F.when(F.ltrim(text).startswith("{") & one["market_id"].isNull(), by_key).otherwise(_items(text))
    rows = parsed.select(F.explode(items).alias("_text"), F.col("_m.timestamp").try_cast("long").alias("updated_at_ms")).withColumn("_s", F.from_json("_text", STATS))
    numbers = [blank_to_null_number(F.col(f"_s.{c}")).alias(c) for c in (*STATS_PRICES, *STATS_DAILY)]
    out = rows.select(F.col("_s.market_id").try_cast("int").alias("market_id"), F.col("_s.symbol").alias("symbol"), *numbers, F.col("_s.funding_timestamp").try_cast("long").alias("funding_timestamp"), "updated_at_ms")
    return out.where(F.col("market_id").isNotNull() & F.col("symbol").isNotNull())


def feed_book_updates(messages: DataFrame, column: str = "value") -> DataFrame:
    """Level updates of raw feed messages, as ``operators.rebuild`` takes them: a row for each level, one without a price for an empty message. Messages without a market are left out."""
    kind = F.col("_m.type")
    parsed = _messages(messages, column).where(kind.isin("update/order_book", "subscribed/order_book") & F.col("_market").isNotNull()).withColumn("_b", F.from_json("_m.order_book", BOOK))
    side = lambda name, given: F.transform(F.coalesce(F.col(f"_b.{given}"), F.array().cast(BOOK[given].dataType)), lambda x: F.struct(F.lit(name).alias("side"), x["price"].try_cast("double").alias("price"), x["size"].try_cast("double").alias("size")))
    rows = parsed.select(F.col("_market").alias("market_id"), F.col("_m.timestamp").try_cast("long").alias("timestamp_ms"), F.col("_b.nonce").try_cast("long").alias("nonce"), F.col("_b.begin_nonce").try_cast("long").alias("begin_nonce"), F.when(kind == "subscribed/order_book", "snapshot").otherwise("delta").alias("kind"), F.explode_outer(F.concat(side("bid", "bids"), side("ask", "asks"))).alias("_l"))
    return rows.select("market_id", "timestamp_ms", "nonce", "begin_nonce", "kind", "_l.side", "_l.price", "_l.size")


def market_dimension(markets: DataFrame, *, active_only: bool = True) -> DataFrame:
    """Perpetual markets, by default the active ones."""
    keep: Column = F.col("market_type") == "perp"
    return markets.where(keep & (F.col("status") == "active") if active_only else keep).select("market_id", "symbol", "market_type", "status")


def publish_generation(tables: dict[str, DataFrame], root: str, generation: str, *, by: dict[str, str] | None = None) -> DataFrame:
    """Write the tables below ``generations/<id>`` and, after all of them, a pointer row; returns the pointer as read back.

    ``by``: tables with a document for each value of a column, in a folder of that name.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by[name]) if by and name in by else writer).json(f"{root}/generations/{generation}/{name}")
    spark.range(1).select(F.lit(generation).alias("generation"), F.array(*map(F.lit, tables)).alias("tables")).coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return spark.read.schema("generation string, tables array<string>").json(f"{root}/current")


def export_csv(rows: DataFrame, path: str) -> None:
    """``rows`` as CSV with a header below ``path``; one row ``no data`` where there are none."""
    some = rows.limit(1).count()
    out = rows if some else rows.sparkSession.range(1).select(F.lit("no data").alias("message"))
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
