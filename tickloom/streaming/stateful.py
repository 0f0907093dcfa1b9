"""Stateful processors: markouts that resolve in the stream, and books kept level by level.

They need the RocksDB state store, whose change log makes what a batch writes as large as what it
changed (``STATE_STORE``; ``jobs.run_to_end`` sets it for the streams that it starts).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.config import Markouts
from tickloom.functions.columns import markout_bps, regular_trade

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

RESOLVED = "market_id int, trade_id long, horizon_s int, timestamp_ms long, price double, is_maker_ask boolean, reference_mid double, future_mid double, outcome string"
#: Ids are forgotten by so long stretches of time.
STRETCH_MS = 60_000
#: A market's time is cut in bins of this length, each a key of its own: what a key holds doesn't grow with the time that a batch spans, and one market is many tasks.
BIN_MS = 21_600_000


def _rows(columns: dict, schema: str) -> pd.DataFrame:
    return pd.DataFrame({c.split()[0]: columns[c.split()[0]] for c in schema.split(", ")})


def _packed(columns: list[np.ndarray]) -> tuple[bytes, ...]:
    return tuple(c.tobytes() for c in columns)


def _unpacked(state, types: tuple) -> list[np.ndarray]:
    """The columns of a value state that holds them as packed numbers; none if there is no value."""
    held = state.get() if state.exists() else [b""] * len(types)
    return [np.frombuffer(bytes(h), t) for h, t in zip(held, types, strict=True)]


def in_bins(rows: DataFrame, before_ms: int = 0, after_ms: int = 0) -> DataFrame:
    """Each row in its bin of time (``_bin``), and once more in each other bin that begins within ``before_ms`` after it or ends within ``after_ms`` before it."""
    of = lambda ms: F.floor((F.col("timestamp_ms") + F.lit(ms)) / F.lit(BIN_MS)).cast("long")
    return rows.withColumn("_bin", F.explode(F.sequence(of(-after_ms), of(before_ms))))


class MarkoutProcessor(StatefulProcessor):
    """Trades of a market's bin wait, once for each horizon, until the watermark is past the time in which a mid may still count; then the first mid from the target on counts, else the last one before it.

    State: mids and waiting trades, each one value of packed numbers that a batch reads and writes
    once, and no more of either than the longest horizon and the watermark's delay need. One timer
    stands at the earliest waiting target, or where the last mid isn't needed any more.
    """

    MIDS, WAITING = (np.int64, float), (np.int64, np.int64, np.int64, np.int64, float, bool)

    def __init__(self, config: Markouts):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mids = handle.getValueState("mids", "times binary, mids binary")
        self.waiting = handle.getValueState("waiting", "targets binary, horizons binary, times binary, ids binary, prices binary, maker_asks binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        mids, trades = frame[frame["mid"].notna()], frame[frame["trade_id"].notna()]
        new = [mids["timestamp_ms"].to_numpy(np.int64), mids["mid"].to_numpy(float)]
        horizons = np.array(self.config.horizons_s, np.int64)
        times = np.repeat(trades["timestamp_ms"].to_numpy(np.int64), len(horizons))
        every = np.tile(horizons, len(trades))
        each = [np.repeat(trades[c].to_numpy(t), len(horizons)) for c, t in (("trade_id", np.int64), ("price", float), ("is_maker_ask", bool))]
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs(), new, [times + every * 1000, every, times, *each])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs(), None, None)

    def _settle(self, key, watermark: int, new_mids, new_waiting) -> Iterator[pd.DataFrame]:
        joined = lambda old, new: [np.append(o, n) for o, n in zip(old, new, strict=True)] if new else old
        wait, age = self.config.tolerance_ms, self.config.reference_age_ms
        at, mids = joined(_unpacked(self.mids, self.MIDS), new_mids)
        order = np.argsort(at, kind="stable")
        at, mids = at[order], mids[order]
        waiting = joined(_unpacked(self.waiting, self.WAITING), new_waiting)
        due = waiting[0] + wait < watermark
        if due.any():
            yield self._resolved(key, at, mids, *(c[due] for c in waiting))
        rest = [c[~due] for c in waiting]
        needed = max(self.config.horizons_s) * 1000 + wait + age
        kept = at >= watermark - needed
        for state, columns in ((self.mids, [at[kept], mids[kept]]), (self.waiting, rest)):
            if len(columns[0]):
                state.update(_packed(columns))
            elif state.exists():
                state.clear()
        # A timer goes off at its own time and is then deleted, also one set anew: it must stand past the target.
        if len(rest[0]):
            self.handle.registerTimer(int(rest[0].min()) + wait + 1)
        elif kept.any():
            self.handle.registerTimer(int(at[-1]) + needed + 1)

    def _resolved(self, key, at, mids, targets, horizons, times, ids, prices, maker_asks) -> pd.DataFrame:
        wait, age = self.config.tolerance_ms, self.config.reference_age_ms
        mids = np.append(mids, np.nan)
        at = np.append(at, np.iinfo(np.int64).max)
        after = np.searchsorted(at, targets, "left")
        forward = at[after] <= targets + wait
        before = np.searchsorted(at, targets, "right") - 1
        backward = ~forward & (before >= 0) & (at[before] >= targets - wait)
        future = np.where(forward, mids[after], np.where(backward, mids[before], np.nan))
        seen = np.searchsorted(at, times, "right") - 1
        reference = np.where((seen >= 0) & (at[seen] >= times - age), mids[seen], np.nan)
        outcome = np.where(forward, "forward", np.where(backward, "backward", "expired"))
        return _rows({"market_id": np.full(len(ids), key[0]), "trade_id": ids, "horizon_s": horizons, "timestamp_ms": times, "price": prices, "is_maker_ask": maker_asks, "reference_mid": reference, "future_mid": future, "outcome": outcome}, RESOLVED)

    def close(self) -> None:
        pass


def markouts_stream(trades: DataFrame, mids: DataFrame, config: Markouts = Markouts(), delay: str = "20 seconds") -> DataFrame:
    """One row for each regular trade and horizon once the watermark is past it: ``reference_mid``, ``future_mid``, ``maker_markout_bps`` and ``outcome`` (forward, backward or expired; an expired one has no mid near its target).

    ``trades`` and ``mids``: streams. Mids may come late by as much as ``delay``. Trades without a
    reference mid have a row too, without a value. ``outcome`` tells what a drop count needs.
    """
    nothing = {"trade_id": "long", "price": "double", "is_maker_ask": "boolean"}
    left = trades.where(regular_trade()).select("market_id", "timestamp_ms", F.lit(None).cast("double").alias("mid"), *(F.col(c).cast(t).alias(c) for c, t in nothing.items()))
    right = mids.where("mid > 0").select("market_id", "timestamp_ms", F.col("mid").cast("double").alias("mid"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    # A trade needs the mids from before it to past its last target.
    around = in_bins(right, max(config.reference_age_ms, config.tolerance_ms), max(config.horizons_s) * 1000 + config.tolerance_ms)
    line = in_bins(left).unionByName(around).withColumn("event_time", F.timestamp_millis("timestamp_ms")).withWatermark("event_time", delay)
    found = line.groupBy("market_id", "_bin").transformWithStateInPandas(MarkoutProcessor(config), RESOLVED, "append", "EventTime")
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    plain = found.select("market_id", "trade_id", "horizon_s", "timestamp_ms", "price", "is_maker_ask", known("reference_mid"), known("future_mid"), "outcome")
    return plain.withColumn("maker_markout_bps", markout_bps(F.col("price"), F.col("future_mid"), F.col("reference_mid"), F.col("is_maker_ask")))


ROLLED = "market_id int, trade_id long, timestamp_ms long, tpm double"


class RollingProcessor(StatefulProcessor):
    """Trades of a market's bin wait for the watermark; then those of the window before each are counted, of which the first may lie in the bin before. State: times and ids as one value of packed numbers, none older than the window and the watermark's delay need."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trades = handle.getValueState("trades", "times binary, ids binary")
        self.told = handle.getValueState("told", "upto long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs(), [frame["timestamp_ms"].to_numpy(np.int64), frame["trade_id"].to_numpy(np.int64)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs(), [np.zeros(0, np.int64)] * 2)

    def _settle(self, key, watermark: int, new: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        """The bin's trades before the watermark and not before what was told already."""
        told = self.told.get()[0] if self.told.exists() else -1
        times, ids = (np.append(o, n) for o, n in zip(_unpacked(self.trades, (np.int64, np.int64)), new, strict=True))
        order = np.lexsort((ids, times))
        times, ids = times[order], ids[order]
        own = times // BIN_MS == key[1]
        due = np.flatnonzero(own & (times > told) & (times < watermark))
        if len(due):
            upto, since = np.searchsorted(times, times[due], "right"), np.searchsorted(times, times[due] - self.window_ms + 1, "left")
            yield _rows({"market_id": np.full(len(due), key[0]), "trade_id": ids[due], "timestamp_ms": times[due], "tpm": (upto - since) * (60_000.0 / self.window_ms)}, ROLLED)
        kept = times > watermark - self.window_ms
        if not kept.any():
            self.trades.clear()
            self.told.clear()
            return
        self.trades.update(_packed([times[kept], ids[kept]]))
        if watermark - 1 > told:
            self.told.update((watermark - 1,))
        waiting = times[own & (times >= watermark)]
        self.handle.registerTimer(int(waiting[0]) + 1 if len(waiting) else int(times[-1]) + self.window_ms + 1)  # when the watermark has passed it

    def close(self) -> None:
        pass


def rolling_tpm_stream(trades: DataFrame, window_ms: int = 60_000, delay: str = "20 seconds") -> DataFrame:
    """``operators.trades.rolling_tpm`` of regular trades, each told once the watermark has passed it, so that late ones within ``delay`` count."""
    rows = in_bins(trades.where(regular_trade()).select("market_id", "trade_id", "timestamp_ms"), window_ms).withColumn("event_time", F.timestamp_millis("timestamp_ms")).withWatermark("event_time", delay)
    return rows.groupBy("market_id", "_bin").transformWithStateInPandas(RollingProcessor(window_ms), ROLLED, "append", "EventTime")


BOOK = "market_id int, timestamp_ms long, nonce long, kind string, best_bid double, best_ask double, in_step boolean, out_of_step boolean"


class _Book:
    """Levels by signed price (bids below 0), with the best of each side on a heap whose dropped entries are skipped when they come up."""

    def __init__(self, levels: dict[float, float]):
        self.levels, self.changed, self.emptied = levels, {}, False
        self.sides = {"bid": [p for p in levels if p < 0], "ask": [p for p in levels if p > 0]}
        for side in self.sides.values():
            heapq.heapify(side)

    def empty(self) -> None:
        self.levels, self.changed, self.emptied, self.sides = {}, {}, True, {"bid": [], "ask": []}

    def put(self, side: str, price: float, size: float) -> None:
        at = -price if side == "bid" else price
        if size > 0:
            if at not in self.levels:
                heapq.heappush(self.sides[side], at)
            self.levels[at] = size
        elif self.levels.pop(at, None) is None:
            return
        self.changed[at] = size if size > 0 else None

    def best(self, side: str) -> float | None:
        line = self.sides[side]
        while line and line[0] not in self.levels:
            heapq.heappop(line)
        return abs(line[0]) if line else None


class BookProcessor(StatefulProcessor):
    """A market's book as a map of levels. A message changes its own levels; a snapshot, and a message out of step, empty the map."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "price double", "size double")
        self.head = handle.getValueState("head", "nonce long, in_step boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("nonce", kind="stable")
        nonce, in_step = self.head.get() if self.head.exists() else (None, False)
        book, out = _Book({p: s for (p,), (s,) in self.levels.iterator()}), []
        columns = [frame[c].tolist() for c in ("nonce", "timestamp_ms", "begin_nonce", "kind", "side", "price", "size")]
        now = None

        def tell() -> None:
            best = (book.best("bid"), book.best("ask")) if in_step else (None, None)
            out.append((key[0], now[1], now[0], now[2], *best, in_step, fell_out))

        for number, time, begin, kind, side, price, size in zip(*columns, strict=True):
            if now is None or number != now[0]:
                if now is not None:
                    tell()
                now, fell_out = (number, time, kind), False
                if kind == "snapshot":
                    book.empty()
                    in_step = True
                elif not in_step or begin is None or begin != begin or int(begin) != nonce:
                    fell_out = in_step
                    if in_step:
                        book.empty()
                    in_step = False
                if in_step:
                    nonce = int(number)
            if in_step and price is not None and price == price:
                book.put(side, price, size)
        tell()
        if book.emptied:
            self.levels.clear()
        for price, size in book.changed.items():
            if size is not None:
                self.levels.updateValue((price,), (size,))
            elif not book.emptied:
                self.levels.removeKey((price,))
        self.head.update((nonce, bool(in_step)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BOOK.split(", ")]).astype({"best_bid": float, "best_ask": float})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass


def book_stream(updates: DataFrame) -> DataFrame:
    """Best bid and ask after each message, from books kept as state; ``out_of_step``: the message that ended a book.

    Messages of a batch are taken in order of nonce; the levels of one are applied together. A
    message without a nonce can't be put in order: as in ``operators.rebuild`` it comes to nothing.
    A batch reads a book once and writes the levels that it changed.
    """
    numbered = updates.where(F.col("nonce").isNotNull()).select("market_id", "timestamp_ms", "nonce", "begin_nonce", "kind", "side", "price", "size")
    rows = numbered.groupBy("market_id").transformWithStateInPandas(BookProcessor(), BOOK, "append", "None")
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return rows.select("market_id", "timestamp_ms", "nonce", "kind", known("best_bid"), known("best_ask"), "in_step", "out_of_step")
