import math

from pyspark.sql import functions as F

from tickloom.operators import books, fills, ledger, temporal, trades
from tickloom.operators.rebuild import level_intervals

MIDS = "market_id int, timestamp_ms long, mid double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_forward_moves_of_a_geometric_series(spark):
    rows = [(1, k * 5_000, 100 * 1.0001**k) for k in range(13)] + [(2, 3_000, 50.0)]
    got = {r.market_id: r for r in books.volatility_horizons(spark.createDataFrame(rows, MIDS)).collect()}
    assert (got[1].mid_move_5s_count, got[1].mid_move_30s_count, got[1].mid_move_60s_count) == (12, 7, 1)
    assert abs(got[1].p50_abs_mid_move_5s_bps - math.log(1.0001) * 1e4) < 1e-9
    assert got[2].mid_move_5s_count == 0
    assert "Join" not in plan(books.forward_horizon_pairs(spark.createDataFrame(rows, MIDS)))


def test_earliest_in_the_window_counts(spark):
    rows = [(1, 0, 1.0), (1, 5_500, 2.0), (1, 6_000, 3.0)]
    assert books.forward_horizon_pairs(spark.createDataFrame(rows, MIDS), (5,)).where("timestamp_ms = 0").first().mid_5s == 2.0


def _fill(spark, trade_ms, usd, price=99.0, maker_ask=False):
    snap = spark.createDataFrame([(1, "M", 0, 100.0, 101.0, 100.0, 100.0)], "market_id int, symbol string, timestamp_ms long, best_bid double, best_ask double, best_bid_size_usd double, best_ask_size_usd double")
    trade = spark.createDataFrame([(1, trade_ms, price, usd, maker_ask)], "market_id int, timestamp_ms long, price double, usd_amount double, is_maker_ask boolean")
    eligible = fills.touch_flow_eligible(snap, trade)
    assert "CartesianProduct" not in plan(eligible) and "BroadcastNestedLoopJoin" not in plan(eligible)
    return fills.fill_rates(eligible).first()


def test_fill_boundaries(spark):
    assert _fill(spark, 1_000, 149.99).bid_conservative_5s_50 == 0.0
    assert _fill(spark, 1_000, 150.0).bid_conservative_5s_50 == 1.0
    assert _fill(spark, 0, 150.0).bid_optimistic_30s_50 == 0.0  # at the snapshot's own time
    assert _fill(spark, 30_000, 150.0).bid_optimistic_30s_50 == 1.0
    assert _fill(spark, 30_000, 150.0).bid_optimistic_5s_50 == 0.0
    assert _fill(spark, 1_000, 150.0, price=100.5).bid_optimistic_5s_50 == 0.0
    assert _fill(spark, 1_000, 150.0, price=101.0, maker_ask=True).mkt_optimistic_5s_50 == 0.0  # the other side had nothing


def test_minute_slots_hold_zeros(spark):
    windows = spark.createDataFrame([(1, 59_000, 130_000, 71.0)], "market_id int, effective_start_ms long, effective_end_ms long, market_observation_seconds double")
    rows = spark.createDataFrame([(1, 7, 61_000)], "market_id int, trade_id long, timestamp_ms long")
    assert [r.trade_count for r in trades.minute_slots(rows, windows).orderBy("minute_idx").collect()] == [0, 1, 0]
    assert trades.trades_per_minute(rows, windows).first().trades_per_minute_median == 0.0


def test_asof_never_looks_ahead(spark):
    rows = spark.createDataFrame([(1, 10, "a"), (1, 4_000, "b"), (2, 10, "c")], "market_id int, timestamp_ms long, who string")
    states = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0)], MIDS)
    got = {r.who: r.mid for r in temporal.asof_backward(rows, states, ["market_id"], ["mid"], longest_ms=3_000).collect()}
    assert got == {"a": 1.0, "b": None, "c": None}


def test_fifo_equals_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(1, k, k * 1_000, rng.choice(["bid", "ask"]), float(rng.randint(1, 4)), 100.0 + rng.randint(-5, 5)) for k in range(120)]
    lots, profit = [], 0.0
    for _, _, _, side, qty, price in rows:
        while qty and lots and lots[0][0] != side:
            used = min(qty, lots[0][1])
            profit += used * ((price - lots[0][2]) if side == "ask" else (lots[0][2] - price))
            qty -= used
            lots[0][1] -= used
            if not lots[0][1]:
                lots.pop(0)
        if qty:
            lots.append([side, qty, price])
    df = spark.createDataFrame(rows, "market_id int, fill_id long, timestamp_ms long, side string, qty_base double, price double")
    assert abs(ledger.realized_pnl(df).first().realized_pnl_usd - profit) < 1e-9
    mids = spark.createDataFrame([(1, 999_000, 103.0)], MIDS)
    still = sum(q * ((103.0 - p) if s == "bid" else (p - 103.0)) for s, q, p in lots)
    assert abs(ledger.unrealized_pnl(df, mids).first().unrealized_pnl_usd - still) < 1e-9


def test_rebuild_equals_a_loop(spark):
    updates = [
        (1, 10, 1, None, "snapshot", "bid", 99.0, 5.0), (1, 20, 2, 1, "delta", "ask", 101.0, 4.0), (1, 30, 3, 2, "delta", "bid", 99.0, 0.0),
        (1, 40, 5, 4, "delta", "bid", 98.0, 1.0), (1, 50, 6, 5, "delta", "ask", 102.0, 1.0), (1, 60, 7, 6, "snapshot", "ask", 103.0, 2.0),
    ]
    df = spark.createDataFrame(updates, "market_id int, timestamp_ms long, nonce long, begin_nonce long, kind string, side string, price double, size double")
    got = sorted((r.price, r.from_ms, r.to_ms) for r in level_intervals(df).collect())
    assert got == [(99.0, 10, 30), (101.0, 20, 40), (103.0, 60, None)]


def test_persistence_gap_is_one_interval(spark):
    rows = [(1, 0, 100.0, 10.0), (1, 100_000, 100.0, 1.0)]
    df = spark.createDataFrame(rows, "market_id int, timestamp_ms long, mid double, spread_bps double").withColumns({"is_usable": F.lit(True), "best_bid": F.lit(99.0), "best_ask": F.lit(101.0)})
    assert books.spread_persistence(df).first().pct_time_spread_ge_5bps == 0.5


def test_empty_tables(spark):
    none = spark.createDataFrame([], MIDS)
    assert books.volatility_consecutive(none).collect() == []
    assert books.forward_horizon_pairs(none).collect() == []


UPDATES = "market_id int, timestamp_ms long, nonce long, begin_nonce long, kind string, side string, price double, size double"


def _random_updates(seed):
    """Messages of several levels, with deletes, gaps, missing nonces and empty messages."""
    import random

    rng, rows, at, before = random.Random(seed), [], 0, None
    for nonce in range(3, 400, 3):
        at += rng.choice([0, 900, 2_700])
        kind = "snapshot" if rng.random() < 0.06 else "delta"
        begin = rng.choice([before, before, before, before, before, before, before, before, 1, None])
        levels = rng.sample(range(-8, 9), rng.choice([0, 1, 2, 5] if kind == "delta" else [0, 3, 6]))
        rows += [(1, at, nonce, begin, kind, "bid" if k < 0 else "ask", 100.0 + k, float(rng.choice([0, 1, 2]))) for k in levels] or [(1, at, nonce, begin, kind, None, None, None)]
        before = nonce
    return rows


def _books(rows):
    """Time, nonce, levels (None: out of step) and time of the last applied message after each message, by a loop."""
    out, book, in_step, last, heard = [], {}, False, None, None
    for nonce in sorted({r[2] for r in rows}):
        own = [r for r in rows if r[2] == nonce]
        if own[0][4] == "snapshot":
            book, in_step = {}, True
        elif not in_step or own[0][3] != last:
            book, in_step = {}, False
        if in_step:
            last, heard = nonce, own[0][1]
            for r in own:
                if r[6] is not None:
                    book = {k: v for k, v in book.items() if k != r[6]} | ({r[6]: r[7]} if r[7] else {})
        out.append((own[0][1], nonce, dict(book) if in_step else None, heard))
    return out


def test_books_of_many_levels_equal_a_loop(spark):
    from tickloom.config import Sampling
    from tickloom.operators.rebuild import book_sample_grid
    from tickloom.streaming import jobs, stateful

    for seed in range(3):
        rows = _random_updates(seed)
        df, truth, end = spark.createDataFrame(rows, UPDATES), _books(rows), max(r[1] for r in rows) + 30_000
        got = {r.grid_ms: r for r in book_sample_grid(df, end, Sampling(depth_bps=(150,), inactive_ms=4_000)).collect()}
        grid = range(-(-rows[0][1] // 5_000) * 5_000, end + 1, 5_000)
        assert sorted(got) == list(grid)
        for at in grid:
            _, _, book, heard = [t for t in truth if t[0] <= at][-1]
            bids, asks, r = [p for p in book or () if p < 100], [p for p in book or () if p >= 100], got[at]
            assert (r.best_bid, r.best_ask) == (max(bids, default=None), min(asks, default=None))
            mid = (max(bids) + min(asks)) / 2 if bids and asks else None
            assert (r.mid, r.is_usable) == (mid, mid is not None)
            assert r.book_update_age_ms == (None if heard is None else at - heard) and r.is_inactive == (heard is None or at - heard > 4_000)
            near = sum(p * book[p] for p in bids if p >= mid - mid * 0.015) if mid else 0.0
            assert abs(r.bid_depth_150bps_usd - near) < 1e-9
        streamed = {r.nonce: r for r in jobs.run_to_end(stateful.book_stream(jobs.as_stream(df, "t", order="nonce", file_rows=40)), "t").collect()}
        for at, nonce, book, _ in truth:
            bids, asks, r = [p for p in book or () if p < 100], [p for p in book or () if p >= 100], streamed[nonce]
            assert (r.timestamp_ms, r.best_bid, r.best_ask, r.in_step) == (at, max(bids, default=None), min(asks, default=None), book is not None)


def test_time_bins_change_no_result(spark):
    import random

    rng = random.Random(5)
    times = sorted(rng.sample(range(0, 4_000), 150))
    states = spark.createDataFrame([(1, t, float(t)) for t in times[::2]], MIDS)
    rows = spark.createDataFrame([(1, t, k) for k, t in enumerate(times[1::2])], "market_id int, timestamp_ms long, n int")
    for longest in (None, 90):
        for bin_ms in (10, 130, 10**6):
            got = {r.n: r.mid for r in temporal.asof_backward(rows, states, ["market_id"], ["mid"], longest_ms=longest, bin_ms=bin_ms).collect()}
            assert got == {k: max((float(s) for s in times[::2] if s <= t and (longest is None or t - s <= longest)), default=None) for k, t in enumerate(times[1::2])}
    for bin_ms in (10, 130):
        got = {r.timestamp_ms: r.b for r in temporal.previous(states, ["market_id"], ("timestamp_ms",), "mid", "b", bin_ms=bin_ms).collect()}
        assert got == dict(zip(times[::2], [None, *map(float, times[::2][:-1])], strict=True))
        near = temporal.nearest_forward_then_backward(rows, states, ["market_id"], "mid", target="timestamp_ms", tolerance_ms=40, out="x", bin_ms=bin_ms)
        for r in near.collect():
            ahead, back = [s for s in times[::2] if 0 <= s - r.timestamp_ms <= 40], [s for s in times[::2] if 0 <= r.timestamp_ms - s <= 40]
            assert r.x == (min(ahead) if ahead else max(back, default=None))


def test_running_values_equal_windows(spark):
    import random

    from pyspark.sql import Window

    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2, None]), t, k, rng.choice([None, float(rng.randint(-5, 5))])) for k, t in enumerate(rng.choices([None, *range(0, 900, 7)], k=300))]
    df = spark.createDataFrame(rows, "k int, t long, n int, x double")
    line = Window.partitionBy("k").orderBy("t", "n")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("n", F.coalesce(F.sum("x").over(upto), F.lit(0.0)).alias("s"), F.max("x").over(upto).alias("h"), F.lag("x").over(line).alias("b"), F.lead("x").over(line).alias("a"))
    for bin_ms in (5, 50, 10_000):
        got = temporal.running(df, ["k"], ("t", "n"), sums={"s": F.col("x")}, highs={"h": F.col("x")}, before={"b": "x"}, after={"a": "x"}, bin=temporal.bin_of(F.col("t"), bin_ms))
        assert sorted(got.select("n", "s", "h", "b", "a").collect()) == sorted(want.collect()) or {tuple(r) for r in got.select("n", "s", "h", "b", "a").collect()} == {tuple(r) for r in want.collect()}


def test_selected_percentiles_equal_spark_s(spark):
    import random

    from tickloom.operators.selection import exact_percentiles

    rng = random.Random(6)
    rows = [(k, x, y) for k, x, y in [(rng.choice([1, 1, 1, 1, 2, None]), rng.choice([None, rng.gauss(0, 1), 7.0, rng.lognormvariate(0, 20), -1e300]), float(rng.randint(0, 3))) for _ in range(800)]]
    rows += [(3, 1.0, 2.0), (4, None, None)] + [(5, 4.5, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, x double, y double").coalesce(2)
    wanted = {"x0": ("x", 0.0), "x3": ("x", 0.3), "x5": ("x", 0.5), "x95": ("x", 0.95), "x1": ("x", 1.0), "y5": ("y", 0.5), "y9": ("y", 0.9)}
    want = {r.k: tuple(r[n] for n in wanted) for r in df.groupBy("k").agg(*(F.percentile(c, p).alias(n) for n, (c, p) in wanted.items())).collect() if r.k != 4}
    for accuracy, margin in ((10_000, 0.0005), (10, 0.01)):  # the second: bounds that miss, and are widened
        got = {r.k: tuple(r[n] for n in wanted) for r in exact_percentiles(df, ["k"], {n: (F.col(c), p) for n, (c, p) in wanted.items()}, accuracy=accuracy, margin=margin).collect()}
        assert got.keys() == want.keys()
        for k, values in want.items():
            assert all(a == b or abs(a - b) <= 1e-9 * max(1.0, abs(b)) for a, b in zip(got[k], values, strict=True)), (k, got[k], values)


def test_fractions_pair_first_in_first_out(spark):
    import random
    from fractions import Fraction

    from tickloom.operators import ledger

    schema = "market_id int, fill_id long, timestamp_ms long, side string, qty_base double, price double"
    told = [(1, 1, 1, "bid", 0.1, 10.0), (1, 2, 2, "bid", 0.2, 11.0), (1, 3, 3, "ask", 0.3, 12.0), (1, 4, 4, "bid", 0.1, 9.0), (1, 5, 5, "ask", 0.1, 13.0)]
    pairs = sorted((r.buy_id, r.sell_id, r.qty) for r in ledger.fifo_matches(spark.createDataFrame(told, schema)).collect())
    assert pairs == [(1, 3, 0.1), (2, 3, 0.2), (4, 5, 0.1)]

    rng = random.Random(4)
    fills = [(rng.choice([1, 1, 1, 2]), k, k * 10, rng.choice(["bid", "ask"]), rng.randint(1, 40) / 10, float(rng.randint(90, 110))) for k in range(400)]
    lots, want = {}, {}
    for market, fill, _, side, qty, _ in fills:
        left = Fraction(str(qty))
        queue = lots.setdefault((market, "ask" if side == "bid" else "bid"), [])
        while left and queue:
            part = min(left, queue[0][1])
            key = (market, fill, queue[0][0]) if side == "bid" else (market, queue[0][0], fill)
            want[key] = want.get(key, 0) + part
            queue[0][1] -= part
            left -= part
            if not queue[0][1]:
                queue.pop(0)
        if left:
            lots.setdefault((market, side), []).append([fill, left])
    df = spark.createDataFrame(fills, schema)
    for bin_fills in (3, 50, 10_000):
        got = {(r.market_id, r.buy_id, r.sell_id): Fraction(str(r.qty)) for r in ledger.fifo_matches(df, bin_fills=bin_fills).collect()}
        assert got == want
    hot = plan(ledger.fifo_matches(df))
    assert all("_bin" in part.split(")")[0] or "side" in part.split(")")[0] for part in hot.split("Window")[1:] if "fill_id" in part.split(")")[0])


def test_a_hot_market_is_many_tasks(spark):
    """One market with nine tenths of the rows: windows are partitioned by its bins too."""
    rows = spark.range(20_000).select((F.when(F.col("id") % 10 > 0, 1).otherwise(2)).cast("int").alias("market_id"), (F.col("id") * 1_000).alias("timestamp_ms"), (100 + F.rand(1)).alias("mid"))
    for df in (books.forward_horizon_pairs(rows), temporal.previous(rows, ["market_id"], ("timestamp_ms",), "mid", "b")):
        assert "hashpartitioning(market_id" in plan(df) and "_bin" in plan(df).split("Window")[1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    sizes = books.forward_horizon_pairs(rows).withColumn("p", F.spark_partition_id()).where("market_id = 1").groupBy("p").agg(F.count(F.lit(1)).alias("count"), F.sum("mid_5s")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < 12_000


def test_files_that_cannot_be_read(spark, tmp_path):
    from tickloom.sources import tables

    root = tmp_path / "data" / "date=2024-01-01"
    spark.range(2_000).coalesce(1).write.parquet(str(root / "hour=00"))
    whole = next((root / "hour=00").glob("*.parquet")).read_bytes()
    garbled, cut = bytearray(whole), whole[: len(whole) // 2]
    garbled[-200:-8] = b"\xff" * 192
    broken = bytearray(whole)
    broken[4:60] = b"\xff" * 56
    for name, content in (("empty", b""), ("garbled", bytes(garbled)), ("cut", cut), ("text", b"PAR1 text PAR1"), ("rows", bytes(broken))):
        (root / f"{name}.parquet").write_bytes(content)
    health = tables.file_health(spark, str(tmp_path / "data"))
    bad = {r.path.rsplit("/", 1)[1].split(".")[0]: r.reason for r in tables.quarantine_list(health).collect()}
    assert set(bad) == {"empty", "garbled", "cut", "text", "rows"} and bad["empty"] == "empty"
    assert tables.file_health_summary(health).first().asDict() == {"files": 6, "valid_files": 1, "corrupt_files": 5, "status": "degraded"}


def test_layout_without_files(spark, tmp_path):
    import pytest

    from tickloom.sources import tables

    schema = spark.range(1).schema
    assert tables.discover_layout(spark, str(tmp_path), schema).count() == 0
    with pytest.raises(ValueError, match="no Parquet files"):
        tables.discover_layout(spark, str(tmp_path))


def test_marks_never_go_back(spark):
    from tickloom.operators import quality

    mark = spark.createDataFrame([(1, 50), (2, 10)], "market_id int, durable_ms long")
    after = quality.advance_watermark(mark, spark.createDataFrame([(1, 40), (2, 20), (3, None)], "market_id int, durable_ms long"))
    assert sorted((r.market_id, r.durable_ms) for r in after.collect()) == [(1, 50), (2, 20), (3, None)]
