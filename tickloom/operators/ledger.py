"""Profit and loss of a ledger of fills: ``market_id``, ``fill_id``, ``timestamp_ms``, ``side`` (bid: bought), ``qty_base``, ``price``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import markout_bps
from tickloom.operators.temporal import asof_backward, nearest_forward_then_backward, running

FLAT = 1e-9


#: Quantities are added up as decimals: sums of doubles are neither exact nor the same in any order.
QUANTITY = "decimal(28,12)"
#: Fills of a market that meet in one bin of quantity, about.
BIN_FILLS = 2048
_ORDER = ("timestamp_ms", "fill_id")


def _quantity(c: str = "qty_base"):
    return F.col(c).cast(QUANTITY)


def _counted(fills: DataFrame) -> DataFrame:
    """``upto``: quantity of the market's side up to and with the fill; ``qty_base`` is a decimal."""
    exact = fills.withColumn("qty_base", _quantity())
    return running(exact, ["market_id", "side"], _ORDER, sums={"upto": F.col("qty_base")})


def fifo_matches(fills: DataFrame, *, bin_fills: int = BIN_FILLS) -> DataFrame:
    """Quantities closed against each other first in, first out, with ``pnl`` dated by the later fill.

    Lots are of one side at a time, so the k-th unit bought always meets the k-th unit sold. The ends
    of both sides' fills, in order of quantity, cut the units into pieces of one purchase and one
    sale each. A market's units are dealt in bins of quantity, so that one with most of the fills is
    many tasks; a fill that reaches over bins has a part in each, and the parts of a pair are added.
    """
    counted = _counted(fills)
    totals = counted.groupBy("market_id").agg(F.max("upto").alias("_all"), F.count(F.lit(1)).alias("_n"))
    width = F.greatest((F.col("_all") / F.ceil(F.col("_n") / bin_fills)).cast("decimal(38,12)"), F.lit("0.000000000001").cast("decimal(38,12)"))
    known = counted.join(totals.select("market_id", width.alias("_w")), "market_id").withColumn("_from", F.col("upto") - F.col("qty_base"))
    # One more at either end, as quotients are rounded; parts without a quantity go.
    bins = F.sequence(F.floor(F.col("_from") / F.col("_w")).cast("long") - 1, F.ceil(F.col("upto") / F.col("_w")).cast("long"))
    parts = known.where("qty_base > 0").withColumn("_bin", F.explode(bins)).withColumns({"end": F.least(F.col("upto"), ((F.col("_bin") + 1) * F.col("_w")).cast("decimal(38,12)")), "_begin": F.greatest(F.col("_from"), (F.col("_bin") * F.col("_w")).cast("decimal(38,12)"))}).where("end > _begin")
    fill = F.struct("timestamp_ms", "price", "fill_id")
    ends = parts.select("market_id", "_bin", "_begin", "end", F.when(F.col("side") == "bid", fill).alias("buy"), F.when(F.col("side") == "ask", fill).alias("sell"))
    cuts = ends.groupBy("market_id", "_bin", "end").agg(F.max("buy").alias("buy"), F.max("sell").alias("sell"), F.min("_begin").alias("_begin"))
    line = Window.partitionBy("market_id", "_bin").orderBy("end")
    onward = line.rowsBetween(0, Window.unboundedFollowing)
    lowest = F.min("_begin").over(Window.partitionBy("market_id", "_bin"))
    pieces = cuts.select("market_id", (F.col("end") - F.coalesce(F.lag("end").over(line), lowest)).alias("qty"), F.first("buy", ignorenulls=True).over(onward).alias("b"), F.first("sell", ignorenulls=True).over(onward).alias("s"))
    pairs = pieces.where(F.col("b").isNotNull() & F.col("s").isNotNull()).groupBy("market_id", F.col("b.fill_id").alias("buy_id"), F.col("s.fill_id").alias("sell_id")).agg(F.sum("qty").cast("double").alias("qty"), F.max("b").alias("b"), F.max("s").alias("s"))
    return pairs.select("market_id", "qty", "buy_id", "sell_id", F.col("b.price").alias("buy_price"), F.col("s.price").alias("sell_price"), ((F.col("s.price") - F.col("b.price")) * F.col("qty")).alias("pnl"), F.greatest("b.timestamp_ms", "s.timestamp_ms").alias("closed_ms"))


def realized_pnl(fills: DataFrame) -> DataFrame:
    return fifo_matches(fills).groupBy("market_id").agg(F.sum("pnl").alias("realized_pnl_usd"), F.sum("qty").alias("closed_qty"))


def unrealized_pnl(fills: DataFrame, mids: DataFrame) -> DataFrame:
    """Open lots at the market's last mid."""
    counted = _counted(fills)
    none = F.lit(0).cast("decimal(38,12)")
    side = lambda name: F.coalesce(F.sum(F.when(F.col("side") == name, _quantity())), none)
    totals = fills.groupBy("market_id").agg(side("bid").alias("_bought"), side("ask").alias("_sold"))
    last = mids.groupBy("market_id").agg(F.max_by("mid", "timestamp_ms").alias("last_mid"))
    rows = counted.join(totals, "market_id").join(last, "market_id")
    closed = F.least("_bought", "_sold")
    still = F.greatest(none, F.col("upto") - F.greatest(F.col("upto") - F.col("qty_base"), closed)).cast("double")
    signed = F.when(F.col("side") == "bid", still).otherwise(-still)
    return rows.groupBy("market_id").agg(F.sum(signed).alias("open_qty"), F.sum(signed * (F.col("last_mid") - F.col("price"))).alias("unrealized_pnl_usd"), F.max("last_mid").alias("last_mid"))


def positions(fills: DataFrame) -> DataFrame:
    """``position``: signed quantity after each fill, added up exactly."""
    signed = F.when(F.col("side") == "bid", _quantity()).otherwise(-_quantity())
    return running(fills, ["market_id"], _ORDER, sums={"position": signed}).withColumn("position", F.col("position").cast("double"))


def round_trips(fills: DataFrame) -> DataFrame:
    """From flat to flat again: how many, and their median, p90 (nearest rank) and longest seconds."""
    flat = (F.abs("position") < FLAT).cast("int")
    trips = running(positions(fills).withColumn("_flat", flat), ["market_id"], _ORDER, sums={"_upto": F.col("_flat")}).withColumn("_trip", F.col("_upto") - F.col("_flat"))
    held = trips.groupBy("market_id", "_trip").agg(F.min("timestamp_ms").alias("_from"), F.max(F.when(F.col("_flat") == 1, F.col("timestamp_ms"))).alias("_to")).where(F.col("_to").isNotNull()).withColumn("seconds", (F.col("_to") - F.col("_from")) / 1000.0)
    return held.groupBy("market_id").agg(F.count(F.lit(1)).alias("round_trips"), F.percentile("seconds", 0.5).alias("median_holding_seconds"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY seconds)").alias("p90_holding_seconds"), F.max("seconds").alias("max_holding_seconds"))


def inventory_exposure(fills: DataFrame, mids: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Share of the window with a position, its largest value and the last one."""
    priced = running(asof_backward(positions(fills), mids, ["market_id"], ["mid"]), ["market_id"], _ORDER, after={"_next": "timestamp_ms"})
    step = (F.coalesce("_next", F.lit(end_ms)) - F.col("timestamp_ms")) / 1000.0
    rows = priced.withColumns({"_s": F.greatest(step, F.lit(0.0)), "_usd": F.abs(F.col("position")) * F.coalesce("mid", "price")})
    window_s = max((end_ms - start_ms) / 1000.0, 1.0)
    held = F.sum(F.when(F.abs("position") >= FLAT, F.col("_s")).otherwise(0.0))
    return rows.groupBy("market_id").agg((held / window_s * 100.0).alias("time_with_inventory_pct"), F.max("_usd").alias("max_abs_inventory_usd"), F.max_by("position", F.struct("timestamp_ms", "fill_id")).alias("final_position"))


def fill_markouts(fills: DataFrame, mids: DataFrame, end_ms: int, horizons_s: tuple[int, ...] = (5, 30), tolerance_ms: int = 2_500) -> DataFrame:
    """Median and number of the fills' markouts; none whose horizon ends after the window."""
    priced = asof_backward(fills, mids, ["market_id"], ["mid"]).withColumnRenamed("mid", "reference_mid")
    aimed = priced.withColumn("horizon_s", F.explode(F.array(*map(F.lit, horizons_s)))).withColumn("target_ms", F.col("timestamp_ms") + F.col("horizon_s") * 1000).where(F.col("target_ms") <= end_ms)
    found = nearest_forward_then_backward(aimed, mids, ["market_id"], "mid", target="target_ms", tolerance_ms=tolerance_ms, out="future_mid")
    value = markout_bps(F.col("price"), F.col("future_mid"), F.col("reference_mid"), F.col("side") == "ask")
    at = lambda h: F.when(F.col("horizon_s") == h, value)
    return found.groupBy("market_id").agg(*(c for h in horizons_s for c in (F.percentile(at(h), 0.5).alias(f"markout_{h}s_median_bps"), F.count(at(h)).alias(f"markout_{h}s_count"))))


def pnl_summary(fills: DataFrame, mids: DataFrame, start_ms: int, end_ms: int, fee_bps: float = 0.0) -> DataFrame:
    """Notional, fees, gross (realised and unrealised) and total profit of each market."""
    hours = max((end_ms - start_ms) / 3_600_000.0, 1e-9)
    notional = F.sum(F.col("qty_base") * F.col("price"))
    done = fills.groupBy("market_id").agg(notional.alias("filled_notional_usd"), F.count_if(F.col("side") == "bid").alias("bid_fills"), F.count_if(F.col("side") == "ask").alias("ask_fills"))
    rows = done.join(realized_pnl(fills), "market_id", "left").join(unrealized_pnl(fills, mids), "market_id", "left")
    rows = rows.withColumns({"realized_pnl_usd": F.coalesce("realized_pnl_usd", F.lit(0.0)), "unrealized_pnl_usd": F.coalesce("unrealized_pnl_usd", F.lit(0.0)), "fees_usd": F.col("filled_notional_usd") * fee_bps / 10000.0})
    rows = rows.withColumn("gross_pnl_usd", F.col("realized_pnl_usd") + F.col("unrealized_pnl_usd")).withColumn("total_pnl_usd", F.col("gross_pnl_usd") - F.col("fees_usd"))
    return rows.select("market_id", "bid_fills", "ask_fills", "filled_notional_usd", "realized_pnl_usd", "unrealized_pnl_usd", "fees_usd", "gross_pnl_usd", "total_pnl_usd", (F.col("total_pnl_usd") / hours).alias("pnl_per_hour_usd"), F.when(F.col("filled_notional_usd") > 0, F.col("total_pnl_usd") / F.col("filled_notional_usd") * 10000.0).alias("pnl_bps_on_notional"))


def ledger_attach(ranked: DataFrame, ledger: DataFrame, top: int) -> DataFrame:
    """Ranked markets with their ledger results: those beyond ``top`` aren't simulated, those without fills unavailable."""
    rows = ranked.select("market_id", "symbol", "rank").join(ledger, "market_id", "left")
    shown = F.col("rank") <= top
    status = F.when(~shown, "not_simulated").when(F.col("total_pnl_usd").isNull(), "unavailable").otherwise("ok")
    return rows.select("market_id", "symbol", "rank", status.alias("ledger_status"), *(F.when(shown, F.col(c)).alias(c) for c in ledger.columns if c != "market_id"))
