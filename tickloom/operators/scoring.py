"""Cross-sectional ranks, scores, penalties, candidates and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import Candidates, Confidence, Weights
from tickloom.functions.columns import coverage_confidence, duration_confidence, first_number, hill, recommended_order, resolved_coverage, sample_state, sample_value, size_fit

COMPONENTS = ("trade_activity", "estimated_maker_fill", "spread", "two_sided_depth", "maker_markout", "data_quality_persistence")


def mid_ranks(rows: DataFrame, values: dict[str, str], peers: DataFrame | None = None) -> DataFrame:
    """``rows`` with, for each column named in ``values``, its mid-rank percentile under the given name: the share of known peers below it, ties by half, times 100; 0 where it is null.

    ``peers``: other rows to rank among, with the same columns. There is one row for each market, so
    the windows over all rows, which one task does, are as long as there are markets.
    """
    names = list(values)
    counted = rows.select(F.struct(*rows.columns).alias("_row"), F.lit(peers is None).alias("_peer"), *names)
    if peers is not None:
        counted = counted.unionByName(peers.select(*names).withColumns({"_row": F.lit(None).cast(counted.schema["_row"].dataType), "_peer": F.lit(True)}))

    def rank(name: str) -> Column:
        value = F.col(name).cast("double")
        known, line = F.when(F.col("_peer"), value), Window.partitionBy().orderBy(value)
        upto, ties = F.count(known).over(line.rangeBetween(Window.unboundedPreceding, 0)), F.count(known).over(line.rangeBetween(0, 0))
        n = F.count(known).over(Window.partitionBy())
        return F.when(value.isNull() | (n == 0), 0.0).otherwise((upto - 0.5 * ties) / n * 100.0)

    ranked = counted.withColumns({out: rank(n) for n, out in values.items()})
    return ranked.where(F.col("_row").isNotNull()).select("_row.*", *values.values())


def activity_blend() -> Column:
    mean, median = F.col("trades_per_minute_mean"), F.col("trades_per_minute_median")
    return F.coalesce(0.7 * mean + 0.3 * median, mean, median)


def preferred_coverage() -> Column:
    """That of the observation, 0 too, else of the data."""
    return first_number(F.col("observation_coverage_pct"), F.col("data_coverage_pct"))


def quality_blend() -> Column:
    cover = preferred_coverage()
    return F.coalesce(F.col("pct_time_spread_ge_5bps") * 100.0 * 0.6 + cover * 0.4, cover)


def rank_components(rows: DataFrame, peers: DataFrame | None = None) -> DataFrame:
    """The six ranks as ``rank_<component>``. An unknown fill rate has no rank; other unknown values rank 0."""
    inputs = {
        "_trade_activity": activity_blend(),
        "_estimated_maker_fill": F.col("estimated_maker_fill_rate_30s_conservative"),
        "_spread": F.when(F.col("median_spread_bps").isNotNull(), F.least("median_spread_bps", F.lit(20.0))),
        "_two_sided_depth": F.col("median_two_sided_depth_10bps_usd"),
        "_maker_markout": F.col("maker_markout_5s_median_bps"),
        "_data_quality_persistence": quality_blend(),
    }
    ranked = mid_ranks(rows.withColumns(inputs), {f"_{c}": f"rank_{c}" for c in COMPONENTS}, None if peers is None else peers.withColumns(inputs))
    fill = F.when(F.col("estimated_maker_fill_rate_30s_conservative").isNotNull(), F.col("rank_estimated_maker_fill"))
    return ranked.withColumn("rank_estimated_maker_fill", fill).drop(*inputs)


def weighted_score(ranked: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """``weighted_score``: mean of the known ranks by weight."""
    known = [(F.col(f"rank_{c}"), F.lit(getattr(weights, c))) for c in COMPONENTS]
    total = sum((F.coalesce(r * w, F.lit(0.0)) for r, w in known), F.lit(0.0))
    used = sum((F.when(r.isNotNull(), w).otherwise(0.0) for r, w in known), F.lit(0.0))
    return ranked.withColumn("weighted_score", total / F.when(used > 0, used).otherwise(sum(getattr(weights, c) for c in COMPONENTS)))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _hours() -> Column:
    return F.greatest(F.coalesce("observation_hours", F.lit(1.0)), F.lit(0.01))


def penalties(limits: Candidates = Candidates()) -> list[tuple[Column, float, str, bool]]:
    """Condition, factor, text and whether it is hard, of each penalty."""
    cover = F.coalesce(preferred_coverage(), F.lit(0.0))
    fill = F.col("estimated_maker_fill_rate_30s_conservative")
    return [
        (cover < limits.coverage_pct, 0.55, f"strong penalty: observation coverage < {limits.coverage_pct:.0f}%", True),
        (_zero("total_trade_count") < limits.trades_per_hour * 0.25 * _hours(), 0.5, "strong penalty: extremely low trade count", True),
        (_zero("median_two_sided_depth_10bps_usd") < limits.depth_10bps_usd, 0.75, "penalty: two-sided depth very thin", False),
        (F.col("maker_markout_5s_median_bps") < 0, 0.7, "penalty: median 5s maker markout < 0", False),
        (F.col("maker_markout_30s_median_bps") < limits.markout_30s_bps, 0.55, "strong penalty: 30s markout largely negative", True),
        ((fill <= 0) & (_zero("estimated_maker_fill_samples") >= limits.fill_samples), 0.85, "penalty: Estimated Maker Fill ~0 @30s conservative ($50)", False),
    ]


def score_penalties(scored: DataFrame, limits: Candidates = Candidates()) -> DataFrame:
    """``score``, from 0 to 100, ``penalties`` and ``hard_penalty``."""
    held = [(F.coalesce(c, F.lit(False)), f, t, h) for c, f, t, h in penalties(limits)]
    score = F.col("weighted_score")
    for c, factor, _, _ in held:
        score = score * F.when(c, factor).otherwise(1.0)
    hard = F.lit(False)
    for c, _, _, is_hard in held:
        hard = hard | c if is_hard else hard
    return scored.withColumns({"score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), "penalties": F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, _, t, _ in held))), "hard_penalty": hard})


def candidate_gate(scored: DataFrame, limits: Candidates = Candidates(), peer_count: Column | None = None) -> DataFrame:
    """``candidate``: all limits are met, and with enough peers the activity isn't among the lowest."""
    per_hour = _zero("total_trade_count") / _hours()
    met = [
        F.coalesce(preferred_coverage(), F.lit(0.0)) >= limits.coverage_pct,
        (per_hour >= limits.trades_per_hour) | (_zero("trades_per_minute_mean") * 60.0 >= limits.trades_per_hour),
        _zero("observation_hours") >= limits.hours,
        _zero("median_two_sided_depth_10bps_usd") >= limits.depth_10bps_usd,
        _zero("median_spread_bps") >= limits.spread_bps,
        F.col("maker_markout_5s_median_bps") >= limits.markout_5s_bps,
        F.col("maker_markout_30s_median_bps") >= limits.markout_30s_bps,
        _zero("markout_5s_count") >= limits.markouts_5s,
        _zero("markout_30s_count") >= limits.markouts_30s,
        _zero("estimated_maker_fill_samples") >= limits.fill_samples,
    ]
    if limits.trades_per_minute_median is not None:
        met.append(_zero("trades_per_minute_median") >= limits.trades_per_minute_median)
    peers = F.count(F.lit(1)).over(Window.partitionBy()) if peer_count is None else peer_count
    ok = ~((peers >= limits.peers) & (_zero("rank_trade_activity") < limits.activity_rank))
    for m in met:
        ok = ok & F.coalesce(m, F.lit(False))
    return scored.withColumn("candidate", ok)


def letter_rank(scored: DataFrame) -> DataFrame:
    score = F.col("score")
    weak = ~F.col("candidate") | F.col("hard_penalty")
    letter = F.when(weak & (score >= 55), "C").when(weak, "D").when(score >= 75, "A").when(score >= 60, "B").when(score >= 45, "C").otherwise("D")
    return scored.withColumn("letter_rank", letter)


LEAVES = ("markout_5s", "markout_30s", "fill", "trade", "coverage", "duration")


def market_confidence(scored: DataFrame, config: Confidence = Confidence()) -> DataFrame:
    """``confidence`` (weighted geometric mean of the known leaves times their weight), ``confidence_label``, at most three ``confidence_reasons``, ``confidence_breakdown`` and ``effective_score``."""
    cover = resolved_coverage(F.col("data_coverage_pct"), F.col("observation_coverage_pct"))
    sample = {"markout_5s": F.col("markout_5s_count"), "markout_30s": F.col("markout_30s_count"), "fill": F.col("estimated_maker_fill_samples"), "trade": F.col("total_trade_count"), "duration": F.col("observation_hours")}
    v = {k: sample_value(c) for k, c in sample.items()}
    leaf = {
        "markout_5s": F.when(v["markout_5s"].isNotNull(), hill(v["markout_5s"], config.k_markout)),
        "markout_30s": F.when(v["markout_30s"].isNotNull(), hill(v["markout_30s"], config.k_markout)),
        "fill": F.when(v["fill"].isNotNull(), hill(v["fill"], config.k_fill)),
        "trade": F.when(v["trade"].isNotNull(), hill(v["trade"], config.k_trade)),
        "coverage": F.when(cover.isNotNull(), coverage_confidence(cover)),
        "duration": F.when(v["duration"].isNotNull(), duration_confidence(v["duration"], config.tau_hours)),
    }
    weight = {"markout_5s": config.markout * config.share_5s, "markout_30s": config.markout * config.share_30s, "fill": config.fill, "trade": config.trade, "coverage": config.coverage, "duration": config.duration}
    rows = scored.withColumns({f"_c_{k}": c for k, c in leaf.items()} | {"_cover": cover})
    c = {k: F.col(f"_c_{k}") for k in LEAVES}

    def geometric(keys, weights) -> tuple[Column, Column]:
        used = sum((F.when(c[k].isNotNull(), weights[k]).otherwise(0.0) for k in keys), F.lit(0.0))
        logs = sum((F.when(c[k].isNotNull(), weights[k] * F.log(F.greatest(c[k], F.lit(config.least)))).otherwise(0.0) for k in keys), F.lit(0.0))
        return used, logs

    used, logs = geometric(LEAVES, weight)
    overall = F.when(used > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(logs / used) * used))).otherwise(0.0)
    part, part_logs = geometric(("markout_5s", "markout_30s"), {"markout_5s": config.share_5s, "markout_30s": config.share_30s})
    markout = F.when(part > 0, F.exp(part_logs / part) * part)

    low = F.coalesce(c["markout_5s"] < 0.25, F.lit(False)) | F.coalesce(c["markout_30s"] < 0.25, F.lit(False))
    reasons = [
        (low, "low_markout_samples"),
        (c["fill"] < 0.25, "low_fill_samples"),
        (c["trade"] < 0.25, "low_trade_observations"),
        (F.col("_cover") < 95.0, "low_coverage"),
        (c["duration"] < 0.30, "short_observation_duration"),
        ((c["markout_5s"].isNull() | c["markout_30s"].isNull()) & ~low, "missing_markout_samples"),
        (c["fill"].isNull(), "missing_fill_samples"),
        (c["trade"].isNull(), "missing_trade_observations"),
        (F.col("_cover").isNull(), "missing_coverage"),
        (c["duration"].isNull(), "missing_observation_duration"),
    ]
    known = rows.withColumns({
        "confidence": overall,
        "confidence_reasons": F.slice(F.array_compact(F.array(*(F.when(x, F.lit(t)) for x, t in reasons))), 1, 3),
        "confidence_breakdown": F.struct(markout.alias("markout"), c["markout_5s"].alias("markout_5s"), c["markout_30s"].alias("markout_30s"), c["fill"].alias("estimated_fill"), c["trade"].alias("trades"), c["coverage"].alias("coverage"), c["duration"].alias("duration")),
    })
    label = F.when(F.col("confidence") < config.low, "low").when(F.col("confidence") < config.high, "medium").otherwise("high")
    effective = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score") * F.col("confidence")))
    return known.withColumns({"confidence_label": label, "effective_score": effective}).drop("_cover", *(f"_c_{k}" for k in LEAVES))


def rank_markets(scored: DataFrame) -> DataFrame:
    """``rank`` by effective score, score and symbol (none: as if empty)."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("effective_score"), F.desc("score"), F.coalesce("symbol", F.lit("")), "market_id")))


def narratives(scored: DataFrame, limits: Candidates = Candidates()) -> DataFrame:
    """``pros`` (six summary lines first), ``cons`` and ``warnings``. The texts."""
    spread, depth, tpm = F.col("median_spread_bps"), F.col("median_two_sided_depth_10bps_usd"), F.col("trades_per_minute_median")
    m5, m30, fill = F.col("maker_markout_5s_median_bps"), F.col("maker_markout_30s_median_bps"), F.col("estimated_maker_fill_rate_30s_conservative")
    held, samples, vol = _zero("pct_time_spread_ge_5bps"), _zero("estimated_maker_fill_samples"), F.col("p95_abs_mid_move_5s_bps")
    cover = F.coalesce(preferred_coverage(), F.lit(0.0))
    # Ties go to even digits, where a format alone would round them up.
    signed = lambda x: F.format_string("%+.2f", F.bround(x, 2))
    summary = [
        F.when(spread.isNotNull(), F.format_string("SPREAD: median %.2fbp", F.bround(spread, 2))).otherwise("SPREAD: n/a"),
        F.when(depth.isNotNull(), F.format_string("DEPTH: $%,.0f within ±10bp", F.bround(depth, 0))).otherwise("DEPTH: n/a"),
        F.when(tpm.isNotNull(), F.format_string("ACTIVITY: %.2f trades/min (market-level)", F.bround(tpm, 2))).otherwise("ACTIVITY: n/a"),
        F.when(m5.isNotNull() & m30.isNotNull(), F.concat(F.lit("MARKOUT: "), signed(m5), F.lit("bp @5s / "), signed(m30), F.lit("bp @30s"))).otherwise("MARKOUT: n/a"),
        F.when(fill.isNotNull(), F.format_string("EST. FILL: %.0f%% @30s cons. ($50)", F.bround(fill * 100, 0))).otherwise("EST. FILL: n/a"),
        F.format_string("PERSISTENCE: spread >=5bp for %.0f%% of observed time", F.bround(held * 100, 0)),
    ]
    pros = [
        F.when((spread >= 3) & (held >= 0.25), "persistent/usable spread").when(spread >= 3, "meaningful median spread"),
        F.when(held >= 0.35, "spread >=5bp for substantial fraction of time"),
        F.when(tpm >= 5, "high trade frequency (market-level; not Estimated Maker Fill)"),
        F.when(fill >= 0.3, "meaningful Estimated Maker Fill @30s conservative ($50)"),
        F.when(depth >= 1000, "sufficient two-sided depth within ±10bp"),
        F.when(m5 > 0, "positive 5s maker markout"),
        F.when(m30 > 0, "positive 30s maker markout"),
    ]
    untouched = F.coalesce((fill <= 0) & (samples >= limits.fill_samples), F.lit(False))
    cons = [
        F.when(spread < 1.5, "tight spread — limited edge after fees/latency"),
        F.when(_zero("trades_per_minute_median") < 1, "low trade activity"),
        F.when(untouched, "Estimated Maker Fill ~0 @30s conservative (touch rarely clears)"),
        F.when(_zero("median_two_sided_depth_10bps_usd") < 500, "thin two-sided depth"),
        F.when(m5 < 0, "negative 5s maker markout (adverse selection)"),
        F.when(vol > spread * 2, "elevated 5s volatility vs spread"),
    ]
    warnings = [
        F.when(~untouched & (samples < limits.fill_samples), f"Estimated Maker Fill sample insufficient (<{limits.fill_samples})"),
        F.when(F.abs("current_funding_rate") > 0.01, "funding relatively high"),
        F.when((cover >= limits.coverage_pct) & (cover < 95), "data coverage below 95%"),
    ]
    compact = lambda xs: F.array_compact(F.array(*xs))
    return scored.withColumns({"pros": compact(summary + pros), "cons": compact(cons), "warnings": F.array_distinct(F.concat(compact(warnings), "penalties"))})


def score_markets(rows: DataFrame, peers: DataFrame | None = None, *, weights: Weights = Weights(), limits: Candidates = Candidates(), config: Confidence = Confidence()) -> DataFrame:
    """Ranked, scored markets; ``peers``: the rows that ranks are among, the rows themselves if none are given."""
    ranked = rank_components(rows, peers)
    count = None
    if peers is not None:
        ranked = ranked.join(F.broadcast(peers.agg(F.count(F.lit(1)).alias("_peers")).withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).drop("_one")
        count = F.col("_peers")
    gated = letter_rank(candidate_gate(score_penalties(weighted_score(ranked, weights), limits), limits, count)).drop("_peers")
    sized = gated.withColumns({"recommended_max_order_usd": recommended_order(F.col("median_two_sided_depth_5bps_usd"), F.col("median_two_sided_depth_10bps_usd")), "size_fit": size_fit(F.col("median_two_sided_depth_10bps_usd"))})
    return rank_markets(narratives(market_confidence(sized, config), limits))


def sample_states(rows: DataFrame) -> DataFrame:
    return rows.select("market_id", *(sample_state(F.col(c)).alias(f"{c}_state") for c in ("markout_5s_count", "markout_30s_count", "estimated_maker_fill_samples", "total_trade_count", "observation_hours")))


def cross_section_stats(rows: DataFrame, column: str) -> DataFrame:
    """One row: percentiles of a column over all markets."""
    ps = (10, 25, 50, 75, 90, 95)
    got = rows.agg(F.percentile(column, F.array(*(F.lit(p / 100) for p in ps))).alias("_p"), F.count(column).alias("n"))
    return got.select("n", *(F.col("_p")[k].alias(f"p{p}") for k, p in enumerate(ps)))
