"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.config import COVERAGE_ANCHORS, SIZE_LADDER, FillPolicy


def observed() -> Column:
    """The book was usable, or is of the older layout (no flag) and has a mid."""
    return F.col("is_usable") | (F.col("is_usable").isNull() & F.col("mid").isNotNull())


def metrics_good() -> Column:
    """As ``observed``, but a row without the flag must not be stale."""
    return F.col("is_usable") | (F.col("is_usable").isNull() & ~F.col("is_stale") & F.col("mid").isNotNull())


def valid_bid_ask() -> Column:
    """Bid, ask and mid are there and positive, and don't cross."""
    return F.coalesce((F.col("best_bid") > 0) & (F.col("best_ask") > 0) & (F.col("mid") > 0) & (F.col("best_ask") >= F.col("best_bid")), F.lit(False))


def effective_spread() -> Column:
    """The stored spread, else that of a valid quote, in basis points."""
    return F.coalesce(F.col("spread_bps"), F.when(valid_bid_ask(), (F.col("best_ask") - F.col("best_bid")) / F.col("mid") * 10000.0))


def regular_trade() -> Column:
    return F.col("type") == "trade"


def safe_mid(bid: Column, ask: Column) -> Column:
    return F.when((bid > 0) & (ask > 0) & (bid <= ask), (bid + ask) / 2)


def bps_move(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 10000.0)


def markout_bps(trade_price: Column, future_mid: Column, reference_mid: Column, is_maker_ask: Column) -> Column:
    """What the maker gained by the later mid, in basis points of the reference mid."""
    gain = F.when(is_maker_ask, trade_price - future_mid).when(~is_maker_ask, future_mid - trade_price)
    return F.when(reference_mid > 0, gain / reference_mid * 10000.0)


def taker_is_buy(is_maker_ask: Column) -> Column:
    """Whoever takes from an ask buys."""
    return is_maker_ask


def sample_quality(n: Column, policy: FillPolicy = FillPolicy()) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) < policy.meaningful, "insufficient").when(n < policy.reliable, "preliminary").otherwise("reliable")


def fee_rate_to_bps(rate: Column) -> Column:
    return F.coalesce(rate, F.lit(0.0)) * 10000.0


def snapshot_bucket(timestamp_ms: Column, bucket_ms: int = 30_000) -> Column:
    return F.floor(timestamp_ms / F.lit(bucket_ms)).cast("long")


def max_snapshots(hours: Column, bucket_ms: int = 30_000) -> Column:
    return F.greatest(F.ceil(hours * 3_600_000.0 / bucket_ms).cast("long"), F.lit(0).cast("long"))


def hill(n: Column, k: float) -> Column:
    """n / (n + k), 0 where n isn't positive."""
    return F.when(n > 0, n / (n + k)).otherwise(0.0)


def coverage_confidence(pct: Column) -> Column:
    """Straight lines between the anchors; 1 above the last."""
    out = F.when(pct >= COVERAGE_ANCHORS[-1][0], 1.0).when(pct <= 0, 0.0)
    for (x0, y0), (x1, y1) in zip(COVERAGE_ANCHORS, COVERAGE_ANCHORS[1:], strict=False):
        out = out.when(pct <= x1, F.lit(y0) + (pct - x0) / (x1 - x0) * (y1 - y0))
    return out


def duration_confidence(hours: Column, tau_hours: float) -> Column:
    return F.when(hours > 0, 1.0 - F.exp(-hours / tau_hours)).otherwise(0.0)


def finite(x: Column) -> Column:
    """The number, or null where it isn't one."""
    x = x.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def sample_value(x: Column) -> Column:
    """A count or duration: null if missing, negative or not finite."""
    return F.when(finite(x) >= 0, finite(x))


def sample_state(x: Column) -> Column:
    return F.when(sample_value(x).isNull(), "missing").when(sample_value(x) == 0, "zero").otherwise("value")


def resolved_coverage(data: Column, observation: Column) -> Column:
    """The lower of the valid coverages, null if neither is."""
    valid = lambda c: F.when(finite(c).between(0, 100), finite(c))
    return F.least(valid(data), valid(observation))


def first_number(*columns: Column) -> Column:
    """The first that reads as a number; 0 counts."""
    return F.coalesce(*(c.try_cast("double") for c in columns))


def iso_to_ms(text: Column) -> Column:
    """Milliseconds of an ISO-8601 text, without zone UTC; null if it can't be read."""
    return F.unix_millis(F.try_to_timestamp(text))


def ms_to_iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def blank_to_null_number(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def partition_key(timestamp_ms: Column, rotation_minutes: int = 15) -> list[Column]:
    """``date``, ``hour`` and ``bucket`` (UTC) of an event."""
    t = F.timestamp_millis(timestamp_ms)
    return [F.date_format(t, "yyyy-MM-dd").alias("date"), F.date_format(t, "HH").alias("hour"), (F.floor(F.minute(t) / rotation_minutes) * rotation_minutes).cast("int").alias("bucket")]


def recommended_order(depth_5: Column, depth_10: Column) -> Column:
    """The largest size of the ladder within a quarter of the depth at 10 bp (5 bp if that is missing)."""
    cap = F.coalesce(depth_10, depth_5) * 0.25
    return F.array_max(F.filter(F.array(*map(F.lit, SIZE_LADDER)), lambda x: x <= cap))


def size_fit(depth_10: Column) -> Column:
    """Map of size to whether four times as much depth is there."""
    pairs = [c for n in SIZE_LADDER for c in (F.lit(f"fit_{int(n)}"), F.coalesce(depth_10, F.lit(0.0)) >= n * 4.0)]
    return F.create_map(*pairs)


# What may not appear in published text. Java's dialect; (?i) ignores case.
SENSITIVE = (
    r"(?i)gs://[^\s`'\")\]]+",
    r"(?i)storage\.googleapis\.com/[^\s`'\")\]]+",
    r"(?i)/(?:tmp|var|mnt|home|Users|opt|workspace|app)/[^\s`'\")\]]+",
    r"(?i)[A-Za-z]:\\[^\s`'\")\]]+",
    r"\bNEXT_PUBLIC_[A-Z0-9_]+\b",
    r"\b[A-Z][A-Z0-9_]*(?:_KEY|_TOKEN|_SECRET|_PASSWORD|_CREDENTIAL|_IAM)\b",
    r"(?i)\b(?:GCS_BUCKET|BUCKET|CORS|IAM)\b",
    r"(?i)\blatest\.json\b",
    r"(?i)\bmarkets\.json\b",
    r"(?i)\bcollector_status\.json\b",
    r"(?i)\banalysis_status\.json\b",
    r"(?i)\bTraceback\b[\s\S]{0,2000}",
    r"(?i)\bat\s+\S+\s+\(.*?:\d+:\d+\)",
    r"(?i)\bhttps?://(?:127\.0\.0\.1|localhost|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[0-1])\.\d+\.\d+)[^\s`'\")\]]*",
    r"(?i)\b(?:Bearer|token|secret|credential|password)\s*[:=]\s*\S+",
)
FALLBACK = "Internal detail omitted."


def redact_text(text: Column, fallback: str = FALLBACK) -> Column:
    """Sensitive parts replaced, runs of white space made one space; the fallback where nothing else is left, or where what is left is sensitive again."""
    out = text
    for pattern in SENSITIVE:
        out = F.regexp_replace(out, pattern, "[redacted]")
    out = F.regexp_replace(F.regexp_replace(out, r"\s{2,}", " "), r"^\s+|\s+$", "")
    empty = F.coalesce(out == "", F.lit(True)) | out.rlike(r"(?i)^[\[\]redacted\s.,;:-]+$")
    again = F.lit(False)
    for pattern in SENSITIVE:
        again = again | out.rlike(pattern)
    return F.when(empty | again, F.lit(fallback)).otherwise(out)
