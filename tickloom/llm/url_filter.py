"""Operator 6, URL filters: host and path rules, then a blocked Bloom filter before an exact hash join.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A block has four words of 64 bits; a key sets one bit in each word.
WORDS = 4
KEYS_PER_BLOCK = 16
#: Bytes of a block's row, and of filters that are broadcast at most.
BLOCK_BYTES = 64
BROADCAST_BYTES = 64 << 20
#: Listed URLs that are broadcast at most (about 100 bytes each), and keys of rows that look for nothing.
BROADCAST_LISTED, OTHER_KEYS = 200_000, 4096


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for a null url or one without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host and path without slashes at the end: scheme, query and fragment don't count. Null where there is no host."""
    host = url_host(url)
    return F.when(host != "", F.concat(host, F.rtrim(url_path(url), F.lit("/"))))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule, like ``example.org/es/``, or null. A rule fits its host and all subdomains where the path starts with the rule's."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest is tested first, as the outermost
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("long")


def _bits(url: Column) -> list[Column]:
    h = F.xxhash64(url, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(WORDS)]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """The blocks of the filter that have bits: ``_block`` and the words ``_w0`` to ``_w3``. ``listed``: column ``url``."""
    words = [F.bit_or(b).alias(f"_w{k}") for k, b in enumerate(_bits(F.col("url")))]
    return listed.groupBy(_block(F.col("url"), blocks).alias("_block")).agg(*words)


def judge_urls(pages: DataFrame, listed: DataFrame, rules: dict[str, str], *, id_column: str = "page_id", url_column: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``id_column``, ``host``, ``path``, ``rule``, ``verdict`` and ``listed`` for each row of ``pages``.

    ``rules``: verdict (``allow`` or ``block``) by rule; the longest fitting rule decides. Where none
    fits, a page whose canonical URL is among those of ``listed`` (any column of URLs named ``url``)
    is blocked and any other allowed. The Bloom filter passes possible hits to a hash join with the
    list; a page that it holds back is not in the list. Filters beyond ``broadcast_bytes`` are
    joined by a shuffle on the block number.

    A null url, or one without ``://``, has an empty host and path, no rule and is allowed. Null and
    repeated list entries change nothing, an empty list blocks nothing, an empty table gives no
    rows, and repeated rows are judged each. Other columns are dropped, whatever their names.
    """
    canon = listed.select(canonical_url(F.col("url")).alias("url")).where(F.col("url").isNotNull()).distinct()
    n_listed = canon.count()
    blocks = max(1, -(-n_listed // KEYS_PER_BLOCK))
    url = F.col(url_column)
    parts = pages.select(F.col(id_column).alias("_id"), url_host(url).alias("host"), url_path(url).alias("path"), canonical_url(url).alias("_url"))
    ruled = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)

    bloom = bloom_filter(canon, blocks)
    bloom = F.broadcast(bloom) if blocks * BLOCK_BYTES <= broadcast_bytes else bloom
    asked = F.when(F.col("rule").isNull(), F.col("_url"))
    hit = F.lit(True)
    for k, b in enumerate(_bits(F.col("_asked"))):
        hit = hit & (F.col(f"_w{k}").bitwiseAND(b) == b)
    # Pages with a rule or without a host aren't looked for in the filter, nor those that it holds back in the list: their keys are ones that neither has (no canonical URL holds a ``#``), many, so that no task gets them all.
    other = F.pmod(F.xxhash64("_id", "host", "path"), F.lit(OTHER_KEYS)).cast("long")
    asking = ruled.withColumn("_asked", asked).withColumn("_block", F.when(F.col("_asked").isNotNull(), _block(F.col("_asked"), blocks)).otherwise(-1 - other))
    probed = asking.join(bloom, "_block", "left").withColumn("_possible", F.when(hit, F.col("_asked")).otherwise(F.concat(F.lit("#"), other.cast("string"))))
    known = canon.select(F.col("url").alias("_possible"), F.lit(True).alias("_in"))
    found = probed.join(known.hint("shuffle_hash") if n_listed > BROADCAST_LISTED else F.broadcast(known), "_possible", "left")
    is_listed = F.when(F.col("_asked").isNotNull(), F.coalesce("_in", F.lit(False)))
    verdict = F.coalesce(by_rule, F.when(is_listed, F.lit("block")), F.lit("allow"))
    return found.select(F.col("_id").alias(id_column), "host", "path", "rule", verdict.alias("verdict"), is_listed.alias("listed"))
