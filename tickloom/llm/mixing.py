"""Operator 1, mixing sources to target weights by Pfair scheduling.

DataFrame functions only. A source's target after ``t`` slots is the number of blocks that its
weight's share of them makes; once a source has had all its blocks, its share goes to the others in
proportion to their weights, so the targets of all sources sum to ``t`` at each ``t`` and every slot
has a block. Block ``i`` (from 0) of a source is released at the slot in which its target passes
``i`` and due before the slot at whose begin it is ``i + 1``. Each slot takes the released block
with the earliest deadline: any source is less than one block from its target after any slot.

A slot takes what is left by all blocks of earlier deadlines, so the schedule is also this: in order
of deadline, each block takes the first free slot from its release on. Slots are cut in segments,
each a fold over the blocks that may come in it, with the list of its free slots: what a block costs
doesn't depend on how many sources there are.

Segments are folded in parallel, from guessed begins: at a segment's begin those pending blocks are
done whose deadlines are earliest. Then each segment whose begin isn't the end of the one before it
is folded again from there, until none is left. What one segment did early or late is made up for
within a few others, so a few rounds are enough, and then the whole is the schedule that one fold
over all slots would give, whatever the guesses were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import discard, stash

#: Hex digits of the row's MD5 that number rows within a source in parallel: 16**3 ranges for each source.
RANGE_DIGITS = 3
#: Slots of a segment; at least a quarter of the number of sources.
SEGMENT = 1024
#: Targets so close to a whole number count as it: doubles of 10**8 blocks are wrong by 10**-8. All sources together stay below a hundredth of a block, so that each slot has a released one.
CLOSE = 1e-6

#: One segment: blocks ``_c`` in order of deadline each take the first free slot that isn't before their release ``r``. ``_x``: the times at its begin and at its slots' ends.
FOLD = """
aggregate(_c, named_struct('free', sequence(0, size(_x) - 2), 'picked', cast(array() as array<struct<src:string,block:bigint,slot:int>>)),
  (a, c) -> if(size(a.free) = 0, a, transform(array(get(filter(a.free, f -> f >= c.r), 0)), f ->
    if(f is null, a, named_struct('free', array_remove(a.free, f), 'picked', array_append(a.picked, named_struct('src', c.src, 'block', c.block, 'slot', f)))))[0])).picked
"""


def _key(source):
    """One string for each source, null too."""
    return F.concat(F.when(source.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(source.cast("string"), F.lit("")))


def tempered_weights(docs: DataFrame, *, source_column: str = "source", exponent: float = 0.5) -> DataFrame:
    """``source`` and ``weight``: each source's number of rows to the power ``exponent``."""
    rows = F.count(F.lit(1)).cast("double")
    return docs.groupBy(F.col(source_column).alias("source")).agg((F.sqrt(rows) if exponent == 0.5 else F.pow(rows, F.lit(exponent))).alias("weight"))


def block_schedule(blocks: DataFrame, weights: DataFrame, *, segment: int = SEGMENT) -> DataFrame:
    """``_src``, ``_block`` (from 0) and ``_slot`` of every block.

    ``blocks``: ``_src`` and its number of blocks ``_n``; ``weights``: ``source`` and ``weight``.
    Sources without a positive weight come after all others, in equal shares.
    """
    given = weights.groupBy(_key(F.col("source")).alias("_src")).agg(F.sum(F.when((F.col("weight") > 0) & ~F.isnan("weight") & (F.col("weight") < float("inf")), F.col("weight"))).alias("_w"))
    known = stash(blocks.join(given, "_src", "left").select("_src", "_n", F.when(F.col("_w").isNull(), 1).otherwise(0).alias("_tier"), F.coalesce("_w", F.lit(1.0)).alias("w")), "sources")
    tiers = {r._tier: r for r in known.groupBy("_tier").agg(F.count(F.lit(1)).alias("sources"), F.sum("_n").alias("blocks")).collect()}  # two rows at most
    sources = sum(r.sources for r in tiers.values())
    segment, close = max(segment, -(-sources // 4)), min(CLOSE, 0.01 / max(sources, 1))
    segments = _times(known, segment)
    begins = known.withColumns({"_p": F.lit(0).cast("long"), "_had": F.lit(0).cast("long")})
    if any(r.blocks > segment for r in tiers.values()):
        segments = stash(segments, "segments")
        begins = _begins(known, segments, begins, segment, close)
    taken = _picked(begins, segments, close).select("_tier", (F.col("_p") * segment + F.col("_of.slot")).alias("_slot"), F.col("_of.src").alias("_src"), F.col("_of.block").alias("_block"))
    first = tiers[0].blocks if 0 in tiers else 0  # tiers follow one another
    return taken.select("_src", "_block", F.when(F.col("_tier") == 1, F.col("_slot") + first).otherwise(F.col("_slot")).alias("_slot"))


def _times(known: DataFrame, segment: int) -> DataFrame:
    """``_tier``, ``_p`` and ``_x``: a time for the begin of each segment and the end of each of its slots. Times are such that a source of weight w has had w * x blocks at x: it ends at n / w."""
    by_end = Window.partitionBy("_tier").orderBy(F.col("_n") / F.col("w"), "_src")  # one row for each source
    later = F.sum("w").over(by_end.rowsBetween(0, Window.unboundedFollowing))
    ended = F.coalesce(F.sum("_n").over(by_end.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy("_tier"))
    last = F.lead("_src").over(by_end).isNull()
    phases = known.select("_tier", "_src", "_n", "w", (F.col("_n") / F.col("w")).alias("_x1"), later.alias("_rate"), ended.alias("_ended"), total.alias("_total"), last.alias("_last"))
    phases = phases.withColumn("_t1", F.when(F.col("_last"), F.col("_total").cast("double")).otherwise(F.col("_ended") + F.col("_x1") * F.col("_rate")))
    phases = phases.withColumns({"_x0": F.coalesce(F.lag("_x1").over(by_end), F.lit(0.0)), "_t0": F.coalesce(F.lag("_t1").over(by_end), F.lit(0.0))})
    # Slots' ends in each phase, by segment; a segment has its begin too.
    lo, hi = F.when(F.col("_t0") <= 0, 0).otherwise(F.floor("_t0") + 1).cast("long"), F.floor("_t1").cast("long")
    spans = phases.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").select("_tier", "_lo", "_hi", "_x0", "_x1", "_t0", "_rate", F.explode(F.expr(f"sequence(greatest(_lo - 1, 0L) div {segment}, _hi div {segment})")).alias("_p"))
    begin, end = F.greatest(F.col("_lo"), F.col("_p") * segment), F.least(F.col("_hi"), (F.col("_p") + 1) * segment)
    times = F.transform(F.sequence(begin, end), lambda u: F.greatest(F.col("_x0"), F.least(F.col("_x1"), F.col("_x0") + (u - F.col("_t0")) / F.col("_rate"))))
    pieces = spans.where(begin <= end).select("_tier", "_p", begin.alias("_b"), times.alias("_x"))
    return pieces.groupBy("_tier", "_p").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_x"))), lambda s: s["_x"])).alias("_x")).where(F.size("_x") > 1)


def _picked(begins: DataFrame, segments: DataFrame, close: float) -> DataFrame:
    """``_tier``, ``_p`` and ``_of``: the blocks that come in each segment of ``begins`` (``_had``: each source's blocks before it), and their slots."""
    ends = segments.select("_tier", "_p", F.element_at("_x", -1).alias("_end"))
    released = F.least(F.col("_n"), F.ceil(F.col("w") * F.col("_end") - close))
    blocks = begins.join(ends, ["_tier", "_p"]).where(released > F.col("_had")).withColumn("_block", F.explode(F.sequence(F.col("_had"), released - 1)))
    listed = blocks.groupBy("_tier", "_p").agg(F.sort_array(F.collect_list(F.struct(((F.col("_block") + 1) / F.col("w")).alias("due"), F.col("_src").alias("src"), F.col("_block").alias("block"), "w"))).alias("_c"))
    release = f"if(c.w * _x[1] > c.block + {close}, 0, size(filter(_x, x -> c.w * x <= c.block + {close})) - 1)"
    todo = listed.join(segments, ["_tier", "_p"]).withColumn("_c", F.expr(f"transform(_c, c -> named_struct('src', c.src, 'block', c.block, 'r', {release}))"))
    return todo.select("_tier", "_p", F.explode(F.expr(FOLD)).alias("_of"))


def _begins(known: DataFrame, segments: DataFrame, zero: DataFrame, segment: int, close: float) -> DataFrame:
    """``known`` with ``_p`` and ``_had``, each source's blocks before each segment: a row for each source and segment, which is at most four for each block."""
    at = ["_tier", "_p"]
    starts = segments.select(*at, F.col("_x")[0].alias("_x0"))
    reached = known.join(F.broadcast(segments.groupBy("_tier").agg(F.max("_p").alias("_last"))), "_tier").withColumn("_p", F.explode(F.expr("sequence(0L, _last)"))).join(starts, at)  # two rows at most
    target = F.least(F.col("_n").cast("double"), F.col("w") * F.col("_x0"))
    rows = reached.withColumns({"_target": target, "_whole": F.floor(target + close)})
    pending = (F.col("_target") - F.col("_whole") > close) & (F.col("_whole") < F.col("_n"))
    within = Window.partitionBy(*at)
    rank = F.row_number().over(within.orderBy(F.when(pending, 0).otherwise(1), (F.col("_whole") + 1) / F.col("w"), "_src"))
    left = F.col("_p") * segment - F.sum("_whole").over(within)
    guess = rows.withColumns({"_rank": rank, "_left": left}).select(*known.columns, "_p", (F.col("_whole") + F.when(pending & (F.col("_rank") <= F.col("_left")), 1).otherwise(0)).alias("_had"))

    begins, ends, todo = stash(guess, "begins"), None, None
    while True:
        given = begins if todo is None else begins.join(todo, at, "left_semi")
        done = _picked(given, segments, close).groupBy(*at, F.col("_of.src").alias("_src")).agg(F.count(F.lit(1)).alias("_more"))
        new = given.join(done, [*at, "_src"], "left").select(*begins.columns[:-1], (F.col("_had") + F.coalesce("_more", F.lit(0))).alias("_had"))
        before, ends = ends, stash(new if ends is None else new.unionByName(ends.join(todo, at, "left_anti")), "ends")
        follow = ends.withColumn("_p", F.col("_p") + 1).join(starts.select(*at), at, "left_semi").unionByName(zero.select(*begins.columns))
        other = begins.select(*at, "_src", F.col("_had").alias("_was"))
        todo, last = stash(follow.join(other, [*at, "_src"]).where("_had <> _was").select(*at).distinct(), "todo"), todo
        for unused in (before, last):
            if unused is not None:
                discard(unused)
        if todo.isEmpty():
            return follow
        begins = follow


def mix_sources(docs: DataFrame, weights: DataFrame, *, id_column: str = "doc_id", source_column: str = "source", block_rows: int = 64, segment: int = SEGMENT) -> DataFrame:
    """``docs`` with ``mix_block``, ``mix_slot`` and ``mix_offset`` added; the mixed order is by slot, then offset.

    ``weights``: rows of ``source`` and ``weight``, of any sum; those of one source are added up. A
    source without a positive, finite weight comes after all others. Every row has one place and
    every slot one block. ``mix_block`` numbers a source's blocks of ``block_rows`` rows from 0, in
    the order of the MD5 of the id (equal ids: of the row's other columns); its last block may be
    shorter.

    Rows are numbered within ranges of the MD5, so a source that holds a third of all rows is spread
    over as many tasks as there are ranges. A null source is a source of its own; a null id sorts
    first; repeated rows each have a place; an empty table gives no rows. Columns of ``docs`` named
    like the added ones are replaced; others may have any names.
    """
    added = ["mix_block", "mix_slot", "mix_offset"]
    own = [c for c in docs.columns if c not in added]
    quoted = [F.col(f"`{c}`") for c in own]
    digest = F.coalesce(F.md5(F.col(id_column).cast("string").cast("binary")), F.lit(""))
    placed = [_key(F.col(source_column)).alias("_src"), F.substring(digest, 1, RANGE_DIGITS).alias("_range")]

    sizes = docs.select(*placed).groupBy("_src", "_range").agg(F.count(F.lit(1)).alias("_rows"))
    line = Window.partitionBy("_src").orderBy("_range")
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = sizes.groupBy("_src").agg(F.expr(f"(sum(_rows) + {block_rows - 1}) div {block_rows}").alias("_n"))
    schedule = block_schedule(blocks, weights, segment=segment)

    # The slots of the blocks of each range, in order: what a row needs lies under the keys by which rows are numbered, so that rows are shuffled once.
    wanted = starts.withColumn("_block", F.explode(F.expr(f"sequence(_before div {block_rows}, (_before + _rows - 1) div {block_rows})")))
    slots = wanted.join(schedule, ["_src", "_block"]).groupBy("_src", "_range").agg(F.first("_before").alias("_before"), F.transform(F.sort_array(F.collect_list(F.struct("_block", "_slot"))), lambda b: b["_slot"]).alias("_slots"))

    rows = docs.select(F.struct(*quoted).alias("_row"), *placed, digest.alias("_md5"), F.col(id_column).alias("_id"), F.xxhash64(*quoted).alias("_tie"))
    within = Window.partitionBy("_src", "_range").orderBy("_md5", "_id", "_tie")
    numbered = rows.withColumn("_rank", F.row_number().over(within).cast("long") - 1).select("_src", "_range", "_row", "_rank").join(slots, ["_src", "_range"])
    number = F.col("_before") + F.col("_rank")
    block = F.expr(f"(_before + _rank) div {block_rows}")
    slot = F.get("_slots", (block - F.expr(f"_before div {block_rows}")).cast("int"))
    return numbered.select("_row.*", block.alias("mix_block"), slot.alias("mix_slot"), (number % block_rows).cast("int").alias("mix_offset"))


def in_mixed_order(mixed: DataFrame, partitions: int) -> DataFrame:
    """The rows of ``mix_sources`` range-partitioned and sorted by their place, without the added columns."""
    order = ["mix_slot", "mix_offset"]
    dealt = mixed.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return dealt.drop("mix_block", *order)
