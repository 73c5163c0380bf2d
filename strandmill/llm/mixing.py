"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k of the mix is the point ``(k + 1) * 2654435769 mod 2**32`` (the golden
ratio in 32-bit fixed point), mapped through the sources' cumulative targets.
The slots of a source are ranked; rank r takes its block ``r mod blocks``, in
pass ``r div blocks``, so no part repeats before all others were taken. A
source's documents, shuffled by a hash of their id, are laid end to end and cut
into blocks of equal token counts; a document is taken as often as the blocks
that cover it. The number of slots is bounded by ``slots`` whatever the corpus;
the block grows with it. A source of fewer than ``FEW_BLOCKS`` such blocks, or of
fewer slots, would miss its target by chance: it is taken in blocks of one word
in the same order, whole passes and then a head, so it meets its target to a
word. No text is shuffled.

Edge cases: null and empty texts have size 0 and are never taken; null sources
form the last source; an empty table gives an empty result; repeated rows count
on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandmill.llm.common import running_sum, stage, word_count

SLOTS = 1 << 17
#: Below so many blocks or slots a source has blocks of one word.
FEW_BLOCKS = 1024
WEIGHTS = (5, 2, 1)
_CELL_BITS = 10


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per source: sid, source, source_size, target.

    Targets share ``share`` times all sizes by weight; a target stops at
    ``most`` times its source and the excess is shared again by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(order).cast("long"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = W.partitionBy()
    per = per.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    rank = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    per = per.withColumn("used", F.coalesce(F.sum("cap").over(rank.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("open", F.sum("weight").over(rank.rowsBetween(0, W.unboundedFollowing)))
    per = per.withColumn("level", (F.col("total") - F.col("used")) / F.col("open"))
    # in this order the caps reached come first; the first source below its cap sets the level of all that follow
    per = per.withColumn("rn", F.row_number().over(rank))
    per = per.withColumn("open_from", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("rn"))).over(everything))
    per = per.withColumn("capped", F.col("open_from").isNull() | (F.col("rn") < F.col("open_from")))
    per = per.withColumn("final", F.max(F.when(F.col("rn") == F.col("open_from"), F.col("level"))).over(everything))
    return per.select("sid", "source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"), "total")


def slot_schedule(targets: DataFrame, block: int, slots: int) -> DataFrame:
    """One row per slot: slot, sid, rank (0-based among the slots of its source)."""
    spark = targets.sparkSession
    upto = F.sum("target").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0))
    full, shift = 1 << 32, 32 - _CELL_BITS
    part = targets.withColumn("hi", F.floor(upto / F.col("total") * full).cast("long"))
    part = part.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("sid")), F.lit(0)).cast("long"))
    last = F.max("sid").over(W.partitionBy())
    part = part.withColumn("hi", F.when(F.col("sid") == last, F.lit(full)).otherwise(F.col("hi"))).filter("hi > lo")
    part = part.select("sid", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * 2654435769 % full).alias("x"))
    points = points.withColumn("cell", F.shiftright("x", shift))
    placed = points.join(part, "cell").filter("x >= lo and x < hi").select("slot", "sid", F.lit(1).alias("one"))
    return running_sum(placed, ["sid"], ["slot"], "one", "rank", F.shiftright("slot", 12)).select("slot", "sid", "rank")


def shuffle_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, slots: int = SLOTS) -> DataFrame:
    """How much of each document the mix takes.

    Returns one row per input row: doc_id, size, source, source_size, target,
    taken, n_blocks, row_key.
    """
    sizes = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = stage(sizes.withColumn("row_key", F.monotonically_increasing_id()), "sizes")
    targets = stage(source_targets(sizes, weights, share, most), "targets")
    total = targets.agg(F.max("total")).first()[0] or 0.0
    block = max(1, int(total / slots))
    n_slots = int(-(-total // block))
    ranked = slot_schedule(targets, block, n_slots)
    ranked = ranked.join(targets.select("sid", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block)).cast("long").alias("blocks")), "sid")
    takes = ranked.filter(F.col("rank") < most * F.col("blocks")).groupBy("sid", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("takes"))
    known = sizes.join(targets.drop("total"), sizes["source"].eqNullSafe(targets["source"])).select(sizes["*"], "sid", "source_size", "target").withColumn("h", shuffle_key(F.col("doc_id")))
    laid = running_sum(known, ["sid"], ["h", "doc_id", "row_key"], "size", "at", F.substring("h", 1, 2))
    laid = laid.select("row_key", "doc_id", "size", "source", "source_size", "target", "sid", "at")
    # with blocks of one word a rank is a word's place: passes over all words, then the words below the rest
    words = F.round("target").cast("long")
    fine = (F.lit(block) > 1) & (F.least(F.col("source_size").cast("double"), F.col("target")) < FEW_BLOCKS * block) & (F.col("size") > 0)
    rest = F.greatest(F.lit(0), F.least(F.col("size"), words % F.col("source_size") - F.col("at")))
    laid = laid.withColumn("fine", F.when(fine, F.floor(words / F.col("source_size")) * F.col("size") + rest))
    pieces = laid.filter("size > 0 AND fine IS NULL").select("row_key", "sid", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    pieces = pieces.withColumn("part", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("at", F.col("block") * block))
    got = pieces.join(takes, ["sid", "block"]).groupBy("row_key").agg(F.sum(F.col("part") * F.col("takes")).alias("taken"), F.count("*").alias("n_blocks"))
    return laid.join(got, "row_key", "left").select(
        "doc_id", "size", "source", "source_size", "target", F.coalesce("fine", "taken", F.lit(0)).cast("long").alias("taken"), F.coalesce(F.when(F.col("fine") > 0, F.least("fine", "size")), "n_blocks", F.lit(0)).cast("long").alias("n_blocks"), "row_key"
    )
