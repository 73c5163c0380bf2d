"""Sharding by extendible hashing, in DataFrame operations only.

Rows are placed by the leading bits of a 60-bit hash of their id. A directory
holds one entry for each hash prefix of ``depth`` bits; only a bucket above the
byte limit splits on one more bit, so local depths differ. Each round looks
``step`` bits ahead, sums bytes for those cells once, rolls them up the prefix
tree and settles every bucket that fits; only rows of buckets that are still too
large go to the next round. Rows that share all hash bits are cut by rank.

Edge cases: a row above the limit gets a shard of its own (``oversize``); null
texts weigh nothing; null ids hash as the empty string; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import running_sum, stage

HASH_BITS = 60
MAX_BYTES = 16 << 20


def row_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key, as LONG."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(bits: int | Column) -> Column:
    """The first ``bits`` bits of the column h."""
    return F.floor(F.col("h") / F.pow(F.lit(2.0), F.lit(HASH_BITS) - bits)).cast("long") if not isinstance(bits, int) else F.shiftright("h", HASH_BITS - bits)


def split_round(rows: DataFrame, depth: int, step: int, limit: int) -> DataFrame:
    """The directory of one round: for each cell of ``depth + step`` bits its bucket's depth, or null if it must split on."""
    deep = depth + step
    cells = rows.groupBy(_prefix(deep).alias("cell")).agg(F.sum("n_bytes").alias("n"))
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {deep} - depth)"))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("bucket_bytes")).filter(F.col("bucket_bytes") <= limit)
    fits = levels.select("cell", "depth", "prefix").join(sums, ["depth", "prefix"])
    return cells.select("cell").join(fits.groupBy("cell").agg(F.min("depth").alias("depth")), "cell", "left")


def extendible_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, depth, prefix, piece, shard, shard_bytes, shard_docs, oversize.

    ``shard`` is the bucket's bit string, with ``.piece`` where rows of one
    hash were cut by rank.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), row_hash(F.col(id_col)).alias("h"))
    left = stage(rows.withColumn("row_key", F.monotonically_increasing_id()), "sizes")
    total = left.agg(F.sum("n_bytes")).first()[0] or 0
    depth, step, done = 0, min(HASH_BITS, 2 + max(0, math.ceil(math.log2(max(1, total) / max_bytes)))), []
    while True:
        directory = split_round(left, depth, step, max_bytes)
        deep = depth + step
        placed = left.withColumn("cell", _prefix(deep)).join(directory, "cell").drop("cell")
        placed = stage(placed, f"round{deep}")
        done.append(placed.filter(F.col("depth").isNotNull()))
        left = placed.filter(F.col("depth").isNull()).drop("depth")
        depth, step = deep, min(4, HASH_BITS - deep)
        if step == 0 or left.isEmpty():
            break
    if depth == HASH_BITS:  # what no bit can split: rows of one hash
        done.append(left.withColumn("depth", F.lit(HASH_BITS)))
    out = reduce(DataFrame.unionByName, [d.select("doc_id", "n_bytes", "h", "row_key", F.col("depth").cast("int").alias("depth")) for d in done])
    out = out.withColumn("prefix", F.expr(f"shiftright(h, {HASH_BITS} - depth)"))
    # a settled bucket fits the limit; only rows of one hash that together exceed it are cut, by rank
    same = out.filter(F.col("depth") == HASH_BITS)
    most = stage(same.groupBy("h").agg(F.max("n_bytes").alias("most")).select(F.col("h").alias("of"), "most"), "one-hash")
    same = running_sum(same.withColumn("one", F.lit(1)), ["h"], ["row_key"], "one", "rank", F.shiftright("row_key", 14)).join(most, F.col("h") == F.col("of"))
    per = F.greatest(F.lit(1), F.floor(F.lit(max_bytes) / F.greatest(F.lit(1), F.col("most"))))
    same = same.withColumn("piece", F.floor(F.col("rank") / per).cast("long")).drop("one", "rank", "of", "most")
    out = out.filter(F.col("depth") < HASH_BITS).withColumn("piece", F.lit(0).cast("long")).unionByName(same)
    out = out.withColumn("shard", F.when(F.col("depth") == 0, F.lit("root")).otherwise(F.expr("lpad(bin(prefix), depth, '0')")))
    out = out.withColumn("shard", F.when(F.col("depth") == HASH_BITS, F.concat_ws(".", "shard", "piece")).otherwise(F.col("shard")))
    sums = out.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return out.join(sums, "shard").select("doc_id", "n_bytes", "depth", "prefix", "piece", "shard", "shard_bytes", "shard_docs", (F.col("shard_bytes") > max_bytes).alias("oversize"))
