"""Seed anchors, their merging and clustering, as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SLACK, TOP_CLUSTERS = 3, 64
_KEY = ("read_id", "strand", "contig_id")


def seed_hits(seeds: DataFrame, index: DataFrame, freqs: DataFrame, most: int = 512) -> DataFrame:
    """Seeds (read_id, strand, off, kmer, seed_no) with their frequency and hits; frequencies above ``most`` are dropped before the hits are joined."""
    known = seeds.join(freqs.filter(F.col("freq") <= most), "kmer")
    return known.join(index, "kmer").select(*_KEY[:2], "contig_id", "seed_no", "off", "freq", (F.col("pos") - F.col("off")).alias("diagonal"))


def expand(hits: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """One anchor for each start within k of a diagonal that leaves room for a window of n - k bases; ``lengths``: read_id, n, and contigs' length come along in ``hits``."""
    room = hits.join(lengths, "read_id")
    lo = F.greatest(F.lit(-k).cast("long"), -F.col("diagonal"))
    hi = F.least(F.lit(k).cast("long"), F.col("length") - F.greatest(F.lit(1), F.col("n") - k) - F.col("diagonal"))
    fit = room.withColumn("lo", lo).withColumn("hi", hi).filter("lo <= hi")
    return fit.select(*_KEY, "seed_no", "off", "freq", F.explode(F.sequence("lo", "hi")).alias("d"), "diagonal").select(*_KEY, (F.col("diagonal") + F.col("d")).alias("start"), "seed_no", "off", "freq")


def merge(anchors: DataFrame) -> DataFrame:
    """Anchors of one start as one: least frequency, count, span of read offsets, and the set of seeds as bits."""
    bit = F.when(F.col("seed_no") < 32, F.expr("shiftleft(1L, cast(seed_no AS INT))")).otherwise(F.lit(0).cast("long"))
    return anchors.groupBy(*_KEY, "start").agg(F.min("freq").alias("freq"), F.least(F.count("*"), F.lit(65535)).alias("n_anchors"), F.min("off").alias("min_off"), F.max("off").alias("max_off"), F.bit_or(bit).alias("seeds"))


def cluster(merged: DataFrame, k: int) -> DataFrame:
    """Runs of merged anchors whose starts follow within k + SLACK, with ``rep``, the middle start."""
    order = W.partitionBy(*_KEY).orderBy("start")
    gap = F.col("start") - F.lag("start").over(order)
    new = F.when(gap.isNull() | (gap > k + SLACK), 1).otherwise(0)
    run = merged.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = run.groupBy(*_KEY, "run").agg(F.min("start").alias("min_start"), F.max("start").alias("max_start"), F.min("freq").alias("freq"), F.least(F.sum("n_anchors"), F.lit(65535)).alias("n_anchors"), F.min("min_off").alias("min_off"), F.max("max_off").alias("max_off"), F.bit_or("seeds").alias("seeds"))
    return out.withColumn("n_seeds", F.bit_count("seeds").cast("long")).withColumn("rep", F.col("min_start") + F.floor((F.col("max_start") - F.col("min_start")) / 2)).drop("run", "seeds")


def best_clusters(clusters: DataFrame, n: int = TOP_CLUSTERS) -> DataFrame:
    """The ``n`` best clusters of each read and strand: most seeds, widest read span, most anchors, rarest seed, first start; ``place`` from 1."""
    order = W.partitionBy("read_id", "strand").orderBy(F.desc("n_seeds"), F.desc(F.col("max_off") - F.col("min_off")), F.desc("n_anchors"), "freq", "min_start", "contig_id")
    return clusters.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
