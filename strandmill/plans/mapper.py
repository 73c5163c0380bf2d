"""Read mapping.

``exhaustive`` mode is complete: of k + 1 disjoint pieces of a read one is free of
errors, so seeds from every piece (as many as the index stride) meet the index on a
k-mer; the windows around each diagonal are fetched by one equi-join and kept if
their edit distance is within k. ``seeded`` mode applies the usual caps instead:
frequency tiers, a spaced choice of seeds, sampled occurrences, clusters and
top-n cuts (see :mod:`strandmill.plans.seeded`); its seeds are staged when it is called,
while an exhaustive plan is lazy.

Both report at most two hits for each read: the best by (edit, contig name,
position, strand), and the best that is not within ``tolerance`` of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandmill.functions.sequence import edit_within, normalize, reverse_complement
from strandmill.operators.align import banded_align
from strandmill.operators.index import SEED, fetch

STRIDE, TOLERANCE = 4, 10


def oriented(reads: DataFrame, n_policy: str = "n") -> DataFrame:
    """read_id, strand, oseq: each read in both directions, in one pass; a read that is its own reverse complement once."""
    fwd = reads.select("read_id", normalize("seq", n_policy).alias("s"))
    both = F.array(F.struct(F.lit("+").alias("strand"), F.col("s").alias("oseq")), F.struct(F.lit("-").alias("strand"), reverse_complement("s").alias("oseq")))
    apart = F.filter(both, lambda o: (o["strand"] == "+") | (o["oseq"] != F.col("s")))
    return fwd.select("read_id", F.explode(apart).alias("o")).select("read_id", "o.strand", "o.oseq")


def piece_seeds(both: DataFrame, k: int, seed: int = SEED, stride: int = STRIDE) -> DataFrame:
    """read_id, strand, off, kmer: ``stride`` neighbouring seeds at the start of each of k + 1 pieces."""
    piece = F.floor(F.length("oseq") / (k + 1)).cast("int")
    at = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(stride - 1)), lambda j: (i * piece + j).cast("int"))))
    pairs = F.transform(at, lambda o: F.struct(o.alias("off"), F.col("oseq").substr(o + 1, F.lit(seed)).alias("kmer")))
    fit = F.filter(pairs, lambda p: (F.length(p["kmer"]) == seed) & ~p["kmer"].contains("N"))
    return both.select("read_id", "strand", F.explode(fit).alias("x")).select("read_id", "strand", "x.off", "x.kmer")


def candidate_starts(seeds: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """read_id, strand, contig_id, start: every start within k of a seed's diagonal, once."""
    hit = seeds.join(index, "kmer").select("read_id", "strand", "contig_id", (F.col("pos") - F.col("off")).alias("diagonal")).distinct()
    return hit.select("read_id", "strand", "contig_id", F.explode(F.sequence(F.col("diagonal") - k, F.col("diagonal") + k)).alias("start")).filter("start >= 0").distinct()


def score_windows(starts: DataFrame, both: DataFrame, ref_chunks: DataFrame, k: int, longest: int | None = None) -> DataFrame:
    """``starts`` (read_id, strand, contig_id, start, ...) with edit and ref_len: the least distance of any window length at a start, shortest first."""
    held = starts.join(both, ["read_id", "strand"]).withColumn("n", F.length("oseq"))
    got = fetch(held.withColumn("size", F.col("n") + k), ref_chunks, "start", "size", "window", longest=longest and longest + k)
    lens = F.filter(F.sequence(F.greatest(F.lit(1), F.col("n") - k), F.col("n") + k), lambda m: m <= F.length("window"))
    scored = F.transform(lens, lambda m: F.struct(edit_within("oseq", F.col("window").substr(F.lit(1), m), k).alias("edit"), m.alias("ref_len")))
    best = F.array_min(F.filter(scored, lambda s: s["edit"] >= 0))
    return got.select(*starts.columns, best.alias("b")).filter("b IS NOT NULL").select(*starts.columns, "b.edit", "b.ref_len")


def top_two(hits: DataFrame, names: DataFrame, tolerance: int | Column = TOLERANCE, same_edit: bool = False) -> DataFrame:
    """One row for each read with hits: the primary and, if any, the best hit not near it; positions are 1-based.

    Near is a start within ``tolerance`` (a number, or a column of ``hits`` such as the
    read's length) on the same contig, and with ``same_edit`` of the same edit distance.
    """
    named = hits.join(names.select("contig_id", F.col("name").alias("chrom")), "contig_id")
    order = W.partitionBy("read_id").orderBy("edit", "chrom", "start", "strand")
    first = [F.first(c).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias(f"_{c}") for c in ("chrom", "start", "edit")]
    seen = named.select("*", *first)
    near = (F.col("chrom") == F.col("_chrom")) & (F.abs(F.col("start") - F.col("_start")) <= tolerance)
    if same_edit:
        near = (near & (F.col("edit") == F.col("_edit"))) | ((F.col("chrom") == F.col("_chrom")) & (F.col("start") == F.col("_start")) & (F.col("ref_len") == F.first("ref_len").over(order)))
        seen = seen.withColumn("_near", near)
        near = F.col("_near")
    hit = F.struct("edit", "chrom", (F.col("start") + 1).alias("pos"), "strand", "ref_len", "contig_id")
    best = seen.groupBy("read_id").agg(F.min(hit).alias("p"), F.min(F.when(~near, hit)).alias("a"))
    return best.select("read_id", *[F.col(f"p.{c}") for c in ("chrom", "pos", "edit", "strand", "ref_len", "contig_id")], *[F.col(f"a.{c}").alias(f"alt_{c}") for c in ("chrom", "pos", "edit", "strand", "ref_len", "contig_id")])


def map_reads(reads: DataFrame, ref_chunks: DataFrame, index: DataFrame, k: int, mode: str = "exhaustive", seed: int = SEED, stride: int = STRIDE, tolerance: int = TOLERANCE, n_policy: str = "n", same_edit: bool = False) -> DataFrame:
    """Every read with its two best hits, unmapped reads with nulls.

    ``ref_chunks`` and ``index`` come from :mod:`strandmill.operators.index` with
    the same ``seed`` and ``stride``. Complete for reads of at least
    (k + 1)(seed + stride - 1) bases, however long.
    """
    if not 0 <= k <= 3:
        raise ValueError(f"k must be 0 to 3, not {k}")
    if mode not in ("exhaustive", "seeded"):
        raise ValueError(f"mode must be 'exhaustive' or 'seeded', not {mode!r}")
    names = ref_chunks.filter("chunk_id = 0").select("contig_id", "name")
    if mode == "seeded":
        from strandmill.plans.seeded import seeded_hits

        hits = seeded_hits(reads, ref_chunks, index, k, seed, stride)
    else:
        both = oriented(reads, n_policy)
        longest = reads.agg(F.max(F.length("seq"))).first()[0]  # reads within the chunk overlap need one chunk each
        hits = score_windows(candidate_starts(piece_seeds(both, k, seed, stride), index, k), both, ref_chunks, k, longest)
    return reads.join(top_two(hits, names, tolerance, same_edit), "read_id", "left")


def with_cigars(mapped: DataFrame, ref_chunks: DataFrame, k: int) -> DataFrame:
    """Adds cigar and alt_cigar, each with the edit distance of its alignment; only reported hits are fetched and aligned."""
    out = mapped
    for p in ("", "alt_"):
        want = mapped.filter(F.col(f"{p}contig_id").isNotNull()).select("read_id", F.col(f"{p}contig_id").alias("contig_id"), (F.col(f"{p}pos") - 1).alias("start"), F.col(f"{p}ref_len").alias("size"), F.when(F.col(f"{p}strand") == "-", reverse_complement(normalize("seq"))).otherwise(normalize("seq")).alias("oseq"))
        got = fetch(want, ref_chunks, "start", "size")
        got = got.select("read_id", banded_align("oseq", "window", k).alias("a")).select("read_id", F.col("a.cigar").alias(f"{p}cigar"), F.col("a.edit").alias(f"{p}cigar_edit"))
        out = out.join(got, "read_id", "left")
    return out
