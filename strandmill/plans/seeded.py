"""Seeded mapping: bounded work for each read, with the customary caps.

Seeds come from a plan of positions, are ordered by rarity and chosen with a least
spacing that is relaxed twice; the rarest have more of their occurrences expanded.
Clusters are cut to 64 for each strand, scored windows to 20, and of these the 10
best go on if they are at most one edit worse than the best. With k of at most 1 rare
seeds are tried first without gaps; a strand that this settles is not searched further.
The reverse strand does not count where the forward one has two exact hits.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandmill.functions.sequence import mismatches
from strandmill.operators.index import fetch
from strandmill.plans import anchors as A
from strandmill.sources.shared import stage

#: Fixed caps of this mode.
SEED_TARGET = {0: 10, 1: 12, 2: 14, 3: 16}
SPACING = (10, 5, 0)
FREQ_SKIP, FREQ_MOST = 64, 512
DENSE_ALL, DENSE_SAMPLED = 192, 48
EXPAND_FIRST, EXPAND_OTHER, EXPAND_LEAST, EXPAND_FREE = 1024, 256, 64, 32
TOP_PREFILTER, TOP_VERIFY = 20, 10
QUICK_SEEDS, QUICK_FREQ, QUICK_STARTS, NEAR = 3, 8, 8, 10


def evenly(n: int, last: int) -> list[int]:
    """n whole numbers spread over 0..last, rounded half down."""
    return [0] if n <= 1 else sorted({(i * last + (n - 1) // 2) // (n - 1) for i in range(n)})


def seed_positions(length: int, k: int, seed: int, stride: int) -> list[int]:
    """Read offsets at which seeds are looked up."""
    last = length - seed
    if last < 0:
        return []
    target = min(SEED_TARGET[k], last + 1)
    if target <= 1:
        return [0]
    if stride == 1:
        return list(range(last + 1)) if last < DENSE_ALL else evenly(min(last + 1, max(4 * target, DENSE_SAMPLED)), last)
    return sorted({*range(min(stride, last + 1)), *evenly(target, last)})


def choose_seeds(found: list[tuple[int, int]], k: int) -> list[int]:
    """Chosen offsets, rarest first, among (frequency, offset) pairs.

    Frequencies up to FREQ_SKIP go first, then all; each time the spacing is relaxed
    from 10 to 5 to 0 until the target is met. A seed that the last spacing meets
    again spends a place, and the second round may go one beyond.
    """
    ranked, picked = sorted(found), []
    for most in (FREQ_SKIP, FREQ_MOST):
        full = False
        for space in SPACING:
            for freq, off in ranked:
                if freq <= most and all(abs(off - o) >= space for _, o in picked):
                    picked.append((freq, off))
                    if full := len(picked) >= SEED_TARGET[k]:
                        break
            if full:
                break
    return [off for _, off in sorted(set(picked))]


def expand_limit(rank: int, freq: int, stride: int) -> int:
    """How many occurrences of a seed are expanded, evenly spread when there are more."""
    limit = EXPAND_FIRST if rank < 2 else EXPAND_OTHER
    if stride == 1:
        limit = max(EXPAND_LEAST, limit // 2)
    return max(limit, freq) if freq <= EXPAND_FREE else limit


def planned_seeds(both: DataFrame, k: int, seed: int, stride: int) -> DataFrame:
    """read_id, strand, off, kmer at the planned positions."""

    @F.udf("array<int>")
    def plan(n: int) -> list[int]:
        return seed_positions(n, k, seed, stride)

    sizes = both.select(F.length("oseq").alias("n")).distinct().select("n", plan("n").alias("at"))
    rows = both.withColumn("n", F.length("oseq")).join(sizes, "n")
    pairs = F.transform("at", lambda o: F.struct(o.alias("off"), F.col("oseq").substr(o + 1, F.lit(seed)).alias("kmer")))
    return rows.select("read_id", "strand", F.explode(F.filter(pairs, lambda p: ~p["kmer"].contains("N"))).alias("x")).select("read_id", "strand", "x.off", "x.kmer")


def chosen_seeds(seeds: DataFrame, freqs: DataFrame, k: int) -> DataFrame:
    """read_id, strand, seed_no, off, kmer, freq of the chosen seeds."""
    known = seeds.join(freqs.filter(F.col("freq") <= FREQ_MOST), "kmer")
    per = known.groupBy("read_id", "strand").agg(F.collect_list(F.struct("freq", "off", "kmer")).alias("found"))

    @F.pandas_udf("array<int>")
    def pick(found: pd.Series) -> pd.Series:
        return found.map(lambda f: choose_seeds([(int(x["freq"]), int(x["off"])) for x in f], k))

    rows = per.select("read_id", "strand", "found", pick("found").alias("offs"))
    rows = rows.select("read_id", "strand", "found", F.posexplode("offs").alias("seed_no", "o"))
    one = F.filter("found", lambda f: f["off"] == F.col("o"))[0]
    return rows.select("read_id", "strand", "seed_no", F.col("o").alias("off"), one["kmer"].alias("kmer"), one["freq"].alias("freq"))


def sampled_hits(seeds: DataFrame, index: DataFrame, stride: int) -> DataFrame:
    """Occurrences of the chosen seeds, evenly sampled where they exceed their limit."""
    rank = F.row_number().over(W.partitionBy("kmer").orderBy("contig_id", "pos")) - 1
    wanted = index.join(seeds.select("kmer").distinct(), "kmer", "left_semi").withColumn("nth", rank)
    j = seeds.join(wanted, "kmer")
    limit = F.when(F.col("seed_no") < 2, EXPAND_FIRST).otherwise(EXPAND_OTHER)
    if stride == 1:
        limit = F.greatest(F.lit(EXPAND_LEAST), F.floor(limit / 2))
    limit = F.when(F.col("freq") <= EXPAND_FREE, F.greatest(limit, F.col("freq"))).otherwise(limit)
    picks = F.transform(F.sequence(F.lit(0).cast("long"), (limit - 1).cast("long")), lambda i: F.floor((i * (F.col("freq") - 1) + F.floor((limit - 1) / 2)) / (limit - 1)))
    keep = (F.col("freq") <= limit) | F.array_contains(picks, F.col("nth").cast("long"))
    return j.filter(keep).select("read_id", "strand", "contig_id", "seed_no", "off", "freq", (F.col("pos") - F.col("off")).alias("diagonal"))


def quick_hits(seeds: DataFrame, index: DataFrame, both: DataFrame, ref_chunks: DataFrame, sizes: DataFrame, k: int, longest: int | None) -> tuple[DataFrame, DataFrame]:
    """Hits without gaps of the rarest seeds, and the strands (read_id, strand) they settle.

    Starts are tried in order; a strand is settled by its first exact hit or its second
    distinct one, and what comes after does not count.
    """
    rare = seeds.filter((F.col("seed_no") < QUICK_SEEDS) & (F.col("freq") <= QUICK_FREQ))
    starts = rare.join(index, "kmer").select("read_id", "strand", "contig_id", (F.col("pos") - F.col("off")).alias("start")).distinct()
    starts = starts.join(both, ["read_id", "strand"]).join(sizes, "contig_id").withColumn("n", F.length("oseq"))
    starts = starts.filter((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("length")))
    strand = W.partitionBy("read_id", "strand").orderBy("contig_id", "start")
    starts = starts.withColumn("place", F.row_number().over(strand)).filter(F.col("place") <= QUICK_STARTS).drop("length")
    got = fetch(starts, ref_chunks, "start", "n", "window", longest=longest)
    got = got.withColumn("edit", mismatches("oseq", "window", k)).filter((F.col("edit") >= 0) & (F.col("edit") <= k))
    same = W.partitionBy("read_id", "strand", "contig_id", "edit").orderBy("start")
    apart = F.coalesce(F.col("start") - F.lag("start").over(same) > NEAR, F.lit(True))
    got = got.withColumn("new", apart.cast("int"))
    upto = W.partitionBy("read_id", "strand").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    got = got.withColumn("done", ((F.min("edit").over(upto) == 0) | (F.sum("new").over(upto) >= 2)).cast("int"))
    kept = ["read_id", "strand", "contig_id", "start", "edit", "n", "done"]
    got = stage(got.select(*kept, F.sum("done").over(upto).alias("closed")), "quick")
    settled = got.filter("done = 1").select("read_id", "strand").distinct()
    hits = got.filter("closed <= 1").select("read_id", "strand", "contig_id", "start", "edit", F.col("n").alias("ref_len"))
    return hits, settled


def drop_idle_reverse(hits: DataFrame) -> DataFrame:
    """Without the reverse hits of reads that have two distinct exact forward ones."""
    exact = hits.filter("strand = '+' AND edit = 0").select("read_id", "contig_id", "start").distinct()
    same = W.partitionBy("read_id", "contig_id").orderBy("start")
    apart = exact.withColumn("new", F.coalesce(F.col("start") - F.lag("start").over(same) > NEAR, F.lit(True)).cast("int"))
    full = apart.groupBy("read_id").agg(F.sum("new").alias("n")).filter("n >= 2").select(F.col("read_id").alias("full"))
    return hits.join(full, (F.col("read_id") == F.col("full")) & (F.col("strand") == "-"), "left_anti")


def seeded_hits(reads: DataFrame, ref_chunks: DataFrame, index: DataFrame, k: int, seed: int, stride: int) -> DataFrame:
    """read_id, strand, contig_id, start, edit, ref_len of verified windows."""
    from strandmill.plans.mapper import oriented, score_windows

    both = oriented(reads)
    longest = reads.agg(F.max(F.length("seq"))).first()[0]
    planned = planned_seeds(both, k, seed, stride)
    # each of these is used more than once
    index = stage(index.join(planned.select("kmer").distinct(), "kmer", "left_semi"), "index")
    freqs = index.groupBy("kmer").agg(F.count("*").alias("freq"))
    seeds = stage(chosen_seeds(planned, freqs, k), "seeds")
    sizes = ref_chunks.filter("chunk_id = 0").select("contig_id", "length")
    quick = None
    if k <= 1:
        quick, settled = quick_hits(seeds, index, both, ref_chunks, sizes, k, longest)
        seeds = seeds.join(settled, ["read_id", "strand"], "left_anti")
    hits = sampled_hits(seeds, index, stride).join(sizes, "contig_id")
    lengths = reads.select("read_id", F.length("seq").alias("n"))
    best = A.best_clusters(A.cluster(A.merge(A.expand(hits, lengths, k)), k))
    starts = best.select("read_id", "strand", "contig_id", "n_seeds", "freq", "rep", F.explode(F.sequence(F.greatest(F.col("rep") - k, F.lit(0)), F.col("rep") + k)).alias("start"))
    scored = score_windows(starts, both, ref_chunks, k, longest)
    one = scored.groupBy("read_id", "strand", "contig_id", "rep").agg(F.max("n_seeds").alias("n_seeds"), F.min("freq").alias("freq"), F.min(F.struct("edit", "start", "ref_len")).alias("b"))
    strand = W.partitionBy("read_id", "strand")
    kept = one.withColumn("place", F.row_number().over(strand.orderBy(F.col("b.edit"), F.desc("n_seeds"), "freq", "rep"))).filter(F.col("place") <= TOP_PREFILTER)
    kept = kept.withColumn("least", F.min("b.edit").over(strand)).filter((F.col("place") <= TOP_VERIFY) & (F.col("b.edit") <= F.col("least") + 1))
    found = kept.select("read_id", "strand", "contig_id", F.col("b.start").alias("start"), F.col("b.edit").alias("edit"), F.col("b.ref_len").alias("ref_len"))
    return drop_idle_reverse(found if quick is None else found.unionByName(quick).distinct())
