"""Exact and k-mismatch occurrences of patterns in contigs, for patterns of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.sequence import hamming
from strandmill.operators.index import OVERLAP, WIDTH, fetch

#: So many distinct anchors at most are tested before positions become rows.
FEW_ANCHORS = 1000


def occurrences(ref_chunks: DataFrame, patterns: DataFrame, anchor: int = 4, width: int = WIDTH, overlap: int = OVERLAP) -> DataFrame:
    """All, also overlapping, occurrences: pattern, contig_id, pos (0-based).

    Patterns (column pattern) meet the chunks on their first letters, as many as the
    shortest pattern has but at most ``anchor``; the rest is compared in place, and
    beyond the chunk overlap in windows fetched for it. Empty patterns have none.
    """
    wanted = patterns.filter(F.length("pattern") > 0).select("pattern").distinct()
    sizes = wanted.agg(F.min(F.length("pattern")), F.max(F.length("pattern"))).first()
    if sizes[0] is None:
        return ref_chunks.limit(0).select(F.lit("").alias("pattern"), "contig_id", F.col("chunk_start").alias("pos"))
    anchor, longest = min(anchor, sizes[0]), min(sizes[1], overlap)
    # each offset with as many letters as the longest pattern within a chunk, not with its whole chunk
    grams = F.regexp_extract_all(F.col("seq").substr(F.lit(1), F.lit(width + longest - 1)), F.lit(f"(?s)(?=(.{{1,{longest}}}))"), F.lit(1))
    placed = F.transform(grams, lambda g, i: F.struct(i.alias("off"), g.alias("here")))
    wanted = wanted.withColumn("a", F.substring("pattern", 1, anchor)).withColumn("head", F.substring("pattern", 1, longest))
    starts = [r["a"] for r in wanted.select("a").distinct().limit(FEW_ANCHORS + 1).collect()]
    if len(starts) <= FEW_ANCHORS:
        placed = F.filter(placed, lambda p: F.substring(p["here"], 1, anchor).isin(starts))
    rows = ref_chunks.select("contig_id", "chunk_start", F.inline(placed)).filter(F.col("off") < width)
    hit = rows.join(wanted, F.substring("here", 1, anchor) == F.col("a")).filter(F.col("here").startswith(F.col("head")))
    hit = hit.select("pattern", "contig_id", (F.col("chunk_start") + F.col("off")).alias("pos"))
    if sizes[1] <= overlap:
        return hit
    long = fetch(hit.filter(F.length("pattern") > overlap).withColumn("size", F.length("pattern").cast("long")), ref_chunks, "pos", "size", "_window", width, overlap)
    return hit.filter(F.length("pattern") <= overlap).unionByName(long.filter("_window = pattern").select("pattern", "contig_id", "pos"))


def mismatch_occurrences(ref_chunks: DataFrame, patterns: DataFrame, k: int, width: int = WIDTH, overlap: int = OVERLAP) -> DataFrame:
    """Occurrences with at most ``k`` mismatches: pattern, contig_id, pos, mismatches.

    Pigeonhole: of k + 1 pieces of a pattern one occurs exactly, so patterns meet the
    chunks on pieces and are compared whole only there. One scan serves pieces of all
    lengths. Patterns of at most k letters occur wherever they fit; they are refused.
    """
    sizes = patterns.agg(F.min(F.length("pattern")), F.max(F.length("pattern"))).first()
    if sizes[0] is not None and sizes[0] <= k:
        raise ValueError(f"a pattern of {sizes[0]} letters matches anything within {k} mismatches")
    piece_width = F.floor(F.length("pattern") / (k + 1)).cast("int")
    pieces = patterns.select("pattern", piece_width.alias("w")).distinct()
    pieces = pieces.select("pattern", "w", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("p")).select("pattern", "w", (F.col("p") * F.col("w")).alias("shift"), F.expr("substring(pattern, p * w + 1, w)").alias("piece"))
    widths = sorted(r["w"] for r in pieces.select("w").distinct().collect())
    if not widths:
        return ref_chunks.limit(0).select(F.lit("").alias("pattern"), "contig_id", F.col("chunk_start").alias("pos"), F.lit(0).alias("mismatches"))
    # a piece of up to the overlap starts and ends in one chunk; longer ones meet it by their first letters
    seen = F.explode(F.array(*[F.lit(min(w, overlap)) for w in widths])).alias("seen")
    rows = ref_chunks.select("contig_id", "chunk_start", "seq", seen).distinct() if len(set(min(w, overlap) for w in widths)) < len(widths) else ref_chunks.select("contig_id", "chunk_start", "seq", seen)
    found = F.regexp_extract_all(F.col("seq").substr(F.lit(1), F.lit(width - 1) + F.col("seen")), F.concat(F.lit("(?s)(?=(.{"), F.col("seen"), F.lit("}))")), F.lit(1))
    rows = rows.select("contig_id", "chunk_start", "seen", F.posexplode(found).alias("off", "piece")).filter(F.col("off") < width)
    keyed = pieces.select("pattern", "shift", F.least("w", F.lit(overlap)).alias("seen"), F.substring("piece", 1, overlap).alias("piece"))
    starts = rows.join(keyed, ["seen", "piece"]).select("pattern", "contig_id", (F.col("chunk_start") + F.col("off") - F.col("shift")).alias("pos")).filter("pos >= 0").distinct()
    whole = fetch(starts.withColumn("size", F.length("pattern").cast("long")), ref_chunks, "pos", "size", "_window", width, overlap, longest=sizes[1])
    whole = whole.withColumn("mismatches", hamming("_window", "pattern")).filter((F.col("mismatches") >= 0) & (F.col("mismatches") <= k))
    return whole.select("pattern", "contig_id", "pos", "mismatches")
