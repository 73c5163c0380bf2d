"""Sequence statistics and k-mer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.sequence import gc_count, kmers


def global_stats(df: DataFrame, gc_policy: str = "letters") -> DataFrame:
    """One row: n_seqs, total, shortest, longest, mean (integer division), gc, gc_pct."""
    rows = df.select(F.length("seq").cast("long").alias("n"), gc_count("seq", gc_policy).alias("gc"))
    out = rows.agg(F.count("*").alias("n_seqs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.coalesce(F.sum("gc"), F.lit(0)).alias("gc"))
    return out.withColumn("mean", F.floor(F.try_divide("total", "n_seqs")).cast("long")).withColumn("gc_pct", F.coalesce(F.try_divide(100.0 * F.col("gc"), F.col("total")), F.lit(0.0)))


def per_sequence(df: DataFrame, keep: str = "last", ordinal: str = "ordinal", gc_policy: str = "letters") -> DataFrame:
    """name, length, gc, gc_pct; of records that share a name the ``last`` (FASTA) or ``first`` (FASTQ) counts."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    rows = df.select("name", ordinal, F.struct(F.length("seq").cast("long").alias("length"), gc_count("seq", gc_policy).alias("gc")).alias("s"))
    pick = F.max_by if keep == "last" else F.min_by
    one = rows.groupBy("name").agg(pick("s", ordinal).alias("s")).select("name", "s.*")
    return one.withColumn("gc_pct", F.coalesce(F.try_divide(100.0 * F.col("gc"), F.col("length")), F.lit(0.0)))


def kmer_table(df: DataFrame, k: int, per_line: bool = False) -> DataFrame:
    """kmer, n, first_pos, last_pos over all sequences; k-mers with N are left out."""
    src = df.select(F.explode(F.split("seq", "\n")).alias("seq")) if per_line else df.select("seq")
    rows = src.select(F.explode(kmers("seq", k)).alias("x")).select("x.kmer", "x.off")
    return rows.groupBy("kmer").agg(F.count("*").alias("n"), F.min("off").alias("first_pos"), F.max("off").alias("last_pos"))


def kmer_positions(df: DataFrame, k: int) -> DataFrame:
    """kmer with its sorted list of positions (small inputs: the list of a common k-mer is one row)."""
    rows = df.select(F.explode(kmers("seq", k)).alias("x")).select("x.kmer", "x.off")
    return rows.groupBy("kmer").agg(F.sort_array(F.collect_list("off")).alias("positions"))
