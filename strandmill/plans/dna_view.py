"""Sequences derived from text tables, so that every query has inputs in both engines.

Letters map to ACGT by their place in the alphabet, a space to G, anything else to N.
``documents`` become contigs; tiles of ``benchmark`` become reads, some of them
changed by a rule on their id.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.sequence import reverse_complement

FROM = string.ascii_uppercase + string.ascii_lowercase + " "
TO = ("ACGT" * 7)[:26] * 2 + "G"
READ_LENGTH, READ_STEP = 100, 50


def dna(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), FROM, TO), "[^ACGT]", "N")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig_id, name, seq of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("contig_id"), F.col("doc_id").cast("string").alias("name"), dna(F.col("text")).alias("seq"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, name, seq, qual: tiles of benchmark texts; by read_id mod 5 unchanged, one substitution, deletion, insertion, or the other strand."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", dna(F.col("text")).alias("s"))
    last = F.floor((F.length("s") - READ_LENGTH) / READ_STEP).cast("int")
    tiles = items.filter(F.length("s") >= READ_LENGTH).select("item_id", "s", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    tiles = tiles.select((F.col("item_id") * 1000 + F.col("i")).alias("read_id"), F.col("s").substr(F.col("i") * READ_STEP + 1, F.lit(READ_LENGTH)).alias("t"))
    kind, at = F.col("read_id") % 5, ((F.col("read_id") * 7) % 80 + 10).cast("int")
    head, base, rest = F.col("t").substr(F.lit(1), at), F.col("t").substr(at + 1, F.lit(1)), F.col("t").substr(at + 2, F.lit(READ_LENGTH))
    seq = F.when(kind == 1, F.concat(head, F.translate(base, "ACGTN", "CGTAA"), rest)).when(kind == 2, F.concat(head, rest)).when(kind == 3, F.concat(head, F.lit("A"), base, rest)).when(kind == 4, reverse_complement("t")).otherwise(F.col("t"))
    rows = tiles.select("read_id", F.concat(F.lit("read"), "read_id").alias("name"), seq.alias("seq"))
    return rows.withColumn("qual", quality(F.col("name"), F.col("seq")))


def quality(name: Column, seq: Column) -> Column:
    """A quality string as long as the sequence, from the MD5 of the name."""
    letters = F.translate(F.md5(name), "0123456789abcdef", "!$'*-0369<?BEHI#")
    return F.repeat(letters, F.ceil(F.length(seq) / 32).cast("int")).substr(F.lit(1), F.length(seq))
