"""Exact dedup by content-defined chunk recipes.

A text (A-Z lower-cased, null as empty) is cut where the hash of the last eight
bytes has ``CUT_BITS`` leading zero bits, within a least and a greatest chunk
length. A chunk's identifier is a 64-bit fingerprint; it is *verified* over the
corpus against 128 bits of the chunk's SHA-256: a fingerprint under which two
digests meet is widened by the digest wherever it stands. Documents are equal
when their ordered identifier lists are. Texts are read once where they lie;
only recipes (about eight bytes for each KB of text) are shuffled.

Edge cases: null and empty texts are equal to each other; of rows that repeat
both text and doc_id one row is kept; a null doc_id ranks below any other; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import bounded_batches, stage, text_slices
from strandmill.llm.textscan import LOWER, mix

CUT_BITS, LEAST, GREATEST = 11, 256, 16384
_SCHEMA = "doc_id long, recipe binary, fps array<long>, check_a array<long>, check_b array<long>, text_sha256 string"


def chunk_ends(text: np.ndarray) -> list[int]:
    """Ends of the content-defined chunks of one normalised text (bytes)."""
    n = len(text)
    if n <= LEAST:
        return [n]
    x = text.astype(np.uint64)
    for shift in (1, 2, 4):  # x[i]: the eight bytes that end at i
        x[shift:] |= x[:-shift] << np.uint64(8 * shift)
    marks = np.flatnonzero(mix(x) >> np.uint64(64 - CUT_BITS) == 0) + 1
    ends, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > GREATEST:
            last += GREATEST
            ends.append(last)
        if m - last >= LEAST or m == n:
            ends.append(m)
            last = m
    return ends if ends[-1] == n else [*ends, n]


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in text_slices(batch.column(1)):
            low = LOWER[data]
            recipe, fps, ca, cb, sha = [], [], [], [], []
            for i in range(hi - lo):
                part = low[offs[i] : offs[i + 1]]
                raw, at, digests = part.tobytes(), 0, []
                for e in chunk_ends(part):
                    digests.append(hashlib.sha256(raw[at:e]).digest())
                    at = e
                marks = [hashlib.blake2b(d, digest_size=8).digest() for d in digests]
                recipe.append(b"".join(marks))
                fps.append(np.frombuffer(recipe[-1], np.int64))
                d = np.frombuffer(b"".join(x[:16] for x in digests), np.int64)
                ca.append(d[0::2])
                cb.append(d[1::2])
                sha.append(hashlib.sha256(raw).hexdigest())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(recipe, pa.binary()), pa.array(fps, longs), pa.array(ca, longs), pa.array(cb, longs), pa.array(sha, pa.string())],
                ["doc_id", "recipe", "fps", "check_a", "check_b", "text_sha256"],
            )


def chunk_dictionary(recipes: DataFrame) -> DataFrame:
    """One row per chunk identifier: occurrences, and whether one digest stands behind it."""
    chunks = recipes.select(F.inline(F.arrays_zip("fps", "check_a", "check_b")))
    least, most = [F.min("check_a"), F.min("check_b")], [F.max("check_a"), F.max("check_b")]
    return chunks.groupBy("fps").agg(F.count("*").alias("occurrences"), ((least[0] == most[0]) & (least[1] == most[1])).alias("verified"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts; of each, the row with the largest id stays.

    Returns one row per input row: doc_id, keep_id, group_size, kept,
    text_sha256, n_chunks, and ``row_key``, unique for each row.
    """
    df = bounded_batches(df)
    recipes = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_recipes, _SCHEMA)
    recipes = stage(recipes.withColumn("row_key", F.monotonically_increasing_id()), "recipes")
    clash = chunk_dictionary(recipes).filter(~F.col("verified")).limit(1).count()
    # without a clash the fingerprints are the verified identifiers; with one, digests widen every identifier
    ident = F.struct("fps", "check_a", "check_b") if clash else F.col("recipe")
    rows = recipes.select("doc_id", "row_key", "text_sha256", F.size("fps").cast("long").alias("n_chunks"), ident.alias("ident"))
    groups = rows.groupBy("ident").agg(F.max(F.struct("doc_id", "row_key")).alias("top"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = stage(groups, "groups")  # so that the join reads both sides as they lie and can split a large group
    out = rows.join(groups, "ident", "left")
    return out.select(
        "doc_id",
        F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("top").isNull() | (F.col("top.row_key") == F.col("row_key"))).alias("kept"),
        "text_sha256",
        "n_chunks",
        "row_key",
    )
