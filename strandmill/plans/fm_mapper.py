"""Mapping of reads over FM indexes, contig by contig, with the customary cuts of that mode.

Exact intervals first, else bounded backtracking; of a contig's intervals those with
the fewest edits, and of each the first rows, are verified. Reads are a bounded table;
indexes are rows of :func:`strandmill.operators.suffix.fm_table`, so contigs are the
unit of parallel work and candidates alone are shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.align import banded
from strandmill.operators.suffix import FMIndex, bounded, opened
from strandmill.plans.mapper import oriented, top_two

#: Fixed cuts of this mode: intervals of a search, rows verified of an interval.
MOST_INTERVALS, ROWS_EACH = 32, 4


def verify(text: str, read: str, start: int, k: int) -> tuple[int, int] | None:
    """(edits, reference length) at a start: the shortest of the lengths with strictly fewest edits."""
    best = None
    for size in range(max(1, len(read) - k), min(len(text) - start, len(read) + k) + 1):
        got = banded(read, text[start : start + size], k)
        if got is not None and got[0] <= k and (best is None or got[0] < best[0]):
            best = got[0], size
    return best


def candidates(fm: FMIndex, read: str, k: int) -> list[int]:
    """Starts to verify: the first rows of the intervals with the fewest edits."""
    lo, hi = fm.interval(read)
    spans = [(lo, hi, 0)] if lo < hi else fm.within(read, k, MOST_INTERVALS) if k else []
    least = spans[0][2] if spans else 0
    starts = [fm.locate(row) for a, b, e in spans if e == least for row in range(a, min(b, a + ROWS_EACH))]
    return [s for s in dict.fromkeys(starts) if s + len(read) <= len(fm.text)]


def map_reads_fm(reads: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """Every read with its best hit and the best one further from it than a read's length, unmapped reads with nulls.

    A read that is its own reverse complement is searched once.
    """
    if not 0 <= k <= 3:
        raise ValueError(f"k must be 0 to 3, not {k}")
    asked = bounded(oriented(reads), ["read_id", "strand", "oseq"])

    def each(frames):
        for cid, _, fm in opened(frames):
            rows = []
            for read_id, strand, seq in asked:
                for start in candidates(fm, seq.replace("N", "n"), k) if seq else []:
                    if (got := verify(fm.text, seq.replace("N", "n"), start, k)) is not None:
                        rows.append((read_id, strand, cid, start, *got, len(seq)))
            yield pd.DataFrame(rows, columns=["read_id", "strand", "contig_id", "start", "edit", "ref_len", "n"])

    hits = table.mapInPandas(each, "read_id long, strand string, contig_id long, start long, edit int, ref_len int, n int")
    return reads.join(top_two(hits, table.select("contig_id", "name"), tolerance=F.col("n")), "read_id", "left")
