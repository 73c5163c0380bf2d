"""Suffix arrays, BWT and FM index tables of bounded contigs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_LENGTH = 1 << 24


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; ranks are packed unsorted while they fit."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    size, step, dense = int(rank.max()) + 1 if n else 0, 1, True
    while not dense or size < n:
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:] if step < n else second[: n - step]
        rank, size, dense = rank * (size + 1) + second + 1, size * (size + 1), False
        step *= 2
        if size >= 1 << 31 or step >= n:
            rank = np.unique(rank, return_inverse=True)[1]
            size, dense = int(rank.max()) + 1, True
    return np.argsort(rank, kind="stable")


def _each(contigs: DataFrame, table: Callable, schema: str, max_length: int) -> DataFrame:
    """``table(text, suffix array)`` of every contig, with its contig_id in front; nothing is shuffled.

    One task for each contig, so contigs above ``max_length`` are refused.
    """
    text = F.when(F.length("seq") > max_length, F.raise_error(F.lit("contig too long for a suffix array"))).otherwise(F.col("seq"))

    def each(frames):
        for pdf in frames:
            for cid, seq in zip(pdf["contig_id"], pdf["seq"], strict=True):
                t = np.frombuffer((seq + "$").encode(), np.uint8)
                out = pd.DataFrame(table(t, suffix_order(t)))
                out.insert(0, "contig_id", cid)
                yield out

    return contigs.select("contig_id", text.alias("seq")).mapInPandas(each, f"contig_id long, {schema}")


def _letters(codes: np.ndarray) -> np.ndarray:
    return np.array([chr(c) for c in range(256)], object)[codes]


def suffix_array(contigs: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """contig_id, row, pos, ch: suffixes of ``seq`` + ``$`` in order, and the BWT letter before each."""
    return _each(contigs, lambda t, sa: {"row": np.arange(len(t)), "pos": sa, "ch": _letters(t[sa - 1])}, "row long, pos long, ch string", max_length)


def bwt_strings(contigs: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """contig_id, bwt."""
    return _each(contigs, lambda t, sa: {"bwt": [t[sa - 1].tobytes().decode()]}, "bwt string", max_length)


def contig_symbol_starts(contigs: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """:func:`symbol_starts` of whole contigs, counted where the suffixes are sorted."""

    def table(t: np.ndarray, sa: np.ndarray) -> dict:
        ch, n = np.unique(t[sa - 1], return_counts=True)
        return {"ch": _letters(ch), "n": n, "start": np.cumsum(n) - n}

    return _each(contigs, table, "ch string, n long, start long", max_length)


def contig_checkpoints(contigs: DataFrame, every: int = 32, max_length: int = MAX_LENGTH) -> DataFrame:
    """:func:`checkpoints` of whole contigs, counted where the suffixes are sorted."""

    def table(t: np.ndarray, sa: np.ndarray) -> dict:
        bwt, rows = t[sa - 1], np.arange(0, len(t), every)
        return {"row": rows} | {f"n_{c.lower()}": np.concatenate([[0], np.cumsum(bwt == ord(c))])[rows] for c in "ACGT"}

    return _each(contigs, table, "row long, n_a long, n_c long, n_g long, n_t long", max_length)


def contig_samples(contigs: DataFrame, every: int = 32, max_length: int = MAX_LENGTH) -> DataFrame:
    """:func:`sampled` of whole contigs."""
    return _each(contigs, lambda t, sa: {"row": np.arange(0, len(t), every), "pos": sa[::every]}, "row long, pos long", max_length)


def symbol_starts(bwt: DataFrame) -> DataFrame:
    """The C array: contig_id, ch, n, start (symbols that sort before)."""
    counts = bwt.groupBy("contig_id", "ch").agg(F.count("*").alias("n"))
    before = W.partitionBy("contig_id").orderBy("ch").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def checkpoints(bwt: DataFrame, every: int = 32) -> DataFrame:
    """Occ checkpoints: counts of A, C, G, T in the rows before each multiple of ``every``."""
    before = W.partitionBy("contig_id").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    counts = [F.coalesce(F.sum((F.col("ch") == c).cast("long")).over(before), F.lit(0)).alias(f"n_{c.lower()}") for c in "ACGT"]
    return bwt.select("contig_id", "row", *counts).filter(F.col("row") % every == 0)


def sampled(sa: DataFrame, every: int = 32) -> DataFrame:
    """Sampled suffix array rows."""
    return sa.filter(F.col("row") % every == 0).select("contig_id", "row", "pos")


class FMIndex:
    """An FM index of one bounded text: BWT, checkpoints of its symbols and sampled positions."""

    def __init__(self, text: str, every: int = 32):
        t = np.frombuffer((text + "$").encode(), np.uint8)
        self.sa = suffix_order(t)
        self._set(t[self.sa - 1], self.sa[::every], every)
        self._back: FMIndex | None = None
        self.text = text

    def _set(self, bwt: np.ndarray, samples: np.ndarray, every: int) -> None:
        self.bwt, self.samples, self.n, self.every = bwt, samples, len(bwt), every
        self.symbols = {chr(c): c for c in np.unique(bwt)}
        self.start = {s: int((bwt < c).sum()) for s, c in self.symbols.items()}
        self.marks = {s: np.concatenate([[0], np.cumsum(bwt == c)])[::every] for s, c in self.symbols.items()}

    @classmethod
    def load(cls, text: str, bwt: bytes, samples: np.ndarray, every: int) -> FMIndex:
        """From what :func:`fm_table` keeps."""
        self = cls.__new__(cls)
        self._set(np.frombuffer(bwt, np.uint8), samples, every)
        self.text, self._back = text, None
        return self

    def occ(self, symbol: str, row: int) -> int:
        """Occurrences of a symbol in the BWT rows before ``row``."""
        if symbol not in self.symbols:
            return 0
        block = row // self.every
        return int(self.marks[symbol][block]) + int((self.bwt[block * self.every : row] == self.symbols[symbol]).sum())

    def lf(self, row: int) -> int:
        s = chr(self.bwt[row])
        return self.start[s] + self.occ(s, row)

    def step(self, c: str, lo: int, hi: int) -> tuple[int, int]:
        """The rows of [lo, hi) with ``c`` put before them."""
        if c not in self.start or lo >= hi:
            return 0, 0
        return self.start[c] + self.occ(c, lo), self.start[c] + self.occ(c, hi)

    def interval(self, pattern: str) -> tuple[int, int]:
        """Rows [lo, hi) whose suffixes start with the pattern; empty for an empty pattern."""
        lo, hi = (0, self.n) if pattern else (0, 0)
        for c in reversed(pattern):
            lo, hi = self.step(c, lo, hi)
        return (lo, hi) if lo < hi else (0, 0)

    def locate(self, row: int) -> int:
        """Text position of a row, walking back to a sampled one."""
        steps = 0
        while row % self.every:
            row = self.lf(row)
            steps += 1
        return (int(self.samples[row // self.every]) + steps) % self.n

    def lower_bounds(self, pattern: str) -> list[int]:
        """For each i the number of disjoint segments of pattern[:i + 1] that do not occur: errors that any match of it needs.

        Segments grow to the right, so they are looked up in the index of the reversed text.
        """
        if self._back is None:
            self._back = FMIndex(self.text[::-1], self.every)
        out, absent = [], 0
        lo, hi = 0, self._back.n
        for c in pattern:
            lo, hi = self._back.step(c, lo, hi)
            if lo >= hi:
                absent += 1
                lo, hi = 0, self._back.n
            out.append(absent)
        return out

    def within(self, pattern: str, k: int, limit: int = 64) -> list[tuple[int, int, int]]:
        """(lo, hi, edits) of rows whose suffixes start with a string within ``k`` edits; least edits for each interval, best ``limit``."""
        best: dict[tuple[int, int], int] = {}
        need = [0, *self.lower_bounds(pattern)]

        def walk(i: int, lo: int, hi: int, used: int) -> None:
            if lo >= hi or used + need[max(i + 1, 0)] > k:
                return
            if i < 0:
                best[lo, hi] = min(used, best.get((lo, hi), used))
                return
            walk(i - 1, lo, hi, used + 1)
            for c in self.start:
                if c == "$":
                    continue
                a, b = self.step(c, lo, hi)
                walk(i - 1, a, b, used + (c != pattern[i]))
                walk(i, a, b, used + 1)

        walk(len(pattern) - 1, 0, self.n, 0)
        return [(lo, hi, e) for e, lo, hi in sorted((e, lo, hi) for (lo, hi), e in best.items())][:limit]


FM_VERSION = 1
_FM = "contig_id long, name string, seq string, every int, bwt binary, samples array<long>, version int"


def fm_table(contigs: DataFrame, every: int = 32, max_length: int = MAX_LENGTH) -> DataFrame:
    """FM indexes of contigs, one row each: contig_id, name, seq, every, bwt, samples, version."""
    tooth = F.when(F.length("seq") > max_length, F.raise_error(F.lit("contig too long for a suffix array"))).otherwise(F.col("seq"))

    def each(frames):
        for pdf in frames:
            for cid, name, seq in zip(pdf["contig_id"], pdf["name"], pdf["seq"], strict=True):
                fm = FMIndex(seq, every)
                yield pd.DataFrame({"contig_id": [cid], "name": [name], "seq": [seq], "every": [every], "bwt": [fm.bwt.tobytes()], "samples": [fm.samples.tolist()], "version": [FM_VERSION]})

    return contigs.select("contig_id", "name", tooth.alias("seq")).mapInPandas(each, _FM)


def write_fm(contigs: DataFrame, path: str, every: int = 32) -> None:
    """Save FM indexes as Parquet."""
    fm_table(contigs, every).write.mode("overwrite").parquet(path)


def open_fm(spark: SparkSession, path: str) -> DataFrame:
    """Saved FM indexes; a row of another version raises when it is read."""
    table = spark.read.schema(_FM).parquet(path)
    wrong = F.raise_error(F.concat(F.lit("FM index of version "), F.coalesce(F.col("version").cast("string"), F.lit("?"))))
    return table.withColumn("bwt", F.when(F.col("version").eqNullSafe(FM_VERSION), F.col("bwt")).otherwise(wrong))


#: Patterns or reads sent to every index at once, in bytes; more are an error, to be searched in several calls.
MAX_SENT = 8 << 20


def bounded(df: DataFrame, columns: list[str]) -> list[tuple]:
    """The rows of a table that is small enough to be sent to every task, checked before it is collected."""
    size = df.select(F.sum(sum((F.octet_length(F.col(c).cast("string")) for c in columns), F.lit(0)) + 16)).first()[0] or 0
    if size > MAX_SENT:
        raise ValueError(f"{size} bytes of patterns; at most {MAX_SENT} in one call")
    return [tuple(r) for r in df.select(*columns).collect()]


def opened(frames):
    """(contig_id, name, index) of rows of :func:`fm_table`."""
    for pdf in frames:
        for r in pdf.itertuples():
            yield r.contig_id, r.name, FMIndex.load(r.seq, r.bwt, np.asarray(r.samples), r.every)


def fm_occurrences(table: DataFrame, patterns: DataFrame, k: int = 0, limit: int = 64) -> DataFrame:
    """Rows of each index whose suffixes start with a pattern within ``k`` edits: contig_id, pattern, lo, hi, edits, positions.

    Patterns are a bounded table (:data:`MAX_SENT`); with k = 0 all matches, else the ``limit`` best intervals.
    """
    wanted = sorted({p for (p,) in bounded(patterns.filter("pattern <> ''").distinct(), ["pattern"])})

    def each(frames):
        for cid, _, fm in opened(frames):
            rows = []
            for p in wanted:
                lo, hi = fm.interval(p)
                for a, b, e in [(lo, hi, 0)] * (lo < hi) if k == 0 else fm.within(p, k, limit):
                    rows.append((cid, p, a, b, e, sorted(fm.locate(r) for r in range(a, b))))
            yield pd.DataFrame(rows, columns=["contig_id", "pattern", "lo", "hi", "edits", "positions"])

    return table.mapInPandas(each, "contig_id long, pattern string, lo long, hi long, edits int, positions array<long>")


def membership(table: DataFrame, patterns: DataFrame) -> DataFrame:
    """contig_id, pattern, n: how often each pattern occurs in each contig, 0 included; nothing is located."""
    wanted = sorted({p for (p,) in bounded(patterns.distinct(), ["pattern"])})

    def each(frames):
        for cid, _, fm in opened(frames):
            spans = [fm.interval(p) for p in wanted]
            yield pd.DataFrame({"contig_id": cid, "pattern": wanted, "n": [hi - lo for lo, hi in spans]})

    return table.mapInPandas(each, "contig_id long, pattern string, n long")


def inverted(table: DataFrame) -> DataFrame:
    """contig_id, seq: the texts spelled out of their BWTs alone."""

    def each(frames):
        for pdf in frames:
            for cid, bwt in zip(pdf["contig_id"], pdf["bwt"], strict=True):
                t = np.frombuffer(bwt, np.uint8)
                # rows in order of the symbol before them: following them spells the text forward
                following, out = np.argsort(t, kind="stable"), np.empty(len(t), np.uint8)
                row = int(following[0])
                ahead, first = following.tolist(), t[following]
                for i in range(len(t)):
                    out[i] = first[row]
                    row = ahead[row]
                yield pd.DataFrame({"contig_id": [cid], "seq": [out[:-1].tobytes().decode()]})

    return table.select("contig_id", "bwt").mapInPandas(each, "contig_id long, seq string")
