"""Nucleotide functions; all are JVM-side column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(seq: Column | str, n_policy: str = "n") -> Column:
    """A, C, G, T in upper case; any other character becomes N, or A with ``n_policy="as_a"``."""
    if n_policy not in ("n", "as_a"):
        raise ValueError(f"n_policy must be 'n' or 'as_a', not {n_policy!r}")
    return F.regexp_replace(F.translate(_col(seq), "acgt", "ACGT"), "[^ACGT]", "N" if n_policy == "n" else "A")


def reverse_complement(seq: Column | str) -> Column:
    """Reverse complement of a normalized sequence; N stays N."""
    return F.reverse(F.translate(_col(seq), "ACGT", "TGCA"))


def base_code(base: Column | str) -> Column:
    """A, C, G, T to 0..3, anything else to -1."""
    return F.instr(F.lit("ACGT"), F.upper(_col(base))) - 1


def kmer_code(kmer: Column | str) -> Column:
    """A k-mer (k <= 31, ACGT only) as a base-4 LONG; null if it holds another letter."""
    k = _col(kmer)
    return F.when(k.rlike("^[ACGT]+$"), F.conv(F.translate(k, "ACGT", "0123"), 4, 10).cast("long"))


def kmer_from_code(code: Column | str, k: int) -> Column:
    """The inverse of :func:`kmer_code`."""
    return F.translate(F.lpad(F.conv(_col(code).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def ranks(seq: Column | str) -> Column:
    """Alphabet ranks with a final sentinel: A, C, G, T as 2..5 and 0 at the end."""
    return F.concat(F.translate(_col(seq), "ACGT", "2345"), F.lit("0"))


def gc_count(seq: Column | str, policy: str = "letters") -> Column:
    """Number of G and C; ``policy="bits"`` also counts K, O, S and W, whose low bits agree."""
    drop = {"letters": "[^CGcg]", "bits": "[^CGKOSWcgkosw]"}[policy]
    return F.length(F.regexp_replace(_col(seq), drop, "")).cast("long")


def gc_content(seq: Column | str) -> Column:
    """GC share in percent; 0 for an empty sequence."""
    n = F.length(_col(seq))
    return F.when(n > 0, 100.0 * gc_count(seq) / n).otherwise(0.0)


def windows(seq: Column | str, k: int) -> Column:
    """Array of (off, kmer): all k-letter substrings, also overlapping ones.

    One pass of a lookahead; a substring for each offset would walk the string anew.
    """
    found = F.regexp_extract_all(_col(seq), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    return F.transform(found, lambda w, i: F.struct(i.alias("off"), w.alias("kmer")))


def kmers(seq: Column | str, k: int, stride: int = 1, origin: Column | int = 0) -> Column:
    """Array of (off, kmer) for offsets whose global coordinate ``origin + off`` is a multiple of ``stride``.

    K-mers with a letter other than ACGT are left out before the array is exploded.
    """
    s = _col(seq)
    if stride == 1:
        return F.filter(windows(s, k), lambda p: ~p["kmer"].contains("N"))
    o = F.lit(origin) if isinstance(origin, int) else origin
    last = F.length(s) - k
    first = F.pmod(F.lit(stride) - F.pmod(o, F.lit(stride)), F.lit(stride)).cast("int")
    at = F.when(last >= first, F.sequence(first, last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(at, lambda i: F.struct(i.alias("off"), s.substr(i + 1, F.lit(k)).alias("kmer")))
    return F.filter(pairs, lambda p: ~p["kmer"].contains("N"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Mismatches of two strings, -1 if their lengths differ; N equals N."""
    x, y = _col(a), _col(b)
    diff = F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: (p != q).cast("int")), F.lit(0), lambda acc, v: acc + v)
    return F.when(F.length(x) != F.length(y), -1).otherwise(F.when(F.length(x) == 0, 0).otherwise(diff))


def mismatches(read: Column | str, ref: Column | str, limit: int) -> Column:
    """Mismatches where an N of the reference never matches, exact up to ``limit``, else limit + 1."""
    return F.least(hamming(read, F.translate(_col(ref), "N", "n")), F.lit(limit + 1))


def next_dna(seq: Column | str) -> Column:
    """The next string of equal length in the order A < C < G < T; empty after all T."""
    s = _col(seq)
    kept = F.regexp_replace(s, "T+$", "")
    n = F.length(kept)
    head, last = kept.substr(F.lit(1), n - 1), F.translate(F.substring(kept, -1, 1), "ACG", "CGT")
    return F.when(n == 0, F.lit("")).otherwise(F.concat(head, last, F.repeat(F.lit("A"), F.length(s) - n)))


#: Fixed start and factor of the 64-bit FNV-1a checksum.
FNV_START, FNV_PRIME = 1469598103934665603, 1099511628211


def checksum(seq: Column | str) -> Column:
    """FNV-1a of a sequence's bytes, as the LONG of the same 64 bits."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> int | None:
            if text is None:
                return None
            h = FNV_START
            for b in text.encode():
                h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
            return h - (1 << 64) if h >> 63 else h

        return pd.Series([one(t) for t in texts], dtype="Int64")

    return run(_col(seq))


def edit_within(read: Column | str, ref: Column | str, k: int) -> Column:
    """Edit distance up to ``k``, else -1; N matches nothing."""
    return F.levenshtein(F.translate(_col(read), "N", "n"), _col(ref), k)


def short_name(header: Column | str) -> Column:
    """A record's name: its header up to the first space or tab."""
    return F.regexp_extract(_col(header), "^[^ \t]*", 0)
