"""CIGAR and SAM field functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MID = "^([0-9]+[MID])+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_mid(cigar: Column | str) -> Column:
    """True for run lengths of M, I and D only."""
    return _col(cigar).rlike(MID)


def has_clip(cigar: Column | str) -> Column:
    return _col(cigar).rlike("[SH]")


def _length(cigar: Column, ops: str) -> Column:
    total = F.aggregate(F.transform(F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{ops}]"), F.lit(1)), lambda n: n.cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)
    return F.when(is_mid(cigar), total).otherwise(F.lit(-1).cast("long"))


def query_length(cigar: Column | str) -> Column:
    """Bases of the read that a CIGAR covers (M and I); -1 if it cannot be parsed."""
    return _length(_col(cigar), "MI")


def reference_length(cigar: Column | str) -> Column:
    """Bases of the reference that a CIGAR covers (M and D); -1 if it cannot be parsed."""
    return _length(_col(cigar), "MD")


def decode(cigar: Column | str) -> Column:
    """Array of (len, op)."""
    parts = F.regexp_extract_all(_col(cigar), F.lit("[0-9]+[MIDSH]"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^[0-9]+", 0).cast("int").alias("len"), F.substring(p, -1, 1).alias("op")))


def from_ops(ops: Column | str) -> Column:
    """Run-length code of a string of operations; ``*`` if empty."""
    o = _col(ops)
    runs = F.regexp_extract_all(o, F.lit("(M+|I+|D+)"), F.lit(1))
    return F.when(F.length(o) == 0, F.lit("*")).otherwise(F.concat_ws("", F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1)))))


def flag_set(flag: Column | str, mask: int) -> Column:
    """SAM flag test: 4 unmapped, 256 secondary, 2048 supplementary."""
    return _col(flag).bitwiseAND(F.lit(mask)) != 0


def nm_tag(tags: Column | str) -> Column:
    """The last ``NM:i:`` value among the tags, -1 if there is none."""
    values = F.filter(_col(tags), lambda t: t.startswith("NM:i:"))
    return F.coalesce(F.when(F.size(values) > 0, F.element_at(values, -1).substr(F.lit(6), F.lit(20)).try_cast("int")), F.lit(-1))
