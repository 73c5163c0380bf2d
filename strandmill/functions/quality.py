"""Quality strings and plain number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_limit(qual: Column | str, qmin: int) -> Column:
    """Length to keep: through the rightmost base of Phred quality ``qmin`` or more (ASCII less 33)."""
    q = _col(qual)
    if qmin <= 0:
        return F.length(q)
    return F.length(F.regexp_replace(q, f"[\\x21-\\x{33 + qmin - 1:02x}]+$", ""))


def trim(df, qmin: int, seq: str = "seq", qual: str = "qual"):
    """Reads cut at :func:`trim_limit`."""
    keep = trim_limit(qual, qmin)
    return df.withColumn("_keep", keep).withColumn(seq, F.col(seq).substr(F.lit(1), F.col("_keep"))).withColumn(qual, F.col(qual).substr(F.lit(1), F.col("_keep"))).drop("_keep")


def mebibytes(n: Column | str) -> Column:
    return _col(n) / F.lit(1048576.0)


def iec(n: Column | str) -> Column:
    """Bytes with a binary unit, two decimals above bytes."""
    x = _col(n).cast("double")
    out = F.format_string("%.0f B", x)
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(x >= 1024.0**power, F.format_string(f"%.2f {unit}", x / 1024.0**power)).otherwise(out)
    return out


def ratio(a: Column | str, b: Column | str) -> Column:
    """A quotient that is null where the divisor is 0."""
    return F.try_divide(_col(a), _col(b))
