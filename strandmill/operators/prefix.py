"""Running sums that do not put all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def running_sum(df: DataFrame, order: str, value: Column, out: str, cell_rows: int = 4096) -> DataFrame:
    """Exclusive running sum of ``value`` over all rows by the integer column ``order``.

    Rows are summed by ranges of ``order`` first; only those sums are prefixed in
    one place (one row for ``cell_rows`` ids), then each range on its own.
    """
    df = df.withColumn("_v", value).withColumn("_cell", F.floor(F.col(order) / cell_rows))
    cells = df.groupBy("_cell").agg(F.sum("_v").alias("_n"))
    before = W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = W.partitionBy("_cell").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_run", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    return df.join(cells, "_cell").withColumn(out, (F.col("_run") + F.col("_base")).cast("long")).drop("_v", "_cell", "_run", "_base")
