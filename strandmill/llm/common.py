"""Shared plumbing: staged tables, two-level prefix sums, Arrow batch slicing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Text slices handed to one numpy pass; a longer single text forms its own slice.
SLICE_BYTES = 1 << 18
#: Word: a maximal run without ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

_RUN = uuid.uuid4().hex[:12]


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the checkpoint directory of the session.

    That is ``spark.checkpoint.dir`` or what ``setCheckpointDir`` was given. Where
    neither is set a temporary folder of this machine is made, in local mode only;
    on a cluster, where executors would not see it, that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandmill-")
        context.setCheckpointDir(base)
    # with its scheme, so that Spark and Python open the same store
    path = context._jvm.org.apache.hadoop.fs.Path(base)
    full = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/(?!/)", "file:///", full).rstrip("/")


class Scratch:
    """Tables written on the way to results; :meth:`drop` deletes them once those results are written.

    As a context it takes in every table staged inside its block, whichever operator
    stages it; tables of other blocks, and those staged outside any, stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.before = _scratch.set(self)
        return self

    def __exit__(self, *_) -> None:
        _scratch.reset(self.before)

    def drop(self) -> None:
        while self.paths:
            _remove(self.spark, self.paths.pop())


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder: removed with the open :class:`Scratch`, and when the process ends."""
    path = f"{shared_dir(spark)}/strandmill-{_RUN}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    if (held := _scratch.get()) is not None:
        held.paths.append(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is already gone
        pass


#: Spark drops the shuffle files of a query when it ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and reread it: lineage ends here, a lost
    executor costs no recomputation, nothing is computed twice, and the shuffles behind it
    go as soon as it is written."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    with _shuffles_go(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def _shuffles_go(spark: SparkSession):
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


#: Bytes of one Arrow batch between the JVM and a Python worker; both hold a batch or two at once.
BATCH_BYTES = 8 << 20


def _write_parquet(uri: str, body: Callable, schema: pa.Schema):
    """mapInArrow body: what ``body`` yields, in one file under ``uri``; gives the file's name, if there are rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(uri)
        name, out, held, size = f"part-{uuid.uuid4().hex}.parquet", None, [], 0
        try:
            for batch in chain(body(batches), [None]):
                if batch is not None and len(batch):
                    held.append(batch)
                    size += held[-1].nbytes
                if held and (batch is None or size >= BATCH_BYTES):
                    out = out or pq.ParquetWriter(f"{base}/{name}", schema, filesystem=fs)
                    out.write_table(pa.Table.from_batches(held).cast(schema))
                    held, size = [], 0
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_pydict({"file": [name]})

    return run


def stage_mapped(df: DataFrame, body: Callable, schema: pa.Schema, sql: str, name: str) -> DataFrame:
    """``stage(df.mapInArrow(body, sql), name)`` whose rows do not pass through the JVM: the Python
    tasks write the files. ``schema`` is that of ``sql`` in Arrow; other columns of ``body`` are left out.

    Only files that a task has reported count, so failed and repeated attempts add nothing. On
    local files this also saves the ``chmod`` processes that Hadoop starts for each file and
    folder, whose start doubles the JVM's memory for whoever reads it in that instant. A store
    that pyarrow does not open is written to by Spark.
    """

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in body(batches):
            yield batch.select(schema.names)

    spark = df.sparkSession
    path = shared_path(spark, name)
    tried = f"{path}/_tried"
    try:
        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(f"{base}/_tried")
    except (OSError, ValueError, NotImplementedError):
        return stage(df.mapInArrow(chosen, sql), name)
    with _shuffles_go(spark):
        files = df.mapInArrow(_write_parquet(tried, chosen, schema), "file string").collect()
    for r in files:
        fs.move(f"{base}/_tried/{r['file']}", f"{base}/{r['file']}")
    fs.delete_dir(f"{base}/_tried")
    return spark.read.schema(sql).parquet(path)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Arrow batches of at most ``BATCH_BYTES`` from now on, unless it sets a size of its own."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(key) == "67108864b":  # Spark's default
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as LONG; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Cut a string array into row ranges of about ``limit`` bytes.

    Yields ``(lo, hi, data, offsets)``: UTF-8 bytes of rows lo..hi and their
    n+1 offsets. Null rows are empty. Whole texts always; a text above the
    limit is a slice of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, obuf, dbuf = texts.buffers()
    offsets = np.frombuffer(obuf, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(dbuf, dtype=np.uint8) if dbuf is not None and dbuf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str, cell: Column) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group`` in ``order``.

    ``cell`` is a coarse, order-preserving key (for instance the leading bits
    of the ordering hash). Sums per (group, cell) are prefixed first, then rows
    within one cell, so a group with a third of all rows is still spread over
    many tasks.
    """
    df = df.withColumn("_cell", cell)
    cells = df.groupBy(*group, "_cell").agg(F.sum(value).alias("_in"))
    before = W.partitionBy(*group).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_cell").alias("_c"), F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_base"))
    inner = W.partitionBy(*group, "_cell").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_run", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    on = [df[g].eqNullSafe(cells[f"_g{i}"]) for i, g in enumerate(group)] + [df["_cell"] == cells["_c"]]
    return df.join(cells, on).withColumn(out, F.col("_run") + F.col("_base")).drop("_cell", "_run", "_base", "_c", *[f"_g{i}" for i in range(len(group))])


def unique_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, part, text) in which (doc_id, part) names one row.

    ``part`` is 0 where ids are unique (checked); else rows of one id are
    numbered by a hash of their text, in a staged table.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).alias("part"), F.col(text_col).alias("text"))
    if not rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        part = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text")))
        rows = stage(rows.withColumn("part", part), "rows")
    return rows


def only_repeated(batches):
    """mapInArrow body: of rows sorted by their first column, those whose key has a neighbour.

    Works over a stream; one row is held back between batches.
    """
    held, before = None, None
    for batch in batches:
        if len(batch) == 0:
            continue
        table = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks()
        key = table.column(0).to_numpy()
        same = key[1:] == key[:-1]
        keep = np.zeros(len(key), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if before is not None:
            keep[0] |= key[0] == before
        if len(key) > 1:
            before = int(key[-2])
        held = table.slice(len(key) - 1).combine_chunks().to_batches()[0]
        yield from table.slice(0, len(key) - 1).filter(pa.array(keep[:-1])).to_batches()
    if held is not None and before is not None and held.column(0)[0].as_py() == before:
        yield held
