"""FASTA and FASTQ.

FASTA is split at record starts (a line that begins with >) by Spark's own text
reader, so a genome is read by many tasks. FASTQ files are cut into byte ranges; the task of a range finds the
first record start in it, so one large file is read in parallel too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.functions.sequence import short_name

READ = T.StructType([T.StructField("read_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("seq", T.StringType()), T.StructField("qual", T.StringType())])


def read_fasta(spark: SparkSession, path: str, mode: str = "strict", full_header: bool = False) -> DataFrame:
    """Records of FASTA files: file, ordinal, name, seq.

    Names end at the first space or tab unless ``full_header``; carriage returns and
    blank lines are dropped; a header may hold > anywhere but in its first place.
    ``strict`` fails on bases before the first header and on records without bases;
    ``lenient`` skips both.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError(f"mode must be 'strict' or 'lenient', not {mode!r}")
    text = spark.read.option("lineSep", "\n>").text(path)
    raw = text.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^>", "").alias("value"), F.monotonically_increasing_id().alias("ordinal"))
    headless = [f for f in text.inputFiles() if first_letter(spark, f) not in ("", ">")]
    if headless and mode == "strict":
        raise ValueError(f"FASTA: bases before the first header: {headless[0]}")
    if headless:  # what comes before the first header of these files is their first record here
        plain = lambda f: F.regexp_replace(f, "^file:/*", "/")
        first = raw.select("ordinal", plain("file").alias("f")).filter(F.col("f").isin([re.sub("^file:/*", "/", f) for f in headless]))
        raw = raw.join(first.groupBy("f").agg(F.min("ordinal").alias("ordinal")).select("ordinal"), "ordinal", "left_anti").select("file", "value", "ordinal")
    body = F.regexp_replace(F.col("value"), "\r", "")
    header = F.substring_index(body, "\n", 1)
    rest = F.regexp_replace(body.substr(F.length(header) + 1, F.length(body)), "\\s+", "")
    rows = raw.select("file", "ordinal", header.alias("header"), rest.alias("seq"), F.length(F.trim(F.regexp_replace(body, "\\s+", ""))).alias("_n"))
    rows = rows.filter("_n > 0").drop("_n")
    if mode == "strict":
        rows = rows.withColumn("seq", F.when(F.length("seq") == 0, F.raise_error(F.concat(F.lit("FASTA: record without bases: "), "header"))).otherwise(F.col("seq")))
    else:
        rows = rows.filter(F.length("seq") > 0)
    return rows.select("file", "ordinal", (F.col("header") if full_header else short_name("header")).alias("name"), "seq")


def first_letter(spark: SparkSession, file: str) -> str:
    """The first character of a file, packed or not, that is no white space; empty if there is none."""
    jvm = spark.sparkContext._jvm
    path, conf = jvm.org.apache.hadoop.fs.Path(file), spark.sparkContext._jsc.hadoopConfiguration()
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        stream = codec.createInputStream(stream) if codec is not None else stream
        while (c := stream.read()) >= 0:
            if not chr(c).isspace():
                return chr(c)
        return ""
    finally:
        stream.close()


def read_fastq(spark: SparkSession, path: str, mode: str = "strict", split_bytes: int = 64 << 20) -> DataFrame:
    """Reads of FASTQ files: file, read_id (byte offset of the record, so input order), name, seq, qual.

    Files are cut into byte ranges that are read by different tasks; a range owns the
    records that start in it. Four lines each; ``strict`` checks ``@``, ``+``, equal
    lengths and truncation and fails; ``lenient`` drops malformed records and does not
    check the ``+`` line.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError(f"mode must be 'strict' or 'lenient', not {mode!r}")
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    ranges = files.filter("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = max(1, min(10_000, ranges.count()))
    records = ranges.repartition(n).mapInArrow(_fastq_range(split_bytes), "file string, read_id long, h string, seq string, plus string, qual string")
    return _checked(records, mode)


def _fastq_range(split_bytes: int):
    def run(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        names = ["file", "read_id", "h", "seq", "plus", "qual"]
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = pafs.FileSystem.from_uri(_uri(path))
                with fs.open_input_file(name) as f:
                    rows: list[tuple] = []
                    for row in _records(f, start, start + split_bytes):
                        rows.append((path, *row))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                            rows = []
                    if rows:
                        cols = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 1 else pa.string()) for k, c in enumerate(cols)], names)

    return run


def _records(f, start: int, end: int):
    """Records (offset, four lines) that start in [start, end) of an open file; lines of a truncated one are None."""
    at = max(0, start - 1)
    f.seek(at)
    text = _lines(f, at)
    window: list[tuple[int, bytes]] = []
    if start:
        next(text, None)  # the rest of a line that starts before the range
        # a record starts at an @ line whose second next line starts with +; qualities may start with either
        window = [x for x in (next(text, None) for _ in range(8)) if x]
        for i in range(min(4, len(window))):
            if window[i][1].startswith(b"@") and i + 2 < len(window) and window[i + 2][1].startswith(b"+") and (i + 4 >= len(window) or window[i + 4][1].startswith(b"@")):
                window = window[i:]
                break

    def lines():
        yield from window
        yield from text

    four: list[tuple[int, bytes]] = []
    for at, line in lines():
        if not four and at >= end:
            return
        if not four and not line:
            continue
        four.append((at, line))
        if len(four) == 4:
            yield four[0][0], *(x.decode() for _, x in four)
            four = []
    if four:
        yield four[0][0], *(x.decode() for _, x in four), *[None] * (4 - len(four))


def _lines(f, at: int):
    """(offset, line without its end) from the file's position on."""
    held = b""
    while True:
        block = f.read(1 << 22)
        if not block:
            break
        held += block
        *whole, held = held.split(b"\n")
        for line in whole:
            yield at, line.rstrip(b"\r")
            at += len(line) + 1
    if held:
        yield at, held.rstrip(b"\r")


def _checked(records: DataFrame, mode: str) -> DataFrame:
    whole = F.col("qual").isNotNull()
    faults: list[tuple[Column, str]] = [(~whole, "truncated record"), (~F.col("h").startswith("@"), "header without @"), (F.length("seq") != F.length("qual"), "sequence and quality differ in length")]
    if mode == "strict":
        faults.insert(2, (~F.col("plus").startswith("+"), "third line without +"))
        seq = F.col("seq")
        for test, said in reversed(faults):
            seq = F.when(test, F.raise_error(F.concat(F.lit(f"FASTQ: {said}: "), F.coalesce("h", F.lit("?"))))).otherwise(seq)
        records = records.withColumn("seq", seq)
    else:
        for test, _ in faults:
            records = records.filter(~F.coalesce(test, F.lit(False)))
    return records.select("file", "read_id", short_name(F.expr("substring(h, 2)")).alias("name"), "seq", "qual")


def build_fai(spark: SparkSession, path: str) -> DataFrame:
    """The index of FASTA files: file, name, length, file_offset, line_bases, line_bytes. Files are streamed, each by one task."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(_fai, "file string, name string, length long, file_offset long, line_bases int, line_bytes int")


def write_fai(spark: SparkSession, fasta: str, fai: str | None = None) -> str:
    """Build the index of one FASTA file and save it as tab-separated text (a folder), ``<fasta>.fai`` unless named."""
    fai = fai or f"{fasta}.fai"
    build_fai(spark, fasta).drop("file").coalesce(1).write.mode("overwrite").csv(fai, sep="\t")
    return fai


def open_fasta(spark: SparkSession, fasta: str, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Records of a FASTA file and its index: the saved one if there is one, else it is built and saved."""
    from strandmill.sources.tables import FAI, read_tsv

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{fasta}.fai")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        write_fai(spark, fasta)
    return read_fasta(spark, fasta, mode), read_tsv(spark, f"{fasta}.fai", FAI)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, line ends included: file, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def first_reads(reads: DataFrame, n: int) -> DataFrame:
    """The first ``n`` reads in file order (by read_id)."""
    return reads.orderBy("read_id").limit(n)


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path


def _fai(batches):
    import pyarrow as pa
    import pyarrow.fs as pafs

    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = ["file", "name", "length", "file_offset", "line_bases", "line_bytes"]
    for batch in batches:
        for file in batch.column(0).to_pylist():
            fs, path = pafs.FileSystem.from_uri(_uri(file))
            rows, now = [], None
            with fs.open_input_stream(path) as f:
                for at, line, end in _ended_lines(f):
                    if line.startswith(b">"):
                        now = [file, line[1:].replace(b"\t", b" ").split(b" ")[0].decode(), 0, end, 0, 0]
                        rows.append(now)
                    elif now is not None and line:
                        if not now[2]:
                            now[4], now[5] = len(line), end - at
                        now[2] += len(line)
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _ended_lines(f):
    """(offset, line without its end, offset after its end) of a stream."""
    held, at = b"", 0
    while block := f.read(1 << 22):
        *whole, held = (held + block).split(b"\n")
        for line in whole:
            yield at, line.rstrip(b"\r"), at + len(line) + 1
            at += len(line) + 1
    if held:
        yield at, held.rstrip(b"\r"), at + len(held)
