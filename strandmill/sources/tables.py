"""SAM, mapper output, TSV side tables, and logs of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAI = "name STRING, length LONG, file_offset LONG, line_bases INT, line_bytes INT"
SIZES = "name STRING, length LONG"
COMPARISON = "name STRING, chrom STRING, pos LONG, cigar STRING"
RUNS = "case_id STRING, index_kind STRING, simd_label STRING, simd_request STRING, effective_simd STRING, verifier_kernel STRING, real DOUBLE, user DOUBLE, sys DOUBLE, peak_rss_bytes LONG, mapped LONG, unmapped LONG, with_alt LONG, dir STRING"
LEVELS = "level INT, index_size_bytes LONG, index_time_sec DOUBLE, map_peak_rss_bytes LONG, map_time_sec DOUBLE, mapped_reads LONG"


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False, sep: str = "\t") -> DataFrame:
    """A table of fixed schema; lines that do not fit it are dropped."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, mode="DROPMALFORMED")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines of SAM files; header lines are skipped and tags start at field 12."""
    part = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.size(part) >= 11)).select(part.alias("f"))
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    kinds = {"flag": "int", "pos": "long", "mapq": "int", "pnext": "long", "tlen": "long"}
    return rows.select(*[F.try_element_at("f", F.lit(i + 1)).try_cast(kinds.get(n, "string")).alias(n) for i, n in enumerate(names)], F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))).alias("tags"))


def read_mapper_output(spark: SparkSession, path: str) -> DataFrame:
    """Lines of mapper output, with the raw field count; markers become nulls."""
    return parse_mapper_lines(spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value"))


def parse_mapper_lines(lines: DataFrame) -> DataFrame:
    """(line_no, value) to line_no, n_fields, name, chrom, pos, cigar, seq, qual, alt; raw strings."""
    f = F.split(F.trim("value"), "[ \t]+")
    rows = lines.select("line_no", f.alias("f"))
    return rows.select("line_no", F.size("f").alias("n_fields"), *[F.try_element_at("f", F.lit(i + 1)).alias(n) for i, n in enumerate(("name", "chrom", "pos", "cigar", "seq", "qual", "alt"))])


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """``k=v`` lines: file, key, value."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.filter(F.col("value").contains("=")).select("file", F.substring_index("value", "=", 1).alias("key"), F.expr("substring(value, instr(value, '=') + 1)").alias("value"))


def read_time_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logs of ``time`` in its GNU, BSD and POSIX dialects: file, real, user, sys (s), rss (bytes)."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("v"))
    return parse_time_lines(rows)


def parse_time_lines(rows: DataFrame) -> DataFrame:
    """(file, v) lines of ``time`` logs to one row for each file; the last match of a field wins."""
    v, num = F.col("v"), "([0-9.]+)"

    def grab(pattern: str) -> F.Column:
        got = F.regexp_extract(v, pattern, 1)
        return F.when(got != "", got.try_cast("double"))

    clock = F.regexp_extract(v, r"Elapsed \(wall clock\).*?: ([0-9:.]+)$", 1)
    parts = F.reverse(F.split(clock, ":"))
    elapsed = F.when(clock != "", F.coalesce(F.try_element_at(parts, F.lit(1)).try_cast("double"), F.lit(0.0)) + 60 * F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.lit(0.0)) + 3600 * F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("double"), F.lit(0.0)))
    fields = {
        "real": F.coalesce(elapsed, grab(rf"^{num} real"), grab(rf"^real\s+{num}")),
        "user": F.coalesce(grab(rf"^User time \(seconds\): {num}"), grab(rf"{num} user"), grab(rf"^user\s+{num}")),
        "sys": F.coalesce(grab(rf"^System time \(seconds\): {num}"), grab(rf"{num} sys"), grab(rf"^sys\s+{num}")),
        "rss": F.coalesce(grab(rf"^Maximum resident set size \(kbytes\): {num}") * 1024, grab(rf"^{num}\s+maximum resident set size")),
    }
    numbered = rows.withColumn("n", F.monotonically_increasing_id())
    return numbered.select("file", "n", *[c.alias(k) for k, c in fields.items()]).groupBy("file").agg(*[F.max_by(k, F.when(F.col(k).isNotNull(), F.col("n"))).alias(k) for k in fields])


def parse_stderr(rows: DataFrame) -> DataFrame:
    """(file, v) lines of mapper logs: peak RSS in bytes from MiB, SIMD level and kernel; the last match wins."""
    numbered = rows.withColumn("n", F.monotonically_increasing_id())
    mib = F.regexp_extract("v", r"(?i)peak[ _]?rss[^0-9]*([0-9.]+) ?MiB", 1)
    fields = {"peak_rss": F.when(mib != "", F.floor(mib.try_cast("double") * 1048576 + 0.5)), **{k: F.when(F.regexp_extract("v", p, 1) != "", F.regexp_extract("v", p, 1)) for k, p in (("simd", r"(?i)simd[=: ]+([A-Za-z0-9_-]+)"), ("kernel", r"(?i)kernel[=: ]+([A-Za-z0-9_-]+)"))}}
    return numbered.select("file", "n", *[c.alias(k) for k, c in fields.items()]).groupBy("file").agg(*[F.max_by(k, F.when(F.col(k).isNotNull(), F.col("n"))).alias(k) for k in fields])


def parse_perf_stat(rows: DataFrame) -> DataFrame:
    """(v) lines of ``perf stat -x;``: event (without suffix), value; unsupported counters are dropped."""
    f = F.split("v", ";")
    out = rows.filter(F.size(f) >= 3).select(F.regexp_replace(f[2], ":[a-z]+$", "").alias("event"), F.regexp_replace(f[0], ",", "").try_cast("double").alias("value"))
    return out.filter(F.col("value").isNotNull())


def report_head(rows: DataFrame, pattern: str, n: int) -> DataFrame:
    """The first ``n`` matching lines of a report (line_no, v), by line number."""
    return rows.filter(F.col("v").rlike(pattern)).orderBy("line_no").limit(n)


def peak_snapshot(snapshots: DataFrame) -> DataFrame:
    """The heap snapshot (ordinal, heap, extra, stacks) of largest total; the first of equals."""
    total = F.col("heap") + F.col("extra") + F.col("stacks")
    return snapshots.agg(F.max_by(F.struct(*snapshots.columns), F.struct(total, -F.col("ordinal"))).alias("s")).select("s.*")
