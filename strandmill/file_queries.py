"""Registered queries over files, plain functions and alignment scores, and their SQL.

The file queries write a derived table in its format to a shared folder and read it
back, so that the SQL over the same table checks writer and reader together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandmill import queries as base
from strandmill.functions import cigar as C
from strandmill.functions import quality as Q
from strandmill.functions import sequence as S
from strandmill.operators import align, evaluate, index, stats
from strandmill.plans.dna_view import contigs, reads
from strandmill.queries import _C, _QUAL, _R, RECORDS, SAM, SIZES, query
from strandmill.sources import sequences, tables, writers
from strandmill.sources.shared import shared_folder

LINE = 80


def _fasta(spark: SparkSession, sf_dir: str) -> str:
    """The contigs as wrapped FASTA."""
    path = f"{shared_folder(spark)}/contigs.fa"
    writers.write_fasta(contigs(spark, sf_dir).filter("seq != ''"), path, LINE)
    return path


# --- sequence files ---------------------------------------------------------------


@query(f"WITH {_C} SELECT name, CAST(length AS INTEGER) AS length, md5(seq) AS digest FROM c WHERE length > 0")
def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.read_fasta(spark, _fasta(spark, sf_dir)).select("name", F.length("seq").alias("length"), F.md5("seq").alias("digest"))


@query(f"WITH {_C} SELECT name, CAST(length AS BIGINT) AS length, CAST(least(length, {LINE}) AS INTEGER) AS line_bases, CAST(least(length, {LINE}) + 1 AS INTEGER) AS line_bytes FROM c WHERE length > 0")
def fai_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved index of a FASTA file, read back."""
    saved = sequences.write_fai(spark, _fasta(spark, sf_dir))
    return tables.read_tsv(spark, saved, tables.FAI).select("name", "length", "line_bases", "line_bytes")


@query(f"WITH {_C} SELECT name, CAST(length(name) + 2 AS BIGINT) AS header_bytes FROM c WHERE length > 0")
def fai_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies between each record's first base and the end of the record before it: a header line."""
    fai = sequences.build_fai(spark, _fasta(spark, sf_dir))
    end = F.col("file_offset") + F.col("length") + F.ceil(F.col("length") / F.col("line_bases"))
    before = F.coalesce(F.lag(end).over(W.partitionBy("file").orderBy("file_offset")), F.lit(0))
    return fai.select("name", (F.col("file_offset") - before).cast("long").alias("header_bytes"))


@query(f"WITH {_R} SELECT name, seq, {_QUAL} AS qual FROM r")
def fastq_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/reads.fq"
    writers.write_fastq(reads(spark, sf_dir), path)
    return sequences.read_fastq(spark, path).select("name", "seq", "qual")


@query(f"WITH {_R}, g AS (SELECT 'read' || (read_id % 50) AS name, CAST(length(seq) AS BIGINT) AS length, CAST(length(regexp_replace(seq, '[^CG]', '', 'g')) AS BIGINT) AS gc, row_number() OVER (PARTITION BY read_id % 50 ORDER BY read_id) AS k FROM r) SELECT name, length, gc, 100.0::DOUBLE * gc / length AS gc_pct FROM g WHERE k = 1")
def fastq_name_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of reads that share a name the first counts."""
    return stats.per_sequence(reads(spark, sf_dir).withColumn("name", F.concat(F.lit("read"), F.col("read_id") % 50)), "first", "read_id")


# --- alignment files and reports ----------------------------------------------------


@query(f"WITH s AS ({SAM}) SELECT qname, CAST(flag AS INTEGER) AS flag, rname, CAST(pos AS BIGINT) AS pos, CAST(mapq AS INTEGER) AS mapq, cigar, 'ACGT' AS seq, tags FROM s")
def sam_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/x.sam"
    rows = base.sam(spark, sf_dir)
    star = F.lit("*")
    line = F.concat_ws("\t", "qname", F.col("flag").cast("string"), "rname", F.col("pos").cast("string"), F.col("mapq").cast("string"), "cigar", star, F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("IIII"), F.array_join("tags", "\t"))
    head = spark.range(1).select(F.lit("@HD\tVN:1.6").alias("value"))
    head.unionByName(rows.select(line.alias("value"))).write.text(path)
    return tables.read_sam(spark, path).select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", F.array_join("tags", " ").alias("tags"))


@query(f"""WITH m AS ({RECORDS}) SELECT name, chrom, CAST(pos AS VARCHAR) AS pos, cigar, 'ACGT' AS seq, 'IIII' AS qual, alt, CAST(CASE WHEN alt IS NULL THEN 6 ELSE 7 END AS INTEGER) AS n_fields FROM m""")
def mapped_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapper output, written in read order and read back."""
    path = f"{shared_folder(spark)}/mapped.txt"
    rows = base.records(spark, sf_dir)
    known = F.col("chrom") != "*"
    alt = F.split(F.expr("substring(alt, 5)"), ",")
    rows = rows.select(F.col("ordinal").alias("read_id"), "name", *[F.when(known, F.col(c)).alias(c) for c in ("chrom", "pos", "cigar")], F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"), *[alt[i].alias(f"alt_{c}") for i, c in enumerate(("chrom", "pos", "cigar"))])
    writers.write_mapped(rows, path)
    return tables.read_mapper_output(spark, path).drop("line_no")


@query(f"SELECT name, CAST(length AS BIGINT) AS length FROM ({SIZES})")
def tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/sizes.tsv"
    writers.write_report(base.sizes(spark, sf_dir), path)
    return tables.read_tsv(spark, path, tables.SIZES, header=True)


@query(f"WITH {_C}, g AS (SELECT count(*) AS n, sum(length) AS total, min(length) AS least, max(length) AS most FROM c) SELECT unnest(['n_seqs', 'total', 'shortest', 'longest']) AS key, CAST(unnest([n, total, least, most]) AS VARCHAR) AS value FROM g")
def key_values_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/report.txt"
    writers.write_key_values(stats.global_stats(contigs(spark, sf_dir)).select("n_seqs", "total", "shortest", "longest"), path)
    return tables.read_key_values(spark, path).select("key", "value")


_PCT = "printf('%d.%02d', (2 * gc * 10000 + n) // (2 * n) // 100, (2 * gc * 10000 + n) // (2 * n) % 100)"


@query(f"""WITH {_C}, e AS (SELECT name, CAST(length AS BIGINT) AS n, CAST(length(regexp_replace(seq, '[^CG]', '', 'g')) AS BIGINT) AS gc FROM c WHERE length > 0),
t AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, CAST(sum(gc) AS BIGINT) AS gc FROM e)
SELECT 1 AS section, name, unnest(range(0, 5)) AS line_no, unnest(['ID: ' || name, '  > Length: ' || n || ' bp', '  > GC content: ' || {_PCT} || '%', '', repeat('-', 44)]) AS value FROM e
UNION ALL SELECT 0, '', unnest(range(0, 5)), unnest([repeat('=', 44), '       SUMMARY GENOMIC ANALYSIS', repeat('=', 44), 'Number of processed sequences: ' || k, repeat('-', 44)]) FROM t
UNION ALL SELECT 2, '', unnest(range(0, 4)), unnest(['GLOBAL SUMMARY:', '  > Total length: ' || n || ' bp', '  > Total GC content: ' || {_PCT} || '%', repeat('=', 44)]) FROM t""")
def statistics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contigs(spark, sf_dir).filter("seq != ''")
    return writers.statistics_lines(stats.global_stats(rows), stats.per_sequence(rows, ordinal="contig_id"))


_LOG = "SELECT n_name AS file, n_nationkey + 0.25 AS r, n_nationkey * 2 + 0.5 AS u, 0.75 AS s, 1000 + n_nationkey AS kb, n_nationkey % 3 AS dialect FROM nation"


@query(f"SELECT file, CAST(r AS DOUBLE) AS real, CAST(u AS DOUBLE) AS \"user\", CAST(s AS DOUBLE) AS sys, CAST(CASE dialect WHEN 0 THEN kb * 1024 WHEN 1 THEN kb END AS DOUBLE) AS rss FROM ({_LOG})")
def time_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of the GNU, BSD and POSIX dialects."""
    logs = base._derived(spark, sf_dir, _LOG)
    r, u, s, kb = (F.col(c).cast("string") for c in ("r", "u", "s", "kb"))
    gnu = F.array(F.concat(F.lit("Elapsed (wall clock) time (h:mm:ss or m:ss): 0:"), r), F.concat(F.lit("User time (seconds): "), u), F.concat(F.lit("System time (seconds): "), s), F.concat(F.lit("Maximum resident set size (kbytes): "), kb))
    bsd = F.array(F.concat_ws(" ", r, F.lit("real"), u, F.lit("user"), s, F.lit("sys")), F.concat(kb, F.lit("  maximum resident set size")))
    posix = F.array(F.concat(F.lit("real "), r), F.concat(F.lit("user "), u), F.concat(F.lit("sys "), s))
    lines = F.when(F.col("dialect") == 0, gnu).when(F.col("dialect") == 1, bsd).otherwise(posix)
    return tables.parse_time_lines(logs.select("file", F.explode(lines).alias("v")))


@query(f"SELECT file, CAST(floor((r + 1) * 1048576 + 0.5) AS BIGINT) AS peak_rss, 'avx' || kb AS simd, CASE WHEN dialect = 1 THEN 'myers' END AS kernel FROM ({_LOG})")
def stderr_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = base._derived(spark, sf_dir, _LOG)
    lines = F.array(F.lit("reading"), F.concat(F.lit("simd=avx"), "kb"), F.when(F.col("dialect") == 1, F.lit("kernel: myers")), F.concat(F.lit("peak RSS: "), (F.col("r") + 1).cast("string"), F.lit(" MiB")))
    got = tables.parse_stderr(logs.select("file", F.explode(F.filter(lines, lambda v: v.isNotNull())).alias("v")))
    return got.select("file", F.col("peak_rss").cast("long").alias("peak_rss"), "simd", "kernel")


@query(f"SELECT 'cycles' || kb AS event, CAST(kb * 1000 AS DOUBLE) AS \"value\" FROM ({_LOG}) WHERE dialect <> 2")
def perf_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that the machine does not support are left out."""
    logs = base._derived(spark, sf_dir, _LOG)
    count = F.when(F.col("dialect") == 2, F.lit("<not supported>")).otherwise((F.col("kb") * 1000).cast("string"))
    return tables.parse_perf_stat(logs.select(F.concat_ws(";", count, F.lit(""), F.concat(F.lit("cycles"), "kb", F.lit(":u"))).alias("v")))


@query(f"WITH {_C} SELECT count(*) FILTER (length > 0) AS records, CAST(sum(CASE WHEN length > 0 THEN length(name) + 2 + length + ceil(length / {LINE}) ELSE 0 END) AS BIGINT) AS letters FROM c")
def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and letters of the FASTA files, each read as one text."""
    files = sequences.read_whole(spark, _fasta(spark, sf_dir))
    return files.agg(F.sum(F.regexp_count("text", F.lit("(?m)^>"))).alias("records"), F.sum(F.length("text")).cast("long").alias("letters"))


@query(f"WITH {_R} SELECT read_id, name, seq FROM r ORDER BY read_id LIMIT 20")
def first_reads_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 reads, which is the feature."""
    return sequences.first_reads(reads(spark, sf_dir), 20).select("read_id", "name", "seq")


@query("SELECT l_orderkey * 10 + l_linenumber AS line_no, l_shipdate::DATE::VARCHAR AS v FROM lineitem WHERE l_shipdate::DATE::VARCHAR LIKE '1995-0%' OR l_shipdate::DATE::VARCHAR LIKE '2%' ORDER BY line_no LIMIT 12")
def report_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 12 matching lines, which is the feature."""
    lines = base.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("v"))
    return tables.report_head(lines, "^(1995-0|2)", 12)


_LEVELS = "SELECT CAST(n_nationkey AS INTEGER) AS level, (40 - n_nationkey) * 1000 AS index_size_bytes, n_nationkey + 0.5 AS index_time_sec, (90 - 2 * n_nationkey) * 1000 AS map_peak_rss_bytes, n_nationkey + 1.5 AS map_time_sec, 1000 AS mapped_reads FROM nation"


@query(f"""WITH l AS ({_LEVELS}) SELECT level, CAST(index_size_bytes AS BIGINT) AS index_size_bytes, CAST(index_time_sec AS DOUBLE) AS index_time_sec, CAST(map_peak_rss_bytes AS BIGINT) AS map_peak_rss_bytes, CAST(map_time_sec AS DOUBLE) AS map_time_sec, CAST(mapped_reads AS BIGINT) AS mapped_reads,
100.0::DOUBLE * (40000 - index_size_bytes) / 40000 AS index_saved_pct, 100.0::DOUBLE * (90000 - map_peak_rss_bytes) / 90000 AS rss_saved_pct FROM l""")
def level_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep over index levels, written as CSV and read back, with what each level saves."""
    path = f"{shared_folder(spark)}/levels.csv"
    writers.write_report(base._derived(spark, sf_dir, _LEVELS), path, sep=",")
    return evaluate.level_savings(tables.read_tsv(spark, path, tables.LEVELS, header=True, sep=","))


_HEAP = "SELECT o_orderkey AS ordinal, (o_orderkey * 7919) % 10007 AS heap, o_custkey % 50 AS extra, o_orderkey % 13 AS stacks FROM orders"


@query(f"WITH h AS ({_HEAP}) SELECT * FROM h ORDER BY heap + extra + stacks DESC, ordinal LIMIT 1")
def heap_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.peak_snapshot(base._derived(spark, sf_dir, _HEAP))


@query("""SELECT o_orderkey, CASE WHEN b >= 1073741824 THEN printf('%d.%02d GiB', c3 // 100, c3 % 100) WHEN b >= 1048576 THEN printf('%d.%02d MiB', c2 // 100, c2 % 100) WHEN b >= 1024 THEN printf('%d.%02d KiB', c1 // 100, c1 % 100) ELSE b || ' B' END AS size
FROM (SELECT o_orderkey, b, (b * 200 + 1024) // 2048 AS c1, (b * 200 + 1048576) // 2097152 AS c2, (b * 200 + 1073741824) // 2147483648 AS c3 FROM (SELECT o_orderkey, CAST(pow(2, o_orderkey % 33) AS BIGINT) + o_orderkey AS b FROM orders))""")
def binary_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.pow(F.lit(2.0), F.col("o_orderkey") % 33).cast("long") + F.col("o_orderkey")
    return base.table(spark, sf_dir, "orders").select("o_orderkey", Q.iec(n).alias("size"))


@query(f"""WITH {_R}, t AS (SELECT substr(seq, 1, 40) AS a, substr(seq, 41) AS b FROM r), l AS (SELECT a AS s FROM t UNION ALL SELECT b FROM t),
g AS (SELECT substr(s, off + 1, 6) AS kmer, off FROM (SELECT s, unnest(range(0, length(s) - 5)) AS off FROM l WHERE length(s) >= 6))
SELECT kmer, count(*) AS n, CAST(min(off) AS INTEGER) AS first_pos, CAST(max(off) AS INTEGER) AS last_pos FROM g WHERE NOT contains(kmer, 'N') GROUP BY kmer""")
def kmers_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers that do not span the lines of a record."""
    wrapped = F.concat(F.col("seq").substr(1, 40), F.lit("\n"), F.expr("substring(seq, 41)"))
    return stats.kmer_table(reads(spark, sf_dir).select(wrapped.alias("seq")), 6, per_line=True)


# --- saved index --------------------------------------------------------------------


@query(base.ORACLE_SQL["kmer_stride_index"])
def saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-mer index, saved with its metadata and opened again."""
    path = f"{shared_folder(spark)}/index"
    n = spark.sparkContext.defaultParallelism
    placed = index.with_offsets(contigs(spark, sf_dir))
    index.build_index(placed.repartition(2 * n, "contig_id"), path, partitions=n)
    held = index.open_index(spark, path, index.SEED, 4)[1].join(placed.select("contig_id", "start"), "contig_id")
    place = F.col("start") + F.col("pos")
    return held.groupBy("kmer").agg(F.count("*").alias("freq"), F.min(place).alias("first_pos"), F.max(place).alias("last_pos")).filter("freq > 1")


# --- functions ----------------------------------------------------------------------

_NEXT = "CASE WHEN regexp_full_match(acgt, 'T*') THEN '' ELSE regexp_replace(acgt, '[ACG]T*$', '') || translate(regexp_extract(acgt, '([ACG])T*$', 1), 'ACG', 'CGT') || repeat('A', length(regexp_extract(acgt, 'T*$'))) END"
_OPS = "translate(md5(name), '0123456789abcdef', 'MMMMMMMMMMMMIIDD')"


@query(f"""WITH {_R}, a AS (SELECT *, regexp_replace(seq, '[^ACGT]', 'A', 'g') AS acgt, {_OPS} AS ops FROM r)
SELECT read_id, acgt, CAST(strpos('ACGT', substr(seq, 1, 1)) AS INTEGER) - 1 AS first_code, translate(acgt, 'ACGT', '2345') || '0' AS ranks, {_NEXT} AS after,
CAST((SELECT CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END FROM (SELECT list_reduce(list_transform(string_split(seq, ''), lambda ch: CAST(ascii(ch) AS HUGEINT)), lambda acc, b: (xor(acc, b) * {S.FNV_PRIME}::HUGEINT) % 18446744073709551616::HUGEINT, {S.FNV_START}::HUGEINT) AS h)) AS BIGINT) AS checksum,
name AS short, array_to_string(list_transform(regexp_extract_all(ops, 'M+|I+|D+'), lambda g: length(g) || substr(g, 1, 1)), '') AS cigar,
CAST(read_id AS DOUBLE) / 1048576 AS mib FROM a""")
def function_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of a sequence, a header, operations and a number of bytes."""
    acgt = S.normalize("seq", "as_a")
    ops = F.translate(F.md5("name"), "0123456789abcdef", "MMMMMMMMMMMMIIDD")
    header = F.concat("name", F.lit("\tlane 1"))
    return reads(spark, sf_dir).select(
        "read_id", acgt.alias("acgt"), S.base_code(F.substring("seq", 1, 1)).alias("first_code"), S.ranks(acgt).alias("ranks"), S.next_dna(acgt).alias("after"),
        S.checksum("seq").alias("checksum"), S.short_name(header).alias("short"), C.from_ops(ops).alias("cigar"), Q.mebibytes("read_id").alias("mib"),
    )


@query(f"""WITH {_R}, p AS (SELECT a.read_id, a.seq AS x, translate(b.seq, 'N', 'n') AS y FROM r a JOIN r b ON b.read_id = a.read_id + 1)
SELECT read_id, CAST(CASE WHEN length(x) <> length(y) THEN -1 ELSE least(80, hamming(x, y)) END AS INTEGER) AS n FROM p""")
def mismatches_with_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mismatches of neighbouring reads, where an N of the second matches nothing; 80 stands for more."""
    return base._pairs(spark, sf_dir).select("read_id", S.mismatches("x", "y", 79).alias("n"))


@query(f"""WITH {_R}, g AS (SELECT unnest(range(0, length(seq) - 7)) AS off, seq FROM r), k AS (SELECT substr(seq, off + 1, 8) AS kmer, off FROM g)
SELECT kmer, string_agg(CAST(off AS VARCHAR), ',' ORDER BY off) AS positions FROM k WHERE NOT contains(kmer, 'N') GROUP BY kmer""")
def kmer_position_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kmer_positions(reads(spark, sf_dir), 8).select("kmer", F.array_join("positions", ",").alias("positions"))


# --- alignment scores -----------------------------------------------------------------

_LOW = -1000000
_SUB = f"CASE WHEN substr(x, i + 1, 1) = substr(y, CAST(j AS BIGINT), 1) THEN {align.MATCH} WHEN substr(x, i + 1, 1) || substr(y, CAST(j AS BIGINT), 1) IN ('AG', 'GA', 'CT', 'TC') THEN {align.TRANSITION} ELSE {align.TRANSVERSION} END"
_O, _E = align.GAP_OPEN, align.GAP_EXTEND


def _affine_sql(edge: str, corner: str, top: str, side: str, floor: int, score: str) -> str:
    """Affine scores by rows: ``edge`` and ``corner`` start the pair state in row 0, ``top`` the gap along it, ``side`` the first column of later rows (pair, gap)."""
    pair, gap = side.split(";")
    return f"""WITH RECURSIVE {_R}, q AS (SELECT a.read_id, a.seq AS x, b.seq AS y, length(b.seq) AS m FROM r a JOIN r b ON b.read_id = a.read_id + 1),
dp AS (SELECT read_id, x, y, m, 0 AS i, list_transform(range(0, m + 1), lambda j: CAST(CASE WHEN j = 0 THEN {corner} ELSE {edge} END AS BIGINT)) AS p, list_transform(range(0, m + 1), lambda j: CAST({_LOW} AS BIGINT)) AS d, list_transform(range(0, m + 1), lambda j: CAST(CASE WHEN j = 0 THEN {_LOW} ELSE {top} END AS BIGINT)) AS g FROM q
UNION ALL SELECT read_id, x, y, m, i + 1, p, d, list_transform(range(0, m + 1), lambda j: CAST(CASE WHEN j = 0 THEN {_LOW} ELSE list_max(list_transform(p[1:j], lambda v, t: v + {_O} + {_E} * (j - t))) END AS BIGINT)) FROM (
  SELECT read_id, x, y, m, i, list_transform(range(0, m + 1), lambda j: CAST(CASE WHEN j = 0 THEN {pair} ELSE greatest({floor}, greatest(p[j], d[j], g[j]) + {_SUB}) END AS BIGINT)) AS p,
    list_transform(range(0, m + 1), lambda j: CAST(CASE WHEN j = 0 THEN {gap} ELSE greatest(p[j + 1] + {_O}, d[j + 1] + {_E}) END AS BIGINT)) AS d FROM dp WHERE i < length(x)))
SELECT read_id, CAST({score} AS INTEGER) AS score, true AS whole FROM dp GROUP BY read_id"""


def _scores(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Scores of neighbouring reads, and whether the rows without gaps are the reads (of free ends: parts of them)."""
        a = base._pairs(spark, sf_dir).select("read_id", "x", "y", align.align(kind, "x", "y").alias("a"))
        bare = [F.replace(F.col(f"a.aligned_{v}"), F.lit("-"), F.lit("")) for v in "xy"]
        free = {"semiglobal": "x", "local": "xy"}.get(kind, "")
        held = [F.col(v).contains(b) if v in free else F.col(v) == b for v, b in zip("xy", bare, strict=True)]
        return a.select("read_id", F.col("a.score").alias("score"), (held[0] & held[1]).alias("whole"))

    run.__name__ = f"align_{kind}_scores"
    return run


_FIRST = f"{_O} + {_E} * (j - 1)"
query(_affine_sql(str(_LOW), "0", _FIRST, f"{_LOW};{_O} + {_E} * i", 10 * _LOW, "max(greatest(p[m + 1], d[m + 1], g[m + 1])) FILTER (i = length(x))"))(_scores("affine"))
query(_affine_sql(str(_LOW), "0", _FIRST, f"0;{_LOW}", 10 * _LOW, "max(greatest(p[m + 1], d[m + 1], g[m + 1]))"))(_scores("semiglobal"))
query(_affine_sql("0", "0", str(_LOW), f"0;{_LOW}", 0, "max(list_max(p))"))(_scores("local"))
query(f"""WITH RECURSIVE {_R}, q AS (SELECT a.read_id, a.seq AS x, b.seq AS y, length(b.seq) AS m FROM r a JOIN r b ON b.read_id = a.read_id + 1),
dp AS (SELECT read_id, x, y, m, 0 AS i, list_transform(range(0, m + 1), lambda j: CAST(j * {align.GAP} AS BIGINT)) AS d FROM q
UNION ALL SELECT read_id, x, y, m, i + 1, list_transform(range(0, m + 1), lambda j: CAST(list_max(list_transform(e[1:j + 1], lambda v, t: v + {align.GAP} * (j + 1 - t))) AS BIGINT)) FROM (
  SELECT read_id, x, y, m, i, list_transform(range(0, m + 1), lambda j: CAST(CASE WHEN j = 0 THEN (i + 1) * {align.GAP} ELSE greatest(d[j] + {_SUB}, d[j + 1] + {align.GAP}) END AS BIGINT)) AS e FROM dp WHERE i < length(x)))
SELECT read_id, CAST(d[m + 1] AS INTEGER) AS score, true AS whole FROM dp WHERE i = length(x)""")(_scores("weighted"))
