import pytest
from pyspark.sql import functions as F

from strandmill.sources import sequences, tables, writers
from strandmill.streaming import events

FASTA = ">chr1 first\r\nACGT\r\nac\r\n\r\n>chr2\tsecond\nTTTT\nGG\n"


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fa", FASTA)
    got = [(r["name"], r["seq"]) for r in sequences.read_fasta(spark, p).orderBy("ordinal").collect()]
    assert got == [("chr1", "ACGTac"), ("chr2", "TTTTGG")]
    assert sequences.read_fasta(spark, p, full_header=True).orderBy("ordinal").first()["name"] == "chr1 first"
    bad = put(tmp_path, "b.fa", "ACGT\n>x\nAC\n>empty\n")
    assert [r["name"] for r in sequences.read_fasta(spark, bad, "lenient").collect()] in (["x"], ["ACGT", "x"])
    with pytest.raises(Exception, match="without bases"):
        sequences.read_fasta(spark, put(tmp_path, "c.fa", ">x\n>y\nAC\n")).collect()
    with pytest.raises(ValueError):
        sequences.read_fasta(spark, p, "other")


def test_fasta_headers_may_hold_the_mark(spark, tmp_path):
    p = put(tmp_path, "m.fa", ">p1 (2->3)-beta enzyme\nACGT\nAC\n>p2>x y\nTT\n")
    got = sequences.read_fasta(spark, p, full_header=True).orderBy("ordinal").collect()
    assert [(r["name"], r["seq"]) for r in got] == [("p1 (2->3)-beta enzyme", "ACGTAC"), ("p2>x y", "TT")]
    bad = put(tmp_path, "n.fa", "\nACGT\nACG\n>x\nAC\n")
    with pytest.raises(ValueError, match="before the first header"):
        sequences.read_fasta(spark, bad)
    assert [(r["name"], r["seq"]) for r in sequences.read_fasta(spark, bad, "lenient").collect()] == [("x", "AC")]


def test_indexed_open(spark, tmp_path):
    p = put(tmp_path, "i.fa", FASTA)
    records, fai = sequences.open_fasta(spark, p)
    assert (tmp_path / "i.fa.fai").exists() and records.count() == 2
    assert sorted(tuple(r) for r in fai.collect()) == [("chr1", 6, 13, 4, 6), ("chr2", 6, FASTA.index("TTTT"), 4, 5)]
    before = (tmp_path / "i.fa.fai").stat().st_mtime_ns
    assert sequences.open_fasta(spark, p)[1].count() == 2 and (tmp_path / "i.fa.fai").stat().st_mtime_ns == before
    assert sequences.read_whole(spark, p).first()["text"] == FASTA


def test_first_reads(spark, tmp_path):
    p = put(tmp_path, "f.fq", "".join(f"@r{i}\nAC\n+\nII\n" for i in range(30)))
    got = sequences.first_reads(sequences.read_fastq(spark, p, split_bytes=50), 7).collect()
    assert [r["name"] for r in got] == [f"r{i}" for i in range(7)]


def test_fai(spark, tmp_path):
    p = put(tmp_path, "a.fa", FASTA)
    got = [tuple(r)[1:] for r in sequences.build_fai(spark, p).collect()]
    assert got == [("chr1", 6, 13, 4, 6), ("chr2", 6, FASTA.index("TTTT"), 4, 5)]
    sequences.build_fai(spark, p).drop("file").write.csv(str(tmp_path / "fai"), sep="\t")
    assert tables.read_tsv(spark, str(tmp_path / "fai"), tables.FAI).count() == 2


def test_fastq(spark, tmp_path):
    records = [(f"r{i} x", "ACGT" * (1 + i % 5), "@+II" * (1 + i % 5)) for i in range(200)]
    p = put(tmp_path, "a.fq", "\n".join(f"@{n}\n{s}\n+\n{q}" for n, s, q in records))
    for split in (1 << 26, 97, 1000):  # ranges that start anywhere give the same records
        got = sequences.read_fastq(spark, p, split_bytes=split).orderBy("read_id").collect()
        assert [(r["name"], r["seq"], r["qual"]) for r in got] == [(n.split()[0], s, q) for n, s, q in records]
    for text, said in (("@a\nAC\n+\nI\n", "differ"), ("a\nAC\n+\nII\n", "without @"), ("@a\nAC\n-\nII\n", r"without \+"), ("@a\nAC\n", "truncated")):
        bad = put(tmp_path, "bad.fq", text)
        with pytest.raises(Exception, match=said):
            sequences.read_fastq(spark, bad).collect()
    mixed = put(tmp_path, "mixed.fq", "@a\nAC\n+\nI\n@b\nAC\n-\nII\n")
    assert [r["name"] for r in sequences.read_fastq(spark, mixed, "lenient").collect()] == ["b"]


def test_sam_and_output(spark, tmp_path):
    p = put(tmp_path, "a.sam", "@HD\tVN:1\nq1\t0\tchr1\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:0\tXX:Z:a\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    got = tables.read_sam(spark, p).orderBy("qname").collect()
    assert (got[0]["pos"], got[0]["tags"], got[1]["tags"]) == (5, ["NM:i:0", "XX:Z:a"], [])
    p = put(tmp_path, "out.txt", "r1 chr1 5 4M ACGT IIII ALT:chr2,9,4M\nr2 *  0 * AC II\n")
    got = tables.read_mapper_output(spark, p).orderBy("name").collect()
    assert [(r["n_fields"], r["chrom"], r["alt"]) for r in got] == [(7, "chr1", "ALT:chr2,9,4M"), (6, "*", None)]


def test_logs(spark, tmp_path):
    gnu = "\tUser time (seconds): 1.50\n\tSystem time (seconds): 0.25\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02.50\n\tMaximum resident set size (kbytes): 2000\n"
    bsd = "        3.10 real         2.00 user         0.50 sys\n             4096  maximum resident set size\n"
    posix = "real 7.5\nuser 6.5\nsys 0.5\n"
    rows = [(n, line.strip()) for n, t in (("gnu", gnu), ("bsd", bsd), ("posix", posix)) for line in t.splitlines()]
    got = {r["file"]: tuple(r)[1:] for r in tables.parse_time_lines(spark.createDataFrame(rows, "file string, v string").coalesce(1)).collect()}
    assert got == {"gnu": (62.5, 1.5, 0.25, 2048000.0), "bsd": (3.1, 2.0, 0.5, 4096.0), "posix": (7.5, 6.5, 0.5, None)}
    log = spark.createDataFrame([("a", "peak RSS: 1.5 MiB"), ("a", "simd=avx2"), ("a", "peak RSS: 2 MiB"), ("a", "kernel: myers")], "file string, v string").coalesce(1)
    assert tuple(tables.parse_stderr(log).first()) == ("a", 2097152, "avx2", "myers")
    perf = spark.createDataFrame([("1,234;;cycles:u;1",), ("<not supported>;;x;1",)], "v string")
    assert [tuple(r) for r in tables.parse_perf_stat(perf).collect()] == [("cycles", 1234.0)]
    kv = put(tmp_path, "m.txt", "real=1.5\nname=a=b\n")
    assert {r["key"]: r["value"] for r in tables.read_key_values(spark, kv).collect()} == {"real": "1.5", "name": "a=b"}
    heap = spark.createDataFrame([(0, 5, 1, 1), (1, 9, 0, 1), (2, 8, 1, 1)], "ordinal int, heap int, extra int, stacks int")
    assert tables.peak_snapshot(heap).first()["ordinal"] == 1
    lines = spark.createDataFrame([(i, f"{i}% f") for i in range(9)], "line_no int, v string")
    assert [r["line_no"] for r in tables.report_head(lines, "[2-9]%", 2).collect()] == [2, 3]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "r1", "chr1", 5, "4M", "ACGT", "IIII", "chr2", 9, "4M"), (0, "r0", None, None, None, "AC", "II", None, None, None)], "read_id long, name string, chrom string, pos long, cigar string, seq string, qual string, alt_chrom string, alt_pos long, alt_cigar string")
    writers.write_mapped(df, str(tmp_path / "o"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "o")).collect()] == ["r0 * 0 * AC II", "r1 chr1 5 4M ACGT IIII ALT:chr2,9,4M"]
    writers.write_fastq(df, str(tmp_path / "q"))
    assert sequences.read_fastq(spark, str(tmp_path / "q")).count() == 2
    writers.write_fasta(df, str(tmp_path / "f"), 3)
    assert {r["seq"] for r in sequences.read_fasta(spark, str(tmp_path / "f")).collect()} == {"ACGT", "AC"}
    writers.write_key_values(df.filter("read_id = 1").select("name", "pos"), str(tmp_path / "k"))
    assert {r[0] for r in spark.read.text(str(tmp_path / "k")).collect()} == {"name=r1", "pos=5"}
    writers.write_report(df.select("name"), str(tmp_path / "r"))
    assert df.select(writers.percent(F.lit(1), F.lit(3))).first()[0] == "33.33"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a.fq", "@a x\nAC\n+\nII\n@b\nGG\n+\nII\n")
    q = events.stream_fastq(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("fq").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["name"], r["seq"]) for r in spark.sql("select * from fq").collect()} == {("a", "AC"), ("b", "GG")}
    rows = [(1, 0), (1, 60), (1, 5000), (2, 10), (9, 50000)]
    data = spark.createDataFrame([(i, u, t, 1.0) for i, (u, t) in enumerate(rows)], "event_id long, user_id long, t long, value double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    got = sorted((r["user_id"], r["n_events"]) for r in events.sessions(data).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (9, 1)]
    data.write.parquet(str(tmp_path / "ev"))
    s = events.stream_sessions(spark.readStream.schema(data.schema).parquet(str(tmp_path / "ev")))
    q = s.writeStream.format("memory").outputMode("append").queryName("ses").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["user_id"], r["n_events"]) for r in spark.sql("select * from ses").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_statistics_report(spark, tmp_path):
    from strandmill.operators import stats

    df = spark.createDataFrame([("b", 0, "ACGG"), ("a", 1, "TTTTTC")], "name string, ordinal int, seq string")
    lines = lambda **how: [r["value"] for r in writers.statistics_lines(stats.global_stats(df), **how).orderBy("section", "name", "line_no").collect()]
    rule, dashes = "=" * 44, "-" * 44
    head = [rule, "       SUMMARY GENOMIC ANALYSIS", rule, "Number of processed sequences: 2"]
    one = lambda n, size, gc: [f"ID: {n}", f"  > Length: {size} bp", f"  > GC content: {gc}%", ""]
    foot = ["GLOBAL SUMMARY:", "  > Total length: 10 bp", "  > Total GC content: 40.00%"]
    assert lines() == [*head, *foot, rule]
    assert lines(each=stats.per_sequence(df)) == [*head, dashes, *one("a", 6, "16.67"), dashes, *one("b", 4, "75.00"), dashes, *foot, rule]
    lengths = ["  > Minimum read: 4 bp", "  > Maximum read: 6 bp", "  > Avg length read: 5 bp"]
    assert lines(each=stats.per_sequence(df, "first"), reads=True) == [*head, dashes, *one("a", 6, "16.67"), *one("b", 4, "75.00"), dashes, *foot, *lengths, rule]
    assert lines(reads=True) == [*head, dashes, *foot, *lengths, rule]
    writers.write_statistics(stats.global_stats(df), str(tmp_path / "s"), stats.per_sequence(df))
    assert spark.read.text(str(tmp_path / "s")).count() == 19


def test_staged_tables(spark):
    from strandmill.sources.shared import shared_folder, stage

    one, two = shared_folder(spark), shared_folder(spark)
    assert one != two
    rows = spark.createDataFrame([(1, None), (2, ["a"])], "a INT, b ARRAY<STRING>")
    staged = stage(rows, "rows")
    assert staged.schema == rows.schema and sorted(staged.collect()) == sorted(rows.collect())
    assert stage(rows.limit(0), "none").collect() == []


def test_shared_folder_needs_a_store_on_a_cluster():
    import types

    from strandmill.sources.shared import shared_folder

    conf = types.SimpleNamespace(get=lambda key, default: default)
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        context = types.SimpleNamespace(getCheckpointDir=lambda: None, master=master, applicationId="x")
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(types.SimpleNamespace(conf=conf, sparkContext=context))
