import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandmill.operators import align, evaluate, index, search, stats, suffix
from strandmill.operators.prefix import running_sum


def genome(seed, n, letters="ACGT"):
    r = random.Random(seed)
    return "".join(r.choice(letters) for _ in range(n))


def contigs(spark, *seqs):
    return spark.createDataFrame([(i, f"c{i}", s) for i, s in enumerate(seqs)], "contig_id long, name string, seq string")


# --- stats and index -------------------------------------------------------------


def test_stats(spark):
    df = spark.createDataFrame([("a", 0, "GGAT"), ("b", 1, "AT"), ("a", 2, "C")], "name string, ordinal int, seq string")
    last = {r["name"]: r["length"] for r in stats.per_sequence(df).collect()}
    first = {r["name"]: r["length"] for r in stats.per_sequence(df, "first").collect()}
    assert last == {"a": 1, "b": 2} and first == {"a": 4, "b": 2}
    g = stats.global_stats(df).first()
    assert (g["n_seqs"], g["total"], g["shortest"], g["longest"], g["mean"], g["gc"]) == (3, 7, 1, 4, 2, 3)
    assert stats.global_stats(df.limit(0)).first()["total"] == 0
    k = {r["kmer"]: r["n"] for r in stats.kmer_table(spark.createDataFrame([("ACGA\nACG",)], "seq string"), 3, per_line=True).collect()}
    assert k == {"ACG": 2, "CGA": 1}
    assert stats.kmer_positions(spark.createDataFrame([("AAAA",)], "seq string"), 3).first()["positions"] == [0, 1]


def test_offsets_and_locate(spark):
    seqs = [genome(i, n) for i, n in enumerate((5, 0, 700, 3, 40000))]
    placed = index.with_offsets(contigs(spark, *seqs))
    want = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    assert [r["start"] for r in placed.orderBy("contig_id").collect()] == want[:-1].tolist()
    pos = spark.range(0, int(want[-1]), 37).withColumnRenamed("id", "gpos")
    for r in index.locate(pos, placed).collect():
        c = int(np.searchsorted(want, r["gpos"], side="right")) - 1
        assert (r["contig_id"], r["local"]) == (c, r["gpos"] - want[c])
    many = spark.range(20000).select((F.col("id") * 3).alias("k"))
    got = running_sum(many, "k", F.lit(2), "s").filter("s != 2 * (k / 3)").count()
    assert got == 0


def test_kmer_index(spark):
    seqs = [genome(1, 2000, "ACGTN"), genome(2, 515), genome(3, 9)]
    placed = index.with_offsets(contigs(spark, *seqs))
    for stride in (1, 4):
        got = sorted((r["kmer"], r["contig_id"], r["pos"]) for r in index.kmer_index(index.chunks(placed), 8, stride).collect())
        start, want = 0, []
        for c, s in enumerate(seqs):
            want += [(s[i : i + 8], c, i) for i in range(len(s) - 7) if (start + i) % stride == 0 and "N" not in s[i : i + 8]]
            start += len(s)
        assert got == sorted(want)


def test_fetch(spark):
    s = genome(4, 1500)
    ch = index.chunks(contigs(spark, s))
    want = spark.createDataFrame([(0, i, 100) for i in (0, 500, 511, 512, 1450, 1499)], "contig_id long, start long, size int")
    for r in index.fetch(want, ch, "start", "size").collect():
        assert r["window"] == s[r["start"] : r["start"] + 100]


# --- search ------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "pattern", "want"), [("GATTACAGATTACA", "GATTACA", [0, 7]), ("AAAAA", "AAA", [0, 1, 2]), ("ACGTACGTACGT", "TAC", [3, 7]), ("ACGT", "ACGTA", []), ("ACGT", "", [])])
def test_exact_examples(spark, text, pattern, want):
    hit = search.occurrences(index.chunks(contigs(spark, text)), spark.createDataFrame([(pattern,)], "pattern string"), anchor=3)
    assert sorted(r["pos"] for r in hit.collect()) == want


def test_search_random(spark):
    s = genome(5, 3000, "ACG")
    pats = [s[i : i + n] for i, n in ((0, 6), (505, 20), (2990, 10), (1000, 4))] + ["ACGACG", "TTTT"]
    ch = index.chunks(contigs(spark, s))
    pf = spark.createDataFrame([(p,) for p in set(pats)], "pattern string")
    got = sorted((r["pattern"], r["pos"]) for r in search.occurrences(ch, pf).collect())
    assert got == sorted((p, i) for p in set(pats) for i in range(len(s) - len(p) + 1) if s[i : i + len(p)] == p)
    ham = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    got = sorted((r["pattern"], r["pos"], r["mismatches"]) for r in search.mismatch_occurrences(ch, pf.filter("length(pattern) >= 6"), 2).collect())
    assert got == sorted((p, i, ham(s[i : i + len(p)], p)) for p in set(pats) if len(p) >= 6 for i in range(len(s) - len(p) + 1) if ham(s[i : i + len(p)], p) <= 2)


# --- alignment ----------------------------------------------------------------------

DNA = st.text("ACGT", min_size=0, max_size=14)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def replay(cigar, read, ref):
    """Edits that a CIGAR stands for."""
    import re

    i = j = cost = 0
    for n, op in re.findall("([0-9]+)([MID])", cigar):
        for _ in range(int(n)):
            cost += op != "M" or read[i] != ref[j]
            i += op != "D"
            j += op != "I"
    assert (i, j) == (len(read), len(ref))
    return cost


@settings(max_examples=150, deadline=None)
@given(DNA, DNA, st.integers(0, 3))
def test_banded(a, b, k):
    got = align.banded(a, b, k)
    if edits(a, b) <= k:
        assert got[0] == edits(a, b)
        if a or b:
            assert replay(got[1], a, b) == got[0]
    else:
        assert got is None or got[0] > k


def test_banded_ties():
    assert align.banded("ACGT", "ACGT", 1) == (0, "4M")
    assert align.banded("AAC", "AC", 1) == (1, "1I2M")
    assert align.banded("AC", "AAC", 1) == (1, "1D2M")


def gap_cost(ax, ay, open_=align.GAP_OPEN, extend=align.GAP_EXTEND):
    score, state = 0, ""
    for p, q in zip(ax, ay, strict=True):
        now = "x" if p == "-" else "y" if q == "-" else ""
        score += align.substitution(p, q) if not now else (extend if now == state else open_)
        state = now
    return score


def best_affine(x, y, mode):
    """Reference by memoised recursion over (i, j, state)."""
    from functools import lru_cache

    low = -(10**6)

    @lru_cache(None)
    def f(i, j, s):
        if s == 0:
            if i and j:
                v = max(f(i - 1, j - 1, t) for t in range(3)) + align.substitution(x[i - 1], y[j - 1])
                return max(v, 0) if mode == "local" else v
            if mode == "local" or (i, j) == (0, 0) or (mode == "semiglobal" and j == 0):
                return 0
            return low
        if s == 1:
            if i == 0 or (mode != "global" and j == 0):
                return low
            if j == 0:
                return align.GAP_OPEN + (i - 1) * align.GAP_EXTEND
            return max(f(i - 1, j, 0) + align.GAP_OPEN, f(i - 1, j, 1) + align.GAP_EXTEND)
        if j == 0 or (mode == "local" and i == 0):
            return low
        if i == 0:
            return align.GAP_OPEN + (j - 1) * align.GAP_EXTEND
        return max(f(i, j - 1, 0) + align.GAP_OPEN, f(i, j - 1, 2) + align.GAP_EXTEND)

    n, m = len(x), len(y)
    if mode == "global":
        return max(f(n, m, s) for s in range(3))
    if mode == "semiglobal":
        return max(f(i, m, s) for i in range(n + 1) for s in range(3))
    return max(f(i, j, 0) for i in range(n + 1) for j in range(m + 1))


@settings(max_examples=80, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=9), st.text("ACGT", min_size=1, max_size=9), st.sampled_from(["global", "semiglobal", "local"]))
def test_affine(x, y, mode):
    score, ax, ay = align.affine(x, y, mode)
    assert score == best_affine(x, y, mode)
    assert ax.replace("-", "") in x and ay.replace("-", "") in y
    if mode == "global":
        assert (ax.replace("-", ""), ay.replace("-", "")) == (x, y)
    assert gap_cost(ax, ay) == score


@settings(max_examples=100, deadline=None)
@given(DNA, DNA)
def test_linear_space(x, y):
    cost, ax, ay = align.linear_space(x, y)
    assert cost == edits(x, y) == align.linear(x, y)[0]
    assert (ax.replace("-", ""), ay.replace("-", "")) == (x, y)
    assert align.edit_row(x, y)[-1] == cost


def test_align_columns(spark):
    df = spark.createDataFrame([("ACTATTTACGTACT", "ACGTACGTACGAATACGT"), ("ACTT", "AGTGT"), (None, "A")], "x string, y string")
    for kind in ("edit", "weighted", "affine", "semiglobal", "local", "hirschberg"):
        rows = df.select(align.align(kind, "x", "y").alias("a")).select("a.*").collect()
        assert rows[0]["score"] is not None and rows[2]["score"] is None
    got = df.filter("x is not null").select(align.align("edit", "x", "y")["score"].alias("s"), F.levenshtein("x", "y").alias("l")).collect()
    assert all(r["s"] == r["l"] for r in got)


def test_quality_covers_whole_texts(spark, tmp_path):
    import hashlib

    from strandmill.plans.dna_view import quality
    from strandmill.queries import QUERIES

    data = [(i, "ab " * n) for i, n in enumerate((0, 1, 40, 200, 3000))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert df.filter(F.length(quality(F.col("doc_id").cast("string"), F.col("text"))) != F.length("text")).count() == 0
    df.write.parquet(f"{tmp_path}/documents.parquet")
    letters = str.maketrans("0123456789abcdef", "!$'*-0369<?BEHI#")
    keep = []
    for i, t in data:
        q = (hashlib.md5(str(i).encode()).hexdigest().translate(letters) * 1000)[: len(t)]
        keep.append(max((k + 1 for k, x in enumerate(q) if ord(x) - 33 >= 18), default=0))
    bases = sum(len(t) for _, t in data)
    assert tuple(QUERIES["quality_trim"](spark, str(tmp_path)).first()) == (5, bases, sum(keep), min(keep), max(keep), sum(keep) // 5)


# --- suffix structures ------------------------------------------------------------------


def test_suffix_array(spark):
    seqs = ["ACGTACGTACGTACGT", "", "A", genome(6, 300), "AAAAAAAA"]
    got = {}
    for r in suffix.suffix_array(contigs(spark, *seqs)).collect():
        got.setdefault(r["contig_id"], []).append((r["row"], r["pos"], r["ch"]))
    for c, s in enumerate(seqs):
        t = s + "$"
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert [(p, ch) for _, p, ch in sorted(got[c])] == [(p, t[p - 1]) for p in want]


def test_suffix_queries_over_whole_texts(spark, tmp_path):
    from strandmill.queries import QUERIES

    seqs = [genome(8, 700), genome(9, 90) * 4, "", "ACGTACGTACGTACGTN", "A" * 300]
    letters = str.maketrans("ACGTN", "abcd.")
    spark.createDataFrame([(i, s.translate(letters).replace("c", "g" if i % 2 else "c")) for i, s in enumerate(seqs)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from strandmill.plans.dna_view import contigs as texts

    names = {"suffix_array": "suffix_array_small", "bwt": "bwt_small"}
    got = {q: [tuple(r) for r in QUERIES[names.get(q, q)](spark, str(tmp_path)).collect()] for q in ("suffix_array", "bwt", "fm_counts", "occ_checkpoints", "sa_samples")}
    want = {q: [] for q in got}
    for c, _, s in texts(spark, str(tmp_path)).collect():
        t = s + "$"
        sa = sorted(range(len(t)), key=lambda i: t[i:])
        bwt = "".join(t[p - 1] for p in sa)
        want["suffix_array"] += [(c, r, p) for r, p in enumerate(sa)]
        want["bwt"].append((c, bwt))
        want["fm_counts"] += [(c, x, bwt.count(x), sum(y < x for y in bwt)) for x in sorted(set(bwt))]
        want["occ_checkpoints"] += [(c, r, *[bwt[:r].count(x) for x in "ACGT"]) for r in range(0, len(t), 32)]
        want["sa_samples"] += [(c, r, sa[r]) for r in range(0, len(t), 32)]
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items()}


@pytest.mark.parametrize("every", [1, 3, 4, 5, 8, 16, 32, 256])
def test_occ_and_locate(every):
    for n in (1, 2, 17, 64, 129):
        s = genome(n, n)
        fm = suffix.FMIndex(s, every)
        bwt = "".join(map(chr, fm.bwt))
        for c in "ACGT":
            for row in range(0, fm.n + 1, 7):
                assert fm.occ(c, row) == bwt[:row].count(c)
        assert [fm.locate(r) for r in range(fm.n)] == fm.sa.tolist()


def test_fm_search():
    s = "ACGTACGTGACG"
    fm = suffix.FMIndex(s)
    for p in ("ACG", "CGT", "TGA", "GATTACA", "ACGTG", "GAC", "TTT", ""):
        lo, hi = fm.interval(p)
        assert sorted(fm.locate(r) for r in range(lo, hi)) == [i for i in range(len(s)) if p and s.startswith(p, i)]
    hits = {(fm.locate(r), e) for lo, hi, e in fm.within("ACGA", 1, 100) for r in range(lo, hi)}
    assert (0, 1) in hits and all(e <= 1 for _, e in hits)


# --- evaluation ---------------------------------------------------------------------


def test_agreement(spark):
    cols = "name string, chrom string, pos long, cigar string, ordinal int"
    m = spark.createDataFrame([("a", "1", 10, "4M", 0), ("a", "1", 12, "4M", 1), ("b", "2", 5, "4M", 2), ("c", "*", 0, "*", 3), ("d", "1", 7, "4M", 4)], cols)
    b = spark.createDataFrame([("a", "1", 10, "4M", 0), ("b", "1", 5, "4M", 1), ("c", "1", 9, "4M", 2), ("d", "*", 0, "*", 3), ("e", "*", 0, "*", 4)], cols).drop("ordinal")
    r = evaluate.agreement(m, b).first().asDict()
    assert r == {"subset_reads": 5, "mapper_mapped": 3, "baseline_mapped": 3, "shared_mapped": 2, "chrom_match": 1, "within_10bp": 1, "within_50bp": 1, "exact_pos": 0, "exact_cigar": 1, "exact_primary": 0, "mapper_only": 1, "baseline_only": 1}


def test_baseline_rows(spark):
    sam = spark.createDataFrame([("a", 0, "1", 5, "4M", ["NM:i:1"]), ("b", 256, "1", 5, "4M", ["NM:i:0"]), ("c", 4, "1", 5, "4M", ["NM:i:0"]), ("d", 0, "1", 5, "1S3M", ["NM:i:0"]), ("e", 0, "1", 5, "4M", []), ("f", 16, "1", 5, "4M", ["NM:i:3"])], "qname string, flag int, rname string, pos long, cigar string, tags array<string>")
    got = {r["name"]: r["chrom"] for r in evaluate.baseline_rows(sam, 1).collect()}
    assert got == {"a": "1", "c": "*", "d": "*", "e": "*", "f": "*"}
    assert tuple(evaluate.baseline_stats(sam, 1).first()) == (1, 4, 1)


def test_violations(spark):
    sizes = spark.createDataFrame([("1", 100)], "name string, length long")
    lines = ["ok 1 5 4M ACGT IIII", "ok2 * 0 * AC II", "ok3 1 97 4M ACGT IIII ALT:1,1,4M", "few 1 5", "qual 1 5 4M ACGT III", "un * 3 * AC II", "chrom 9 5 4M ACGT IIII", "low 1 0 4M ACGT IIII", "cig 1 5 2S2M ACGT IIII", "len 1 5 3M ACGT IIII", "end 1 98 4M ACGT IIII", "alt 1 5 4M ACGT IIII ALT:1,x", "altc 1 5 4M ACGT IIII ALT:7,1,4M", "altl 1 5 4M ACGT IIII ALT:1,1,3M", "alte 1 5 4M ACGT IIII ALT:1,98,4M"]
    from strandmill.sources.tables import parse_mapper_lines

    rows = parse_mapper_lines(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"))
    got = {r["name"]: r["rule"] for r in evaluate.violations(rows, sizes).collect()}
    assert got.pop("few") == "field count"
    assert got == {"qual": "sequence and quality lengths", "un": "unmapped coordinates", "chrom": "unknown contig", "low": "position out of bounds", "cig": "primary cigar", "len": "primary cigar length", "end": "primary crosses the end", "alt": "alt syntax", "altc": "unknown alt contig", "altl": "alt cigar length", "alte": "alt crosses the end"}
    assert tuple(evaluate.mapped_stats(rows.filter("name like 'ok%'")).first()) == (3, 2, 1, 1)


def test_loci_and_runs(spark):
    sam = spark.createDataFrame([(i, f"q{i}", 0, "1" if i < 4 else "un_1", p, 60) for i, p in enumerate((100, 120, 6000, 9990, 5))], "ordinal int, qname string, flag int, rname string, pos long, mapq int")
    sizes = spark.createDataFrame([("1", 10000)], "name string, length long")
    got = [(r["qname"], r["start"], r["end"]) for r in evaluate.select_loci(sam, 10, 5000, sizes=sizes).orderBy("start").collect()]
    assert got == [("q0", 1, 450), ("q2", 5750, 6350)]
    runs = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", 1.0)], "case_id string, real double")
    got = {r["case_id"]: (r["best"], r["mean"], r["speed_up"]) for r in evaluate.timing_summary(runs, 10).collect()}
    assert got == {"a": (2.0, 3.0, 1.0), "b": (1.0, 1.0, 3.0)}
    lv = spark.createDataFrame([(0, 100, 50), (5, 25, 40)], "level int, index_size_bytes long, map_peak_rss_bytes long")
    assert evaluate.level_savings(lv).filter("level = 5").first()["index_saved_pct"] == 75.0
    pair = spark.createDataFrame([("a", "r", "1", 5, "4M"), ("b", "r", "1", 7, "4M"), ("a", "s", "*", 0, "*"), ("b", "s", "1", 1, "4M")], "case_id string, name string, chrom string, pos long, cigar string")
    r = evaluate.run_pairs(pair).first()
    assert (r["reads"], r["shared_mapped"], r["within_10bp"], r["exact_pos"], r["b_only"]) == (2, 1, 1, 0, 1)


# --- any length ---------------------------------------------------------------------


def test_windows_over_several_chunks(spark):
    seq = genome(31, 3000)
    ch = index.chunks(contigs(spark, seq))
    asked = [(0, s, n) for s, n in ((0, 10), (500, 600), (511, 1200), (100, 256), (100, 257), (2900, 600), (2999, 1), (500, 600))]
    got = index.fetch(spark.createDataFrame(asked, "contig_id long, start long, size long"), ch, "start", "size").collect()
    assert sorted((r["start"], r["size"], r["window"]) for r in got) == sorted((s, n, seq[s : s + n]) for _, s, n in asked)


def test_patterns_of_any_length(spark):
    seq = genome(32, 2500) + "ACG" * 400
    ch = index.chunks(contigs(spark, seq))
    for group in (["A", "ACG", seq[700:1000], seq[100:1400], "ACG" * 120, "GG"], [seq[300:900]], [""], ["T" * 700]):
        pats = spark.createDataFrame([(p,) for p in group], "pattern string")
        got = sorted((r["pattern"], r["pos"]) for r in search.occurrences(ch, pats).collect())
        assert got == sorted((p, i) for p in set(group) if p for i in range(len(seq)) if seq.startswith(p, i))


def test_mismatches_of_any_length(spark):
    seq = genome(33, 2200)
    change = lambda p, *at: "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] if i in at else c for i, c in enumerate(p))
    pats = [change(seq[300:900], 5, 400), change(seq[1000:1300], 299), seq[10:19], change(seq[50:1250], 0, 1199), *[seq[i : i + 12 + i] for i in range(0, 60, 7)]]
    ch = index.chunks(contigs(spark, seq))
    got = sorted((r["pattern"], r["pos"], r["mismatches"]) for r in search.mismatch_occurrences(ch, spark.createDataFrame([(p,) for p in pats], "pattern string"), 2).collect())
    off = lambda p, i: sum(a != b for a, b in zip(p, seq[i : i + len(p)], strict=True))
    assert got == sorted((p, i, off(p, i)) for p in pats for i in range(len(seq) - len(p) + 1) if off(p, i) <= 2)
    with pytest.raises(ValueError):
        search.mismatch_occurrences(ch, spark.createDataFrame([("AC",)], "pattern string"), 2)


def test_chunks_take_time_in_proportion(spark):
    """One pass over a contig: four times the bases take about four times as long, not sixteen."""
    import time

    took = []
    for n in (2, 8):
        df = spark.createDataFrame([(0, "c", "ACGTTGCA" * (n << 17))], "contig_id long, name string, seq string").cache()
        df.count()
        ch = index.chunks(df)
        began = time.time()
        assert ch.count() == (n << 20) // 512
        assert ch.agg(F.sum(F.length("seq"))).first()[0] == (n << 20) + ((n << 20) // 512 - 1) * 256
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 2, took


def test_saved_index(spark, tmp_path):
    df = contigs(spark, genome(41, 900), genome(42, 1500))
    path = f"{tmp_path}/idx"
    index.build_index(df, path, 16, 4, partitions=3)
    ch, idx, freq, meta = index.open_index(spark, path, 16, 4)
    fresh = index.kmer_index(index.chunks(df), 16, 4)
    assert sorted(map(tuple, idx.select("kmer", "contig_id", "pos").collect())) == sorted(map(tuple, fresh.select("kmer", "contig_id", "pos").collect()))
    assert (meta["bases"], meta["entries"]) == (2400, fresh.count()) and freq.agg(F.sum("freq")).first()[0] == fresh.count()
    assert ch.count() == index.chunks(df).count()
    for bad in ({"seed": 12}, {"stride": 1}):
        with pytest.raises(ValueError, match="index at"):
            index.open_index(spark, path, **bad)
    assert (index.pick_stride(df, 1 << 30), index.pick_stride(df, 1000)) == (1, 4)


def test_fm_table(spark, tmp_path):
    seqs = [genome(51, 400), genome(52, 60) * 3, "", "ACGTACGTGACG"]
    df = contigs(spark, *seqs)
    suffix.write_fm(df, f"{tmp_path}/fm", 8)
    table = suffix.open_fm(spark, f"{tmp_path}/fm")
    pats = ["ACG", "GATTACA", seqs[0][50:80], seqs[1][:20]]
    pd_ = spark.createDataFrame([(p,) for p in pats], "pattern string")
    got = sorted((r["contig_id"], r["pattern"], tuple(r["positions"])) for r in suffix.fm_occurrences(table, pd_).collect())
    spots = lambda s, p: tuple(i for i in range(len(s)) if s.startswith(p, i))
    assert got == sorted((c, p, spots(s, p)) for c, s in enumerate(seqs) for p in pats if spots(s, p))
    n = {(r["contig_id"], r["pattern"]): r["n"] for r in suffix.membership(table, pd_).collect()}
    assert n == {(c, p): len(spots(s, p)) for c, s in enumerate(seqs) for p in pats}
    assert sorted((r["contig_id"], r["seq"]) for r in suffix.inverted(table).collect()) == list(enumerate(seqs))
    near = suffix.fm_occurrences(table, spark.createDataFrame([(seqs[0][50:64] + "A" + seqs[0][65:80],)], "pattern string"), 1).filter("contig_id = 0").collect()
    assert 50 in {i for r in near for i in r["positions"]} and all(r["edits"] <= 1 for r in near)
    table.withColumn("version", F.lit(9)).write.parquet(f"{tmp_path}/old")
    with pytest.raises(Exception, match="version 9"):
        suffix.open_fm(spark, f"{tmp_path}/old").collect()


def test_lower_bounds_never_cut_a_match():
    s = genome(61, 200)
    fm = suffix.FMIndex(s)
    for at in range(0, 180, 9):
        p = s[at : at + 18]
        assert fm.lower_bounds(p) == [0] * 18
        wrong = p[:4] + "ACGT".replace(p[4], "")[0] + p[5:]
        spots = {fm.locate(r) for lo, hi, e in fm.within(wrong, 1) for r in range(lo, hi)}
        assert at in spots
    assert fm.lower_bounds("A" * 60)[-1] >= 1


def test_next_and_checksum(spark):
    from strandmill.functions import sequence as S

    df = spark.createDataFrame([("AAA", "AAC"), ("ACT", "AGA"), ("GTT", "TAA"), ("TTT", ""), ("T", "")], "s string, want string")
    assert df.filter(S.next_dna("s") != F.col("want")).count() == 0
    h = 1469598103934665603
    for b in b"ACGT":
        h = (h ^ b) * 1099511628211 % (1 << 64)
    got = spark.createDataFrame([("ACGT",), ("",), (None,)], "s string").select(S.checksum("s")).collect()
    assert [r[0] for r in got] == [h - (1 << 64) if h >> 63 else h, 1469598103934665603, None]


def test_bands_side_by_side():
    """Many pairs at once give what each gives alone, ties included."""
    import random

    r = random.Random(12)
    for k in range(4):
        pairs = []
        for _ in range(400):
            x = "".join(r.choice("ACGTN") for _ in range(r.randrange(0, 24)))
            y = list(x)
            for _ in range(r.randrange(0, k + 2)):
                i = r.randrange(0, len(y) + 1)
                y[i : i + r.randrange(0, 2)] = r.choice(["", "A", "C"])
            pairs.append((x, "".join(y)))
        edit, cigar = align.banded_all([x for x, _ in pairs], [y for _, y in pairs], k)
        for (x, y), e, c in zip(pairs, edit.tolist(), cigar, strict=True):
            want = align.banded(x, y, k)
            assert (e, c) == ((-1, "") if want is None else want), (x, y, k)
