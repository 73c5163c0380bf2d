import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandmill.operators import index
from strandmill.operators.align import banded
from strandmill.plans import mapper, seeded
from strandmill.sources.writers import mapped_line

RC = str.maketrans("ACGT", "TGCA")


def world():
    r = random.Random(3)
    rand = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    shared = rand(90)
    contigs = [rand(300) + shared + rand(160), rand(200) + shared + rand(120) + "N" * 20 + rand(60)]
    reads = []
    for i in range(22):
        c = contigs[i % 2]
        p = r.randrange(0, len(c) - 64)
        s = list(c[p : p + 64])
        for _ in range(i % 4):
            k, kind = r.randrange(len(s)), r.randrange(3)
            if kind == 0:
                s[k] = r.choice("ACGT")
            elif kind == 1:
                del s[k]
            else:
                s.insert(k, r.choice("ACGT"))
        s = "".join(s).replace("N", "A")
        reads.append(s if i % 3 else s[::-1].translate(RC))
    reads += [contigs[0][:64], contigs[1][-64:], shared[10:74], rand(64)]
    return contigs, reads


def brute(contigs, reads, k):
    """Every window of every contig, by another engine's edit distance."""
    con = duckdb.connect()
    con.execute("CREATE TABLE o (id INT, strand VARCHAR, s VARCHAR)")
    con.execute("CREATE TABLE c (name VARCHAR, s VARCHAR)")
    con.executemany("INSERT INTO o VALUES (?, ?, ?)", [(i, t, s if t == "+" else s[::-1].translate(RC)) for i, s in enumerate(reads) for t in "+-"])
    con.executemany("INSERT INTO c VALUES (?, ?)", [(f"c{i}", s) for i, s in enumerate(contigs)])
    hits = con.execute(
        f"""WITH w AS (SELECT o.id, o.strand, c.name, p, o.s, substr(c.s, p, length(o.s) + e) AS w, length(o.s) + e AS n
          FROM o, (SELECT *, unnest(range(1, length(s) + 1)) AS p FROM c) c, range({-k}, {k + 1}) x(e)),
        d AS (SELECT id, strand, name, p, levenshtein(translate(s, 'N', 'n'), w) AS edit FROM w WHERE length(w) = n)
        SELECT id, min(edit) AS edit, name, p, strand FROM d WHERE edit <= {k} GROUP BY id, name, p, strand ORDER BY id, edit, name, p, strand"""
    ).fetchall()
    out = {i: (None, None) for i in range(len(reads))}
    for i in out:
        mine = [h[1:] for h in hits if h[0] == i]
        alt = [h for h in mine[1:] if not (h[1] == mine[0][1] and abs(h[2] - mine[0][2]) <= 10)]
        out[i] = (mine[0] if mine else None, alt[0] if alt else None)
    return out


def frames(spark, contigs, reads):
    c = spark.createDataFrame([(i, f"c{i}", s) for i, s in enumerate(contigs)], "contig_id long, name string, seq string")
    r = spark.createDataFrame([(i, f"r{i}", s, "I" * len(s)) for i, s in enumerate(reads)], "read_id long, name string, seq string, qual string")
    return index.chunks(c), r


@pytest.mark.parametrize(("k", "seed"), [(0, 16), (1, 16), (2, 12)])
def test_exhaustive_is_complete(spark, k, seed):
    contigs, reads = world()
    ch, rd = frames(spark, contigs, reads)
    got = mapper.map_reads(rd, ch, index.kmer_index(ch, seed, 4), k, seed=seed).collect()
    want = brute(contigs, reads, k)
    assert len(got) == len(reads)
    for r in got:
        p = (r["edit"], r["chrom"], r["pos"], r["strand"]) if r["chrom"] else None
        a = (r["alt_edit"], r["alt_chrom"], r["alt_pos"], r["alt_strand"]) if r["alt_chrom"] else None
        assert (p, a) == want[r["read_id"]], r["name"]


def test_cigars_and_lines(spark):
    contigs, reads = world()
    ch, rd = frames(spark, contigs, reads)
    mapped = mapper.map_reads(rd, ch, index.kmer_index(ch, 16, 4), 1)
    rows = mapper.with_cigars(mapped, ch, 1).withColumn("line", mapped_line()).collect()
    assert any(r["chrom"] for r in rows) and any(r["chrom"] is None for r in rows)
    for r in rows:
        f = r["line"].split(" ")
        if r["chrom"] is None:
            assert f == [r["name"], "*", "0", "*", r["seq"], r["qual"]]
            continue
        o = r["seq"] if r["strand"] == "+" else r["seq"][::-1].translate(RC)
        window = contigs[int(r["chrom"][1:])][r["pos"] - 1 : r["pos"] - 1 + r["ref_len"]]
        assert (r["edit"], r["cigar"]) == banded(o, window, 1)
        assert f[:4] == [r["name"], r["chrom"], str(r["pos"]), r["cigar"]] and f[4] == r["seq"]
        assert (len(f) == 7) == (r["alt_chrom"] is not None)


def test_seeded_agrees(spark):
    """With few repeats the caps do not bite: what the capped mode finds is the exhaustive best."""
    contigs, reads = world()
    ch, rd = frames(spark, contigs, reads)
    for stride in (1, 4):
        idx = index.kmer_index(ch, 16, stride)
        full = {r["read_id"]: r for r in mapper.map_reads(rd, ch, index.kmer_index(ch, 16, 4), 1).collect()}
        capped = {r["read_id"]: r for r in mapper.map_reads(rd, ch, idx, 1, "seeded", stride=stride).collect()}
        found = [i for i, r in full.items() if r["chrom"]]
        same = [i for i in found if (capped[i]["chrom"], capped[i]["pos"], capped[i]["edit"]) == (full[i]["chrom"], full[i]["pos"], full[i]["edit"])]
        assert len(same) >= 0.8 * len(found)
        assert all(full[i]["chrom"] for i, r in capped.items() if r["chrom"])


def test_seed_plan():
    assert seeded.seed_positions(10, 1, 16, 4) == []
    assert seeded.seed_positions(16, 1, 16, 4) == [0]
    p = seeded.seed_positions(100, 1, 16, 4)
    assert p[:4] == [0, 1, 2, 3] and p[-1] == 84 and len(p) <= 16
    assert seeded.seed_positions(100, 0, 16, 1) == list(range(85))
    assert len(seeded.seed_positions(400, 0, 16, 1)) == 48


def test_seed_choice():
    picked = seeded.choose_seeds([(1, 0), (1, 5), (1, 12), (100, 40)], 0)
    assert {0, 12} <= set(picked) and 40 in picked
    assert len(seeded.choose_seeds([(1, 20 * i) for i in range(30)], 0)) in (10, 11)


def test_arguments(spark):
    contigs, reads = world()
    ch, rd = frames(spark, contigs, reads)
    for bad in ({"k": 4}, {"k": 1, "mode": "fast"}):
        with pytest.raises(ValueError):
            mapper.map_reads(rd, ch, ch, **bad)


def test_long_reads_map(spark):
    """Reads beyond the chunk overlap, and beyond a chunk, with and without errors."""
    import random

    r = random.Random(3)
    ref = "".join(r.choice("ACGT") for _ in range(4000))
    data = [(1, ref[100:400]), (2, ref[700:1500]), (3, ref[2000:2300] + "A" + ref[2300:2500]), (4, ref[3000:3250])]
    contigs = spark.createDataFrame([(0, "c", ref)], "contig_id long, name string, seq string")
    reads = spark.createDataFrame([(i, f"r{i}", s, "I" * len(s)) for i, s in data], "read_id long, name string, seq string, qual string")
    chunks = index.chunks(contigs)
    got = mapper.map_reads(reads, chunks, index.kmer_index(chunks), 1)
    assert [(r["read_id"], r["pos"], r["edit"]) for r in got.orderBy("read_id").collect()] == [(1, 101, 0), (2, 701, 0), (3, 2001, 1), (4, 3001, 0)]
    lines = {r["read_id"]: r["cigar"] for r in mapper.with_cigars(got, chunks, 1).collect()}
    assert lines[1] == "300M" and lines[2] == "800M" and "1I" in lines[3]
    capped = mapper.map_reads(reads, chunks, index.kmer_index(chunks), 1, "seeded")
    assert [(r["read_id"], r["pos"]) for r in capped.orderBy("read_id").collect()] == [(1, 101), (2, 701), (3, 2001), (4, 3001)]


def test_duplicate_rules(spark):
    hits = spark.createDataFrame([(1, "+", 0, 10, 0, 50, 50), (1, "+", 0, 14, 1, 50, 50), (1, "+", 0, 55, 1, 50, 50), (1, "-", 0, 200, 1, 50, 50)], "read_id long, strand string, contig_id long, start long, edit int, ref_len int, n int")
    names = spark.createDataFrame([(0, "c")], "contig_id long, name string")
    alt = lambda **how: mapper.top_two(hits, names, **how).first()["alt_pos"]
    assert (alt(), alt(same_edit=True), alt(tolerance=F.col("n"))) == (56, 15, 201)


def test_fm_mapper(spark):
    contigs, reads = world()
    ch, rd = frames(spark, contigs, reads)
    from strandmill.operators import suffix
    from strandmill.plans import fm_mapper

    few = rd.orderBy("read_id").limit(25)
    table = suffix.fm_table(spark.createDataFrame([(i, f"c{i}", s) for i, s in enumerate(contigs)], "contig_id long, name string, seq string"))
    full = {r["read_id"]: r for r in mapper.map_reads(few, ch, index.kmer_index(ch, 16, 4), 1).collect()}
    got = {r["read_id"]: r for r in fm_mapper.map_reads_fm(few, table, 1).collect()}
    assert set(got) == set(full)
    found = [i for i, r in full.items() if r["chrom"]]
    same = [i for i in found if got[i]["chrom"] and got[i]["edit"] == full[i]["edit"]]
    assert len(same) >= 0.9 * len(found) > 0


def test_settled_strands(spark):
    """Quick hits stop at the first exact one, or the second distinct one; two exact forward hits leave the reverse out."""
    hits = spark.createDataFrame([(1, "+", 0, 10, 0, 50), (1, "+", 0, 400, 0, 50), (1, "-", 0, 90, 0, 50), (2, "+", 0, 10, 0, 50), (2, "+", 0, 15, 0, 50), (2, "-", 0, 90, 1, 50)], "read_id long, strand string, contig_id long, start long, edit int, ref_len int")
    kept = seeded.drop_idle_reverse(hits).select("read_id", "strand").collect()
    assert sorted(map(tuple, kept)) == [(1, "+"), (1, "+"), (2, "+"), (2, "+"), (2, "-")]
