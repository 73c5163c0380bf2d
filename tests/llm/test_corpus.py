"""Operators that compare rows across the corpus, and the pipeline: against brute force."""

import hashlib
import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from strandmill.llm import common, exact_dedup, jaccard_join, substring_dedup
from strandmill.llm.common import Scratch, shared_dir
from tests.llm.fixture import SCHEMA, empty, frame, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unique_rows():
    """The fixture without repeated or null ids."""
    return [(1000 + i if r[0] is None or [x[0] for x in rows()].index(r[0]) < i else r[0], *r[1:]) for i, r in enumerate(rows())]


def test_exact_dedup(spark):
    data = rows()
    got = exact_dedup.exact_dedup(frame(spark, data)).collect()
    groups = defaultdict(list)
    for r in data:
        groups[(r[1] or "").translate(LOW)].append(r[0])
    assert len(got) == len(data)
    kept = defaultdict(int)
    for r in got:
        kept[r["text_sha256"]] += r["kept"]
    for t, ids in groups.items():
        digest = hashlib.sha256(t.encode()).hexdigest()
        mine = [r for r in got if r["text_sha256"] == digest]
        top = max((i for i in ids if i is not None), default=None)
        assert kept[digest] == 1 and len(mine) == len(ids)
        assert all(r["group_size"] == len(ids) and r["keep_id"] == top for r in mine)
        assert all(r["doc_id"] == top for r in mine if r["kept"])
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 60_000).astype(np.uint8)
    ends = exact_dedup.chunk_ends(text)
    assert ends[-1] == len(text) and all(b > a for a, b in zip(ends, ends[1:], strict=False))
    assert max(np.diff([0, *ends])) <= exact_dedup.GREATEST
    moved = exact_dedup.chunk_ends(np.concatenate([rng.integers(97, 123, 5000).astype(np.uint8), text]))
    assert len({e - 5000 for e in moved} & set(ends)) > 0.8 * len(ends)  # cuts move with the content
    assert exact_dedup.chunk_ends(np.zeros(100_000, np.uint8))[-1] == 100_000


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    class Weak:
        def __init__(self, data, digest_size):
            pass

        def digest(self):
            return b"\0" * 8

    # every chunk gets one fingerprint: only the verification can part the texts
    rows_ = list(exact_dedup._recipes(iter([])))
    assert rows_ == []
    import strandmill.llm.exact_dedup as m

    recipes = spark.createDataFrame([(1, b"x", [7], [1], [1]), (2, b"x", [7], [2], [2]), (3, b"x", [7], [1], [1])], "doc_id long, recipe binary, fps array<long>, check_a array<long>, check_b array<long>")
    d = m.chunk_dictionary(recipes).collect()
    assert len(d) == 1 and not d[0]["verified"] and d[0]["occurrences"] == 3


def brute_repeats(data):
    seen, out = set(), {}
    for doc, text in sorted(data):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(w)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[doc] = len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()
    return out


def repeat_data():
    data = [(r[0], r[1]) for r in unique_rows()]
    shared = prose(70, 45)
    data += [(2000 + i, prose(100 + i, i) + " " + shared + " " + prose(200 + i, 30)) for i in range(40)]
    data += [(3000, "a b " * 60), (3001, "b a " * 30), (3002, "z " * 19), (3003, "z " * 41)]
    data += [(4000 + i, " ".join(shared.split()[i : i + 25])) for i in range(20)]
    return data


def test_substring_dedup(spark, monkeypatch):
    data = repeat_data()
    df = spark.createDataFrame([(i, t, "", "", 0, "", "", "", "") for i, t in data], SCHEMA).repartition(5)
    want = brute_repeats(data)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == want
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0
    assert substring_dedup.remove_repeats(frame(spark)).count() == len(rows())


def test_subtrees_name_every_repeat():
    rng = np.random.default_rng(2)
    texts = [[b"x%d" % w for w in rng.integers(0, 3, 40)] for _ in range(60)]
    texts += [t[5:] + [b"y"] for t in texts[:30]] + [[b"z"] * 45]
    docs = [b" ".join(t).decode() for t in texts]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(docs))), "part": [0] * len(docs), "text": docs})
    rows_ = []
    for b in substring_dedup._find_anchors([batch]):
        for r in b.to_pylist():
            start, count = r["loc"] >> 8, (r["loc"] & 15) + 1
            rows_.append((r["doc_id"], 0, r["loc"], b" ".join(texts[r["doc_id"]][start : start + count + 19])))
    rng.shuffle(rows_)
    rows_ = [(int(r[0]), int(r[1]), int(r[2]), r[3]) for r in rows_]
    got = {(d, s + i) for d, _, s, n in substring_dedup.subtree_repeats(rows_) for i in range(n)}
    seen, want = set(), set()
    for d, t in enumerate(texts):
        for i in range(len(t) - 19):
            w = tuple(t[i : i + 20])
            if w in seen:
                want.add((d, i))
            seen.add(w)
    assert got == want and len(want) > 300


def hot_data():
    """One passage between many neighbours, copies of one window, and a hot first word."""
    shared, window = prose(71, 45), prose(72, 20)
    data = repeat_data() + [(6000 + i, prose(300 + i, 12) + " " + shared + " " + prose(400 + i, 12)) for i in range(300)]
    data += [(7000 + i, f"u{i} {window} v{i}") for i in range(60)]
    return data + [(8000 + i, "the " + " ".join(f"the t{i} q{j}" for j in range(20))) for i in range(30)]


def test_groups_fit_before_any_task_takes_them(spark, monkeypatch):
    data = hot_data()
    df = spark.createDataFrame([(i, t, "", "", 0, "", "", "", "") for i, t in data], SCHEMA).repartition(5)
    monkeypatch.setattr(substring_dedup, "SEEN_SEGMENTS", 1)  # no task passes a copy over
    groups, real = [], substring_dedup.partition_by_prefix

    def spy(segments, limit):
        settled, copies = real(segments, limit)
        groups.append((settled.groupBy("key").count().agg({"count": "max"}).first()[0], segments.groupBy("key").count().agg({"count": "max"}).first()[0], copies.count(), copies.select("segment").distinct().count()))
        return settled, copies

    monkeypatch.setattr(substring_dedup, "partition_by_prefix", spy)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(df, limit=8).collect()}
    assert got == brute_repeats(data)
    largest, before, n_copies, n_windows = groups[0]
    assert largest <= 8 < 100 < before and n_copies > 8 * n_windows


def test_large_tables_are_staged_by_python_tasks(spark, monkeypatch):
    """Files that the JVM writes cost processes whose start doubles its memory for whoever reads it; Hadoop leaves a .crc beside each."""
    data, staged = repeat_data(), Scratch(spark)
    df = spark.createDataFrame([(i, t, "", "", 0, "", "", "", "") for i, t in data], SCHEMA).repartition(5)
    with staged:
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(data)
    files = {name: [f for p in staged.paths if f"/{name}-" in p for _, _, fs in os.walk(p.removeprefix("file://")) for f in fs] for name in ("anchors", "segments", "repeats")}
    assert all(files.values()) and not [f for fs in files.values() for f in fs if not re.fullmatch(r"part-\w+\.parquet", f)]
    staged.drop()


def test_stage_mapped_counts_reported_files_only(spark, monkeypatch):
    schema, sql = pa.schema([("n", pa.int64()), ("b", pa.binary())]), "n long, b binary"
    ids = spark.range(0, 5000, 1, 7).selectExpr("id AS n", "CAST(repeat(CAST(id AS STRING), 20) AS BINARY) AS b", "id AS more")

    def twice(batches):
        for batch in batches:
            yield from (batch, batch.slice(0, 0), batch.filter(pa.compute.less(batch.column(0), 10)))

    def repeated(uri, body, schema):  # each task leaves the file of an attempt that is not reported
        write = common_write(uri, body, schema)

        def run(batches):
            batches = list(batches)
            list(write(iter(batches)))
            yield from write(iter(batches))

        return run

    class SparkOnly:
        def from_uri(_):
            raise pa.ArrowInvalid("unknown scheme")

    common_write = common._write_parquet
    monkeypatch.setattr(common, "_write_parquet", repeated)
    monkeypatch.setattr(common, "BATCH_BYTES", 4000)  # several row groups a file
    want = sorted([*range(5000), *range(10)])
    for opens in (True, False):
        if not opens:  # a store that only Spark opens
            monkeypatch.setattr(common.pafs, "FileSystem", SparkOnly)
        got = common.stage_mapped(ids, twice, schema, sql, "numbers")
        assert got.columns == ["n", "b"] and sorted(r["n"] for r in got.collect()) == want
        assert all(bytes(r["b"]) == str(r["n"]).encode() * 20 for r in got.take(50))
        assert common.stage_mapped(ids.filter("n < 0"), twice, schema, sql, "none").count() == 0


def test_known_prefixes_are_spread_before_the_shuffle():
    met = substring_dedup.Met(16)
    rng = np.random.default_rng(4)
    told, seen = 0, defaultdict(int)
    for _ in range(300):
        key = np.where(rng.random(20) < 0.5, np.uint64(7), rng.integers(1, 60, 20).astype(np.uint64))
        known = met.twice(key)
        told += int(known[key == 7].sum())
        for k, claimed in zip(key.tolist(), known.tolist(), strict=True):
            assert not claimed or seen[k] >= 2  # never claims what it has not met twice
            seen[k] += 1
    assert told > 0.9 * seen[7]


def brute_components(data, n=3, num=90, den=100):
    sets = {}
    for doc, text in data:
        w = WORD.findall((text or "").translate(LOW))
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


def near_data():
    data = [(r[0], r[1]) for r in unique_rows()]
    rng = np.random.default_rng(11)
    for g, size in enumerate((8, 12, 14, 20, 30, 45, 80, 150, 400)):
        words = prose(500 + g, size, 10_000).split()
        for v in range(12):
            mine = list(words)
            for _ in range(int(rng.integers(0, max(2, size // 15)))):
                k = int(rng.integers(0, len(mine)))
                if rng.random() < 0.5:
                    mine[k] = f"new{rng.integers(0, 999)}"
                else:
                    mine.insert(k, f"add{rng.integers(0, 999)}")
            cut = int(rng.integers(0, 3))
            data.append((5000 + 100 * g + v, " ".join(mine[cut:])))
    chain = prose(900, 200, 10_000).split()
    for v in range(15):  # neighbours are close, the ends are not
        chain = [*chain[4:], *prose(1000 + v, 4, 10_000).split()]
        data.append((8000 - v, " ".join(chain)))
    return data


def test_jaccard_components(spark):
    data = near_data()
    df = spark.createDataFrame([(i, t, "", "", 0, "", "", "", "") for i, t in data], SCHEMA).repartition(4)
    want = brute_components(data)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 40
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0
    assert jaccard_join.jaccard_components(frame(spark)).count() == len(rows())


def test_links_that_no_centre_sees(spark):
    """At 0.8 and five words, where groups are wide and their centre links with few."""
    data = [(i, t) for i, t in near_data() if t]
    rng = np.random.default_rng(21)
    for g in range(6):  # members differ from each other by more than from some
        base = prose(1500 + g, 24 + 10 * g, 10_000).split()
        for v in range(14):
            mine = [w if rng.random() > 0.02 else f"z{rng.integers(0, 9)}" for w in base]
            data.append((20_000 + 100 * g + v, " ".join(mine[int(rng.integers(0, 4)) : len(mine) - int(rng.integers(0, 4))])))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, shingle=5, num=80, den=100).collect()}
    assert got == brute_components(data, 5, 80, 100)


def test_signatures_are_complete():
    """Whatever mix of exact and one-deletion segments, a pair within the bound shares a signature."""
    rng = np.random.default_rng(7)
    for trial in range(400):
        n = int(rng.integers(8, 120))
        starts = jaccard_join.band_starts(90, 100, 1024)
        a = rng.integers(1, 1 << 62, n).astype(np.uint64)
        cut, add = int(rng.integers(0, 3)), int(rng.integers(0, 4))
        b = np.concatenate([a[cut:], rng.integers(1, 1 << 62, add).astype(np.uint64)])
        a, b = np.sort(a), np.sort(b)
        both = len(np.intersect1d(a, b))
        if 100 * both < 90 * (len(a) + len(b) - both) or (len(a) == len(b) == both):
            continue
        size = np.array([len(a), len(b)])
        band = np.searchsorted(starts, size, side="right") - 1
        found = []
        for i, s in enumerate((a, b)):
            mine = set()
            for below in (0, 1):
                scheme = np.array([band[i] - below])
                h = np.where(scheme >= 0, jaccard_join.differ(90, 100, np.maximum(scheme, 0), starts), 0)
                q = np.minimum(np.array([trial % 4]), (h + 1) // 2)
                mine |= set(jaccard_join.signatures(s, np.array([0, len(s)]), scheme, h, q)[0].tolist())
            found.append(mine)
        assert found[0] & found[1], (trial, n, cut, add)


def test_signatures_with_segments_to_spare_are_complete():
    """Pairs at the bound itself, at 0.8, under the schemes that the join uses."""
    rng = np.random.default_rng(12)
    starts = jaccard_join.band_starts(80, 100, 4096)
    shared = 0
    for trial in range(500):
        n = int(rng.integers(5, 400))
        base = rng.integers(1, 1 << 62, n).astype(np.uint64)
        cut = int(rng.integers(0, n // 4 + 1))
        a, b = np.unique(base), np.unique(np.concatenate([base[cut:], rng.integers(1, 1 << 62, max(0, n // 5 - cut)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        if len(a) == len(b) == both:
            continue
        shared += 1
        found = []
        for s in (a, b):
            band = int(np.searchsorted(starts, len(s), side="right")) - 1
            mine = set()
            for scheme in (band, band - 1):
                h = int(jaccard_join.differ(80, 100, np.array([max(scheme, 0)]), starts)[0]) if scheme >= 0 else 0
                q = min(trial % 3 * h // 4, (h + 1) // 2)
                parts = jaccard_join.segments(h, q, float(starts[max(scheme, 0)]))
                mine |= set(jaccard_join.signatures(s, np.array([0, len(s)]), np.array([scheme]), np.array([h]), np.array([q]), np.array([parts]))[0].tolist())
            found.append(mine)
        assert found[0] & found[1], (trial, n, cut)
    assert shared > 100


def test_sketches_never_hide_a_link():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[int(rng.integers(0, max(1, n // 4))) :], rng.integers(1, 1 << 62, int(rng.integers(0, n // 4 + 2))).astype(np.uint64)]))
        a, b = jaccard_join.folded([jaccard_join.sketch(x), jaccard_join.sketch(y)])
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_ties_connect_what_sketches_allow():
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(1, 1 << 62, 200).astype(np.uint64))
    sets = [base[rng.random(len(base)) > 0.04] for _ in range(12)] + [np.unique(rng.integers(1, 1 << 62, 190).astype(np.uint64)) for _ in range(5)]
    n, cid, comp = np.array([len(s) for s in sets]), np.arange(17) + 100, np.array([0, 0, 0, *range(3, 17)])
    raw = [jaccard_join.sketch(s) for s in sets]
    for side in (np.zeros(17, int), np.array([0] * 8 + [1] * 9)):
        got = jaccard_join.ties(cid, n, comp, side, raw, 90, 100)
        assert len(got) < 17 and {x for p in got for x in p} <= set(range(100, 112))
        root = {x: x for x in range(100, 112)}
        for a, b in got:
            root = {x: root[a] if r == root[b] else r for x, r in root.items()}
        linked = {frozenset((i, j)) for i in range(12) for j in range(i) if comp[i] != comp[j] and (side[i] != side[j] or not side.any()) and 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))}
        assert linked and all(root[100 + min(p)] == root[100 + max(p)] for p in linked)


def test_large_groups_and_families_are_dealt_over_units(spark, monkeypatch):
    """Every cut made small: the same components, and units in proportion to what is not yet joined."""
    monkeypatch.setattr(jaccard_join, "UNIT_ROWS", 6)
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 600)
    data = near_data()
    df = spark.createDataFrame([(i, t, "", "", 0, "", "", "", "") for i, t in data], SCHEMA).repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == brute_components(data)
    # a family of 400 sets of one component and 6 strays: blocks of the component never meet each other
    member = spark.createDataFrame([(i, 150, 0 if i < 400 else i, 0) for i in range(406)], "cid long, n long, now long, family long")
    units = jaccard_join._units(member, 90, 100).groupBy("unit").count().count()
    assert units <= 400 * 150 // 600 * 3


def test_cost_moves_to_deletions_as_sets_grow():
    few, many = jaccard_join.one_deletions(1, 12.0, 10, 0.25), jaccard_join.one_deletions(1, 12.0, 1e8, 0.25)
    assert few == 0 and many == 1


def test_shared_dir_is_the_session_setting(spark):
    given = spark.conf.get("spark.checkpoint.dir", None)
    got = shared_dir(spark)
    assert got.startswith("file:///")
    assert given is None or got == "file://" + given.removeprefix("file://").rstrip("/")


def test_pipeline(spark):
    import corpus_pipeline as p

    names = ["language ID", "exact dedup", "n-gram Jaccard join", "mixing sources", "SentencePiece"]
    assert [n for n, _ in p.STAGES] == names
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    data = [(i, t) for i, t in near_data() if t and any(c.isalpha() for c in t)]
    full = [(i, t, "en", f"s{i % 5}", len(t)) for i, t in data] + [(70_000, None, None, None, None), (70_001, "12 34", "en", "s1", 5)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    step = docs
    sizes = []
    for _, f in p.STAGES[:-1]:
        step = f(spark, step, "").cache()
        assert step.columns == columns
        sizes.append(step.count())
    first = {i for i, t, *_ in full if t and any(c.isalpha() for c in t)}
    assert sizes[0] == len(first)
    text = {i: t.translate(LOW) for i, t in data}
    top = {}
    for i, t in text.items():
        top[t] = max(i, top.get(t, -1))
    kept = {i: next(t for d, t in data if d == i) for i in top.values()}
    assert sizes[1] == len(kept)
    comp = brute_components(list(kept.items()), p.SHINGLE, p.NUM, p.DEN)
    assert (p.SHINGLE, p.NUM, p.DEN) == (5, 80, 100)
    heads = {i for i, (_, c) in comp.items() if c == i}
    assert sizes[2] == len(heads)
    got = step.groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in got} <= heads and all(r["count"] in (1, 2) for r in got)
    last = p.STAGES[-1][1](spark, step, "")
    assert last.filter("NOT lossless").count() == 0 and last.count() == sizes[3]


def test_near_copies_go_by_row(spark):
    import corpus_pipeline as p

    a, b, c, d = (prose(800 + i, 80, 10_000) for i in range(4))
    near = lambda t, i: f"{t} end{i}"
    # 5: a near copy of 1 and a clean text; 7: two near copies; null ids: a near copy, two of one kind and a clean text
    data = [(1, a), (5, near(a, 1)), (5, b), (7, c), (7, near(c, 1)), (None, near(a, 2)), (None, d), (None, near(d, 1))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = p.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(got) == 4 and {(1, a), (5, b)} <= set(got)
    assert len([t for i, t in got if i == 7 and t.startswith(c)]) == 1
    assert len([t for i, t in got if i is None and t.startswith(d)]) == 1


def test_stages_take_repeated_null_and_clashing_rows(spark):
    import corpus_pipeline as p

    a, b = prose(900, 80, 10_000), prose(901, 80, 10_000)
    clash = ["_id", "_sha", "_text_sha", "_copies", "_copy", "_row", "row", "gone", "kept", "size", "component_id", "times", "name", "copy"]
    columns = ["doc_id", "text", "lang", "source", "n_chars", *clash]
    # unrelated b under the id of a near copy of a; equal texts under one and under null ids
    data = [(1, a), (2, f"{a} tail"), (2, b), (3, b.upper()), (None, a), (4, f"{a} tail"), (4, f"{a} tail")]
    rows_ = [(i, t, "en", "s", len(t), *[f"{c}{n}" for c in clash]) for n, (i, t) in enumerate(data)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    docs = spark.createDataFrame(rows_, schema).repartition(3)
    step, got = docs, []
    for _, f in p.STAGES[:-1]:
        step = f(spark, step, "").cache()
        assert step.columns == columns
        got.append(sorted((str(r["doc_id"]), r["text"]) for r in step.collect()))
    assert len(got[0]) == 7
    assert got[1] == sorted([("1", a), ("3", b.upper()), ("4", f"{a} tail")])  # of equal texts the largest id, once
    assert got[2] == sorted([("1", a), ("3", b.upper())])
    assert set(got[3]) <= set(got[2])
    assert p.STAGES[-1][1](spark, step, "").filter("lossless").count() == len(got[3])
    nothing = spark.createDataFrame([], schema)
    for _, f in p.STAGES[:-1]:
        nothing = f(spark, nothing, "").cache()
        assert nothing.columns == columns and nothing.count() == 0
    assert p.STAGES[-1][1](spark, nothing, "").count() == 0


def test_a_stage_leaves_other_results_alone(spark):
    import corpus_pipeline as p

    df = frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    held = jaccard_join.jaccard_components(df)
    for _, f in p.STAGES[:3]:
        df = f(spark, df, "").cache()
        df.count()
    assert held.count() == len(rows())


def test_shared_dir_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    import pytest

    none = SimpleNamespace(get=lambda key, default=None: default)
    cluster = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)
