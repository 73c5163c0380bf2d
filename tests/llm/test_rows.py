"""Operators that judge each row: against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from strandmill.llm import language_id, mixing, piece_sampling, quality, secret_scan, sharding, token_files
from strandmill.llm.queries import tokenizer
from tests.llm.fixture import empty, frame, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def by_id(found, cols, ids=None):
    return sorted((tuple(r[c] for c in cols) for r in found), key=str)


# --- quality ------------------------------------------------------------------


def brute_quality(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), n < 20 or 100 * len(cover) > 30 * n


def test_quality_counts(spark):
    more = [(100 + i, t, "en", "a", 1, "", "", "", "") for i, t in enumerate(["a\n\na\nb\r\na", "\nx\n", "### $$ a|b", prose(20, 30) + "\n" + prose(20, 30), "é ü\tß\x0bz"])]
    got = quality.quality_rules(frame(spark, rows() + more)).collect()
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert by_id(got, cols) == sorted(((r[0], *brute_quality(r[1])) for r in rows() + more), key=str)
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert quality.quality_rules(empty(spark)).count() == 0


def test_quality_lines(spark):
    good = "\n".join(prose(i, 12) + "." for i in range(6))
    bad = "\n".join(["All rights reserved.", "home | news | about | contact | more", "BUY!! NOW!! GO!!", good])
    junk = "\n".join(["a$$$ b%%% c&&& d### e*** " * 5] * 3 + [prose(30, 10)])
    data = [(1, good), (2, bad), (3, junk)]
    got = {r["doc_id"]: r for r in quality.quality_rules(frame(spark, [(i, t, "en", "a", 1, "", "", "", "") for i, t in data]), with_text=True).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == good and got[1]["n_removed_lines"] == 0
    assert got[2]["kept"] and got[2]["clean_text"] == good and got[2]["n_removed_lines"] == 3
    assert not got[3]["kept"]
    assert got[2]["clean_sha256"] == sha(good)


# --- secrets ------------------------------------------------------------------

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets_base(spark):
    texts = ["token=api_key: abcdefgh1", "é😀 token = abcdefgh", "AKIAAKIA12 AKIAABCDEFGHIJKL", "f" * 31 + "g" + "a" * 32, "passwordpassword::secret=aaaaaaaa", "SECRET=' abcdefghi", "PassWd\":\"A1B2C3D4E5F6", "tokentoken=12345678=token:12345678"]
    data = rows() + [(100 + i, t, "en", "a", 1, "", "", "", "") for i, t in enumerate(texts)]
    got = by_id(secret_scan.scan_secrets(frame(spark, data)).collect(), ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"])
    want = []
    for r in data:
        b = brute_base(r[1])
        said = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in b)
        want.append((r[0], *(sum(k == n for _, k, _ in b) for n in range(3)), sha(said)))
    assert got == sorted(want, key=str)
    assert secret_scan.scan_secrets(empty(spark)).count() == 0


def test_secrets_ownership(spark):
    rare, wide = "Zx9" * 9, "Qw7" * 9
    data = [(i, f"see {wide} here", "en", f"s{i}", 1, "", "", "", "") for i in range(5)] + [(9, f"key {rare}", "en", "s1", 1, "", "", "", ""), (10, "token = " + rare, "en", "s1", 1, "", "", "", "")]
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(frame(spark, data)).collect()}
    assert all(got[i]["spans"] == "" for i in range(5))  # five owners hold it: an example
    assert got[9]["spans"] == f"opaque:4:{4 + 27}" and got[9]["n_owner_specific"] == 1 and got[9]["held_by"] == "1/2"
    assert got[10]["spans"] == f"assign:0:{8 + 27}" and got[10]["findings"][0]["n_repos"] == 2


def test_secrets_copied_inside_one_owner(spark):
    copied, live = "Abc123Def456Ghi789Jkl012Mno", "Zyx987Wvu654Tsr321Qpo098Nml"
    data = [(i, f"see {copied} here", "en", "hot", 1, "", "", "", "") for i in range(40)] + [(100, f"my {live}", "en", "hot", 1, "", "", "", "")]
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(frame(spark, data)).collect()}
    assert all(got[i]["n_opaque"] == got[i]["n_owner_specific"] == 0 for i in range(40))
    assert got[100]["n_opaque"] == got[100]["n_owner_specific"] == 1
    assert (got[100]["findings"][0]["n_repos"], got[100]["findings"][0]["n_owners"]) == (1, 1)


def test_secrets_grow_with_the_matches(spark):
    """Tens of thousands of matches in one text: positions and overlaps stay right, and in seconds."""
    import time

    part = "token = abcdefgh1 Zx9Yw8Vu7Ts6Rq5Po4Nm3Lk2Ji1 api_key=Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1 "
    text = part * 12_000
    df = frame(spark, [(1, text, "en", "a", 1, "", "", "", "")])
    began = time.time()
    got = secret_scan.scan_secrets(df).collect()[0]
    took = time.time() - began
    opaque = [(m.start() + len(part) * i, 3, m.end() + len(part) * i) for i in range(12_000) for m in [re.search("Zx9[A-Za-z0-9]+", part)]]
    want = sorted([*brute_base(text), *opaque])
    assert got["n_assign"] == 24_000 and got["n_opaque"] == 12_000
    assert got["spans"] == ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in want)
    assert took < 30, took


# --- sharding -----------------------------------------------------------------


def test_shards_fit(spark):
    data = [(i, prose(i, 5 + i % 40), "en", "a", 1, "", "", "", "") for i in range(300)] + rows()
    df = frame(spark, data)
    for limit in (600, 5000, 10**9):
        got = sharding.extendible_shards(df, max_bytes=limit).collect()
        assert len(got) == len(data)
        sums, docs = Counter(), Counter()
        for r in got:
            sums[r["shard"]] += r["n_bytes"]
            docs[r["shard"]] += 1
        for r in got:
            assert (r["shard_bytes"], r["shard_docs"]) == (sums[r["shard"]], docs[r["shard"]])
            assert r["oversize"] == (sums[r["shard"]] > limit)
            assert not r["oversize"] or docs[r["shard"]] == 1 or r["n_bytes"] == 0 or r["n_bytes"] > limit
        # a bucket that split was too large
        for r in got:
            if 0 < r["depth"] < sharding.HASH_BITS:
                parent = r["prefix"] >> 1
                assert sum(x["n_bytes"] for x in got if x["depth"] >= r["depth"] and x["prefix"] >> (x["depth"] - r["depth"] + 1) == parent) > limit
    assert sharding.extendible_shards(empty(spark)).count() == 0


# --- mixing -------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing(spark):
    data = rows() + [(100 + i, prose(i, 10 + i % 50), "en", f"s{i % 7}", 1, "", "", "", "") for i in range(200)]
    got = mixing.mix_sources(frame(spark, data)).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r[0]), len(WORD.findall(r[1] or ""))) for r in data)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(12, 0.01 * want[s])
    again = mixing.mix_sources(frame(spark, data).repartition(7)).collect()
    key = lambda rs: Counter((r["doc_id"], r["taken"]) for r in rs if r["doc_id"] not in (18, 19, None))
    assert key(again) == key(got)
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_mixing_meets_small_targets(spark):
    """Sources far smaller than a block of the schedule, the null source among them."""
    data = [(i, "w " * 400, "en", f"s{i % 4}", 1, "", "", "", "") for i in range(400)]
    small = {"a1": 3, "m2": 37, "s2x": 150, "z9": 700, None: 11}
    for k, (source, n) in enumerate(small.items()):
        data += [(1000 + 10 * k + j, "w " * (n // 3 + (j < n % 3)), "en", source, 1, "", "", "", "") for j in range(3)]
    got = mixing.mix_sources(frame(spark, data), slots=256).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


# --- language -----------------------------------------------------------------


def test_language(spark):
    words = {"en": "the house and that there where with which", "de": "der haus und nicht über schön für welche", "ru": "дом и который здесь где какой с над"}
    r = np.random.default_rng(1)
    data = [(i, " ".join(r.choice(words[g].split(), 30)), g, "a", 1, "", "", "", "") for i, g in enumerate(["en", "de", "ru"] * 40)]
    data += [(900, "the house and der haus " * 1, None, "a", 1, "", "", "", ""), (901, "the house with which there " * 6 + "дом здесь который где " * 4, None, "a", 1, "", "", "", ""), (902, "漢字漢字", None, "a", 1, "", "", "", ""), (903, "12 34 !", None, "a", 1, "", "", "", ""), (904, None, None, "a", 1, "", "", "", ""), (905, "", None, "a", 1, "", "", "", "")]
    df = frame(spark, data)
    model = language_id.fit(df)
    assert model.langs == ["de", "en", "ru"]
    got = {x["doc_id"]: x for x in language_id.identify(df, model, with_spans=True).collect()}
    assert all(got[x[0]]["lang_pred"] == x[2] for x in data[:120])
    import zlib

    assert all(got[x[0]]["held_out"] == (zlib.crc32(str(x[0]).encode()) % 3 == 1) for x in data)
    assert [s["lang"] for s in got[901]["spans"]] == ["en", "ru"] and got[901]["lang_pred"] == "en" and 0.5 < got[901]["score"] < 1
    text = data[121][1]
    assert text[: got[901]["spans"][0]["end"]].endswith("there") and text[got[901]["spans"][1]["start"] :].startswith("дом")
    assert got[902]["lang_pred"] in words and got[902]["score"] == 0
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (903, 904, 905))
    kept = language_id.keep_identified(df, model)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == {x[0] for x in data} - {902, 903, 904, 905}
    assert language_id.identify(empty(spark), language_id.fit(empty(spark))).count() == 0


def test_language_paths_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(200):
        k, pen = int(rng.integers(1, 5)), float(rng.choice([2, 6, 12]))
        counts = rng.integers(0, 40, int(rng.integers(1, 30)))
        first = np.concatenate([[0], np.cumsum(counts)])
        s = rng.normal(0, float(rng.choice([0.5, 3, 6])), (first[-1], k))
        got = language_id.label(s, first, pen)
        worth = lambda p, x: x[np.arange(len(p)), p].sum() - pen * (p[1:] != p[:-1]).sum()
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b > a:
                assert worth(got[a:b], s[a:b]) == pytest.approx(worth(language_id.viterbi(s[a:b], pen), s[a:b]))


# --- pieces and tokens ----------------------------------------------------------


def test_pieces_round_trip(spark):
    path = tokenizer("piece_bpe_32k.model")
    df = frame(spark, [*rows(), (200, "  two  blanks \n\n end ", "en", "a", 1, "", "", "", ""), (201, "漢" * 40 + "\x00" + "y" * 200, "en", "a", 1, "", "", "", "")])
    enc = piece_sampling.encode_sampled(df, path, with_ids=True)
    got = enc.collect()
    assert all(r["lossless"] for r in got) and all(r["n_pieces"] == len(r["ids"]) for r in got)
    back = sorted((str(r["doc_id"]), r["text"]) for r in piece_sampling.decode_ids(enc, path).collect())
    assert back == sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
    again = piece_sampling.encode_sampled(df.repartition(5), path).collect()
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in again) == Counter((r["doc_id"], r["ids_crc32"]) for r in got)
    assert piece_sampling.encode_sampled(empty(spark), path).count() == 0


def test_pieces_follow_the_lattice():
    lat = piece_sampling.lattice(tokenizer("piece_bpe_32k.model"), 1.0)
    n, word = 20000, b"there he"
    ids, at = piece_sampling.segment(lat, np.frombuffer(word * n, np.uint8), np.arange(n + 1) * len(word), np.arange(n))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True))

    def ways(left):
        if not left:
            yield (), 1.0
        for i, p in enumerate(lat.bytes):
            if p and lat.weight[i] > 2e-5 and left.startswith(p) and len(p) <= len(left) and b" " not in p[1:]:
                for rest, w in ways(left[len(p) :]):
                    yield (i, *rest), lat.weight[i] * w

    lat_ways = {}
    for unit in (b" there", b" he"):
        lat_ways[unit] = dict(ways(unit))
    total = {u: sum(w.values()) for u, w in lat_ways.items()}
    for path, count in seen.most_common(6):
        cut = next(i for i in range(len(path) + 1) if b"".join(lat.bytes[p] for p in path[:i]) == b" there")
        want = lat_ways[b" there"][path[:cut]] / total[b" there"] * lat_ways[b" he"][path[cut:]] / total[b" he"]
        assert abs(count / n - want) < 0.02


def test_token_files(spark, tmp_path):
    import zlib

    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    data = rows() + [(300 + i, t, "en", "a", 1, "", "", "", "") for i, t in enumerate(["it's WE'LL", "a\xa0b\x85c <|endoftext|>", "İstanbul ΑΣ Σ ﬁ", prose(40, 4000, 9000)])]
    df = frame(spark, data)
    files = token_files.write_token_files(df, path, f"file://{tmp_path}/t", seq=64, bucket_bytes=20_000)
    assert files.count() > 1
    got = token_files.read_token_files(files).collect()
    enc = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r[0], len(enc(r[1])), crc(enc(r[1]))) for r in data)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order if r["doc_id"] is not None] == sorted(r[0] for r in data if r[0] is not None)
    at = 0
    for r in order:
        assert r["start"] == at
        at += r["n_tokens"]
    first = files.orderBy("bucket").first()
    ids, mask = token_files.sequence(first["path"], 0)
    assert len(ids) == 64 and mask.dtype == bool
    assert token_files.token_files(empty(spark), path).count() == 0


# --- independent versions -----------------------------------------------------------


def brute_lines(text):
    """The line rules and the verdict, word by word."""
    phrases = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "accept cookies", "cookie policy", "licensed under", "released under the", "click here", "lorem ipsum", "enable javascript")
    gone = lost = chars = 0
    for line in text.split("\n"):
        words = WORD.findall(line)
        if not words:
            continue
        n = len(words)
        runs = sum(line[i] in "!?" and line[i - 1] in "!?" for i in range(1, len(line)))
        strewn = sum(c in "#*$%&<" for c in line)
        bars = sum(c in "|>" for c in line)
        low = "".join(c.lower() if c.isascii() else c for c in line)
        last = words[-1]
        for _ in range(2):
            last = last[:-1] if last[-1:] and last[-1] in "\"')]»”’“」）" else last
        open_end = not last or last[-1] not in ".!?:;…。！？।؟۔։።"
        links = sum(low.count(x) for x in ("http://", "https://", "www."))
        bad = open_end or runs > 0.3 * n or strewn > 0.5 * n or (bars >= 3 and bars > 0.2 * n) or 2 * links >= n or any(p in low for p in phrases)
        size = sum(map(len, words))
        chars += size
        gone += bad
        lost += size * bad
    return gone, lost, lost <= 0.5 * chars


def test_quality_verdicts(spark):
    import random

    r = random.Random(5)
    bits = ["Click HERE now", "a | b | c > d", "wow!!", "really?! no!?", "$5 #1 *x", "&&& %%%", "a|b", "Terms of\tuse", "privacy policy é", "licensed under", "", " ", "x > y"]
    texts = ["\n".join(r.choice([prose(r.randrange(999), r.randrange(1, 30)), r.choice(bits), f"{r.choice(bits)} {r.choice(bits)} {prose(r.randrange(99), r.randrange(0, 6))}"]) + r.choice([".", ".", ".", "", "!", "。»", '."', "”)", "¿", ": see https://x.y", "…'"]) for _ in range(r.randrange(1, 14))) for _ in range(300)]
    got = quality.quality_rules(frame(spark, [(i, t, "en", "a", 1, "", "", "", "") for i, t in enumerate(texts)])).collect()
    kept = 0
    for row in got:
        gone, lost, fine = brute_lines(texts[row["doc_id"]])
        assert (row["n_removed_lines"], row["lost_chars"]) == (gone, lost), texts[row["doc_id"]]
        assert row["kept"] == (fine and not row["base_failed"])
        kept += row["kept"]
    assert 30 < kept < 270


def brute_language(model, text, penalty=12.0):
    """Scores word by word from trigrams, and a plain Viterbi."""
    words = [m for m in re.findall(r"[^\W\d_]+", text) if m.isalpha()]
    if not words or not model.langs:
        return "und", 0.0
    letters, path = sum(map(len, words)), []
    back, best = [], None
    for w in words:
        low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in w]
        total = np.zeros(len(model.langs))
        for i, c in enumerate(low):
            key = ((low[i - 1] if i else 0) << 42) ^ (c << 21) ^ (low[i + 1] if i + 1 < len(low) else 0)
            key = ((key ^ (key >> 29)) * 0xBF58476D1CE4E5B9) % (1 << 64)
            total += model.logp[key >> 48]
        script = next(s for a, s in reversed(((0, 0), *language_id.SCRIPTS)) if ord(w[0]) >= a)
        ok = model.uses[script]
        row = np.where(ok, total, -1e4 * len(w)) if ok.any() else np.zeros(len(model.langs))
        if best is None:
            best = row
        else:
            top = int(best.argmax())
            stay = best >= best[top] - penalty
            back.append(np.where(stay, np.arange(len(best)), top))
            best = np.where(stay, best, best[top] - penalty) + row
        path.append((len(w), bool(ok.any())))
    at = int(best.argmax())
    labels = [at]
    for step in reversed(back):
        at = int(step[at])
        labels.append(at)
    won = np.zeros(len(model.langs))
    for (n, known), lang in zip(path, labels[::-1], strict=True):
        won[lang] += n * known
    return (model.langs[int(won.argmax())] if won.max() > 0 else model.langs[model.most]), won.max() / letters


def test_language_against_plain_python(spark):
    from strandmill.llm.common import documents

    docs = documents(spark, "/root/testdata/sf0.001")
    model = language_id.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.filter("length(text) < 6000").limit(150).collect()}
    names = sorted(texts)
    texts |= {900_000 + i: (texts[names[i]] or "")[:300] + " " + (texts[names[-1 - i]] or "")[:300] for i in range(30)}
    texts |= {910_000: None, 910_001: "123 !", 910_002: "漢字", 910_003: "\U00032300"}
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    for i, t in texts.items():
        lang, score = brute_language(model, t or "")
        assert got[i]["lang_pred"] == lang, (i, t[:80])
        assert got[i]["score"] == pytest.approx(score, abs=1e-9)
    assert got[910_003]["lang_pred"] != "und"  # a letter, if a rare one


def brute_pieces(model, text, key):
    """Ids of one text: exact sums over all segmentations of each unit, drawn by the same numbers."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    weight, byte = {}, {}
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or " " in sp.id_to_piece(i)):
            weight[sp.id_to_piece(i).replace("▁", " ").encode()] = (i, 1 / (10.0 - sp.get_score(i)))
    raw, out = b" " + text.encode(), []
    seed = np.array([key], np.uint64)
    seed = piece_sampling.mix(seed)
    for m in re.finditer(rb" +[^ ]*|^[^ ]+", raw):
        unit, base = m[0], m.start()
        chars = [i for i in range(len(unit)) if unit[i] & 0xC0 != 0x80] + [len(unit)]
        into = {t: [] for t in range(len(unit) + 1)}
        for a, b in zip(chars, chars[1:], strict=False):
            for t in range(a + 1, len(unit) + 1):
                if unit[a:t] in weight:
                    piece, w = weight[unit[a:t]]
                    into[t].append((a, piece, w * 24.0 ** (t - a)))  # the same factor for every segmentation
            if unit[a:b] not in weight:
                for k in range(a, b):
                    into[k + 1].append((k, byte[unit[k]], 24.0e-5))
        mass = [1.0] + [0.0] * len(unit)
        for t in range(1, len(unit) + 1):
            mass[t] = sum(mass[f] * w for f, _, w in into[t])
        t, ids = len(unit), []
        while t:
            left = float(piece_sampling.uniform(seed, np.array([base + t]))[0])
            for f, p, w in sorted(into[t]):
                left -= mass[f] * w / mass[t]
                if left < 0:
                    break
            ids.append(p)
            t = f
        out += ids[::-1]
    return out


def test_pieces_against_plain_python(spark):
    path = tokenizer("piece_bpe_32k.model")
    texts = ["Hello world", "  two  blanks ", "naïve 漢字 😀\n▁x", "the quick brown fox jumps over the lazy dog", "a" * 40, "reproducibility of segmentations", "x" * 70 + " " + "漢字かな" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {r["doc_id"]: r["key"] for r in df.selectExpr("doc_id", "xxhash64(cast(doc_id as string)) AS key").collect()}
    got = {r["doc_id"]: r["ids"] for r in piece_sampling.encode_sampled(df, path, with_ids=True).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_pieces(path, t, keys[i] % (1 << 64)), t


def test_very_long_texts(spark):
    """Texts of over a megabyte, one of them without a blank, go through every row operator whole."""
    long, solid = prose(40, 260_000, 50_000), "漢字かな" * 100_000
    data = [(1, long, "en", "a", 1, "", "", "", ""), (2, solid, "ja", "a", 1, "", "", "", "")]
    assert len(long) > 1_500_000
    df = frame(spark, data)
    got = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    assert (got[1]["n_words"], got[2]["n_words"]) == (260_000, 1)
    pieces = {r["doc_id"]: r for r in piece_sampling.encode_sampled(df, tokenizer("piece_bpe_32k.model")).collect()}
    assert pieces[1]["lossless"] and pieces[2]["lossless"]
    files = token_files.token_files(df, tokenizer("word_bpe_49k.json")).collect()
    assert sorted(r["doc_id"] for r in files) == [1, 2]


def test_token_buckets_follow_bytes(spark, tmp_path):
    """Buckets are cut by text, not by rows, however the texts are spread."""
    data = [(i, prose(i, 2 if i < 400 else 300), "en", "a", 1, "", "", "", "") for i in range(450)]
    cuts = token_files.bucket_cuts(frame(spark, data).select("doc_id", "text").repartition(3), 20_000)
    sizes = Counter()
    for i, t, *_ in data:
        sizes[int(np.searchsorted(cuts, i, side="right"))] += len(t)
    assert len(sizes) > 3 and max(sizes.values()) < 24_000


def test_rows_of_one_hash_are_cut_evenly(spark):
    data = [(None, prose(i, 10), "en", "a", 1, "", "", "", "") for i in range(200)] + [(i, prose(i, 10), "en", "a", 1, "", "", "", "") for i in range(50)]
    got = sharding.extendible_shards(frame(spark, data).repartition(3), max_bytes=500).collect()
    assert len(got) == 250 and not any(r["oversize"] for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] is None}) > 10


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGS", 3)
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(frame(spark, [(i, prose(i, 20), f"l{i}", "a", 1, "", "", "", "") for i in range(30)]))
