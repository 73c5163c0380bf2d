"""Substring dedup by prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of a document; a window whose words also
start earlier (smaller doc_id, or earlier in the same document) is a repeat, and
every word it covers is removed.

1. *Anchors.* Of the k-word prefixes inside a window the one with the least hash
   anchors it: equal windows have equal anchors at equal offsets. Windows that
   follow one another mostly share an anchor, so one row stands for about six
   windows, and only the suffixes that start at anchors are indexed. A prefix that
   occurs once in the corpus holds no repeat and goes. Of a prefix that a task has met
   twice, later anchors are known to repeat and are spread freely, so a common one
   sends a few rows a task to where it is counted.
2. *Prefix partition.* The text around each remaining anchor, written once, is dealt
   to the group of its prefix. Groups are counted; those of more than ``limit`` segments
   are split by longer prefixes (``DEPTHS`` words), window by window, until every group
   fits before any task takes it. A window read from its anchor on, then outward to its
   left, is a string of 20 words, so at 20 a group holds copies of one window: its
   earliest is a minimum, summed before the shuffle.
3. *Subtrees.* Each group's suffix tree is built level by level from its anchors, on
   real words, to the right and to the left; leaves are cut off as they appear. The
   occurrences under one node at depth 20 - o to the right and o to the left are a
   repeat of 20 words whose anchor lies at o; runs of them are the maximal repeats. All
   but the earliest of each node are removed.
4. *Removal.* Repeats join their document once more and its words are cut.

Before step 2 each task writes a segment of text once, however many of its
documents hold it: the later ones are repeats of the first (documents come in
order), so a passage that a third of all documents share does not pile up.

Edge cases: null and empty texts have no words; texts below 20 words lose
nothing; a null doc_id comes first; rows that repeat a doc_id are ordered by a
hash of their text, and rows that repeat both by chance of storage; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import bounded_batches, only_repeated, stage, stage_mapped, text_slices, unique_rows
from strandmill.llm.textscan import gram_hash, span_hash, word_spans

WINDOW, PREFIX = 20, 10
#: Prefix lengths, in words, by which a group that is too large is split.
DEPTHS = (12, 15, WINDOW)
#: Segments of about 25 words that a group may hold.
GROUP_SEGMENTS, SEEN_SEGMENTS = 20_000, 200_000
_CACHE = 1 << 20
_POS_BITS = np.uint64(22)


def anchors(h: np.ndarray, doc: np.ndarray, window: int = WINDOW, k: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: prefix hash, first window start, anchor's offset in it, number of windows."""
    span = window - k + 1
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none.astype(np.uint64), none, none, none
    g = gram_hash(h, k)
    # the least hash, leftmost where equal; the position rides in the low bits
    pos = np.arange(len(g), dtype=np.uint64)
    shift = np.uint64(max(int(_POS_BITS), int(len(g)).bit_length()))
    v = ((g >> shift) << shift) | pos
    width = 1
    while 2 * width <= span:
        v = np.minimum(v[: len(v) - width], v[width:])
        width *= 2
    if width < span:
        v = np.minimum(v[: len(v) - (span - width)], v[span - width :])
    starts = np.flatnonzero(doc[: len(v)] == doc[window - 1 :])
    if len(starts) == 0:
        return none.astype(np.uint64), none, none, none
    at = (v[starts] & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    return g[at[head]], starts[head], at[head] - starts[head], np.diff(np.concatenate([head, [len(starts)]]))


class Met:
    """Keys met before in a task: a cache that may forget a key, but never claims one."""

    def __init__(self, size: int = _CACHE):
        self.key, self.n, self.mask = np.zeros(size, np.uint64), np.zeros(size, np.uint8), np.uint64(size - 1)

    def twice(self, key: np.ndarray) -> np.ndarray:
        """Which keys were met at least twice before, in earlier calls or earlier in this one; then counts these."""
        slot = (key & self.mask).astype(np.int64)
        known = (self.key[slot] == key) & (self.n[slot] >= 2)
        order = np.argsort(key, kind="stable")
        known[order[2:]] |= key[order[2:]] == key[order[:-2]]
        new, count = np.unique(key[~known], return_counts=True)
        slot = (new & self.mask).astype(np.int64)
        same = self.key[slot] == new
        put = same | (self.n[slot] < 2)
        total = np.where(same, self.n[slot], 0) + np.minimum(count, 2)
        self.key[slot[put]], self.n[slot[put]] = new[put], np.minimum(total[put], 2)
        # two new keys may share a slot: the count is sure only for the one that stands there
        lost = put & (self.key[slot] != new)
        self.n[slot[lost]] = np.minimum(self.n[slot[lost]], 1)
        return known


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met = Met()
    for batch in batches:
        for lo, hi, data, offs in text_slices(batch.column(2)):
            ws, we, first = word_spans(data, offs)
            doc = np.repeat(np.arange(hi - lo), np.diff(first))
            key, start, offset, count = anchors(span_hash(data, ws, we), doc)
            owner = doc[start] if len(start) else start
            loc = ((start - first[owner]) << 8) | (offset << 4) | (count - 1)
            rows = pa.array(owner + lo)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(loc), pa.array(met.twice(key))], ["key", "doc_id", "part", "loc", "known"])


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors (key, doc_id, part, loc, known), the unknown first and sorted by key: those that are known to repeat or do."""
    passed: list[pa.RecordBatch] = []

    def asked() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(4)
            passed.append(batch.filter(known))
            yield batch.filter(pa.compute.invert(known))

    for batch in only_repeated(asked()):
        yield batch
        yield from passed
        passed.clear()
    yield from passed


_ANCHOR = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("loc", pa.int64())])
_ANCHOR_SQL = "key long, doc_id long, part int, loc long"
_SEGMENT = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("loc", pa.int64()), ("segment", pa.binary()), ("repeats", pa.int64())])
_SEGMENT_SQL = "key long, doc_id long, part int, loc long, segment binary, repeats long"


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order, with their anchors, to segments of text; what this task has written before is a repeat at once."""
    seen: set[bytes] = set()
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            out: list[tuple] = []
            for doc_id, n, text, marks in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                words = text.encode().split()
                run_from = run_to = -1
                for m in sorted(marks, key=lambda x: x["loc"]):
                    loc = m["loc"]
                    start, count = loc >> 8, (loc & 15) + 1
                    segment = b" ".join(words[start : start + count + WINDOW - 1])
                    # equal segments have equal anchors
                    digest = hashlib.blake2b(segment, digest_size=16).digest()
                    if digest not in seen:
                        if len(seen) >= SEEN_SEGMENTS:
                            seen.clear()
                        seen.add(digest)
                        out.append((m["key"], doc_id, n, loc, segment, 0))
                    elif start == run_to:
                        run_to = start + count
                    else:
                        if run_to > run_from:
                            out.append((m["key"], doc_id, n, run_from, None, run_to - run_from))
                        run_from, run_to = start, start + count
                if run_to > run_from:
                    out.append((m["key"], doc_id, n, run_from, None, run_to - run_from))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SEGMENT, strict=True)], schema=_SEGMENT)


def _lengthen(depth: int):
    """Segments to their single windows, keyed by ``depth`` words: from the anchor to the window's end, then outward to its left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for _, doc_id, part, loc, segment, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, start, offset = segment.split(b" "), loc >> 8, loc >> 4 & 15
                for i in range((loc & 15) + 1):
                    window, o = words[i : i + WINDOW], offset - i
                    prefix = (window[o:] + window[:o][::-1])[:depth]
                    key = hashlib.blake2b(b" ".join(prefix), digest_size=8, salt=bytes([o])).digest()
                    out.append((int.from_bytes(key, "little", signed=True), doc_id, part, (start + i) << 8 | o << 4, b" ".join(window), 0))
            cols = list(zip(*out, strict=True)) or [[]] * len(_SEGMENT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SEGMENT, strict=True)], schema=_SEGMENT)

    return run


def _levels(word: np.ndarray, at: np.ndarray, step: int, reach: np.ndarray, depth: int) -> list[np.ndarray]:
    """Nodes of a tree over the strings word[at], word[at + step], ..., ``reach`` words each: for each depth the node of each string, -1 once it is a leaf."""
    node, live = np.zeros(len(at), np.int64), np.arange(len(at))
    out = [node]
    for d in range(depth):
        live = live[reach[live] > d]
        names, size = np.unique(out[-1][live] * (int(word.max()) + 1) + word[at[live] + step * d], return_inverse=True, return_counts=True)[1:]
        inner = size[names] > 1
        node = np.full(len(at), -1)
        live = live[inner]
        node[live] = names[inner]
        out.append(node)
    return out


def subtree_repeats(rows: list[tuple]) -> list[tuple]:
    """Repeated windows among segments (doc_id, part, loc, bytes) of whole groups, as (doc_id, part, start, count)."""
    vocab: dict[bytes, int] = {}
    ids: list[int] = []
    begins = []
    for _, _, _, segment in rows:
        begins.append(len(ids))
        ids.extend(vocab.setdefault(w, len(vocab)) for w in segment.split(b" "))
    word = np.array(ids, np.int64)
    loc = np.array([r[2] for r in rows])
    offset, count = loc >> 4 & 15, (loc & 15) + 1
    begin = np.array(begins)
    size = np.diff(np.concatenate([begin, [len(word)]]))
    right = _levels(word, begin + offset, 1, size - offset, WINDOW)
    left = _levels(word, begin + offset - 1, -1, offset, WINDOW - PREFIX)
    order = np.lexsort(((loc >> 8) + offset, np.array([r[1] for r in rows]), np.array([-(1 << 63) if r[0] is None else r[0] for r in rows], np.int64)))
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    gone = np.zeros((len(rows), WINDOW - PREFIX + 2), bool)
    for o in range(WINDOW - PREFIX + 1):
        r, x = right[WINDOW - o], left[o]
        here = np.flatnonzero((r >= 0) & (x >= 0) & (offset - count < o) & (o <= offset))
        if len(here):
            name = np.unique(r[here] * (int(x.max()) + 1) + x[here], return_inverse=True)[1]
            first = np.full(int(name.max()) + 1, len(rows))
            np.minimum.at(first, name, rank[here])
            later = here[rank[here] != first[name]]
            gone[later, offset[later] - o] = True
    edge = np.diff(gone.astype(np.int8), axis=1, prepend=0)
    row, head = np.nonzero(edge == 1)
    tail = np.nonzero(edge == -1)[1]
    return [(rows[i][0], rows[i][1], (rows[i][2] >> 8) + a, b - a) for i, a, b in zip(row.tolist(), head.tolist(), tail.tolist(), strict=True)]


_MARK = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n", pa.int64())])
_MARK_SQL = "doc_id long, part int, start long, n long"


def _subtrees(limit: int):
    """Segments sorted by key, whole groups of them up to ``limit`` at a time, to repeated windows."""

    def marks(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _MARK, strict=True)], schema=_MARK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        for batch in batches:
            done: list[tuple] = []
            for k, doc_id, part, loc, segment, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key and len(held) >= limit // 2:
                    done += subtree_repeats(held)
                    held = []
                key = k
                held.append((doc_id, part, loc, segment))
            if done:
                yield marks(done)
        if held:
            yield marks(subtree_repeats(held))

    return run


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, removed, sha, texts = [], [], [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode().split() if text else []
                kept = words
                if marks:
                    gone = np.zeros(len(words) + 1, np.int64)
                    at = np.array([m["start"] for m in marks])
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + np.array([m["n"] for m in marks]) + WINDOW - 1, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
                joined = b" ".join(kept)
                n_words.append(len(words))
                removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    texts.append(joined.decode())
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), *[pa.array(texts, pa.string())] * with_text]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    return run


def partition_by_prefix(segments: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Segments in groups of at most ``limit`` under one key, and those of groups that even whole windows leave larger (None: there are none)."""
    settled, left = [], segments
    for depth in (*DEPTHS, None):
        large = stage(left.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(F.col("key").alias("large")), "large-groups")
        if large.isEmpty():
            settled.append(left)
            left = None
            break
        here = left["key"] == large["large"]
        settled.append(left.join(large, here, "left_anti"))
        left = left.join(large, here, "left_semi")
        if depth is not None:
            left = stage_mapped(left, _lengthen(depth), _SEGMENT, _SEGMENT_SQL, f"prefix-{depth}")
    return reduce(DataFrame.unionByName, settled), left


def repeated_windows(rows: DataFrame, limit: int = GROUP_SEGMENTS) -> DataFrame:
    """Repeats in (doc_id, part, text): runs of ``n`` repeated windows from word ``start`` on."""
    found = rows.mapInArrow(_find_anchors, f"{_ANCHOR_SQL}, known boolean")
    deal = F.when(F.col("known"), F.xxhash64("doc_id", "part", "loc")).otherwise(F.col("key"))
    found = stage_mapped(found.repartition(deal).sortWithinPartitions("known", "key"), _repeated_anchors, _ANCHOR, _ANCHOR_SQL, "anchors")
    per_doc = found.groupBy("doc_id", "part").agg(F.collect_list(F.struct("key", "loc")).alias("marks"))
    on = rows["doc_id"].eqNullSafe(per_doc["doc_id"]) & (rows["part"] == per_doc["part"])
    near = rows.join(per_doc, on).select(rows["doc_id"], rows["part"], "text", "marks").sortWithinPartitions("doc_id", "part")
    cut = stage_mapped(near, _cut_segments, _SEGMENT, _SEGMENT_SQL, "segments")
    at_once = cut.filter("repeats > 0").select("doc_id", "part", F.col("loc").alias("start"), F.col("repeats").alias("n"))
    groups, copies = partition_by_prefix(cut.filter("repeats = 0"), limit)
    marks = stage_mapped(groups.repartition("key").sortWithinPartitions("key"), _subtrees(limit), _MARK, _MARK_SQL, "repeats").unionByName(at_once)
    if copies is not None:  # copies of one window, and the earliest of them
        first = stage(copies.groupBy("segment").agg(F.min(F.struct("doc_id", "part", "loc")).alias("first")), "firsts")
        later = copies.join(first, "segment").filter(~F.struct("doc_id", "part", "loc").eqNullSafe(F.col("first")))
        marks = marks.unionByName(stage(later.select("doc_id", "part", F.shiftright("loc", 8).alias("start"), F.lit(1).cast("long").alias("n")), "copies"))
    return marks


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = GROUP_SEGMENTS, with_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text."""
    df = bounded_batches(df)
    rows = unique_rows(df, id_col, text_col)
    marks = repeated_windows(rows, limit).groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    on = rows["doc_id"].eqNullSafe(marks["doc_id"]) & (rows["part"] == marks["part"])
    return rows.join(marks, on, "left").select(rows["doc_id"], "text", "marks").mapInArrow(_cut(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))
