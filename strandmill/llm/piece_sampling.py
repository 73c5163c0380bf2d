"""SentencePiece encoding by sampling, and lossless decoding.

Pieces of a SentencePiece model span the lattice of every unit (a run of blanks
and the word after it; no piece crosses units). Forward filtering sums the
weights of all segmentations up to each byte; backward sampling then draws one
whole segmentation with its exact probability. The random numbers are hashes of
the row key and the byte position, so every run, partitioning and retry draws the
same. A piece's weight falls with its rank (Zipf); characters outside the
vocabulary are spelled in byte pieces. Decoding joins the pieces' bytes and
returns the text exactly, blanks and line breaks included.

Edge cases: null and empty texts have no ids and decode to the empty text; a
literal U+2581 is spelled in bytes, so it survives; rows that repeat a key and a
text draw alike; units above ``LONG_UNIT`` bytes are sampled in logarithms, one
by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import bounded_batches, text_slices
from strandmill.llm.textscan import mix, span_hash

LONG_UNIT, BLOCK, SHARPNESS = 64, 1 << 14, 1.0
_MARK = "▁"
_BLANK = 0x20


class Lattice:
    """The vocabulary as a byte trie, with piece weights."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.weight = np.zeros(n)
        self.byte_id = np.full(256, -1, np.int64)
        children: list[dict[int, int]] = [{}]
        ids: list[int] = [-1]
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_id[b], self.bytes[i], self.weight[i] = i, bytes([b]), 1e-5
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or " " in piece:
                continue
            self.bytes[i] = piece.replace(_MARK, " ").encode()
            self.weight[i] = (10.0 - sp.get_score(i)) ** -sharpness
            at = 0
            for b in self.bytes[i]:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    ids.append(-1)
                at = children[at][b]
            ids[at] = i
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces; decoding would not be lossless")
        self.piece = np.array(ids, np.int64)
        # child table over the byte values that occur, others share an empty column
        used = sorted({b for c in children for b in c})
        self.column = np.zeros(256, np.int64)
        self.column[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.child = np.full(len(children) * self.width, -1, np.int32)
        for at, c in enumerate(children):
            for b, to in c.items():
                self.child[at * self.width + self.column[b]] = to

    def edges(self, u: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All lattice edges (from, to, piece) over the bytes of the units [begin, end) that tile ``u``."""
        n = len(u)
        limit = np.repeat(end, end - begin)
        head = (u & 0xC0) != 0x80
        starts = np.flatnonzero(head)
        width = np.ones(n, np.int64)
        width[starts] = np.diff(np.concatenate([starts, [n]]))
        pos, node, k = starts, np.zeros(len(starts), np.int64), 0
        col = self.column[u]
        covered = np.zeros(n, bool)
        fr, to, pid = [], [], []
        while len(pos):
            inside = pos + k < limit[pos]
            pos, node = pos[inside], node[inside]
            node = self.child[node * self.width + col[pos + k]].astype(np.int64)
            live = node >= 0
            pos, node = pos[live], node[live]
            k += 1
            ids = self.piece[node]
            hit = ids >= 0
            fr.append(pos[hit])
            to.append(pos[hit] + k)
            pid.append(ids[hit])
            covered[pos[hit][width[pos[hit]] == k]] = True
        # characters that are no piece: byte by byte
        lone = starts[~covered[starts]]
        odd = np.zeros(n + 1, np.int64)
        np.add.at(odd, lone, 1)
        np.add.at(odd, lone + width[lone], -1)
        at = np.flatnonzero(np.cumsum(odd)[:-1])
        fr.append(at)
        to.append(at + 1)
        pid.append(self.byte_id[u[at]])
        return np.concatenate(fr), np.concatenate(to), np.concatenate(pid)


def uniform(seed: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A number in [0, 1) from a row's seed and a byte position of its text."""
    h = mix(seed + pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _sample_long(lat: Lattice, unit: np.ndarray, seed: int, base: int) -> list[tuple[int, int]]:
    """Segmentation of one long unit as (start, piece); ``base``: its byte position in the text.

    Edges stay packed and are unpacked a block of positions at a time, so memory is
    about 200 bytes for each byte of the unit.
    """
    n = len(unit)
    fr, to, pid = lat.edges(unit, np.array([0]), np.array([n]))
    order = np.lexsort((pid, fr, to))
    bounds = np.searchsorted(to[order], np.arange(n + 2))
    fr, pid = fr[order].astype(np.int32), pid[order].astype(np.int32)
    log = np.log(lat.weight, where=lat.weight > 0, out=np.full(len(lat.weight), -math.inf))
    alpha = [-math.inf] * (n + 1)
    alpha[0] = 0.0
    for block in range(1, n + 1, BLOCK):
        last = min(n + 1, block + BLOCK)
        lo = int(bounds[block])
        f, w, cut = fr[lo : bounds[last]].tolist(), log[pid[lo : bounds[last]]].tolist(), (bounds[block : last + 1] - lo).tolist()
        for t in range(block, last):
            terms = [alpha[f[e]] + w[e] for e in range(cut[t - block], cut[t - block + 1])]
            top = max(terms, default=-math.inf)
            if top > -math.inf:
                alpha[t] = top + math.log(sum(math.exp(x - top) for x in terms))
    out, t = [], n
    draws = uniform(np.full(n + 1, seed, np.uint64), base + np.arange(n + 1))
    while t:
        left = float(draws[t])
        for f, p in zip(fr[bounds[t] : bounds[t + 1]].tolist(), pid[bounds[t] : bounds[t + 1]].tolist(), strict=True):
            if alpha[f] > -math.inf:
                step = f, p
                left -= math.exp(alpha[f] + log[p] - alpha[t])
                if left < 0:
                    break
        out.append(step)
        t = step[0]
    return out[::-1]


def segment(lat: Lattice, data: np.ndarray, offs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled pieces of a slice: ids in text order, and the bounds of each document's ids."""
    n_docs = len(offs) - 1
    full = np.diff(offs) > 0
    # one blank before each text, as the model expects; it is dropped again in decoding
    text = np.insert(data, offs[:-1][full], _BLANK)
    at = offs + np.concatenate([[0], np.cumsum(full)])
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64)
    blank = text == _BLANK
    first = np.zeros(n, bool)
    first[at[:-1][full]] = True
    first[1:] |= blank[1:] & ~blank[:-1]
    us = np.flatnonzero(first)
    ue = np.concatenate([us[1:], [n]])
    doc = np.searchsorted(at, us, side="right") - 1
    seed = mix(keys.astype(np.uint64))
    out = np.full(n, -1, np.int64)

    long = ue - us > LONG_UNIT
    for i in np.flatnonzero(long).tolist():
        d = doc[i]
        for f, p in _sample_long(lat, text[us[i] : ue[i]], int(seed[d]), int(us[i] - at[d])):
            out[us[i] + f] = p
    us, ue, doc = us[~long], ue[~long], doc[~long]
    if len(us):
        _, pick, same = np.unique(span_hash(text, us, ue), return_index=True, return_inverse=True)
        size = (ue - us)[pick]
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        end = begin + size
        u = text[np.repeat(us[pick] - begin, size) + np.arange(int(end[-1]))]
        fr, to, pid = lat.edges(u, begin, end)
        owner = np.repeat(np.arange(len(size)), size)[fr]
        # nodes of unit i are begin[i] + i .. end[i] + i
        a, b = fr + owner, to + owner
        w = lat.weight[pid] * np.power(24.0, to - fr)  # the same factor for all segmentations of a unit
        depth = to - begin[owner]
        order = np.lexsort((a, b, depth))
        a, b, w, pid, depth = a[order], b[order], w[order], pid[order], depth[order]
        alpha = np.zeros(int(end[-1]) + len(size))
        alpha[begin + np.arange(len(size))] = 1.0
        cuts = np.searchsorted(depth, np.arange(1, int(size.max()) + 2))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if lo < hi:
                np.add.at(alpha, b[lo:hi], alpha[a[lo:hi]] * w[lo:hi])
        order = np.lexsort((a, b))
        a, b, w, pid = a[order], b[order], w[order], pid[order]
        mass = alpha[a] * w / alpha[b]
        group = np.concatenate([[True], b[1:] != b[:-1]])
        rank = np.cumsum(group) - 1
        acc = np.cumsum(mass)
        lead = np.flatnonzero(group)
        acc = np.minimum(acc - np.concatenate([[0.0], acc[lead[1:] - 1]])[rank], 1.0)
        acc[np.concatenate([lead[1:] - 1, [len(acc) - 1]])] = 1.0  # the last option takes what rounding leaves
        ladder = rank + acc
        rank_of = np.zeros(len(alpha), np.int64)
        rank_of[b] = rank
        stop = np.concatenate([lead[1:] - 1, [len(acc) - 1]])
        node = (end + np.arange(len(size)))[same]
        zero = (begin + np.arange(len(size)))[same]
        live = np.argsort(same, kind="stable")  # occurrences of a unit side by side: neighbours look up neighbouring steps
        while len(live):
            local = node[live] - zero[live]
            r = uniform(seed[doc[live]], us[live] + local - at[doc[live]])
            group = rank_of[node[live]]
            e = np.minimum(np.searchsorted(ladder, group + r, side="right"), stop[group])  # the sum may round up to the next step
            node[live] = a[e]
            out[us[live] + a[e] - zero[live]] = pid[e]
            live = live[a[e] > zero[live]]
    taken = out >= 0
    return out[taken], np.concatenate([[0], np.cumsum(taken)])[at]


def decode(lat: Lattice, ids: list[int]) -> bytes:
    """The UTF-8 text behind ids."""
    return b"".join(map(lat.bytes.__getitem__, ids))[1:]


_lattices: dict[tuple[str, float], Lattice] = {}


def lattice(path: str, sharpness: float) -> Lattice:
    """One lattice for each model and worker process."""
    if (path, sharpness) not in _lattices:
        _lattices[path, sharpness] = Lattice(path, sharpness)
    return _lattices[path, sharpness]


def _sampler(path: str, sharpness: float, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(path, sharpness)
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for lo, hi, data, offs in text_slices(batch.column(2)):
                ids, at = segment(lat, data, offs, keys[lo:hi])
                raw, low, listed = data.tobytes(), ids.astype("<u4"), ids.tolist()
                crc, sha, same = [], [], []
                for i in range(hi - lo):
                    back = decode(lat, listed[at[i] : at[i + 1]])
                    crc.append(zlib.crc32(low[at[i] : at[i + 1]].tobytes()))
                    sha.append(hashlib.sha256(back).hexdigest())
                    same.append(back == raw[offs[i] : offs[i + 1]])
                arrays = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same)]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless", *["ids"] * with_ids])

    return run


def _joiner(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(path, SHARPNESS)
        for batch in batches:
            texts = [decode(lat, ids or []).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def encode_sampled(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", sharpness: float = SHARPNESS, with_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_pieces, ids_crc32, decoded_sha256, lossless and, if asked, ids."""
    df = bounded_batches(df)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("string")).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_sampler(model_path, sharpness, with_ids), "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean" + (", ids array<int>" if with_ids else ""))


def decode_ids(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts behind lists of ids: doc_id, text."""
    df = bounded_batches(df)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(_joiner(model_path), "doc_id long, text string")
