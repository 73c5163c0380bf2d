"""N-gram Jaccard join by universe partition and pigeonhole.

A document's set holds its distinct n-word shingles (hashed to 64 bits). Sets of
sizes s <= r with similarity t differ in at most ``(s + r)(1 - t)/(1 + t)`` tokens.
Sizes are cut into bands such that linked sets lie in one band or in neighbours;
the *scheme* of a band hashes the universe into segments, and every set signs
under the scheme of its band and of the band below. With segments that may differ
by v (0: the segment's subset itself; 1: the subset or any one-deletion of it)
and sum(v + 1) = H + 1 above the largest difference H, some segment of a linked
pair is within its v, so both share a signature. How many segments get v = 1 is
chosen for each scheme by cost: signatures to write against pairs expected by
chance among that band's sets. Empty segments say nothing (one token under v = 1 says
as much as v = 0), so a scheme has some segments to spare; a set whose others do not sum
to H + 1 signs again under an independent partition, and no signature is shared merely
for being empty.

Equal sets are one class from the start. The most central set of each signature's
group is compared exactly with the others; groups that are one component then are
done. In the rest, sets are compared by *parity sketches*: bit ``h mod B`` of a sketch
is the parity of the tokens that hash there, so two sketches never differ in more bits
than their sets in tokens, and a pair whose sketches differ in more than H bits is no
link. Pairs that pass tie sets into families. A family's sets are cut into blocks of
bounded size, where overlaps are counted on bit sets, and only links that join
components come out. A component that fills blocks of its own is never compared with
itself. Sizes, centres and members of groups are aggregates and joins, large groups
are dealt over units of work, and pairs of sets are rows only with a group's centre. No
link that would join two components is lost.

Edge cases: null texts, and texts without words, have an empty set, link with
nothing and are their own component; texts below n words have one shingle, the
whole; a null doc_id keeps its own row and never names a component unless all are
null; repeated rows are one class; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import bounded_batches, only_repeated, running_sum, stage, text_slices, unique_rows
from strandmill.llm.textscan import LOWER, gram_hash, mix, span_hash, word_spans

NUM, DEN, SHINGLE = 90, 100, 3
LEVELS, PAIR_COST = 4, 8.0
#: Estimated share of unrelated pairs that have a given word's successor in common; a shingle of n words is common with the n-th power. It moves cost, never results.
WORD_CHANCE = 0.3
BLOCK_TOKENS, UNIT_ROWS = 1 << 17, 2048
_U = np.uint64


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and the bounds (n_docs + 1)."""
    low = LOWER[data]
    ws, we, first = word_spans(low, offs)
    h = span_hash(low, ws, we)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    g = gram_hash(h, n)
    start = np.flatnonzero(doc[: len(g)] == doc[n - 1 :]) if len(g) else np.zeros(0, np.int64)
    tokens, owner = [g[start]], [doc[start]]
    for d in np.flatnonzero((counts > 0) & (counts < n)).tolist():
        k = counts[d]
        tokens.append(gram_hash(h[first[d] : first[d] + k], int(k)) ^ _U(0x5851F42D4C957F2D * int(k) & (1 << 64) - 1))
        owner.append(np.array([d]))
    token, own = np.concatenate(tokens), np.concatenate(owner)
    order = np.lexsort((token, own))
    token, own = token[order], own[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
    token, own = token[new], own[new]
    return token, np.searchsorted(own, np.arange(len(counts) + 1))


@cache
def band_starts(num: int, den: int, most: int) -> np.ndarray:
    """First size of each band, beyond ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, den * (out[-1] - 1) // num + 1))
    return np.array([*out, den * (out[-1] - 1) // num + 1 + out[-1]])


def differ(num: int, den: int, band: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Largest symmetric difference of a linked pair whose smaller set lies in the band."""
    s = starts[band + 1] - 1
    return (s + den * s // num) * (den - num) // (den + num)


@cache
def segments(h: int, q: int, size: float) -> int:
    """Segments of a scheme, q of them with v = 1: as many as most sets of ``size`` tokens need to reach h + 1 without their empty ones."""
    m = h + 1 - q
    while m < 2 * (h + 1):
        none = math.exp(-size / m)
        one = size / m * none
        strength = (m - q) * (1 - none) + q * (2 - 2 * none - one)
        if strength - math.sqrt(m * none + q * one) >= h + 1:
            return m
        m += 1
    return h + 1 - q


def one_deletions(h: int, size: float, sets: float, chance_of_token: float = WORD_CHANCE**SHINGLE) -> int:
    """How many segments of a scheme get v = 1: the cheapest split of h + 1 by expected cost for each set."""
    best, pick = math.inf, 0
    for q in range(0, (h + 1) // 2 + 1):
        m = segments(h, q, size)
        each = size / m
        written = (m - q) + q * (1 + each)
        chance = sets * ((m - q) * chance_of_token**each + q * (1 + each) * chance_of_token ** max(each - 1, 0))
        if written + PAIR_COST * chance < best:
            best, pick = written + PAIR_COST * chance, q
    return pick


def signatures(token: np.ndarray, at: np.ndarray, scheme: np.ndarray, h: np.ndarray, q: np.ndarray, parts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets token[at[i]:at[i+1]] under their scheme of ``parts`` segments (h + 1 - q at least): (signature, set number)."""
    sig_out, set_out = [], []
    parts = h + 1 - q if parts is None else parts
    live = np.flatnonzero(h > 0)
    value = mix(token ^ _U(0xA0761D6478BD642F))
    for level in range(LEVELS):
        if len(live) == 0:
            break
        size = at[live + 1] - at[live]
        row = np.repeat(np.arange(len(live)), size)
        index = np.repeat(at[live] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        m = parts[live].astype(np.int64)
        base = np.cumsum(m) - m
        draw = mix(token[index] + _U((0x9E3779B97F4A7C15 * (level + 1)) & (1 << 64) - 1)) >> _U(32)
        seg = ((draw * m[row].astype(np.uint64)) >> _U(32)).astype(np.int64)
        flat = base[row] + seg
        total = int(m.sum())
        count = np.bincount(flat, minlength=total)
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, flat, value[index])
        owner = np.repeat(np.arange(len(live)), m)
        number = np.arange(total) - base[owner]
        salt = mix(scheme[live][owner].astype(np.uint64) * _U(1 << 36) + number.astype(np.uint64) * _U(8) + _U(level))
        single = number < q[live][owner]
        full = count > 0
        sig_out.append(mix(sums[full] + salt[full]) ^ count[full].astype(np.uint64))
        set_out.append(live[owner[full]])
        drop = np.flatnonzero(single[flat] & (count[flat] > 1))
        f = flat[drop]
        sig_out.append(mix(sums[f] - value[index[drop]] + salt[f]) ^ (count[f] - 1).astype(np.uint64))
        set_out.append(live[row[drop]])
        # a pair without a shared signature differs by this much at least
        strength = np.bincount(owner, np.where(single, np.minimum(count, 2), full), len(live))
        weak = strength < h[live] + 1
        if level == LEVELS - 1:  # the least set of all partitions: shares what is left
            bare = np.where(single, count <= 1, count == 0) & weak[owner]
            sig_out.append(mix(salt[bare]))
            set_out.append(live[owner[bare]])
        live = live[weak]
    if not sig_out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sig_out), np.concatenate(set_out)


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch.column(2)):
                token, at = shingle_sets(data, offs, n)
                a = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token))])
                b = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token ^ _U(0xE7037ED1A0B428DB)))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array((a[at[1:]] - a[at[:-1]]).view(np.int64)), pa.array((b[at[1:]] - b[at[:-1]]).view(np.int64))], ["doc_id", "part", "n_shingles", "fa", "fb"])

    return run


def _sign(n: int, num: int, den: int, chosen: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = batch.column(0).to_numpy()
            for lo, hi, data, offs in text_slices(batch.column(1)):
                token, at = shingle_sets(data, offs, n)
                size = np.diff(at)
                starts = band_starts(num, den, 1 << int(size.max(initial=1)).bit_length())
                band = np.searchsorted(starts, size, side="right") - 1
                for below in (0, 1):
                    scheme = band - below
                    h = np.where((size > 0) & (scheme >= 0), differ(num, den, np.maximum(scheme, 0), starts), 0)
                    q = np.array([min(chosen.get(s, 0), (x + 1) // 2) for s, x in zip(scheme.tolist(), h.tolist(), strict=True)])
                    parts = np.array([segments(int(x), int(y), float(z)) for x, y, z in zip(h, q, starts[np.maximum(scheme, 0)], strict=True)])
                    sig, who = signatures(token, at, scheme, h, q, parts)
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(cid[lo + who]), pa.array(size[who])], ["sig", "cid", "n"])

    return run


def block_links(cid: np.ndarray, comp: np.ndarray, side: np.ndarray, tokens: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join components among the sets of one or two blocks (``side`` 0 and 1), by exact overlaps.

    Tokens that stand in several sets become bits; overlaps of one set with all
    others are counted at once. Pairs already connected are passed over, so a block
    gives at most one link less than it has sets.
    """
    flat = np.concatenate(tokens)
    size = np.array([len(t) for t in tokens])
    owner = np.repeat(np.arange(len(tokens)), size)
    _, name, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count[name] > 1
    _, bit = np.unique(name[common], return_inverse=True)
    words = int(bit.max()) // 64 + 1 if len(bit) else 1
    bits = np.zeros((len(tokens), words), np.uint64)
    np.bitwise_or.at(bits, (owner[common], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    label = np.unique(comp, return_inverse=True)[1].copy()
    two, out = len(np.unique(side)) > 1, []
    for i in range(len(tokens)):
        late = np.arange(len(tokens)) > i
        ask = np.flatnonzero((side != side[i] if two else late) & (label != label[i]) & (late | two) & (den * np.minimum(size, size[i]) >= num * np.maximum(size, size[i])))
        if two and side[i]:
            break
        if len(ask) == 0:
            continue
        both = np.bitwise_count(bits[ask] & bits[i]).sum(1).astype(np.int64)
        for k in ask[den * both >= num * (size[ask] + size[i] - both)].tolist():
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                out.append((min(int(cid[i]), int(cid[k])), max(int(cid[i]), int(cid[k]))))
    return out


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of a set's tokens over at least twice as many bits as it has tokens, a power of two of 64 or more."""
    width = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    bit = (mix(tokens ^ _U(0x8EBC6AF09C88C6E3)) & _U(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, the wider ones folded to the width of the narrowest."""
    width = min(map(len, sketches)) // 8
    rows = np.zeros((len(sketches), width), np.uint64)
    for i, raw in enumerate(sketches):
        rows[i] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, width), axis=0)
    return rows


def _may_link(num: int, den: int):
    """Of pairs (a, b, n of a, n of b, sketch of a, sketch of b) those whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            apart = np.array([int(np.bitwise_count(np.bitwise_xor(*folded([p, q]))).sum()) for p, q in zip(x, y, strict=True)], np.int64)
            keep = pa.array(apart * (den + num) <= n * (den - num))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def ties(cid: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, sketches: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs that sketches allow, between sets of different components, as few as tie together all sets that such pairs connect."""
    rows, label, two, out = folded(sketches), np.arange(len(cid)), len(np.unique(side)) > 1, []
    for i in range(len(cid)):
        late = np.flatnonzero((side != side[i]) if two else (np.arange(len(cid)) > i))
        if two and side[i]:
            break
        ask = late[(comp[late] != comp[i]) & (label[late] != label[i]) & (den * np.minimum(n[late], n[i]) >= num * np.maximum(n[late], n[i]))]
        if len(ask) == 0:
            continue
        apart = np.bitwise_count(rows[ask] ^ rows[i]).sum(1).astype(np.int64)
        for k in ask[apart * (den + num) <= (n[ask] + n[i]) * (den - num)].tolist():
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                out.append((min(int(cid[i]), int(cid[k])), max(int(cid[i]), int(cid[k]))))
    return out


def _by_unit(rows_of: Callable):
    """Body over rows sorted by their first column: pairs (a, b) that ``rows_of`` finds among the rows of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], []

        def pairs() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for unit, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if unit != key:
                    if len(held) > 1:
                        found += rows_of(held)
                    key, held = unit, []
                held.append(row)
            yield pairs()
            found = []
        if len(held) > 1:
            found = rows_of(held)
        yield pairs()

    return run


def _ties(num: int, den: int):
    def rows_of(held: list[list]) -> list[tuple[int, int]]:
        cid, n, comp, side, raw = zip(*held, strict=True)
        return ties(np.array(cid), np.array(n), np.array(comp), np.array(side), list(raw), num, den)

    return _by_unit(rows_of)


def _block_links(num: int, den: int):
    def rows_of(held: list[list]) -> list[tuple[int, int]]:
        cid, comp, side, raw = zip(*held, strict=True)
        return block_links(np.array(cid), np.array(comp), np.array(side), [np.frombuffer(r, np.uint64) for r in raw], num, den)

    return _by_unit(rows_of)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch.column(1)):
                token, at = shingle_sets(data, offs, n)
                each = [token[at[i] : at[i + 1]] for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in each], pa.int64()), pa.array([sketch(t) for t in each], pa.binary()), pa.array([t.tobytes() for t in each], pa.binary())], ["cid", "n", "sketch", "tokens"])

    return run


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, r = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, r, assume_unique=True))
                ok.append(den * both >= num * (len(s) + len(r) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node, comp (least node) of every node but the least, by alternating large-star and small-star steps on staged tables."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        edges = stage(small, "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = now


def _pivot(groups: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links of the most central set of each group (sig, cid, n) to the others, and the groups without it.

    The most central set shares most signatures with most sets.
    """
    size = groups.groupBy("sig").agg(F.count("*").alias("size"))
    weight = stage(groups.join(stage(size, "group-sizes"), "sig").groupBy("cid").agg(F.sum(F.col("size") - 1).alias("weight")), "weights")
    hub = F.max(F.struct("weight", (-F.col("cid")).alias("order"), "cid", "n")).alias("h")
    hubs = groups.join(weight, "cid").groupBy("sig").agg(hub).select("sig", F.col("h.cid").alias("hub"), F.col("h.n").alias("hub_n"))
    met = groups.join(stage(hubs, "hubs"), "sig").filter("cid != hub")
    fits = F.least("n", "hub_n") * den >= F.greatest("n", "hub_n") * num
    pairs = met.filter(fits).select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
    seen = [sets.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab"]
    pairs = stage(pairs.join(seen[0], "a").join(seen[1], "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_may_link(num, den), "a long, b long"), "pairs")
    whole = [sets.select(F.col("cid").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab"]
    links = pairs.join(whole[0], "a").join(whole[1], "b").select("a", "b", "ta", "tb").mapInArrow(_verified(num, den), "a long, b long")
    return stage(links, "links"), met.select("sig", "cid", "n")


def _families(groups: DataFrame, comp: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Sets (cid, n, now, family) of the groups that sketches tie to a set of another component.

    A group of more than UNIT_ROWS sets is dealt over blocks by a hash, each pair of
    blocks one unit.
    """
    groups = groups.join(comp, groups["cid"] == comp["node"], "left").select("sig", "cid", "n", F.coalesce("comp", "cid").alias("now"))
    torn = groups.groupBy("sig").agg(F.count("*").alias("size"), F.min("now").alias("lo"), F.max("now").alias("hi")).filter("lo != hi")
    torn = stage(torn.select("sig", F.ceil(F.col("size") * 2 / UNIT_ROWS).cast("int").alias("blocks")).withColumn("blocks", F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks"))), "torn")
    left = groups.join(torn, "sig").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    unit = F.struct("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    left = left.withColumn("other", other).select(unit.alias("unit"), "cid", "n", "now", (F.col("block") > F.col("other")).cast("int").alias("side"))
    left = left.join(sets.select("cid", "sketch"), "cid").select(F.xxhash64("unit").alias("deal"), "unit", "cid", "n", "now", "side", "sketch")
    left = left.repartition("deal").sortWithinPartitions("deal", "unit", "side").drop("deal")
    tied = components(stage(left.select(F.to_json("unit").alias("unit"), "cid", "n", "now", "side", "sketch").mapInArrow(_ties(num, den), "a long, b long"), "ties"))
    # a family is named by its least member, which is no node of its own
    member = stage(tied.select(F.explode(F.array("node", "comp")).alias("cid"), F.col("comp").alias("family")).distinct(), "tied")
    member = member.join(sets.select("cid", "n"), "cid").join(comp, F.col("cid") == comp["node"], "left")
    return member.select("cid", "n", F.coalesce(comp["comp"], "cid").alias("now"), "family")


def _units(member: DataFrame, num: int, den: int) -> DataFrame:
    """Work on families (cid, n, now, family): unit, cid, now, side.

    A family's sets, in order of size, are cut into blocks of about BLOCK_TOKENS, and
    each pair of blocks whose sizes can link at all is one unit. A component of more
    tokens than a block has blocks of its own, and no unit holds two of these.
    """
    member = member.withColumn("cost", F.greatest("n", F.lit(128)))
    large = stage(member.groupBy("family", "now").agg(F.sum("cost").alias("all")).filter(F.col("all") >= BLOCK_TOKENS).select("family", "now", F.col("now").alias("own")), "large")
    member = member.join(large, ["family", "now"], "left").withColumn("home", F.coalesce("own", F.lit(-1)))
    # rows of one size are dealt over cells by a hash, so that no cell holds a large part of a family
    member = stage(member.select("cid", "n", "now", "family", "home", "cost", F.pmod(F.xxhash64("cid"), F.lit(64)).alias("deal")), "members")
    member = running_sum(member, ["family", "home"], ["n", "deal", "cid"], "cost", "at", F.col("n") * 64 + F.col("deal"))
    member = stage(member.select("cid", "n", "now", "family", "home", F.floor(F.col("at") / BLOCK_TOKENS).alias("block")), "blocks")
    span = member.groupBy("family", "home", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    p, q = (span.select("family", *[F.col(c).alias(f"{c}{k}") for c in ("home", "block", "lo", "hi")]) for k in "ij")
    order = F.struct("homei", "blocki") <= F.struct("homej", "blockj")
    apart = (F.col("homei") != F.col("homej")) | (F.col("homei") == -1)
    near = (F.col("hii") * den >= F.col("loj") * num) & (F.col("hij") * den >= F.col("loi") * num)
    units = stage(p.join(q, "family").filter(order & apart & near).withColumn("unit", F.monotonically_increasing_id()), "units")
    first = units.select("unit", "family", F.col("homei").alias("home"), F.col("blocki").alias("block"), F.lit(0).alias("side"))
    second = units.filter("homei != homej OR blocki != blockj").select("unit", "family", F.col("homej").alias("home"), F.col("blockj").alias("block"), F.lit(1).alias("side"))
    return member.join(first.unionByName(second), ["family", "home", "block"]).select("unit", "cid", "now", "side")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class_size, row key ``part``.

    ``component_id`` is the least doc_id that links of similarity >= num/den
    reach; ``class_size`` the number of rows with the same set.
    """
    df = bounded_batches(df)
    rows = unique_rows(df, id_col, text_col)
    prints = stage(rows.mapInArrow(_fingerprints(shingle), "doc_id long, part int, n_shingles long, fa long, fb long"), "prints")
    classes = prints.filter("n_shingles > 0").groupBy("n_shingles", "fa", "fb").agg(F.min(F.struct("doc_id", "part")).alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("class_size"))
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    # cost-based allocation: sets of about each size
    hist = classes.groupBy(F.floor(F.log("n_shingles") * 32).alias("b")).agg(F.avg("n_shingles").alias("size"), F.count("*").alias("sets")).collect()
    starts = band_starts(num, den, 1 << int(max((r["size"] for r in hist), default=1)).bit_length() + 1)
    held: dict[int, float] = {}
    for r in hist:
        b = int(np.searchsorted(starts, r["size"], side="right")) - 1
        held[b] = held.get(b, 0) + r["sets"]
    chosen = {b: one_deletions(int(differ(num, den, np.array([b]), starts)[0]), float(starts[b]), sets, WORD_CHANCE**shingle) for b, sets in held.items()}
    chosen = {b: q for b, q in chosen.items() if q}

    reps = classes.select("cid", F.col("rep.doc_id").alias("rid"), F.col("rep.part").alias("rpart"))
    on = rows["doc_id"].eqNullSafe(reps["rid"]) & (rows["part"] == reps["rpart"])
    signed = rows.join(reps, on).select("cid", "text").mapInArrow(_sign(shingle, num, den, chosen), "sig long, cid long, n long")
    near = stage(signed.repartition("sig").sortWithinPartitions("sig").mapInArrow(only_repeated, signed.schema), "candidates")
    needed = near.select("cid").distinct().join(reps, "cid")
    on = rows["doc_id"].eqNullSafe(needed["rid"]) & (rows["part"] == needed["rpart"])
    sets = stage(rows.join(needed, on).select("cid", "text").mapInArrow(_sets(shingle), "cid long, n long, sketch binary, tokens binary"), "sets")

    links, groups = _pivot(near, sets, num, den)
    comp = components(links)
    member = stage(_families(groups, comp, sets, num, den), "families")
    if not member.isEmpty():
        work = _units(member, num, den).join(sets, "cid").select("unit", "cid", "now", "side", "tokens")
        found = work.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(_block_links(num, den), "a long, b long")
        comp = components(links.unionByName(stage(found, "links")))
    linked = classes.join(comp, classes["cid"] == comp["node"], "left").select("n_shingles", "fa", "fb", "least", "class_size", F.coalesce("comp", "cid").alias("comp"))
    heads = linked.groupBy("comp").agg(F.min("least").alias("component_id"), F.sum("class_size").alias("rows")).filter("rows > 1")
    special = stage(linked.join(heads, "comp").select("n_shingles", "fa", "fb", "component_id", "class_size"), "linked")
    out = prints.join(special, ["n_shingles", "fa", "fb"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "part")
