"""Language identification of mixed-language text.

A model of character trigrams is fitted on a bounded sample of labelled rows
(about ``per_lang`` documents of each language, chosen by a hash of doc_id, no
more). Prediction scores every word of a whole text under each language whose
scripts include the word's (script ranges narrow the candidates), and a Viterbi
pass with a switching penalty labels spans. The document's language is the one
with most letters; its score is that language's share of all letters.

A constant labelling is provably optimal when no run of words gains the penalty,
and no first or last run half of it, under any other language; only other
documents need the full pass.

Edge cases: null texts and texts without a letter are ``und`` with score 0; so is
everything when no row is labelled; letters of scripts that no learned language
uses are unlabelled and count against the score, and a text of only such letters
gets the most common learned language with score 0; rows may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import bounded_batches, text_slices

PER_LANG, BUCKET_BITS, PENALTY, SMOOTH = 1500, 16, 12.0, 0.3
#: More labels than this are an error: the model holds 2**BUCKET_BITS numbers for each.
MOST_LANGS = 1000
#: Script ranges by first code point of each block group; 0 stands for any other.
SCRIPTS = ((0x41, 1), (0x250, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x900, 7), (0x980, 8), (0xA00, 9), (0xE00, 10), (0xE80, 0), (0x10A0, 11), (0x1100, 12), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 13), (0x3100, 0), (0x3400, 14), (0xA000, 0), (0xAC00, 12), (0xD7B0, 0), (0xF900, 14), (0xFB00, 0), (0x20000, 14), (0x323B0, 0))
N_SCRIPTS = 15


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: lower case (0 for what is no letter), is a letter, script."""
    n = 0x32400  # beyond the last letter
    letter = np.fromiter((chr(c).isalpha() for c in range(n)), bool, n)
    lower = np.zeros(n, np.uint32)
    for c in np.flatnonzero(letter).tolist():
        low = chr(c).lower()
        lower[c] = ord(low) if len(low) == 1 else c
    starts = np.array([a for a, _ in SCRIPTS])
    ids = np.array([0, *[s for _, s in SCRIPTS]])
    return lower, letter, ids[np.searchsorted(starts, np.arange(n), side="right")]


def letters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points (0: no letter), script ids, word starts, word ends, first word of each document, code point offsets."""
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    acc = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = acc[offs]
    lower, _, script = _tables()
    cp = np.minimum(cp, len(lower) - 1)
    low = lower[cp]
    is_letter = low > 0
    cut = np.zeros(len(cp) + 1, bool)
    cut[at] = True
    begin = is_letter & cut[:-1]
    begin[1:] |= is_letter[1:] & ~is_letter[:-1]
    end = is_letter & cut[1:]
    end[:-1] |= is_letter[:-1] & ~is_letter[1:]
    ws, we = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return low, script[cp], ws, we, np.searchsorted(ws, at), at


def features(low: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """A hashed trigram for each code point: the letter between its neighbours within the word (0 outside)."""
    if len(low) == 0:
        return np.zeros(0, np.int64)
    before = np.concatenate([[np.uint32(0)], low[:-1]])
    after = np.concatenate([low[1:], [np.uint32(0)]])
    before[ws] = 0
    after[we - 1] = 0
    key = (before.astype(np.uint64) << np.uint64(42)) ^ (low.astype(np.uint64) << np.uint64(21)) ^ after.astype(np.uint64)
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (key >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, hi, data, offs in text_slices(batch.column(1)):
            low, script, ws, we, _, at = letters(data, offs)
            feats = features(low, ws, we)
            for i in range(hi - lo):
                part = slice(at[i], at[i + 1])
                ok = low[part] > 0
                lang = langs[lo + i]
                if lang not in seen:
                    seen[lang], scripts[lang] = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(N_SCRIPTS, np.int64)
                seen[lang] += np.bincount(feats[part][ok], minlength=1 << BUCKET_BITS)
                scripts[lang] += np.bincount(script[part][ok], minlength=N_SCRIPTS)
    for lang in seen:
        full = np.concatenate([seen[lang], scripts[lang]])
        nz = np.flatnonzero(full)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(nz), pa.string()), pa.array(nz), pa.array(full[nz])], ["lang", "feature", "n"])


class Model:
    """Trigram log-probabilities, and the scripts each language uses."""

    def __init__(self, langs: list[str], logp: np.ndarray, uses: np.ndarray, most: int):
        self.langs, self.logp, self.uses, self.most = langs, logp, uses, most


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_lang: int = PER_LANG) -> Model:
    """Fit on about ``per_lang`` documents of each language that are not held out.

    A document is drawn when the hash of its id is below its language's rate,
    so the sample is the same in every run. Trigram counts are summed by the
    executors; what reaches the driver is bounded by languages times buckets.
    """
    df = bounded_batches(df)
    known = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages; a model of so many does not fit a worker")
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool), 0)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rate = F.lit(False)
    for lang in langs:
        rate = rate | ((F.col("lang") == lang) & (draw < int(min(1.0, per_lang / sizes[lang]) * (1 << 30))))
    counted = known.filter(rate).select("lang", "text").mapInArrow(_counts, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(((1 << BUCKET_BITS) + N_SCRIPTS, len(langs)))
    table[counted["feature"], counted["lang"].map({x: i for i, x in enumerate(langs)})] = counted["n"]
    grams, scripts = table[: 1 << BUCKET_BITS], table[1 << BUCKET_BITS :]
    logp = np.log(grams + SMOOTH) - np.log(grams.sum(0) + SMOOTH * (np.count_nonzero(grams.sum(1)) + 1))
    uses = scripts >= 0.01 * np.maximum(scripts.sum(0), 1)
    return Model(langs, logp.astype(np.float32), uses, max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i)))


def viterbi(s: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best labels of words with scores s[word, lang], each switch costing ``penalty``."""
    n, k = s.shape
    best, back = s[0].astype(float), np.zeros((n, k), np.int32)
    own = np.arange(k)
    for t in range(1, n):
        top = int(best.argmax())
        jump = best[top] - penalty
        stay = best >= jump
        back[t] = np.where(stay, own, top)
        best = np.where(stay, best, jump) + s[t]
    path = np.empty(n, np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def viterbi_batch(s: np.ndarray, starts: np.ndarray, lens: np.ndarray, penalty: float = PENALTY) -> list[np.ndarray]:
    """:func:`viterbi` of several documents at once, word by word; the last few long ones go on alone."""
    k, order = s.shape[1], np.argsort(-lens, kind="stable")
    at, size = starts[order], lens[order]
    best, back = s[at].astype(float), np.zeros(s.shape, np.int8 if k < 128 else np.int32)
    own, t = np.arange(k), 1
    while t < size[0] and (live := int(np.searchsorted(-size, -t, side="left"))) >= 8:
        now = best[:live]
        top = now.argmax(1)
        jump = now[np.arange(live), top][:, None] - penalty
        stay = now >= jump
        back[at[:live] + t] = np.where(stay, own, top[:, None])
        best[:live] = np.where(stay, now, jump) + s[at[:live] + t]
        t += 1
    for d in range(len(at)):
        if size[d] <= t:
            break
        state = best[d].tolist()
        for w, row in enumerate(s[at[d] + t : at[d] + size[d]].tolist(), t):
            most = max(state)
            jump, top = most - penalty, state.index(most)
            back[at[d] + w] = [i if v >= jump else top for i, v in enumerate(state)]
            state = [(v if v >= jump else jump) + x for v, x in zip(state, row, strict=True)]
        best[d] = state
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(at)
    for d, doc in enumerate(order.tolist()):
        steps, here = back[at[d] : at[d] + size[d]].tolist(), int(best[d].argmax())
        path = [here]
        for step in reversed(steps[1:]):
            here = step[here]
            path.append(here)
        out[doc] = np.array(path[::-1])
    return out


def label(scores: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Viterbi labels of all words of a slice; documents begin at ``first``."""
    n = len(scores)
    labels = np.zeros(n, np.int64)
    if n == 0:
        return labels
    acc = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, 0, dtype=np.float64)])
    whole = acc[first[1:]] - acc[first[:-1]]
    best = whole.argmax(1)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    labels[:] = best[doc]
    # gain of any run under another language: the largest rise of the running advantage within a document
    adv = acc - np.concatenate([[0.0], np.cumsum(scores[np.arange(n), labels], dtype=np.float64)])[:, None]
    lift = (adv.max() - adv.min() + penalty + 1) * np.arange(len(counts), 0, -1)  # separates documents for one running minimum
    low = np.minimum.accumulate(adv[:-1] + lift[doc][:, None], 0) - lift[doc][:, None]
    some = np.flatnonzero(counts > 0)
    head, tail = first[:-1][some], first[1:][some]
    inner = np.maximum.reduceat(adv[1:] - low, head, axis=0).max(1)
    begin = (np.maximum.reduceat(adv[1:], head, axis=0) - adv[head]).max(1)
    end = (adv[tail] - np.minimum.reduceat(adv[:-1], head, axis=0)).max(1)
    # m runs take m - 1 switches: first and last run may gain half a penalty each, others one, and still not pay
    eps = 1e-6
    open_ = some[(inner > penalty - eps) | (begin > penalty / 2 - eps) | (end > penalty / 2 - eps)]
    if len(open_):
        for d, path in zip(open_.tolist(), viterbi_batch(scores, first[open_], counts[open_], penalty), strict=True):
            labels[first[d] : first[d + 1]] = path
    return labels


def _predictor(model: Model, penalty: float, with_spans: bool):
    n_langs = len(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch.column(2)):
                n = hi - lo
                low, script, ws, we, first, at = letters(data, offs)
                counts = np.diff(first)
                doc = np.repeat(np.arange(n), counts)
                size = we - ws
                total = np.bincount(doc, size, n)
                if n_langs and len(ws):
                    per = model.logp[features(low, ws, we)]
                    acc = np.concatenate([np.zeros((1, n_langs)), np.cumsum(per * (low > 0)[:, None], 0, dtype=np.float64)])
                    scores = acc[we] - acc[ws]
                    allowed = model.uses[script[ws]]
                    known = allowed.any(1)
                    scores = np.where(known[:, None], np.where(allowed, scores, -1e4 * size[:, None]), 0.0)
                    labels = label(scores, first, penalty)
                    won = np.bincount(doc[known] * n_langs + labels[known], size[known], n * n_langs).reshape(n, n_langs)
                else:
                    known, labels = np.zeros(len(ws), bool), np.zeros(len(ws), np.int64)
                    won = np.zeros((n, max(1, n_langs)))
                pick = np.where(won.max(1) > 0, won.argmax(1), model.most)
                share = won.max(1) / np.maximum(total, 1)
                named = [model.langs[p] if t and n_langs else "und" for p, t in zip(pick.tolist(), total.tolist(), strict=True)]
                change = np.ones(len(ws), bool)
                tag = np.where(known, labels, -1)
                change[1:] = (tag[1:] != tag[:-1]) | (doc[1:] != doc[:-1])
                n_spans = np.bincount(doc[change & known], minlength=n)
                arrays = [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(named, pa.string()), pa.array(np.minimum(share, 1.0)), pa.array(n_spans)]
                if with_spans:
                    head = np.flatnonzero(change)
                    tail = np.concatenate([head[1:], [len(ws)]]) - 1
                    out: list[list[dict]] = [[] for _ in range(n)]
                    for a, b in zip(head.tolist(), tail.tolist(), strict=True):
                        if known[a]:
                            out[doc[a]].append({"start": int(ws[a] - at[doc[a]]), "end": int(we[b] - at[doc[a]]), "lang": model.langs[labels[a]]})
                    arrays.append(pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score", "n_spans", *["spans"] * with_spans])

    return run


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY, with_spans: bool = False) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, n_spans and, if asked, spans (code points)."""
    df = bounded_batches(df)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    schema = "doc_id long, held_out boolean, lang_pred string, score double, n_spans long"
    return rows.mapInArrow(_predictor(model, penalty, with_spans), schema + (", spans array<struct<start: long, end: long, lang: string>>" if with_spans else ""))


def keep_identified(df: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """The rows of ``df``, all columns unchanged, whose language is known with a score of at least ``least``."""
    df = bounded_batches(df)
    predict = _predictor(model, penalty, False)
    columns = df.columns
    doc, text = columns.index(id_col), columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) == 0:
                continue
            asked = pa.RecordBatch.from_arrays([batch.column(doc), batch.column(doc), batch.column(text)], ["doc_id", "held_out", "text"])
            found = pa.Table.from_batches(list(predict(iter([asked]))))
            score, named = found.column("score").to_numpy(), found.column("lang_pred").to_pylist()
            yield batch.filter(pa.array([s >= least and n != "und" for s, n in zip(score.tolist(), named, strict=True)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
