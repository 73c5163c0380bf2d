"""Line-first quality rules.

Each line is judged on its own: punctuation (no mark that ends a sentence behind its
last word, words that end in runs of marks, or symbols strewn over the words),
navigation (menus of bars and arrows, lines that are mostly addresses) and boilerplate
(licence and site phrases). Failing lines go; then a document is
rejected if it lost more than ``max_loss`` of its word characters, or if a base
rule fails (too few words, or too many words in repeated 8-word windows).

Edge cases: null and empty texts have no words and fail; a text without line
breaks is one line; repeated rows are judged alike; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import bounded_batches, text_slices
from strandmill.llm.textscan import LOWER, SPACE, gram_hash, mix, span_hash, word_spans

LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
MAX_LOSS = 0.5
#: Phrases that make a line boilerplate, in lower case.
PHRASES = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "accept cookies", "cookie policy", "licensed under", "released under the", "click here", "lorem ipsum", "enable javascript")
#: Starts of web addresses; a line with one for every two words is navigation.
LINKS = ("http://", "https://", "www.")
#: Marks that end a sentence, and what may close after them.
ENDS = (".", "!", "?", ":", ";", "…", "。", "！", "？", "।", "؟", "۔", "։", "።")
CLOSERS = ('"', "'", ")", "]", "»", "”", "’", "“", "」", "）")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_removed_lines long, lost_chars long, clean_sha256 string"


def _per(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive bounds."""
    acc = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=acc[1:])
    return np.diff(acc[bounds])


def repeat_words(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words in windows of WINDOW words that stand twice or more in their document."""
    if len(h) < WINDOW:
        return np.zeros(n_docs, np.int64)
    g = gram_hash(h, WINDOW)
    start = np.flatnonzero(doc[: len(g)] == doc[WINDOW - 1 :])
    key = mix(g[start] + doc[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    dup = np.zeros(len(key), bool)
    dup[order[1:][same]] = True
    dup[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, start[dup], 1)
    np.add.at(cover, start[dup] + WINDOW, -1)
    return np.bincount(doc, np.cumsum(cover)[:-1] > 0, n_docs).astype(np.int64)


def _stands_before(data: np.ndarray, at: np.ndarray, marks: tuple[str, ...]) -> np.ndarray:
    """Length in bytes of the mark that ends at each position, 0 if there is none."""
    out = np.zeros(len(at), np.int64)
    for mark in marks:
        raw = np.frombuffer(mark.encode(), np.uint8)
        same = at >= len(raw)
        for k, byte in enumerate(raw[::-1], 1):
            same &= data[np.maximum(at - k, 0)] == byte
        out[same] = len(raw)
    return out


def judge(data: np.ndarray, offs: np.ndarray, max_loss: float = MAX_LOSS) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Columns of a slice of documents, and its lines: starts, ends, removed."""
    n_docs = len(offs) - 1
    ws, we, first = word_spans(data, offs)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n_docs), n_words)
    cols = {"n_words": n_words, "n_symbols": _per(_SYMBOLS[data], offs)}
    lead = ((data & 0xC0) != 0x80) & ~SPACE[data]
    cols["word_chars"] = _per(lead, offs)
    cols["n_repeat_words"] = repeat_words(span_hash(data, ws, we), doc, n_docs)

    # a line starts with its document and after every \n in it
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offs[:-1], breaks + 1])
    line_doc = np.concatenate([np.arange(n_docs), np.searchsorted(offs, breaks, side="right") - 1])
    order = np.lexsort((starts, line_doc))
    starts, line_doc = starts[order], line_doc[order]
    ends = offs[line_doc + 1]
    inner = line_doc[1:] == line_doc[:-1]
    ends[:-1][inner] = starts[1:][inner] - 1
    acc = np.concatenate([[0], np.cumsum(lead)])
    wacc = np.searchsorted(ws, np.concatenate([starts, ends])).reshape(2, -1)
    line_words, line_chars = wacc[1] - wacc[0], acc[ends] - acc[starts]
    has = line_words > 0
    lh = mix(span_hash(data, starts, ends) + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    cols["n_dup_lines"] = np.bincount(line_doc[has], minlength=n_docs) - np.bincount(line_doc[has][np.unique(lh[has], return_index=True)[1]], minlength=n_docs)

    def count(flags: np.ndarray) -> np.ndarray:
        a = np.concatenate([[0], np.cumsum(flags)])
        return a[ends] - a[starts]

    mark = (data == 33) | (data == 63)
    run = np.zeros(len(data), bool)
    run[1:] = mark[1:] & mark[:-1]
    strewn = _SYMBOLS[data] & (data != 124) & (data != 62)
    bars = (data == 124) | (data == 62)
    some = np.maximum(line_words, 1)
    tail = we[wacc[1][has] - 1]
    for _ in range(2):
        tail = tail - _stands_before(data, tail, CLOSERS)
    open_end = np.zeros(len(ends), bool)
    open_end[has] = _stands_before(data, tail, ENDS) == 0
    low = LOWER[data].tobytes()

    def holds(phrases: tuple[str, ...]) -> np.ndarray:
        found = np.zeros(len(ends), np.int64)
        for phrase in phrases:
            p, at = phrase.encode(), low.find(phrase.encode())
            while at >= 0:
                line = int(np.searchsorted(starts, at, side="right")) - 1
                found[line] += at + len(p) <= ends[line]
                at = low.find(p, at + len(p))
        return found

    punctuation = open_end | (count(run) > 0.3 * some) | (count(strewn) > 0.5 * some)
    navigation = ((count(bars) >= 3) & (count(bars) > 0.2 * some)) | (2 * holds(LINKS) >= some)
    boiler = holds(PHRASES) > 0
    removed = has & (punctuation | navigation | boiler)
    cols["n_lines"] = np.bincount(line_doc, minlength=n_docs)
    cols["n_removed_lines"] = np.bincount(line_doc[removed], minlength=n_docs)
    cols["lost_chars"] = np.bincount(line_doc[removed], line_chars[removed], n_docs).astype(np.int64)
    cols["base_failed"] = (n_words < LEAST_WORDS) | (100 * cols["n_repeat_words"] > MOST_REPEATED * n_words)
    cols["kept"] = ~cols["base_failed"] & (cols["lost_chars"] <= max_loss * cols["word_chars"])
    return cols, starts, ends, removed


def _judged(max_loss: float, with_text: bool):
    names = [c.split()[0] for c in _SCHEMA.split(", ")][1:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch.column(1)):
                cols, starts, ends, removed = judge(data, offs, max_loss)
                raw, clean = data.tobytes(), []
                at = np.concatenate([[0], np.cumsum(cols["n_lines"])])
                for i in range(hi - lo):
                    if cols["n_removed_lines"][i]:
                        keep = np.flatnonzero(~removed[at[i] : at[i + 1]]) + at[i]
                        clean.append(b"\n".join(raw[starts[k] : ends[k]] for k in keep.tolist()))
                    else:
                        clean.append(raw[offs[i] : offs[i + 1]])
                arrays = [batch.column(0).slice(lo, hi - lo), *[pa.array(cols[n]) for n in names], pa.array([hashlib.sha256(c).hexdigest() for c in clean], pa.string())]
                if with_text:
                    arrays.append(pa.array([c.decode("utf-8", "replace") for c in clean], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, "clean_sha256", *["clean_text"] * with_text])

    return run


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_loss: float = MAX_LOSS, with_text: bool = False) -> DataFrame:
    """One row per input row with its counts, verdict and the digest (or text) of what the line rules leave."""
    df = bounded_batches(df)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_judged(max_loss, with_text), _SCHEMA + (", clean_text string" if with_text else ""))
