"""Token ids in Arrow files of fixed-size lists.

Texts are tokenised once where they lie; only ids (two bytes each when the
vocabulary allows) are shuffled, to buckets that are ranges of doc_id. Each
bucket is written as one Arrow IPC file whose batches hold ``fixed_size_list``
columns: ``ids`` (``SEQ`` ids a row, rows run on across documents) and ``mask``
(false on the padding of the last row), so any row is at a known offset and is
read without a copy. A side file lists the bucket's documents. Files are written
under a temporary name and moved, so a repeated task leaves one whole file.

The word cache relies on two facts of the tokenizer: its pre-tokens never span
ASCII blanks, and its model works on one pre-token at a time.

Edge cases: null and empty texts get the end id only; null doc_ids come first;
rows that repeat a doc_id are ordered by their ids; an empty table gives no file
and an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandmill.llm.common import bounded_batches, shared_path, stage

SEQ, ROWS_PER_BATCH, BUCKET_BYTES = 1024, 256, 64 << 20
_CACHE_WORDS = 600_000
#: Blanks beyond the ASCII ones that a plain split would also take.
_ODD_BLANK = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_SPLIT = re.compile("[^\x20\x09-\x0d]+")
#: The tokenizer's pre-token pattern, for lower-cased Latin-1 words.
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Word to its ids as bytes, filled on demand."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[word] = self.make(word)
        return ids


class WordEncoder:
    """Encodes whole texts with a tokenizers file, one cached word at a time."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.alphabet = _byte_alphabet()
        self.pieces = _Words(self._piece, _CACHE_WORDS)
        self.words = _Words(self._word, _CACHE_WORDS)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._pack([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))])

    def _word(self, word: str) -> bytes:
        # Latin-1 is stable under NFC and lower-cases letter by letter; anything else goes to the library whole
        if max(word) <= "\xff" and "<|" not in word and not _ODD_BLANK.search(word):
            return b"".join(map(self.pieces.__getitem__, _LATIN.findall(word.lower())))
        return self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        words = _SPLIT.findall(text) if _ODD_BLANK.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, words))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each file and worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _encode(path: str, end_id: int, cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                ids = [(enc.encode(t) if t else b"") + end for t in part.column(1).to_pylist()]
                # bucket 0: null ids and ids below the first cut; bucket i: ids from cut i on
                least = part.column(0).fill_null(-(1 << 63)).to_numpy()
                bucket = pa.array(np.searchsorted(cuts, least, side="right"), pa.int32())
                yield pa.RecordBatch.from_arrays([bucket, part.column(0), pa.array(ids, pa.binary())], ["bucket", "doc_id", "ids"])

    return run


class _Writer:
    """Streams one bucket's ids into its Arrow file and keeps its document list."""

    def __init__(self, root: str, bucket: int, dtype: np.dtype, seq: int):
        self.fs, base = pafs.FileSystem.from_uri(root)
        self.fs.create_dir(base)
        self.name, self.base, self.bucket, self.seq = f"{root}/bucket-{bucket:08d}", base, bucket, seq
        self.final = f"{base}/bucket-{bucket:08d}"
        self.temp = f"{base}/_{bucket}-{uuid.uuid4().hex}"
        self.type = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(self.type, seq)), ("mask", pa.list_(pa.bool_(), seq))])
        self.sink = self.fs.open_output_stream(self.temp)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.dtype, self.held, self.have, self.docs, self.n = dtype, [], 0, [], 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        n = len(raw) // self.dtype.itemsize
        self.docs.append((doc_id, self.n, n))
        self.n += n
        self.held.append(raw)
        self.have += n
        if self.have >= ROWS_PER_BATCH * self.seq:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        n = len(ids)
        whole = n // self.seq * self.seq
        if last and whole < n:
            whole += self.seq
            ids = np.concatenate([ids, np.zeros(whole - n, self.dtype)])
        rows = whole // self.seq
        for lo in range(0, rows, ROWS_PER_BATCH):
            part = slice(lo * self.seq, min(rows, lo + ROWS_PER_BATCH) * self.seq)
            mask = np.arange(part.start, part.stop) < n
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids[part], self.type), self.seq), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq)], schema=self.schema))
        rest = ids[whole:n].tobytes() if whole < n else b""
        self.held, self.have = [rest], len(rest) // self.dtype.itemsize

    def close(self) -> dict:
        self._flush(True)
        self.out.close()
        self.sink.close()
        docs = pa.table({"doc_id": pa.array([d[0] for d in self.docs], pa.int64()), "start": pa.array([d[1] for d in self.docs], pa.int64()), "n_tokens": pa.array([d[2] for d in self.docs], pa.int64())})
        with self.fs.open_output_stream(self.temp + ".docs") as sink, pa.ipc.new_file(sink, docs.schema) as out:
            out.write_table(docs)
        self.fs.move(self.temp + ".docs", self.final + ".docs.arrow")
        self.fs.move(self.temp, self.final + ".arrow")
        return {"bucket": self.bucket, "path": self.name, "n_docs": len(self.docs), "n_tokens": self.n}


def _write(root: str, dtype: str, seq: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for bucket, doc_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None or writer.bucket != bucket:
                    if writer is not None:
                        done.append(writer.close())
                    writer = _Writer(root, bucket, np.dtype(dtype), seq)
                writer.add(doc_id, raw)
        if writer is not None:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return run


def bucket_cuts(rows: DataFrame, bucket_bytes: int) -> np.ndarray:
    """First doc_id of each bucket but the first: buckets in order of doc_id of about ``bucket_bytes`` of text each.

    Sizes alone are sorted and summed, by ranges of doc_id and then over the ranges.
    The cuts are eight bytes for each bucket, whatever the number of rows.
    """
    cost = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    sizes = rows.select("doc_id", cost.cast("long").alias("cost")).repartitionByRange(F.col("doc_id").asc_nulls_first())
    sizes = stage(sizes.withColumn("range", F.spark_partition_id()), "text-sizes")
    total = sizes.groupBy("range").agg(F.sum("cost").alias("all"), F.min("doc_id").alias("least"))
    before = W.orderBy(F.col("least").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    base = stage(total.select(F.col("range").alias("of"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base")), "ranges")
    inner = W.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum("cost").over(inner), F.lit(0))
    placed = sizes.withColumn("at", at).join(base, F.col("range") == F.col("of"))
    bucket = F.floor((F.col("at") + F.col("base")) / bucket_bytes)
    first = placed.groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("doc_id")).filter("bucket > 0").select("doc_id").dropna()
    return np.unique(first.toArrow().column(0).to_numpy().astype(np.int64))


def write_token_files(df: DataFrame, tokenizer_path: str, root: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", seq: int = SEQ, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write ids in ascending doc_id order; returns the list of files: bucket, path, n_docs, n_tokens, base (ids before the file)."""
    df = bounded_batches(df)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cuts = bucket_cuts(rows, bucket_bytes)
    enc_type = encoder(tokenizer_path).dtype.str
    coded = rows.mapInArrow(_encode(tokenizer_path, end_id, cuts), "bucket int, doc_id long, ids binary")
    dealt = coded.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")
    files = stage(dealt.mapInArrow(_write(root, enc_type, seq), "bucket long, path string, n_docs long, n_tokens long"), "token-files")
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def open_file(path: str) -> pa.ipc.RecordBatchFileReader:
    """A token or document file; memory-mapped where it is local."""
    fs, name = pafs.FileSystem.from_uri(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(name))
    return pa.ipc.open_file(fs.open_input_file(name))


def sequence(path: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Row ``row`` of a token file, ids without a copy, and its mask."""
    reader = open_file(path + ".arrow")
    batch = reader.get_batch(row // ROWS_PER_BATCH)
    at = row % ROWS_PER_BATCH
    return batch.column(0)[at].values.to_numpy(), batch.column(1)[at].values.to_numpy(zero_copy_only=False)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids, docs = open_file(path + ".arrow"), open_file(path + ".docs.arrow")
            held, held_at, k = np.zeros(0, np.uint16), 0, 0
            for b in range(docs.num_record_batches):
                part = docs.get_batch(b)
                starts, counts = part.column(1).to_numpy(), part.column(2).to_numpy()
                crc = np.empty(len(part), np.int64)
                for i, (s, c) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
                    if s + c > held_at + len(held):
                        parts = [held[s - held_at :]]
                        have = len(parts[0])
                        while have < c:
                            parts.append(ids.get_batch(k).column(0).flatten().to_numpy())
                            have += len(parts[-1])
                            k += 1
                        held, held_at = (np.concatenate(parts) if len(parts[0]) else np.concatenate(parts[1:])), s
                    crc[i] = zlib.crc32(held[s - held_at : s - held_at + c].astype("<u4").tobytes())
                for lo in range(0, len(part), 4096):
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, 4096), pa.array(starts[lo : lo + 4096] + base), part.column(2).slice(lo, 4096), pa.array(crc[lo : lo + 4096])], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    n = max(1, min(100_000, files.count()))
    return files.select("path", "base").repartition(n).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the token files into the session's shared folder and read them back."""
    root = shared_path(df.sparkSession, "tokens")
    return read_token_files(write_token_files(df, tokenizer_path, root, end_id))
