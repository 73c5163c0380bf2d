"""Reference chunks and the k-mer index.

A contig is cut in one pass into chunks of ``WIDTH`` bases that overlap by
``OVERLAP``, so a window fetch is one equi-join and no later task walks a whole
chromosome. Windows longer than the overlap are put together from several chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.sequence import kmers
from strandmill.operators.prefix import running_sum

WIDTH, OVERLAP = 512, 256
SEED = 16


def with_offsets(contigs: DataFrame) -> DataFrame:
    """Contigs with their length and ``start`` in the concatenated coordinate space, by contig_id."""
    return running_sum(contigs.withColumn("length", F.length("seq").cast("long")), "contig_id", F.col("length"), "start")


def chunks(contigs: DataFrame, width: int = WIDTH, overlap: int = OVERLAP) -> DataFrame:
    """contig_id, name, length, chunk_id, chunk_start, seq and, if known, start."""
    more = [c for c in ("start",) if c in contigs.columns]
    n = F.length("seq")
    pieces = F.regexp_extract_all(F.col("seq"), F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    after = range(1, -(-overlap // width) + 1)
    # the array is made once for each contig; shifted against itself it gives every chunk its overlap
    zipped = F.transform(F.array(pieces), lambda p: F.arrays_zip(p.alias("p0"), *[F.slice(p, j + 1, F.greatest(F.size(p) - j, F.lit(0))).alias(f"p{j}") for j in after]))[0]
    rows = contigs.filter(n > 0).select("contig_id", "name", *more, n.cast("long").alias("length"), F.posexplode(zipped).alias("chunk_id", "x"))
    seq = F.concat_ws("", *[F.col(f"x.p{j}") for j in (0, *after)]).substr(F.lit(1), F.lit(width + overlap))
    return rows.select("contig_id", "name", *more, "length", "chunk_id", (F.col("chunk_id") * width).cast("long").alias("chunk_start"), seq.alias("seq"))


def kmer_index(ref_chunks: DataFrame, k: int = SEED, stride: int = 4, width: int = WIDTH) -> DataFrame:
    """kmer, contig_id, pos (0-based in the contig) for global coordinates that are multiples of ``stride``.

    The stride is applied while k-mers are generated, before any shuffle. Without a
    ``start`` column the coordinate is the contig's own.
    """
    origin = F.col("chunk_start") + (F.col("start") if "start" in ref_chunks.columns else F.lit(0))
    inside = F.filter(kmers(F.col("seq").substr(F.lit(1), F.lit(width + k - 1)), k, stride, origin), lambda p: p["off"] < width)
    rows = ref_chunks.select("contig_id", "chunk_start", F.explode(inside).alias("x"))
    return rows.select("x.kmer", "contig_id", (F.col("chunk_start") + F.col("x.off")).alias("pos"))


def frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("kmer").agg(F.count("*").alias("freq"))


def freq_tier(freq: Column) -> Column:
    """unique, quick (<= 8), preferred (<= 64), allowed (<= 512) or skipped."""
    return F.when(freq == 1, "unique").when(freq <= 8, "quick").when(freq <= 64, "preferred").when(freq <= 512, "allowed").otherwise("skipped")


def write_index(index: DataFrame, path: str, partitions: int = 64) -> None:
    """Parquet, ranged and sorted by k-mer, so lookups prune files and row groups."""
    index.repartitionByRange(partitions, "kmer").sortWithinPartitions("kmer", "contig_id", "pos").write.mode("overwrite").parquet(path)


#: Of a saved index.
VERSION = 1
_META = "version INT, seed INT, stride INT, width INT, overlap INT, bases LONG, entries LONG"


def pick_stride(contigs: DataFrame, memory_bytes: int, entry_bytes: int = 24, share: float = 0.6, compact: int = 4) -> int:
    """1 (dense) where an index of every base takes at most ``share`` of the memory, else ``compact``."""
    bases = contigs.agg(F.coalesce(F.sum(F.length("seq").cast("long")), F.lit(0))).first()[0]
    return 1 if bases * entry_bytes <= share * memory_bytes else compact


def build_index(contigs: DataFrame, path: str, seed: int = SEED, stride: int = 4, partitions: int = 64) -> None:
    """Write chunks, k-mers with their frequencies, and metadata under ``path``; metadata last, so a broken build never opens."""
    spark = contigs.sparkSession
    chunks(contigs).repartition(partitions, "contig_id", "chunk_id").write.mode("overwrite").parquet(f"{path}/chunks")
    ref_chunks = spark.read.parquet(f"{path}/chunks")
    write_index(kmer_index(ref_chunks, seed, stride), f"{path}/kmers", partitions)
    kmers_ = spark.read.parquet(f"{path}/kmers")
    frequencies(kmers_).repartitionByRange(partitions, "kmer").write.mode("overwrite").parquet(f"{path}/frequencies")
    bases = ref_chunks.filter("chunk_id = 0").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    spark.createDataFrame([(VERSION, seed, stride, WIDTH, OVERLAP, bases, kmers_.count())], _META).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def open_index(spark: SparkSession, path: str, seed: int | None = None, stride: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """Chunks, k-mers, frequencies and metadata of a saved index; raises if its version, layout, or the asked seed or stride differ."""
    meta = spark.read.schema(_META).json(f"{path}/meta").first()
    meta = meta.asDict() if meta else {}
    wanted = {"version": VERSION, "width": WIDTH, "overlap": OVERLAP} | {k: v for k, v in (("seed", seed), ("stride", stride)) if v is not None}
    for key, value in wanted.items():
        if meta.get(key) != value:
            raise ValueError(f"index at {path}: {key} is {meta.get(key)}, not {value}")
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/kmers"), spark.read.parquet(f"{path}/frequencies"), meta


def fetch(wanted: DataFrame, ref_chunks: DataFrame, start: str, size: str, out: str = "window", width: int = WIDTH, overlap: int = OVERLAP, longest: int | None = None) -> DataFrame:
    """Windows [start, start + size) of contigs, clamped to the contig's end.

    A window up to ``overlap`` long lies in one chunk. Longer ones are joined with
    every chunk they touch and put together; with a known ``longest`` of at most
    ``overlap`` that part of the plan is left out.
    """
    ref = ref_chunks.select("contig_id", "chunk_id", "chunk_start", F.col("seq").alias("_seq"))

    def within(rows: DataFrame) -> DataFrame:
        got = rows.withColumn("chunk_id", F.floor(F.col(start) / width).cast("int")).join(ref, ["contig_id", "chunk_id"])
        return got.withColumn(out, F.col("_seq").substr((F.col(start) - F.col("chunk_start") + 1).cast("int"), F.col(size).cast("int"))).select(*wanted.columns, out)

    if longest is not None and longest <= overlap:
        return within(wanted)
    first, last = F.floor(F.col(start) / width), F.floor((F.col(start) + F.col(size) - 1) / width)
    parts = wanted.filter(F.col(size) > overlap).withColumn("chunk_id", F.explode(F.sequence(first.cast("int"), last.cast("int")))).join(ref, ["contig_id", "chunk_id"])
    lo = F.greatest(F.lit(0), F.col(start) - F.col("chunk_start"))
    hi = F.least(F.lit(width).cast("long"), F.col(start) + F.col(size) - F.col("chunk_start"))
    part = F.struct("chunk_id", F.col("_seq").substr((lo + 1).cast("int"), (hi - lo).cast("int")).alias("s"))
    held = parts.groupBy(*wanted.columns).agg(F.array_sort(F.collect_set(part)).alias("_parts"), F.count("*").alias("_n"))
    text = F.concat_ws("", F.transform("_parts", lambda p: p["s"]))
    # equal rows of ``wanted`` were one group: each comes out as often as it went in
    long = held.withColumn(out, text).withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("_n") / F.size("_parts")).cast("int")))).select(*wanted.columns, out)
    return within(wanted.filter(F.col(size) <= overlap)).unionByName(long)


def locate(positions: DataFrame, contigs: DataFrame, pos: str = "gpos", bin_size: int = 1 << 14) -> DataFrame:
    """Global positions to contig_id and local position: contigs are laid over bins and joined on them."""
    bins = contigs.filter("length > 0").select("contig_id", "start", "length", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("start") + F.col("length") - 1) / bin_size))).alias("_bin"))
    hit = positions.withColumn("_bin", F.floor(F.col(pos) / bin_size)).join(bins, "_bin")
    inside = (F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("start") + F.col("length"))
    return hit.filter(inside).withColumn("local", F.col(pos) - F.col("start")).drop("_bin", "start", "length")
