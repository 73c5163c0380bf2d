"""The registered queries of the sequence engine and their SQL.

Every query runs over whole tables and whole texts. Sequences come from
:mod:`strandmill.plans.dna_view`; alignment tables are derived from ``orders`` by
arithmetic on keys that both engines share (``RECORDS``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import cigar as C
from strandmill.functions import quality as Q
from strandmill.functions import sequence as S
from strandmill.operators import align, evaluate, index, search, stats, suffix
from strandmill.plans import anchors, mapper
from strandmill.plans.dna_view import FROM, TO, contigs, quality, reads
from strandmill.sources.tables import parse_mapper_lines
from strandmill.sources.writers import mapped_line
from strandmill.streaming.events import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# --- shared SQL -----------------------------------------------------------------


def _dna(x: str) -> str:
    return f"regexp_replace(translate(coalesce({x}, ''), '{FROM}', '{TO}'), '[^ACGT]', 'N', 'g')"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


_C = f"c AS (SELECT doc_id AS contig_id, CAST(doc_id AS VARCHAR) AS name, {_dna('text')} AS seq, length({_dna('text')}) AS length FROM documents)"
_R = f"""b0 AS (SELECT item_id, {_dna("text")} AS s FROM benchmark),
b1 AS (SELECT item_id * 1000 + i AS read_id, substr(s, CAST(i * 50 + 1 AS BIGINT), 100) AS t, ((item_id * 1000 + i) * 7) % 80 + 10 AS p, (item_id * 1000 + i) % 5 AS kind
  FROM (SELECT item_id, s, unnest(range(0, (length(s) - 100) // 50 + 1)) AS i FROM b0 WHERE length(s) >= 100)),
r AS (SELECT read_id, 'read' || read_id AS name, CASE kind WHEN 1 THEN substr(t, 1, p) || translate(substr(t, p + 1, 1), 'ACGTN', 'CGTAA') || substr(t, p + 2)
  WHEN 2 THEN substr(t, 1, p) || substr(t, p + 2) WHEN 3 THEN substr(t, 1, p) || 'A' || substr(t, p + 1) WHEN 4 THEN {_rc("t")} ELSE t END AS seq FROM b1)"""
_BOTH = f"o AS (SELECT read_id, '+' AS strand, seq AS oseq FROM r UNION ALL SELECT read_id, '-', {_rc('seq')} FROM r)"


def _cut(source: str = "c") -> str:
    """SQL that cuts sequences into pieces, since a substring of a long text is slow."""
    return f"(SELECT *, substr(seq, base + 1, 560) AS piece FROM (SELECT *, unnest(range(0, length, 512)) AS base FROM {source}))"


def _km(k: int, stride: int) -> str:
    return f"km AS (SELECT contig_id, base + off AS pos, substr(piece, off + 1, {k}) AS kmer FROM (SELECT contig_id, base, piece, unnest(range(0, least(512, length - base - {k - 1}), {stride})) AS off FROM {_cut()}) WHERE NOT contains(substr(piece, off + 1, {k}), 'N'))"


#: Alignment tables from ``orders``; read by both engines.
RECORDS = """SELECT o_orderkey AS ordinal, 'r' || CAST(o_orderkey % 60001 AS STRING) AS name,
 CASE WHEN o_custkey % 7 = 0 THEN '*' ELSE CAST(o_custkey % 25 + 1 AS STRING) END AS chrom,
 CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE (o_custkey * 7919 + o_orderkey) % 990000 + 1 END AS pos,
 CASE WHEN o_custkey % 7 = 0 THEN '*' WHEN o_orderkey % 5 = 0 THEN '100M1I' WHEN o_orderkey % 5 = 1 THEN '50M1D51M' WHEN o_orderkey % 5 = 2 THEN '90M' ELSE '101M' END AS cigar,
 CASE WHEN o_custkey % 7 <> 0 AND o_orderkey % 4 = 0 THEN 'ALT:' || CAST(o_orderkey % 27 + 1 AS STRING) || ',' || CAST((o_orderkey * 31) % 1000000 AS STRING) || ',101M' END AS alt
 FROM orders"""
SAM = """SELECT o_orderkey AS ordinal, 'r' || CAST(o_orderkey % 60001 AS STRING) AS qname,
 CASE WHEN o_orderkey % 11 = 0 THEN 4 WHEN o_orderkey % 11 = 1 THEN 256 WHEN o_orderkey % 11 = 2 THEN 2048 WHEN o_orderkey % 11 < 6 THEN 16 ELSE 0 END AS flag,
 CASE WHEN o_custkey % 13 = 0 THEN '*' WHEN o_custkey % 17 = 0 THEN 'un_1' ELSE CAST(o_custkey % 25 + 1 AS STRING) END AS rname,
 (o_custkey * 7919 + o_orderkey + CASE WHEN o_orderkey % 6 = 0 THEN 7 WHEN o_orderkey % 6 = 1 THEN 33 ELSE 0 END) % 990000 + 1 AS pos,
 o_custkey % 61 AS mapq,
 CASE WHEN o_orderkey % 9 = 0 THEN '5S96M' WHEN o_orderkey % 5 = 0 THEN '100M1I' ELSE '101M' END AS cigar,
 CASE WHEN o_orderkey % 10 = 0 THEN 'AS:i:90' ELSE 'NM:i:' || CAST(o_orderkey % 4 AS STRING) || ' AS:i:90' END AS tags
 FROM orders"""
SIZES = "SELECT CAST(n_nationkey + 1 AS STRING) AS name, 1000000 - n_nationkey * 1000 AS length FROM nation"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the shared derivations above, over its base table."""
    base = sql.rsplit("FROM ", 1)[1].strip()
    return spark.sql(sql.replace(f"FROM {base}", "FROM {base}"), base=table(spark, sf_dir, base))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, RECORDS)


def sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, SAM).withColumn("tags", F.split("tags", " "))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, SIZES)


def ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the contigs, spread over the cores before any k-mer is made."""
    n = spark.sparkContext.defaultParallelism
    return index.chunks(contigs(spark, sf_dir).repartition(n * 2, "contig_id"))


# --- sequences -------------------------------------------------------------------


@query(f"WITH {_C} SELECT name, CAST(length AS INTEGER) AS length, CAST(length - length(replace(seq, 'N', '')) AS INTEGER) AS n_count, md5(seq) AS digest FROM c")
def seq_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = S.normalize("seq")
    return contigs(spark, sf_dir).select("name", F.length("seq").alias("length"), F.length(F.regexp_replace(seq, "[^N]", "")).alias("n_count"), F.md5(seq).alias("digest"))


@query(f"WITH {_C} SELECT name, md5({_rc('seq')}) AS digest FROM c")
def seq_revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contigs(spark, sf_dir).select("name", F.md5(S.reverse_complement("seq")).alias("digest"))


@query(f"WITH {_C} SELECT name, CAST(length AS BIGINT) AS length, CAST(length(regexp_replace(seq, '[^CG]', '', 'g')) AS BIGINT) AS gc, CASE WHEN length = 0 THEN 0.0 ELSE 100.0::DOUBLE * length(regexp_replace(seq, '[^CG]', '', 'g')) / length END AS gc_pct FROM c")
def seq_gc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.per_sequence(contigs(spark, sf_dir), ordinal="contig_id")


@query(f"""WITH {_C}, g AS (SELECT CAST(length AS BIGINT) AS n, CAST(length(regexp_replace(seq, '[^CG]', '', 'g')) AS BIGINT) AS gc FROM c)
SELECT count(*) AS n_seqs, CAST(sum(n) AS BIGINT) AS total, min(n) AS shortest, max(n) AS longest, CAST(sum(gc) AS BIGINT) AS gc, CAST(sum(n) // count(*) AS BIGINT) AS mean, 100.0::DOUBLE * CAST(sum(gc) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS gc_pct FROM g""")
def seq_global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.global_stats(contigs(spark, sf_dir))


_QUAL = "substr(repeat(translate(md5(name), '0123456789abcdef', '!$''*-0369<?BEHI#'), CAST(ceil(length(seq) / 32) AS BIGINT)), 1, length(seq))"


@query(f"""WITH {_C}, t AS (SELECT name, length(regexp_replace({_QUAL}, '[!-2]+$', '')) AS keep, length(seq) AS n FROM c)
SELECT count(*) AS n_reads, CAST(sum(n) AS BIGINT) AS bases_in, CAST(sum(keep) AS BIGINT) AS bases_kept, CAST(min(keep) AS INTEGER) AS shortest, CAST(max(keep) AS INTEGER) AS longest, CAST(floor(sum(keep) / count(*)) AS BIGINT) AS mean FROM t""")
def quality_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trimmed(contigs(spark, sf_dir).select("name", "seq"))


def _trimmed(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("qual", quality(F.col("name"), F.col("seq"))).withColumn("n", F.length("seq"))
    cut = Q.trim(rows, 18).withColumn("keep", F.length("seq"))
    return cut.agg(F.count("*").alias("n_reads"), F.sum("n").alias("bases_in"), F.sum("keep").alias("bases_kept"), F.min("keep").alias("shortest"), F.max("keep").alias("longest"), F.floor(F.sum("keep") / F.count("*")).alias("mean"))


@query(f"WITH {_C}, {_km(6, 1)} SELECT kmer, count(*) AS n, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos FROM km GROUP BY kmer")
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = index.kmer_index(ref(spark, sf_dir), 6, 1)
    return idx.groupBy("kmer").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(f"WITH {_C}, {_km(12, 1)} SELECT kmer, count(*) AS n, count(DISTINCT contig_id) AS n_contigs, CAST(min(pos) AS BIGINT) AS first_pos FROM km GROUP BY kmer ORDER BY n DESC, kmer LIMIT 50")
def kmer_positions_topfreq(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = index.kmer_index(ref(spark, sf_dir), 12, 1)
    # distinct contigs by a second level, not by one wide distinct
    per = idx.groupBy("kmer", "contig_id").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    top = per.groupBy("kmer").agg(F.sum("n").alias("n"), F.count("*").alias("n_contigs"), F.min("p").alias("first_pos"))
    return top.orderBy(F.desc("n"), "kmer").limit(50)


_OFF = f"WITH {_C}, g AS (SELECT contig_id, name, seq, length, CAST(sum(length) OVER (ORDER BY contig_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - length AS start FROM c)"


@query(f"""{_OFF}, km AS (SELECT substr(piece, off + 1, 16) AS kmer, start + base + off AS gpos FROM (SELECT start, base, piece, unnest(range((4 - start % 4) % 4, least(512, length - base - 15), 4)) AS off FROM {_cut("g")}) WHERE NOT contains(substr(piece, off + 1, 16), 'N'))
SELECT kmer, count(*) AS freq, min(gpos) AS first_pos, max(gpos) AS last_pos FROM km GROUP BY kmer HAVING count(*) > 1""")
def kmer_stride_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = index.with_offsets(contigs(spark, sf_dir))
    ch = index.chunks(placed.repartition(spark.sparkContext.defaultParallelism * 2, "contig_id"))
    idx = index.kmer_index(ch, 16, 4).join(placed.select("contig_id", "start"), "contig_id").withColumn("gpos", F.col("start") + F.col("pos"))
    return idx.groupBy("kmer").agg(F.count("*").alias("freq"), F.min("gpos").alias("first_pos"), F.max("gpos").alias("last_pos")).filter("freq > 1")


@query(f"""WITH {_C}, {_km(16, 4)}, f AS (SELECT kmer, count(*) AS freq FROM km GROUP BY kmer)
SELECT CASE WHEN freq = 1 THEN 'unique' WHEN freq <= 8 THEN 'quick' WHEN freq <= 64 THEN 'preferred' WHEN freq <= 512 THEN 'allowed' ELSE 'skipped' END AS tier, count(*) AS kmers, CAST(sum(freq) AS BIGINT) AS hits FROM f GROUP BY tier""")
def kmer_freq_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = index.frequencies(index.kmer_index(ref(spark, sf_dir), 16, 4))
    return f.groupBy(index.freq_tier(F.col("freq")).alias("tier")).agg(F.count("*").alias("kmers"), F.sum("freq").alias("hits"))


@query(f"{_OFF} SELECT name, CAST(length AS BIGINT) AS length, start FROM g")
def contig_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.with_offsets(contigs(spark, sf_dir)).select("name", "length", "start")


@query(f"{_OFF}, p AS (SELECT DISTINCT (l_orderkey * 7919 + l_partkey * 31) % (SELECT CAST(sum(length) AS BIGINT) FROM c) AS gpos FROM lineitem) SELECT gpos, contig_id, gpos - start AS local FROM p JOIN g ON gpos >= start AND gpos < start + length")
def position_to_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = index.with_offsets(contigs(spark, sf_dir))
    total = placed.agg(F.sum("length")).first()[0]
    pos = table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31) % total).alias("gpos")).distinct()
    return index.locate(pos, placed).select("gpos", "contig_id", "local")


_PATTERNS = ("GATTACA", "ACGTACGT", "AAAA", "GAGAGAG", "TTGCA", "CCCCC", "TGTGTG", "GGTTGG")


@query(f"""WITH {_C}, p AS (SELECT unnest({list(_PATTERNS)}) AS pattern), h AS (SELECT pattern, contig_id, base + off AS pos FROM (SELECT pattern, contig_id, base, piece, unnest(range(0, least(512, length - base - length(pattern) + 1))) AS off FROM {_cut()}, p) WHERE substr(piece, off + 1, length(pattern)) = pattern)
SELECT pattern, contig_id, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM h GROUP BY ALL""")
def exact_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pats = spark.createDataFrame([(p,) for p in _PATTERNS], "pattern string")
    hit = search.occurrences(ref(spark, sf_dir), pats)
    return hit.groupBy("pattern", "contig_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(f"""WITH {_C}, {_R}, p AS (SELECT DISTINCT substr(seq, 31, 24) AS pattern FROM r), g AS (SELECT pattern, i * 8 AS shift, substr(pattern, i * 8 + 1, 8) AS piece FROM p, range(0, 3) x(i)),
k8 AS (SELECT contig_id, base + off AS pos, substr(piece, off + 1, 8) AS piece FROM (SELECT contig_id, base, piece, unnest(range(0, least(512, length - base - 7))) AS off FROM {_cut()})),
h AS (SELECT DISTINCT pattern, contig_id, pos - shift AS pos FROM k8 JOIN g USING (piece) WHERE pos >= shift)
SELECT pattern, h.contig_id, h.pos, CAST(hamming(substr(seq, h.pos + 1, 24), pattern) AS INTEGER) AS mismatches FROM h JOIN c USING (contig_id) WHERE h.pos + 24 <= length AND hamming(substr(seq, h.pos + 1, 24), pattern) <= 2""")
def kmismatch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    pats = reads(spark, sf_dir).select(F.substring("seq", 31, 24).alias("pattern")).distinct()
    return search.mismatch_occurrences(ref(spark, sf_dir), pats, 2)


# --- mapping ----------------------------------------------------------------------

_SEED_SQL = f"""WITH {_C}, {_R}, {_BOTH}, {_km(16, 4)}, fr AS (SELECT kmer, count(*) AS freq FROM km GROUP BY kmer),
sd AS (SELECT read_id, strand, off, off // 4 AS seed_no, substr(oseq, off + 1, 16) AS kmer FROM (SELECT *, unnest(range(0, length(oseq) - 15, 4)) AS off FROM o)),
an AS (SELECT read_id, strand, km.contig_id, seed_no, off, freq, pos - off AS diagonal FROM sd JOIN fr USING (kmer) JOIN km USING (kmer) WHERE freq <= 512)"""


def _seeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits of every fourth seed of both strands, read lengths, and contig lengths."""
    ch = ref(spark, sf_dir)
    idx = index.kmer_index(ch, 16, 4)
    both = mapper.oriented(reads(spark, sf_dir))
    found = both.select("read_id", "strand", F.explode(S.kmers("oseq", 16, 4)).alias("x")).select("read_id", "strand", F.col("x.off").cast("long").alias("off"), "x.kmer").withColumn("seed_no", F.floor(F.col("off") / 4))
    near = idx.join(found.select("kmer").distinct(), "kmer", "left_semi")  # entries that no seed asks for go before the counts
    hits = anchors.seed_hits(found, near, index.frequencies(near))
    lengths = reads(spark, sf_dir).select("read_id", F.length("seq").alias("n"))
    return hits, lengths, ch.filter("chunk_id = 0").select("contig_id", "length")


@query(f"{_SEED_SQL} SELECT read_id, strand, contig_id, seed_no, off, freq, diagonal FROM an")
def seed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeds(spark, sf_dir)[0].select("read_id", "strand", "contig_id", "seed_no", "off", "freq", "diagonal")


_MERGE_SQL = f"""{_SEED_SQL}, ex AS (SELECT an.*, diagonal + d AS start FROM an JOIN c USING (contig_id) JOIN r USING (read_id), range(-1, 2) x(d) WHERE diagonal + d >= 0 AND diagonal + d <= c.length - greatest(1, length(r.seq) - 1)),
mg AS (SELECT read_id, strand, contig_id, start, min(freq) AS freq, least(count(*), 65535) AS n_anchors, min(off) AS min_off, max(off) AS max_off, bit_or(1::BIGINT << seed_no) AS seeds FROM ex GROUP BY ALL)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, lengths, size = _seeds(spark, sf_dir)
    return anchors.merge(anchors.expand(hits.join(size, "contig_id"), lengths, 1))


@query(f"{_MERGE_SQL} SELECT * FROM mg")
def anchor_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


_CLUSTER_SQL = f"""{_MERGE_SQL}, ln AS (SELECT *, CASE WHEN start - lag(start) OVER w <= 4 THEN 0 ELSE 1 END AS new FROM mg WINDOW w AS (PARTITION BY read_id, strand, contig_id ORDER BY start)),
rn AS (SELECT *, sum(new) OVER (PARTITION BY read_id, strand, contig_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM ln),
cl AS (SELECT read_id, strand, contig_id, min(start) AS min_start, max(start) AS max_start, min(freq) AS freq, CAST(least(sum(n_anchors), 65535) AS BIGINT) AS n_anchors, min(min_off) AS min_off, max(max_off) AS max_off, CAST(bit_count(bit_or(seeds)) AS BIGINT) AS n_seeds, min(start) + (max(start) - min(start)) // 2 AS rep FROM rn GROUP BY read_id, strand, contig_id, run)"""


@query(f"{_CLUSTER_SQL} SELECT * FROM cl")
def anchor_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.cluster(_merged(spark, sf_dir), 1)


@query(f"{_CLUSTER_SQL} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY read_id, strand ORDER BY n_seeds DESC, max_off - min_off DESC, n_anchors DESC, freq, min_start, contig_id) AS INTEGER) AS place FROM cl) WHERE place <= 64")
def cluster_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.best_clusters(anchors.cluster(_merged(spark, sf_dir), 1))


def _map_sql(k: int) -> str:
    return f"""WITH {_C}, {_R}, {_BOTH}, {_km(16, 4)},
sd AS (SELECT read_id, strand, oseq, i * (length(oseq) // {k + 1}) + j AS off, substr(oseq, i * (length(oseq) // {k + 1}) + j + 1, 16) AS kmer FROM o, range(0, {k + 1}) x(i), range(0, 4) y(j)),
dg AS (SELECT DISTINCT read_id, strand, oseq, contig_id, pos - off AS d FROM sd JOIN km USING (kmer)),
st AS (SELECT DISTINCT read_id, strand, oseq, contig_id, d + e AS start FROM dg, range({-k}, {k + 1}) x(e) WHERE d + e >= 0),
wn AS (SELECT st.*, length(oseq) + e AS ref_len, substr(seq, start + 1, length(oseq) + e) AS w FROM st JOIN c USING (contig_id), range({-k}, {k + 1}) x(e) WHERE start + length(oseq) + e <= length),
ed AS (SELECT read_id, strand, contig_id, start, ref_len, levenshtein(translate(oseq, 'N', 'n'), w) AS edit FROM wn),
sc AS (SELECT *, row_number() OVER (PARTITION BY read_id, strand, contig_id, start ORDER BY edit, ref_len) AS z FROM ed WHERE edit <= {k}),
hn AS (SELECT read_id, strand, CAST(contig_id AS VARCHAR) AS chrom, start, ref_len, edit FROM sc WHERE z = 1),
h1 AS (SELECT *, row_number() OVER w AS place, first_value(chrom) OVER w AS pc, first_value(start) OVER w AS ps FROM hn WINDOW w AS (PARTITION BY read_id ORDER BY edit, chrom, start, strand)),
h2 AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY edit, chrom, start, strand) AS place2 FROM h1 WHERE NOT (chrom = pc AND abs(start - ps) <= 10)),
p AS (SELECT * FROM h1 WHERE place = 1), a AS (SELECT * FROM h2 WHERE place2 = 1)
SELECT r.read_id, r.name, coalesce(p.chrom, '*') AS chrom, coalesce(p.start + 1, 0) AS pos, CAST(coalesce(p.edit, -1) AS INTEGER) AS edit, coalesce(p.strand, '*') AS strand, CAST(coalesce(p.ref_len, 0) AS INTEGER) AS ref_len, coalesce(a.chrom, '*') AS alt_chrom, coalesce(a.start + 1, 0) AS alt_pos, CAST(coalesce(a.edit, -1) AS INTEGER) AS alt_edit, coalesce(a.strand, '*') AS alt_strand
FROM r LEFT JOIN p USING (read_id) LEFT JOIN a USING (read_id)"""


def _mapped(spark: SparkSession, sf_dir: str, k: int, mode: str = "exhaustive") -> tuple[DataFrame, DataFrame]:
    ch = ref(spark, sf_dir)
    return mapper.map_reads(reads(spark, sf_dir), ch, index.kmer_index(ch, 16, 4), k, mode), ch


#: Values of unmapped reads in query results, as the text format prints them.
_UNMAPPED = {"chrom": "*", "pos": 0, "edit": -1, "strand": "*", "ref_len": 0, "alt_chrom": "*", "alt_pos": 0, "alt_edit": -1, "alt_strand": "*"}


def _plain(mapped: DataFrame) -> DataFrame:
    return mapped.select("read_id", "name", *_UNMAPPED).fillna(_UNMAPPED)



@query(_map_sql(0))
def map_exact_k0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_mapped(spark, sf_dir, 0)[0])


@query(_map_sql(1))
def map_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_mapped(spark, sf_dir, 1)[0])


@query(_map_sql(2))
def map_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_mapped(spark, sf_dir, 2)[0])


@query(_map_sql(3))
def map_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_mapped(spark, sf_dir, 3)[0])


@query()
def map_records_cigar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapper output lines with CIGARs (tested against a Python oracle)."""
    mapped, ch = _mapped(spark, sf_dir, 1)
    return mapper.with_cigars(mapped, ch, 1).select("read_id", mapped_line().alias("line"))


@query(f"""WITH m AS ({_map_sql(1)}) SELECT m.read_id, m.chrom, m.pos, m.alt_chrom, m.alt_pos, CASE WHEN m.chrom = '*' THEN -1 ELSE CAST(length(r.seq) AS BIGINT) END AS query_len, CASE WHEN m.chrom = '*' THEN -1 ELSE CAST(m.ref_len AS BIGINT) END AS cigar_ref_len, m.edit AS cigar_edit
FROM m JOIN ({_R.replace("b0 AS", "WITH b0 AS", 1)} SELECT * FROM r) r USING (read_id)""")
def map_records_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the CIGARs of mapped reads cover, and the edit distance of the alignments behind them."""
    mapped, ch = _mapped(spark, sf_dir, 1)
    lines = mapper.with_cigars(mapped, ch, 1)
    lengths = [F.coalesce(f("cigar"), F.lit(-1)).alias(n) for f, n in ((C.query_length, "query_len"), (C.reference_length, "cigar_ref_len"))]
    return lines.select("read_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("chrom", "*"), ("pos", 0), ("alt_chrom", "*"), ("alt_pos", 0))], *lengths, F.coalesce("cigar_edit", F.lit(-1)).alias("cigar_edit"))


@query()
def map_seeded_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capped mode (tested against exhaustive mode)."""
    return _plain(_mapped(spark, sf_dir, 1, "seeded")[0])


@query(f"WITH m AS ({_map_sql(1)}) SELECT read_id, name FROM m WHERE chrom = '*'")
def unmapped_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, 1)[0].filter("chrom IS NULL").select("read_id", "name")


# --- evaluation -------------------------------------------------------------------


@query(f"WITH {_R} SELECT read_id, name FROM r WHERE read_id // 1000 IN (SELECT conv_id FROM conversations WHERE turn = 1)")
def read_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "conversations").filter("turn = 1").select(F.col("conv_id").alias("item"))
    r = reads(spark, sf_dir).withColumn("item", F.floor(F.col("read_id") / 1000))
    return r.join(ids, "item", "left_semi").select("read_id", "name")


@query(f"WITH m AS ({RECORDS}), z AS ({SIZES}) SELECT ordinal, name, split_part(substr(alt, 5), ',', 1) AS alt_chrom FROM m WHERE alt IS NOT NULL AND split_part(substr(alt, 5), ',', 1) NOT IN (SELECT name FROM z)")
def unknown_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records(spark, sf_dir).filter("alt IS NOT NULL").select("ordinal", "name", F.split_part(F.substring("alt", 5, 100), F.lit(","), F.lit(1)).alias("alt_chrom"))
    return m.join(sizes(spark, sf_dir).select(F.col("name").alias("alt_chrom")), "alt_chrom", "left_anti")


_LEN = "list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[{}]', 1), lambda x: CAST(x AS BIGINT)))"


@query(f"WITH m AS ({RECORDS}) SELECT ordinal, cigar, CASE WHEN cigar = '*' THEN -1 ELSE CAST({_LEN.format('MI')} AS BIGINT) END AS query_len, CASE WHEN cigar = '*' THEN -1 ELSE CAST({_LEN.format('MD')} AS BIGINT) END AS ref_len FROM m")
def cigar_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("ordinal", "cigar", C.query_length("cigar").alias("query_len"), C.reference_length("cigar").alias("ref_len"))


@query(f"WITH s AS ({SAM}) SELECT cigar, regexp_full_match(cigar, '([0-9]+[MID])+') AS mid, regexp_matches(cigar, '[SH]') AS clip, count(*) AS n FROM s GROUP BY ALL")
def cigar_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sam(spark, sf_dir).groupBy("cigar", C.is_mid("cigar").alias("mid"), C.has_clip("cigar").alias("clip")).agg(F.count("*").alias("n"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapper lines of the derived records; reads are 101 bases long."""
    seq = F.repeat(F.lit("A"), 101)
    text = F.concat_ws(" ", "name", "chrom", "pos", "cigar", seq, seq, "alt")
    return parse_mapper_lines(records(spark, sf_dir).select(F.col("ordinal").alias("line_no"), text.alias("value")))


@query(f"""WITH m AS ({RECORDS}), z AS ({SIZES}), v AS (SELECT m.*, z.length, CASE WHEN cigar = '*' THEN -1 ELSE CAST({_LEN.format("MI")} AS BIGINT) END AS ql, CASE WHEN cigar = '*' THEN -1 ELSE CAST({_LEN.format("MD")} AS BIGINT) END AS rl,
  split_part(substr(alt, 5), ',', 1) AS ac, CAST(split_part(substr(alt, 5), ',', 2) AS BIGINT) AS ap, y.length AS al FROM m LEFT JOIN z ON z.name = chrom LEFT JOIN z y ON y.name = split_part(substr(alt, 5), ',', 1))
SELECT ordinal AS line_no, name, rule FROM (
  SELECT ordinal, name, 'unknown contig' AS rule FROM v WHERE chrom <> '*' AND length IS NULL
  UNION ALL SELECT ordinal, name, 'position out of bounds' FROM v WHERE chrom <> '*' AND (pos < 1 OR pos > length)
  UNION ALL SELECT ordinal, name, 'primary cigar length' FROM v WHERE chrom <> '*' AND ql <> 101
  UNION ALL SELECT ordinal, name, 'primary crosses the end' FROM v WHERE chrom <> '*' AND pos + rl - 1 > length
  UNION ALL SELECT ordinal, name, 'unknown alt contig' FROM v WHERE alt IS NOT NULL AND al IS NULL
  UNION ALL SELECT ordinal, name, 'alt crosses the end' FROM v WHERE alt IS NOT NULL AND (ap < 1 OR ap + 100 > al))""")
def output_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.violations(_lines(spark, sf_dir), sizes(spark, sf_dir))


_BASE = f"WITH m0 AS ({RECORDS}), m AS (SELECT name, arg_max(chrom, ordinal) AS chrom, arg_max(pos, ordinal) AS pos, arg_max(cigar, ordinal) AS cigar FROM m0 GROUP BY name), s AS ({SAM}), b0 AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(tags, 'NM:i:([0-9]+)', 1), '') AS INTEGER), -1) AS nm FROM s WHERE flag NOT IN (256, 2048)), b1 AS (SELECT *, rname <> '*' AND flag <> 4 AND nm BETWEEN 0 AND 1 AND NOT regexp_matches(cigar, '[SH]') AS ok FROM b0), b AS (SELECT qname AS name, CASE WHEN ok THEN rname ELSE '*' END AS chrom, CASE WHEN ok THEN pos ELSE 0 END AS pos, CASE WHEN ok THEN cigar ELSE '*' END AS cigar FROM b1)"


@query(f"""{_BASE}, j AS (SELECT coalesce(m.chrom <> '*', false) AS g, b.chrom <> '*' AS t, coalesce(m.chrom <> '*', false) AND b.chrom <> '*' AND m.chrom = b.chrom AS same, abs(m.pos - b.pos) AS d, m.cigar = b.cigar AS sc FROM b LEFT JOIN m USING (name))
SELECT count(*) AS subset_reads, count(*) FILTER (g) AS mapper_mapped, count(*) FILTER (t) AS baseline_mapped, count(*) FILTER (g AND t) AS shared_mapped, count(*) FILTER (same) AS chrom_match, count(*) FILTER (same AND d <= 10) AS within_10bp, count(*) FILTER (same AND d <= 50) AS within_50bp, count(*) FILTER (same AND d = 0) AS exact_pos, count(*) FILTER (same AND sc) AS exact_cigar, count(*) FILTER (same AND d = 0 AND sc) AS exact_primary, count(*) FILTER (g AND NOT t) AS mapper_only, count(*) FILTER (NOT g AND t) AS baseline_only FROM j""")
def baseline_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.agreement(records(spark, sf_dir), evaluate.baseline_rows(sam(spark, sf_dir), 1))


@query(f"""WITH m AS ({RECORDS}), q AS (SELECT 'case' || v AS case_id, 'o' || ordinal AS name, CASE WHEN chrom <> '*' AND ordinal % (5 + v) = 0 THEN '*' ELSE chrom END AS chrom, pos + (ordinal % (2 + v)) * v AS pos, cigar FROM m, range(0, 4) x(v))
SELECT a.case_id AS a_case_id, b.case_id AS b_case_id, count(*) AS reads, count(*) FILTER (a.chrom <> '*' AND b.chrom <> '*') AS shared_mapped, count(*) FILTER (a.chrom <> '*' AND a.chrom = b.chrom) AS chrom_match,
 count(*) FILTER (a.chrom <> '*' AND a.chrom = b.chrom AND abs(a.pos - b.pos) <= 10) AS within_10bp, count(*) FILTER (a.chrom <> '*' AND a.chrom = b.chrom AND a.pos = b.pos) AS exact_pos, count(*) FILTER (a.chrom <> '*' AND a.chrom = b.chrom AND a.cigar = b.cigar) AS exact_cigar,
 count(*) FILTER (a.chrom <> '*' AND b.chrom = '*') AS a_only, count(*) FILTER (a.chrom = '*' AND b.chrom <> '*') AS b_only
FROM q a JOIN q b ON a.name = b.name AND a.case_id < b.case_id GROUP BY ALL""")
def run_pair_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records(spark, sf_dir).withColumn("v", F.explode(F.array(*[F.lit(v) for v in range(4)])))
    runs = m.select(F.concat(F.lit("case"), "v").alias("case_id"), F.concat(F.lit("o"), "ordinal").alias("name"), F.when((F.col("chrom") != "*") & (F.col("ordinal") % (5 + F.col("v")) == 0), "*").otherwise(F.col("chrom")).alias("chrom"), (F.col("pos") + (F.col("ordinal") % (2 + F.col("v"))) * F.col("v")).alias("pos"), "cigar")
    return evaluate.run_pairs(runs)


_RUN_STATS = f"""WITH m AS ({RECORDS}), q AS (SELECT 'case' || v AS case_id, CASE WHEN chrom <> '*' AND ordinal % (5 + v) = 0 THEN '*' ELSE chrom END AS chrom, alt FROM m, range(0, 4) x(v)),
t AS (SELECT case_id, count(*) FILTER (chrom <> '*') AS mapped, count(*) FILTER (chrom = '*') AS unmapped, count(*) FILTER (alt IS NOT NULL) AS with_alt FROM q GROUP BY case_id)"""


@query(f"{_RUN_STATS} SELECT a.case_id AS a_case_id, b.case_id AS b_case_id, a.mapped - b.mapped AS delta_mapped, a.unmapped - b.unmapped AS delta_unmapped, a.with_alt - b.with_alt AS delta_with_alt FROM t a JOIN t b ON a.case_id < b.case_id")
def run_pair_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records(spark, sf_dir).withColumn("v", F.explode(F.array(*[F.lit(v) for v in range(4)])))
    runs = m.select(F.concat(F.lit("case"), "v").alias("case_id"), F.when((F.col("chrom") != "*") & (F.col("ordinal") % (5 + F.col("v")) == 0), "*").otherwise(F.col("chrom")).alias("chrom"), "alt")
    mapped = F.col("chrom") != "*"
    stats_ = runs.groupBy("case_id").agg(F.count_if(mapped).alias("mapped"), F.count_if(~mapped).alias("unmapped"), F.count_if(F.col("alt").isNotNull()).alias("with_alt"))
    cases = stats_.select(F.col("case_id").alias("a_case_id")).join(stats_.select(F.col("case_id").alias("b_case_id")), F.col("a_case_id") < F.col("b_case_id"))
    return evaluate.run_deltas(cases, stats_)


@query(f"WITH m AS ({RECORDS}) SELECT count(*) AS reads, count(*) FILTER (chrom <> '*') AS mapped, count(*) FILTER (chrom = '*') AS unmapped, count(*) FILTER (alt IS NOT NULL) AS with_alt FROM m")
def mapped_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mapped_stats(records(spark, sf_dir))


@query(f"""WITH s AS ({SAM}), v AS (SELECT *, flag <> 4 AND rname <> '*' AND coalesce(TRY_CAST(nullif(regexp_extract(tags, 'NM:i:([0-9]+)', 1), '') AS INTEGER), -1) BETWEEN 0 AND 2 AND regexp_full_match(cigar, '([0-9]+[MID])+') AS ok FROM s)
SELECT count(*) FILTER (flag NOT IN (256, 2048) AND ok) AS mapped, count(*) FILTER (flag NOT IN (256, 2048) AND NOT ok) AS unmapped, count(DISTINCT CASE WHEN flag = 256 AND ok THEN qname END) AS with_alt FROM v""")
def secondary_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.baseline_stats(sam(spark, sf_dir), 2)


_LOCI = f"""WITH s AS ({SAM}), z AS ({SIZES}), g AS (SELECT *, row_number() OVER (PARTITION BY rname, pos // 5000 ORDER BY ordinal) AS k FROM s WHERE mapq >= 55 AND NOT contains(rname, '_') AND rname <> '*' AND flag <> 4),
t AS (SELECT * FROM g WHERE k = 1 ORDER BY ordinal LIMIT 200), l AS (SELECT qname, rname AS chrom, CAST(greatest(1, pos - 250) AS BIGINT) AS start, CAST(least(length, pos + 350) AS BIGINT) AS "end" FROM t JOIN z ON z.name = rname)"""


@query(f"{_LOCI} SELECT * FROM l")
def locus_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.select_loci(sam(spark, sf_dir), 200, 5000, 55, sizes=sizes(spark, sf_dir))


@query(f'{_LOCI} SELECT chrom, count(*) AS loci, CAST(sum("end" - start + 1) AS BIGINT) AS bases FROM l GROUP BY chrom')
def locus_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locus_selection(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("loci"), F.sum(F.col("end") - F.col("start") + 1).alias("bases"))


@query(f"WITH {_R} SELECT a.read_id, b.read_id AS next_id, CAST(levenshtein(a.seq, b.seq) AS INTEGER) AS edit FROM r a JOIN r b ON b.read_id = a.read_id + 1")
def edit_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("read_id", "next_id", F.levenshtein("x", "y").alias("edit"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read with its next tile."""
    r = reads(spark, sf_dir)
    return r.select("read_id", F.col("seq").alias("x")).join(r.select(F.col("read_id").alias("next_id"), (F.col("read_id") - 1).alias("read_id"), F.col("seq").alias("y")), "read_id")


def _aligned(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pairs(spark, sf_dir).select("read_id", "next_id", align.align(kind, "x", "y").alias("a")).select("read_id", "next_id", "a.*")

    return run


for _name, _kind in (("align_edit", "edit"), ("align_weighted", "weighted"), ("align_global", "affine"), ("align_semiglobal", "semiglobal"), ("align_local", "local"), ("align_hirschberg", "hirschberg")):
    QUERIES[_name] = _aligned(_kind)


@query(f"WITH {_R} SELECT a.read_id, b.read_id AS next_id, CAST(levenshtein(a.seq, b.seq) AS INTEGER) AS edit, CAST(levenshtein(a.seq, b.seq) AS INTEGER) AS halved, true AS whole FROM r a JOIN r b ON b.read_id = a.read_id + 1")
def align_edit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of both edit alignments, and whether their rows without gaps are the reads."""
    a, b = (align.align(kind, "x", "y").alias(kind) for kind in ("edit", "hirschberg"))
    rows = _pairs(spark, sf_dir).select("read_id", "next_id", "x", "y", a, b)
    bare = lambda c: F.replace(c, F.lit("-"), F.lit(""))
    whole = [bare(F.col(f"{kind}.aligned_{v}")) == F.col(v) for kind in ("edit", "hirschberg") for v in "xy"]
    return rows.select("read_id", "next_id", F.col("edit.score").alias("edit"), F.col("hirschberg.score").alias("halved"), (whole[0] & whole[1] & whole[2] & whole[3]).alias("whole"))


# --- suffix structures -------------------------------------------------------------

# no SQL for the first four: DuckDB would write out and sort every suffix of a text; tested against brute force


@query()
def suffix_array_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_array(contigs(spark, sf_dir)).select("contig_id", "row", "pos")


@query()
def bwt_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.bwt_strings(contigs(spark, sf_dir))


@query()
def occ_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.contig_checkpoints(contigs(spark, sf_dir))


@query()
def sa_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.contig_samples(contigs(spark, sf_dir))


@query(f"""WITH {_C}, l AS (SELECT contig_id, unnest(string_split(seq || '$', '')) AS ch FROM c), n AS (SELECT contig_id, ch, count(*) AS n FROM l WHERE ch <> '' GROUP BY ALL)
SELECT contig_id, ch, n, CAST(coalesce(sum(n) OVER (PARTITION BY contig_id ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM n""")
def fm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol counts taken from the BWT; they are those of the text."""
    return suffix.contig_symbol_starts(contigs(spark, sf_dir))


@query(f"WITH {_C} SELECT contig_id, md5(seq) AS digest FROM c")
def bwt_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts spelled out of their BWTs: right only if the suffixes are in order."""
    return suffix.inverted(suffix.fm_table(contigs(spark, sf_dir))).select("contig_id", F.md5("seq").alias("digest"))


@query(f"""WITH {_C}, p AS (SELECT unnest({list(_PATTERNS)}) AS pattern), h AS (SELECT pattern, contig_id, count(*) AS n FROM (SELECT pattern, contig_id, base, piece, unnest(range(0, least(512, length - base - length(pattern) + 1))) AS off FROM {_cut()}, p) WHERE substr(piece, off + 1, length(pattern)) = pattern GROUP BY ALL)
SELECT contig_id, pattern, coalesce(n, 0) AS n FROM c CROSS JOIN p LEFT JOIN h USING (contig_id, pattern)""")
def fm_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often patterns occur, by backward search alone."""
    pats = spark.createDataFrame([(p,) for p in _PATTERNS], "pattern string")
    return suffix.membership(suffix.fm_table(contigs(spark, sf_dir)), pats)


# --- events and runs ----------------------------------------------------------------


def _micros(name: str) -> Column:
    """Microseconds since 1970, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 1800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n_events, round(sum(value), 4) AS total FROM s GROUP BY user_id, session_no""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(table(spark, sf_dir, "events"))
    return s.select("user_id", "session_no", _micros("start").alias("start_us"), _micros("end").alias("end_us"), "n_events", F.round("total", 4).alias("total"))


@query("""WITH t AS (SELECT 'case' || (o_orderkey % 5) AS case_id, 1.0::DOUBLE + (o_orderkey % 97) AS "real" FROM orders), p AS (SELECT case_id, count(*) AS runs, min("real") AS best, avg("real") AS mean FROM t GROUP BY case_id)
SELECT case_id, runs, best, mean, 1000000.0::DOUBLE / mean AS reads_per_s, max(mean) OVER () / mean AS speed_up FROM p""")
def runtime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("case"), F.col("o_orderkey") % 5).alias("case_id"), (1.0 + F.col("o_orderkey") % 97).alias("real"))
    return evaluate.timing_summary(o, 1_000_000)


from strandmill import file_queries  # noqa: E402, F401  registers its queries here
