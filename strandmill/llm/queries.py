"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import exact_dedup, jaccard_join, language_id, mixing, piece_sampling, quality, secret_scan, sharding, substring_dedup, token_files
from strandmill.llm.common import WORD, documents


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir)).drop("findings")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class_size")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(documents(spark, sf_dir))


def op3_sharding_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of 256 KB at most, so that buckets split at every size of the tables."""
    return sharding.extendible_shards(documents(spark, sf_dir), max_bytes=1 << 18)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir), with_text=False)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode_sampled(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.fit(docs))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_sharding": op3_sharding,
    "op3_sharding_small": op3_sharding_small,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_mixing": op6_mixing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_language_id": op9_language_id,
    "op10_token_files": op10_token_files,
}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hits(kind: int, pattern: str, group: int, least: int) -> str:
    """SQL for the spans of one kind over the view t(doc_id, owner, text)."""
    p = _lit(pattern)
    return f"""
    SELECT doc_id, owner, {kind} AS kind,
      CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS BIGINT) AS s,
      hits[i] AS hit, vals[i] AS val
    FROM (SELECT doc_id, owner, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, owner, regexp_split_to_array(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {group}) AS vals FROM t))
    WHERE length(vals[i]) >= {least}"""


_S = secret_scan
OP1_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),
base AS ({_hits(0, _S.ASSIGN, 2, _S.VALUE_LEAST)} UNION ALL {_hits(1, _S.ACCESS, 0, _S.ACCESS_LEAST)} UNION ALL {_hits(2, _S.HEX, 0, _S.HEX_LEAST)}),
opaque AS (SELECT * FROM ({_hits(3, _S.OPAQUE, 0, 1)}) o
  WHERE regexp_matches(val, '[0-9]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.s < o.s + length(o.hit) AND o.s < b.s + length(b.hit))),
found AS (SELECT doc_id, owner, kind, s, s + length(hit) AS e, val FROM (SELECT * FROM base UNION ALL SELECT * FROM opaque)),
own AS (SELECT val, count(DISTINCT owner) AS n_owners, count(DISTINCT owner || chr(0) || coalesce(CAST(doc_id AS VARCHAR), '')) AS n_repos FROM found GROUP BY val),
judged AS (SELECT f.*, n_owners, n_repos, n_owners <= {_S.MAX_OWNERS} AND n_repos <= {_S.MAX_REPOS} AS specific, (['assign', 'access', 'hex', 'opaque'])[kind + 1] || ':' || s || ':' || e AS span FROM found f JOIN own USING (val) WHERE kind < 3 OR (n_owners <= {_S.MAX_OWNERS} AND n_repos <= {_S.MAX_REPOS})),
per AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS b, string_agg(span, ',' ORDER BY s, kind) AS spans,
  count(*) FILTER (kind = 3) AS n_opaque, count(*) FILTER (specific) AS n_owner_specific, count(*) FILTER (NOT specific) AS n_widely_copied, string_agg(n_owners || '/' || n_repos, ',' ORDER BY s, kind) AS held_by
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_opaque, 0) AS n_opaque, coalesce(n_owner_specific, 0) AS n_owner_specific, coalesce(n_widely_copied, 0) AS n_widely_copied, coalesce(held_by, '') AS held_by
FROM documents d LEFT JOIN per USING (doc_id)"""

def _shards(limit: int) -> str:
    return f"""
WITH r AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
lv AS (SELECT doc_id, d AS depth, h >> ({sharding.HASH_BITS} - d) AS prefix, n_bytes FROM r, range(0, {sharding.HASH_BITS}) x(d)),
b AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM lv GROUP BY depth, prefix HAVING sum(n_bytes) <= {limit}),
c AS (SELECT lv.doc_id, lv.n_bytes, lv.depth, lv.prefix, shard_bytes, shard_docs, row_number() OVER (PARTITION BY doc_id ORDER BY lv.depth) AS k FROM lv JOIN b USING (depth, prefix))
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth, prefix, CAST(0 AS BIGINT) AS piece,
  CASE WHEN depth = 0 THEN 'root' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard, shard_bytes, shard_docs, false AS oversize
FROM c WHERE k = 1"""


_M = mixing
OP6_SQL = f"""
WITH z AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {_lit(WORD)})), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
p0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
p1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM p0),
p2 AS (SELECT *, CAST(([5, 2, 1])[(sid - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM p1),
p3 AS (SELECT *, row_number() OVER w AS rn, (total - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM p2 WINDOW w AS (ORDER BY cap / weight, sid)),
p4 AS (SELECT *, min(CASE WHEN level * weight < cap THEN rn END) OVER () AS open_from FROM p3),
p5 AS (SELECT *, max(CASE WHEN rn = open_from THEN level END) OVER () AS final FROM p4),
tg AS (SELECT sid, source, source_size, CASE WHEN open_from IS NULL OR rn < open_from THEN cap ELSE final * weight END AS target, total FROM p5),
k AS (SELECT greatest(1, CAST(floor(max(total) / {_M.SLOTS}) AS BIGINT)) AS block, max(total) AS total FROM tg),
iv AS (SELECT sid, CAST(coalesce(lag(hi) OVER (ORDER BY sid), 0) AS BIGINT) AS lo, CASE WHEN sid = max(sid) OVER () THEN 4294967296 ELSE hi END AS hi FROM (
  SELECT sid, CAST(floor(sum(target) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) / total * 4294967296) AS BIGINT) AS hi FROM tg)),
pt AS (SELECT slot, ((slot + 1) * 2654435769) % 4294967296 AS x FROM (SELECT unnest(range(CAST(ceil(total / block) AS BIGINT))) AS slot FROM k)),
rk AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM pt JOIN iv ON x >= lo AND x < hi),
bl AS (SELECT sid, greatest(1, CAST(ceil(source_size / block) AS BIGINT)) AS blocks FROM tg, k),
tk AS (SELECT sid, rank % blocks AS b, count(*) AS takes FROM rk JOIN bl USING (sid) WHERE rank < 2 * blocks GROUP BY ALL),
la AS (SELECT doc_id, size, sid, source_size, target, CAST(sum(size) OVER (PARTITION BY sid ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS pos FROM z JOIN tg ON z.source IS NOT DISTINCT FROM tg.source),
pc AS (SELECT doc_id, sid, pos, size, block, unnest(range(pos // block, (pos + size - 1) // block + 1)) AS b FROM la, k WHERE size > 0),
gt AS (SELECT doc_id, CAST(sum((least(pos + size, (b + 1) * block) - greatest(pos, b * block)) * takes) AS BIGINT) AS taken FROM pc JOIN tk USING (sid, b) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM la LEFT JOIN gt USING (doc_id)"""

OP7_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)"""

ORACLE_SQL = {
    "op1_secret_scans": OP1_SQL,
    "op3_sharding": _shards(sharding.MAX_BYTES),
    "op3_sharding_small": _shards(1 << 18),
    "op6_mixing": OP6_SQL,
    "op7_exact_dedup": OP7_SQL,
}
