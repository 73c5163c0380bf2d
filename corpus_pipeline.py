"""A corpus pipeline over ``documents``: language, copies, near copies, mix, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it keeps is
written as Parquet and reread by the next. All but the last return the columns
of ``documents`` and whatever other columns came along. No decision reaches the
driver. A stage's result must be written before the next stage is called in the
same session: what the stage wrote on the way to it is deleted then. Results of
operators called elsewhere are not touched.

Edge cases, in every stage: rows are told apart by doc_id where ids are unique and
not null (checked), else by a number given to each row, so a repeated or null id
never takes another row with it; null and empty texts go in the first stage;
columns of any name may come along, also those that operators use inside; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import exact_dedup, jaccard_join, language_id, mixing, piece_sampling
from strandmill.llm.common import Scratch, documents, stage
from strandmill.llm.queries import tokenizer

#: A document goes when its main language holds less than this share of its letters.
LEAST_SCORE = 0.5
#: Near copies: shingles of five words, similarity of 0.8 or more.
SHINGLE, NUM, DEN = 5, 80, 100

_Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_before: dict[str, Scratch] = {}


def _own_tables(step: _Stage) -> _Stage:
    """The tables staged by ``step`` go when the next stage begins."""

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        if app in _before:
            _before.pop(app).drop()
        with Scratch(spark) as mine:
            out = step(spark, docs, sf_dir)
        _before[app] = mine
        return out

    return run


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the column that names each row: doc_id, or where ids repeat or are null a number, in a staged table."""
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return docs, "doc_id"
    row = _fresh(docs, "row")
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows whose name is not in the first column of ``gone``."""
    name = _fresh(rows, "gone")
    gone = gone.select(F.col(gone.columns[0]).alias(name))
    return rows.join(gone, F.col(row) == F.col(name), "left_anti")


def _losers(rows: DataFrame, row: str, grouped: DataFrame, pick: Callable[[Column], Column], order: list[Column]) -> DataFrame:
    """Names of all rows of each group (grouped: row, group) but the one that ``pick`` takes by ``order``."""
    named = rows.select(F.col(row).alias("row"), F.struct(*order, F.col(row).alias("row")).alias("by")).join(grouped, "row")
    heads = stage(named.groupBy("group").agg(pick(F.col("by")).alias("by")).select(F.col("by.row").alias("head")), "heads")
    return named.select("row").join(heads, F.col("row") == F.col("head"), "left_anti")


@_own_tables
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known; texts without letters and null texts go."""
    return language_id.keep_identified(docs, language_id.fit(docs), LEAST_SCORE)


@_own_tables
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts: the one of the largest doc_id, null ids first to go."""
    rows, row = _rows(docs)
    judged = exact_dedup.exact_dedup(rows, id_col=row)
    if row == "doc_id":
        return _without(rows, row, judged.filter("NOT kept").select("doc_id"))
    grouped = judged.filter("group_size > 1").select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group"))
    return _without(rows, row, _losers(rows, row, grouped, F.max, [F.col("doc_id")])).select(*_columns(docs))


@_own_tables
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each linked group: the one of the least doc_id, null ids first to go."""
    rows, row = _rows(docs)
    near = jaccard_join.jaccard_components(rows, id_col=row, shingle=SHINGLE, num=NUM, den=DEN)
    if row == "doc_id":
        return _without(rows, row, near.filter("component_id != doc_id").select("doc_id"))
    grouped = near.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    return _without(rows, row, _losers(rows, row, grouped, F.min, [F.col("doc_id").isNull(), F.col("doc_id")])).select(*_columns(docs))


@_own_tables
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, to the nearest whole number; rows without words are never taken."""
    rows, row = _rows(docs)
    name, times, copy = (_fresh(rows, x) for x in ("name", "times", "copy"))
    taken = mixing.mix_sources(rows, id_col=row).filter("size > 0")
    taken = taken.select(F.col("doc_id").alias(name), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias(times)).filter(F.col(times) > 0)
    joined = rows.join(taken, F.col(row) == F.col(name))
    return joined.select(*_columns(docs), F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)


@_own_tables
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every row, with the digest of the decoded text; copies of a row draw alike."""
    return piece_sampling.encode_sampled(docs, tokenizer("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix),
    ("SentencePiece", encode_pieces),
]

#: Trained and sampled stages have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, held = documents(spark, sf_dir), None
    for name, step in STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        with Scratch(spark) as kept:
            docs = stage(out, name.replace(" ", "-"))
        if held is not None:
            held.drop()
        held = kept
    return STAGES[-1][1](spark, docs, sf_dir)
