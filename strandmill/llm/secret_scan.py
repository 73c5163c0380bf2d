"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Rules find candidate spans in each whole text. The values (hashed) are then
aggregated over the corpus by distinct repositories and distinct owners: a value
that many owners hold, or many repositories even of one owner, is a copied example;
one that few hold looks live. Opaque tokens (long, upper and lower case with digits)
count as secrets only where few hold them; that adds spans and never drops a base
one.

A text's matches are rows, so positions are running sums and overlaps running
maxima: work grows with the matches, not with their square. Only matches and their
lengths are shuffled, never texts. A value's counts are summed before the shuffle and
staged, so a value that a third of all rows hold meets them in a join that Spark can
split.

Edge cases: null texts are empty; null owners form one owner; rows may repeat;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandmill.llm.common import stage

#: Fixed patterns, as the contract gives them; letters of the assignment's key in either case.
KEYS = ("password", "passwd", "secret", "token", "api_?key")
VALUE = "[A-Za-z0-9+/_.=-]+"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
ACCESS_LEAST, HEX_LEAST, VALUE_LEAST = 16, 32, 8
#: Own rule: runs of 24 or more token characters.
OPAQUE = "[A-Za-z0-9_+/-]{24,}"
KINDS = ("assign", "access", "hex", "opaque")
#: Up to so many distinct owners a value counts as owner-specific.
MAX_OWNERS = 2
#: And up to so many distinct repositories.
MAX_REPOS = 10


def any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = f"({'|'.join(map(any_case, KEYS))})[\"']?\\x20*[:=]\\x20*[\"']?({VALUE})"


def _matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Array of (kind, nth, gap, size, value) of all matches: the code points before a match since the last one, and its own."""
    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("vals"),
    )
    zipped = F.transform(F.array(parts), lambda p: F.arrays_zip(F.slice(p["gaps"], 1, F.size(p["hits"])).alias("gap"), p["hits"].alias("hit"), p["vals"].alias("val")))[0]
    return F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), x["val"].alias("val")))


def candidate_matches(text: Column) -> Column:
    """All matches of a text, of the base kinds 0-2 and of opaque tokens (3); too short assigned values and plain opaque tokens are still among them."""
    none = F.array().cast("array<struct<kind:int,nth:int,gap:int,size:int,val:string>>")
    low = F.lower(text)
    keyed = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    assign = F.when(keyed, _matches(text, ASSIGN, 0, 2)).otherwise(none)
    # a run of the class that is too short fails whole, and no later start in it is longer: so the least length may stand in the pattern
    access = F.when(text.contains("AKIA"), _matches(text, f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", 1)).otherwise(none)
    hexes = F.when(text.rlike(f"[0-9a-f]{{{HEX_LEAST}}}"), _matches(text, f"[0-9a-f]{{{HEX_LEAST},}}", 2)).otherwise(none)
    opaque = F.when(text.rlike(OPAQUE), _matches(text, OPAQUE, 3)).otherwise(none)
    return F.concat(assign, access, hexes, opaque)


def candidate_spans(rows: DataFrame) -> DataFrame:
    """(row_key, owner, repo, matches) to one row for each span: row_key, owner, repo, kind, start, end, value_hash.

    Base spans, and opaque tokens that no base span covers.
    """
    one = rows.filter(F.size("matches") > 0).select("row_key", "owner", "repo", F.inline("matches"))
    until = W.partitionBy("row_key", "kind").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    one = one.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(until).cast("int")).withColumn("start", F.col("end") - F.col("size"))
    base = F.col("kind") < 3
    mixed = F.col("val").rlike("[0-9]") & F.col("val").rlike("[a-z]") & F.col("val").rlike("[A-Z]")
    fits = F.when(F.col("kind") == 0, F.length("val") >= VALUE_LEAST).otherwise(base | mixed)
    one = one.filter(fits).select("row_key", "owner", "repo", "kind", "start", "end", F.sha2("val", 256).alias("value_hash"))
    # a token overlaps a base span that starts no later and ends after its start, or starts within it
    early = W.partitionBy("row_key").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, 0)
    late = W.partitionBy("row_key").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(base, F.col("end"))).over(early)
    next_ = F.min(F.when(base, F.col("start"))).over(late)
    seen = one.withColumn("reach", reach).withColumn("next", next_)
    free = ~(F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False)))
    return seen.filter(base | free).drop("reach", "next")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))


def _is_kind(kind: int):
    return lambda s: s["kind"] == kind


def ownership(found: DataFrame) -> DataFrame:
    """For each value hash: distinct repositories (of an owner) and owners that hold it."""
    per_owner = found.select("value_hash", "owner", "repo").distinct().groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return per_owner.groupBy("value_hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_opaque, n_owner_specific, n_widely_copied, held_by, findings.

    A value is owner-specific if at most ``max_owners`` owners and ``max_repos``
    repositories hold it. ``held_by`` lists owners/repositories of each span in the
    order of ``spans``; ``findings`` has the same as an array of structs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"), candidate_matches(text).alias("matches"))
    rows = stage(rows.withColumn("row_key", F.monotonically_increasing_id()), "matches")
    found = stage(candidate_spans(rows), "spans")
    judged = found.join(stage(ownership(found), "ownership"), "value_hash")
    judged = judged.withColumn("specific", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).filter((F.col("kind") < 3) | F.col("specific"))
    per_row = judged.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "n_repos", "n_owners", "specific"))).alias("found"))
    out = rows.select("row_key", "doc_id").join(per_row, "row_key", "left")
    spans = F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int,n_repos:bigint,n_owners:bigint,specific:boolean>>"))
    out = out.withColumn("findings", spans).drop("found")
    count = lambda test: F.size(F.filter("findings", test)).cast("long")
    return out.select(
        "doc_id",
        *[count(_is_kind(k)).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])],
        F.sha2(_joined(F.filter("findings", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _joined(F.col("findings")).alias("spans"),
        count(lambda s: s["kind"] == 3).alias("n_opaque"),
        count(lambda s: s["specific"]).alias("n_owner_specific"),
        count(lambda s: ~s["specific"]).alias("n_widely_copied"),
        F.concat_ws(",", F.transform("findings", lambda s: F.concat_ws("/", s["n_owners"], s["n_repos"]))).alias("held_by"),
        "findings",
    )
