"""Conversion, validation and comparison of mapping results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.cigar import flag_set, has_clip, is_mid, nm_tag, query_length, reference_length


def baseline_rows(sam: DataFrame, max_nm: int) -> DataFrame:
    """Primary SAM lines as comparison rows (name, chrom, pos, cigar); what is unmapped, clipped or beyond ``max_nm`` becomes unmapped."""
    primary = sam.filter(~flag_set("flag", 256) & ~flag_set("flag", 2048))
    nm = nm_tag("tags")
    good = (F.col("rname") != "*") & ~flag_set("flag", 4) & (nm >= 0) & (nm <= max_nm) & ~has_clip("cigar")
    return primary.select(F.col("qname").alias("name"), F.when(good, F.col("rname")).otherwise("*").alias("chrom"), F.when(good, F.col("pos")).otherwise(0).cast("long").alias("pos"), F.when(good, F.col("cigar")).otherwise("*").alias("cigar"))


def baseline_stats(sam: DataFrame, max_nm: int) -> DataFrame:
    """mapped, unmapped and with_alt (distinct names with a valid secondary line) of SAM lines."""
    nm = nm_tag("tags")
    valid = ~flag_set("flag", 4) & (F.col("rname") != "*") & (nm >= 0) & (nm <= max_nm) & is_mid("cigar")
    primary = ~flag_set("flag", 256) & ~flag_set("flag", 2048)
    return sam.agg(F.count_if(primary & valid).alias("mapped"), F.count_if(primary & ~valid).alias("unmapped"), F.count_distinct(F.when(flag_set("flag", 256) & valid, F.col("qname"))).alias("with_alt"))


def mapped_stats(rows: DataFrame) -> DataFrame:
    """reads, mapped, unmapped, with_alt of mapper rows (chrom ``*`` or null: unmapped)."""
    mapped = F.coalesce(F.col("chrom"), F.lit("*")) != "*"
    alt = F.col("alt").isNotNull() & (F.col("alt") != "")
    return rows.agg(F.count("*").alias("reads"), F.count_if(mapped).alias("mapped"), F.count_if(~mapped).alias("unmapped"), F.count_if(alt).alias("with_alt"))


def last_by_name(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row for each name: the last in file order."""
    return rows.groupBy("name").agg(F.max_by(F.struct("chrom", "pos", "cigar"), ordinal).alias("s")).select("name", "s.*")


def agreement(mapper: DataFrame, baseline: DataFrame, ordinal: str = "ordinal", near: tuple[int, ...] = (10, 50)) -> DataFrame:
    """How far a mapper agrees with a baseline, read by read: one row of counters.

    The baseline's rows all count; of mapper rows that share a name the last does.
    ``exact_primary`` asks for the same contig, position and CIGAR.
    """
    m = last_by_name(mapper, ordinal).select("name", F.col("chrom").alias("mc"), F.col("pos").alias("mp"), F.col("cigar").alias("mg"))
    j = baseline.join(m, "name", "left")
    got, base = F.coalesce(F.col("mc") != "*", F.lit(False)), F.col("chrom") != "*"
    same = got & base & (F.col("mc") == F.col("chrom"))
    delta = F.abs(F.col("mp") - F.col("pos"))
    return j.agg(
        F.count("*").alias("subset_reads"),
        F.count_if(got).alias("mapper_mapped"),
        F.count_if(base).alias("baseline_mapped"),
        F.count_if(got & base).alias("shared_mapped"),
        F.count_if(same).alias("chrom_match"),
        *[F.count_if(same & (delta <= n)).alias(f"within_{n}bp") for n in near],
        F.count_if(same & (delta == 0)).alias("exact_pos"),
        F.count_if(same & (F.col("mg") == F.col("cigar"))).alias("exact_cigar"),
        F.count_if(same & (delta == 0) & (F.col("mg") == F.col("cigar"))).alias("exact_primary"),
        F.count_if(got & ~base).alias("mapper_only"),
        F.count_if(~got & base).alias("baseline_only"),
    )


def run_pairs(runs: DataFrame) -> DataFrame:
    """All pairs of runs (case_id, name, chrom, pos, cigar), compared by name: one row of counters for each pair.

    The join is on the name, so the pairs are of runs, never of reads.
    """
    a = runs.select("name", *[F.col(c).alias(f"a_{c}") for c in ("case_id", "chrom", "pos", "cigar")])
    b = runs.select("name", *[F.col(c).alias(f"b_{c}") for c in ("case_id", "chrom", "pos", "cigar")])
    j = a.join(b, "name").filter("a_case_id < b_case_id")
    am, bm = F.col("a_chrom") != "*", F.col("b_chrom") != "*"
    same = am & bm & (F.col("a_chrom") == F.col("b_chrom"))
    delta = F.abs(F.col("a_pos") - F.col("b_pos"))
    return j.groupBy("a_case_id", "b_case_id").agg(
        F.count("*").alias("reads"),
        F.count_if(am & bm).alias("shared_mapped"),
        F.count_if(same).alias("chrom_match"),
        F.count_if(same & (delta <= 10)).alias("within_10bp"),
        F.count_if(same & (delta == 0)).alias("exact_pos"),
        F.count_if(same & (F.col("a_cigar") == F.col("b_cigar"))).alias("exact_cigar"),
        F.count_if(am & ~bm).alias("a_only"),
        F.count_if(~am & bm).alias("b_only"),
    )


def run_deltas(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Pairs of runs (a_case_id, b_case_id) with the first run's counts less the second's: delta_mapped, delta_unmapped, delta_with_alt; ``stats``: case_id and the counts."""
    names = ("mapped", "unmapped", "with_alt")
    a, b = (stats.select(F.col("case_id").alias(f"{x}_case_id"), *[F.col(c).alias(f"{x}_{c}") for c in names]) for x in "ab")
    both = pairs.join(a, "a_case_id").join(b, "b_case_id")
    return both.select(*pairs.columns, *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"delta_{c}") for c in names])


def violations(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Broken output rules: line_no, name, rule; rows are raw mapper lines (n_fields, name, chrom, pos, cigar, seq, qual, alt).

    ``sizes`` has one row for each contig; the join lets Spark choose by its size.
    """
    text = "^ALT:[^,]+,[0-9]+,([0-9]+[MID])+$"
    part = F.split(F.regexp_replace("alt", "^ALT:", ""), ",")
    ok_alt = F.col("alt").rlike(text)
    r = rows.withColumn("p", F.col("pos").try_cast("long")).withColumn("alt_chrom", F.when(ok_alt, part[0])).withColumn("alt_pos", F.when(ok_alt, part[1].try_cast("long"))).withColumn("alt_cigar", F.when(ok_alt, part[2]))
    r = r.join(sizes.select(F.col("name").alias("chrom"), F.col("length").alias("size")), "chrom", "left").join(sizes.select(F.col("name").alias("alt_chrom"), F.col("length").alias("alt_size")), "alt_chrom", "left")
    hit = F.col("chrom") != "*"
    rlen, alt_rlen = reference_length("cigar"), reference_length("alt_cigar")
    rules: dict[str, Column] = {
        "field count": (F.col("n_fields") < 6) | (F.col("n_fields") > 7),
        "sequence and quality lengths": F.length("seq") != F.length("qual"),
        "unmapped coordinates": ~hit & ((F.col("pos") != "0") | (F.col("cigar") != "*")),
        "unknown contig": hit & F.col("size").isNull(),
        "position out of bounds": hit & F.col("size").isNotNull() & ((F.col("p") < 1) | (F.col("p") > F.col("size"))),
        "primary cigar": hit & ~is_mid("cigar"),
        "primary cigar length": hit & is_mid("cigar") & (query_length("cigar") != F.length("seq")),
        "primary crosses the end": hit & is_mid("cigar") & ((rlen < 1) | (F.col("p") + rlen - 1 > F.col("size"))),
        "alt syntax": F.col("alt").isNotNull() & ~ok_alt,
        "unknown alt contig": ok_alt & F.col("alt_size").isNull(),
        "alt cigar length": ok_alt & (query_length("alt_cigar") != F.length("seq")),
        "alt crosses the end": ok_alt & ((F.col("alt_pos") < 1) | (F.col("alt_pos") + alt_rlen - 1 > F.col("alt_size"))),
    }
    broken = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(rule)) for rule, test in rules.items()])
    return r.select("line_no", "name", F.explode(F.array_compact(broken)).alias("rule"))


def select_loci(sam: DataFrame, n: int, min_gap: int, min_mapq: int = 60, before: int = 250, after: int = 350, sizes: DataFrame | None = None) -> DataFrame:
    """The first locus of each (contig, floor(pos / min_gap)) in file order, then the first ``n``: qname, chrom, start, end (1-based, clamped)."""
    good = sam.filter((F.col("mapq") >= min_mapq) & ~F.col("rname").contains("_") & (F.col("rname") != "*") & ~flag_set("flag", 4))
    one = good.groupBy("rname", F.floor(F.col("pos") / min_gap).alias("bucket")).agg(F.min_by(F.struct("ordinal", "qname", "pos"), "ordinal").alias("s"))
    top = one.select("rname", "s.*").orderBy("ordinal").limit(n)
    start, end = F.greatest(F.lit(1), F.col("pos") - before), F.col("pos") + after
    if sizes is not None:
        top = top.join(sizes.select(F.col("name").alias("rname"), "length"), "rname")
        end = F.least(F.col("length"), end)
    return top.select("qname", F.col("rname").alias("chrom"), start.cast("long").alias("start"), end.cast("long").alias("end"))


def timing_summary(runs: DataFrame, reads: int) -> DataFrame:
    """case_id, runs, best, mean, reads_per_s, speed_up against the slowest case's mean."""
    from pyspark.sql import Window as W

    per = runs.groupBy("case_id").agg(F.count("*").alias("runs"), F.min("real").alias("best"), F.avg("real").alias("mean"))
    return per.select("case_id", "runs", "best", "mean", F.try_divide(F.lit(float(reads)), "mean").alias("reads_per_s"), F.try_divide(F.max("mean").over(W.partitionBy()), "mean").alias("speed_up"))


def level_savings(levels: DataFrame) -> DataFrame:
    """Index size and memory of each level against level 0, in percent saved."""
    base = levels.filter("level = 0").select(F.col("index_size_bytes").alias("i0"), F.col("map_peak_rss_bytes").alias("m0")).limit(1)
    saved = lambda c, z: F.try_divide(100.0 * (F.col(z) - F.col(c)), F.col(z))
    return levels.join(F.broadcast(base)).select(*levels.columns, saved("index_size_bytes", "i0").alias("index_saved_pct"), saved("map_peak_rss_bytes", "m0").alias("rss_saved_pct"))
