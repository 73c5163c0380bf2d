"""Text sinks. Order is kept by an explicit key, never by partition order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mapped_line() -> Column:
    """One line of mapper output from read and hit columns; the original sequence and quality are printed."""
    hit = F.concat_ws(" ", "name", F.coalesce("chrom", F.lit("*")), F.coalesce(F.col("pos").cast("string"), F.lit("0")), F.coalesce("cigar", F.lit("*")), "seq", "qual")
    alt = F.concat(F.lit(" ALT:"), F.concat_ws(",", "alt_chrom", "alt_pos", "alt_cigar"))
    return F.when(F.col("chrom").isNotNull() & F.col("alt_chrom").isNotNull(), F.concat(hit, alt)).otherwise(hit)


def write_mapped(df: DataFrame, path: str) -> None:
    """Mapper output in read order."""
    df.orderBy("read_id").select(mapped_line().alias("value")).write.text(path)


def write_fasta(df: DataFrame, path: str, width: int | None = None) -> None:
    """FASTA, one line for each sequence, or wrapped at ``width``."""
    seq = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n") if width else F.col("seq")
    df.select(F.concat(F.lit(">"), "name", F.lit("\n"), seq).alias("value")).write.text(path)


def write_fastq(df: DataFrame, path: str) -> None:
    """FASTQ with a bare third line, in read order."""
    df.orderBy("read_id").select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.text(path)


def write_report(df: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    """A small headered table."""
    df.coalesce(1).write.csv(path, sep=sep, header=header)


def write_key_values(df: DataFrame, path: str) -> None:
    """The single row of ``df`` as ``k=v`` lines."""
    lines = F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns])
    df.select(F.explode(lines).alias("value")).coalesce(1).write.text(path)


def percent(part: Column, whole: Column) -> Column:
    """A percentage with two decimals, as reports print it."""
    return F.format_string("%.2f", F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0)))


#: Fixed lines of the statistics report.
RULE, DASHES, TITLE = "=" * 44, "-" * 44, "       SUMMARY GENOMIC ANALYSIS"


def statistics_lines(total: DataFrame, each: DataFrame | None = None, reads: bool = False) -> DataFrame:
    """The statistics report as rows (section, name, line_no, value), to be read in that order.

    ``total`` is the row of :func:`strandmill.operators.stats.global_stats`, ``each``
    the table of :func:`per_sequence`, by name; reports of reads also give lengths.
    """
    two = lambda c: F.concat(F.format_string("%.2f", F.coalesce(F.col(c), F.lit(0.0))), F.lit("%"))
    said = lambda label, c: F.concat(F.lit(label), F.coalesce(c.cast("string"), F.lit("0")))

    def rows(df: DataFrame, section: int, name: Column, lines: list[Column]) -> DataFrame:
        return df.select(F.lit(section).alias("section"), name.alias("name"), F.posexplode(F.array(*lines)).alias("line_no", "value"))

    bp = lambda label, c: F.concat(said(label, F.col(c)), F.lit(" bp"))
    foot = [F.lit("GLOBAL SUMMARY:"), bp("  > Total length: ", "total"), F.concat(F.lit("  > Total GC content: "), two("gc_pct"))]
    if reads:
        foot += [bp("  > Minimum read: ", "shortest"), bp("  > Maximum read: ", "longest"), bp("  > Avg length read: ", "mean")]
    head = [F.lit(RULE), F.lit(TITLE), F.lit(RULE), said("Number of processed sequences: ", F.col("n_seqs"))]
    body = [said("ID: ", F.col("name")), bp("  > Length: ", "length"), F.concat(F.lit("  > GC content: "), two("gc_pct")), F.lit("")]
    if each is not None or reads:
        (foot.insert(0, F.lit(DASHES)) if reads else head.append(F.lit(DASHES)))
    if each is not None:
        (head if reads else body).append(F.lit(DASHES))
    out = rows(total, 0, F.lit(""), head).unionByName(rows(total, 2, F.lit(""), [*foot, F.lit(RULE)]))
    return out if each is None else out.unionByName(rows(each, 1, F.col("name"), body))


def write_statistics(total: DataFrame, path: str, each: DataFrame | None = None, reads: bool = False) -> None:
    """The statistics report as text, its lines in order over the part files."""
    statistics_lines(total, each, reads).orderBy("section", "name", "line_no").select("value").write.text(path)
