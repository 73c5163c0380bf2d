import random

import pytest
from pyspark.sql import functions as F

from strandmill.functions import cigar, quality, sequence


def one(spark, col, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).first()[0]


def test_normalize(spark):
    assert one(spark, sequence.normalize("s"), s="acgtNRyX-") == "ACGTNNNNN"
    assert one(spark, sequence.normalize("s", "as_a"), s="acgtNRyX") == "ACGTAAAA"
    with pytest.raises(ValueError):
        sequence.normalize("s", "drop")


def test_reverse_complement(spark):
    r = random.Random(1)
    for n in (0, 1, 7, 64, 129):
        s = "".join(r.choice("ACGTN") for _ in range(n))
        want = "".join({"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"}[c] for c in reversed(s))
        assert one(spark, sequence.reverse_complement("s"), s=s) == want


def test_codes(spark):
    assert one(spark, sequence.kmer_code("s"), s="ACGT" * 4) == int("0123" * 4, 4)
    assert one(spark, sequence.kmer_code("s"), s="ACGN") is None
    assert one(spark, sequence.kmer_from_code(sequence.kmer_code("s"), 9), s="AACGTTGCA") == "AACGTTGCA"
    assert [one(spark, sequence.base_code("s"), s=c) for c in "ACGTN"] == [0, 1, 2, 3, -1]
    assert one(spark, sequence.ranks("s"), s="ACGT") == "23450"


def test_gc(spark):
    assert one(spark, sequence.gc_count("s"), s="gGcCATKOSW") == 4
    assert one(spark, sequence.gc_count("s", "bits"), s="gGcCATKOSW") == 8
    assert one(spark, sequence.gc_content("s"), s="") == 0.0


def test_kmers(spark):
    got = one(spark, sequence.kmers("s", 3), s="ACGNTTTA")
    assert [(x["off"], x["kmer"]) for x in got] == [(0, "ACG"), (4, "TTT"), (5, "TTA")]
    got = one(spark, sequence.kmers("s", 3, 4, F.lit(6)), s="ACGTACGTACGT")
    assert [x["off"] for x in got] == [2, 6]
    assert one(spark, sequence.kmers("s", 5), s="ACG") == []


def test_hamming(spark):
    r = random.Random(2)
    for n in (0, 1, 2, 3, 4, 5, 7, 15, 31, 63, 64, 65, 127):
        a, b = ("".join(r.choice("ACGTN") for _ in range(n)) for _ in range(2))
        assert one(spark, sequence.hamming("a", "b"), a=a, b=b) == sum(x != y for x, y in zip(a, b, strict=True))
    assert one(spark, sequence.hamming("a", "b"), a="AC", b="A") == -1
    assert one(spark, sequence.mismatches("a", "b", 2), a="ANCG", b="ANCT") == 2
    assert one(spark, sequence.mismatches("a", "b", 2), a="AAAAA", b="CCCCC") == 3


def test_edit_within(spark):
    assert one(spark, sequence.edit_within("a", "b", 2), a="ACGT", b="AGT") == 1
    assert one(spark, sequence.edit_within("a", "b", 0), a="ANGT", b="ANGT") == -1


def test_cigar(spark):
    assert one(spark, cigar.query_length("c"), c="23M1D78M") == 101
    assert one(spark, cigar.reference_length("c"), c="23M1D78M") == 102
    assert one(spark, cigar.query_length("c"), c="5S96M") == -1
    assert one(spark, cigar.from_ops("c"), c="MMMIDDM") == "3M1I2D1M"
    assert one(spark, cigar.from_ops("c"), c="") == "*"
    assert [tuple(x) for x in one(spark, cigar.decode("c"), c="10M2I")] == [(10, "M"), (2, "I")]
    assert one(spark, cigar.has_clip("c"), c="5S96M") and not one(spark, cigar.is_mid("c"), c="*")


def test_sam_fields(spark):
    assert one(spark, cigar.flag_set("f", 256), f=272) and not one(spark, cigar.flag_set("f", 4), f=272)
    assert one(spark, cigar.nm_tag("t"), t=["AS:i:3", "NM:i:1", "NM:i:2"]) == 2
    assert one(spark, cigar.nm_tag("t"), t=["AS:i:3"]) == -1


def test_trim(spark):
    for qmin in (1, 5, 20, 41):
        r = random.Random(qmin)
        q = "".join(chr(33 + r.randrange(42)) for _ in range(50))
        keep = max((i + 1 for i, c in enumerate(q) if ord(c) - 33 >= qmin), default=0)
        assert one(spark, quality.trim_limit("q", qmin), q=q) == keep
    assert one(spark, quality.trim_limit("q", 10), q="!!!") == 0
    df = spark.createDataFrame([("ACGT", "II!!")], "seq string, qual string")
    assert quality.trim(df, 20).first() == ("AC", "II")


def test_formats(spark):
    assert one(spark, quality.iec("n"), n=500) == "500 B"
    assert one(spark, quality.iec("n"), n=3 * 1024 * 1024 // 2) == "1.50 MiB"
    assert one(spark, quality.mebibytes("n"), n=1048576) == 1.0
    assert one(spark, quality.ratio("n", "m"), n=1, m=0) is None
