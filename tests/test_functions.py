import math

import pytest
from pyspark.sql import functions as F

from silvatide.functions import clean, special


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long' if isinstance(v, int) else 'double'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("acc,ok", [("SRR1", True), ("ERR22", True), ("DRR3", True), ("SRR", False), ("XYZ1", False), ("", False), (None, False), ("SRR1\n", False), ("SRR1a", False)])
def test_valid_run(spark, acc, ok):
    assert one(spark, clean.valid_run(F.col("a")), a=acc) is ok


@pytest.mark.parametrize("text,v", [("0.5", 0.5), ("0", 0.0), ("1", 1.0), ("1e-1", 0.1), (" 0.2 ", 0.2), ("-0.1", None), ("1.5", None), ("nan", None), ("0.5d", None), ("abc", None), ("", None), (None, None)])
def test_containment_value(spark, text, v):
    assert one(spark, clean.containment_value(F.col("a")), a=text) == v


@pytest.mark.parametrize(
    "name,cleaned",
    [
        ("candidate Bacteria", "Bacteria"),
        ("uncultured bacterium", "bacterium"),
        ("Escherichia coli strain K12", "Escherichia coli"),
        ("Bacteria sp. ABC123", "Bacteria"),
        ("Homo [x] sapiens (y)", "Homo sapiens"),
    ],
)
def test_clean_species(spark, name, cleaned):
    assert one(spark, clean.clean_species(F.col("a")), a=name) == cleaned


@pytest.mark.parametrize(
    "text,lat,lon",
    [
        ("40.7128, -74.0060", 40.7128, -74.006),
        ("40.7128N, 74.0060W", 40.7128, -74.006),
        ("40.7128 -74.0060", 40.7128, -74.006),
        ("[35.5, 100]", 35.5, 100.0),
        ("35.7N 100.2W", 35.7, -100.2),
    ],
)
def test_coordinates(spark, text, lat, lon):
    c = one(spark, clean.coordinates(F.col("a")), a=text)
    assert (c.lat, c.lon) == pytest.approx((lat, lon))


@pytest.mark.parametrize("text", ["invalid", "", "1,2,3", None])
def test_no_coordinates(spark, text):
    assert one(spark, clean.coordinates(F.col("a")), a=text) is None


def test_sequence_measures(spark):
    assert one(spark, clean.gc_fraction(F.col("a")), a="ATGCGCAT") == 0.5
    assert one(spark, clean.gc_fraction(F.col("a")), a="") == 0.0
    for seq, distinct, total, runs in (("ATGCGTACGTAGC", 9, 11, 0), ("AAAAATTTTTGGGG", 7, 12, 2), ("CCCCCCAAAAAAA", 4, 11, 1)):
        assert one(spark, clean.kmer_diversity(F.col("a")), a=seq) == pytest.approx(distinct / total)
        assert one(spark, clean.homopolymer_rate(F.col("a")), a=seq) == pytest.approx(runs / len(seq))
    assert one(spark, clean.kmer_diversity(F.col("a")), a="AC") == 0.0


def test_lineages(spark):
    g = "d__Bacteria;p__Proteo; c__Gamma;o__;f__Entero;g__Esch;s__Esch coli"
    got = {r: one(spark, clean.gtdb_rank(F.col("a"), r), a=g) for r in clean.GTDB_RANKS}
    assert got == {"phylum": "Proteo", "class": "Gamma", "order": None, "family": "Entero", "genus": "Esch", "species": "Esch coli"}
    assert one(spark, clean.lineage_map(F.col("a")), a="Genus:A;species:B:C;genus:D") == {"species": "B:C", "genus": "D"}
    assert one(spark, clean.lineage_map(F.col("a")), a=None) is None


def test_technology(spark):
    case = lambda p, i, s=None: one(spark, clean.technology(F.col("p"), F.col("i"), F.col("s")), p=p, i=i, s=s)
    assert case("ILLUMINA", "HiSeq") == "illumina"
    assert case("OXFORD", "MinION") == "nanopore"
    assert case("PACBIO_SMRT", None) == "pacbio"
    assert case("LS454", "454") == "unknown"
    # Platform and instrument come before the strategy, which never tells illumina.
    assert case("illumina", "MinION", "PacBio") == "illumina"
    assert case("x", "PacBio RS II", "nanopore") == "pacbio"
    assert case("x", "y", "Nanopore WGS") == "nanopore" and case("x", "y", "illumina") == "unknown"
    assert case("illumina inc", "PromethION") == "unknown"


def test_grade_and_anomalies(spark):
    q = lambda m, a, c: spark.range(1).select(clean.quality_grade(F.lit(m), F.lit(a), F.lit(c))).first()[0]
    assert [q(31, 0.0, 0.8), q(25, 0.0, 0.5), q(25, 0.02, 0.5), q(10, 0.2, 0.1)] == ["excellent", "good", "fair", "poor"]
    f = clean.anomaly_flags(F.lit(0.5), F.lit(0.0), F.lit(0.9), F.lit(0.0), F.lit("good"))
    row = spark.range(1).select(f.alias("f"), clean.anomaly_severity(f).alias("s")).first()
    assert (row.f, row.s) == (["unusual_gc"], 0.2)


def test_recommendations(spark):
    one_of = lambda c: spark.range(1).select(c.alias("x")).first().x
    texts = lambda q, a, c: one_of(clean.quality_recommendations(F.lit(q), F.lit(a), F.lit(c)))
    assert texts(15.0, 0.1, 0.2) == list(clean.QUALITY_TEXTS[:3]) and texts(35.0, 0.0, 0.9) == ["Dataset appears to be high quality"]
    flags = F.array(F.lit("low_complexity"), F.lit("high_contamination"), F.lit("unusual_gc"))
    assert one_of(clean.anomaly_actions(flags)) == ["Perform adapter trimming", "Check for vector contamination", "Check for PCR artifacts", "Verify sample preparation"]
    assert one_of(clean.anomaly_reasons(flags, F.lit(0.25), F.lit(0.9), F.lit(0.0))) == "Very low sequence complexity; High adapter contamination: 25.0%; Unusual GC content: 90.0%"


def test_processing_parameters(spark):
    def params(length, grade, adapter, rep, complexity, reads, bases):
        return spark.range(1).select(clean.processing_parameters(*[F.lit(x) for x in (length, grade, adapter, rep, complexity, reads, bases)]).alias("p")).first().p

    p = params(150.0, "poor", 0.15, 0.0, 0.2, 10_000_000, 1_500_000_000)
    assert (p.pipeline, p.quality_trimming.enabled, p.quality_trimming.quality_threshold, p.quality_trimming.min_length) == ("short_read", True, 20, 105)
    assert (p.adapter_removal.enabled, p.adapter_removal.stringency) == (True, "high")
    assert (p.contamination_filtering.enabled, p.contamination_filtering.check_adapters, p.contamination_filtering.complexity_filter) == (True, True, True)
    assert (p.assembly_parameters.kmer_size, p.assembly_parameters.coverage_cutoff, p.assembly_parameters.error_correction) == ("31", 10, True)
    assert (p.computational_requirements.memory_gb, p.computational_requirements.cpu_cores, p.computational_requirements.storage_gb) == (8, 4, 10)
    assert p.estimated_time == "3.9 hours"
    q = params(5000.0, "excellent", 0.0, 0.0, 0.9, 60_000_000, 9_000_000_000)
    assert (q.pipeline, q.quality_trimming.enabled, q.assembly_parameters.coverage_cutoff, q.assembly_parameters.error_correction) == ("long_read", False, 5, False)
    assert (q.computational_requirements.memory_gb, q.computational_requirements.cpu_cores, q.computational_requirements.storage_gb, q.estimated_time) == (12, 8, 45, "12.0 hours")
    assert params(100.0, "good", 0.0, 0.0, 0.9, 1, 1).assembly_parameters.kmer_size == "auto" and params(251.0, "good", 0.0, 0.06, 0.9, 1, 1).contamination_filtering.enabled


def test_sizes_and_times(spark):
    one_of = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one_of(clean.estimated_size_mb(F.lit(a))) for a in ("ERR1", "SRR1", "DRR1")] == [500.0, 800.0, 1024.0]
    assert [one_of(clean.planned_transfer_minutes(F.lit(80.0), F.lit(n))) for n in (1, 2, 9)] == pytest.approx([10.0, 10 / 1.8, 10 / 2.8])


def test_exact_tails_against_enumeration(spark):
    """All tables of small margins, and margins of millions in a moment."""
    import itertools

    choose = math.comb
    tests = [(a, b, c, d) for a, b, c, d in itertools.product((0, 1, 3, 7), repeat=4) if a + b + c + d]
    df = spark.createDataFrame(tests, "a long, b long, c long, d long")
    got = df.select("*", special.fisher_exact(*[F.col(x) for x in "abcd"]).alias("p")).collect()
    for r in got:
        n, row, col = r.a + r.b + r.c + r.d, r.a + r.b, r.a + r.c
        p = {k: choose(col, k) * choose(n - col, row - k) / choose(n, row) for k in range(max(0, row + col - n), min(row, col) + 1)}
        assert r.p == pytest.approx(sum(x for x in p.values() if x <= p[r.a] * (1 + 1e-7)))
    big = spark.range(1).select(special.fisher_exact(*[F.lit(x) for x in (2_000_000, 9_000_000, 2_003_000, 9_000_000)]).alias("p"), special.hypergeometric_tail(*[F.lit(x) for x in (100, 10**9, 10**5, 10**5)]).alias("t")).first()
    assert 0.1 < big.p < 0.9 and 0 < big.t < 1e-60


def test_tails(spark):
    p = spark.range(1).select(special.hypergeometric_tail(F.lit(5), F.lit(1000), F.lit(10), F.lit(100)).alias("p")).first().p
    assert p == pytest.approx(0.00152142, abs=1e-7)
    z = [1.0, 2.0, 10.5, 60000.0]
    got = [r.x for r in spark.createDataFrame([(x,) for x in z], "z double").select(special.lgamma(F.col("z")).alias("x")).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in z], abs=1e-8, rel=1e-12)
    assert special.f_tail_value(4.0, 1, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert special.f_tail_value(0.0, 1, 10) == 1.0
