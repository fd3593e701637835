import math

import pytest
from pyspark.sql import functions as F

from silvatide.operators import containment, diversity, metadata, planning, readqc, statistics, taxonomy


def long_of(spark, table):
    return spark.createDataFrame([(s, g, float(v)) for s, row in table.items() for g, v in row.items()], "sample string, genome string, v double")


@pytest.fixture(scope="module")
def six(spark):
    g = {"G1": (0.8, 0.2, 0.6, 0.05, 0.9, 0.7), "G2": (0.6, 0.7, 0.3, 0.15, 0.2, 0.8), "G3": (0.1, 0.8, 0.9, 0.05, 0.6, 0.2)}
    return long_of(spark, {f"s{i}": {k: v[i] for k, v in g.items()} for i in range(6)})


def test_cooccurrence(six):
    got = {(r.genome_a, r.genome_b): r.n for r in containment.cooccurrence(six, 0.5, 3).collect()}
    assert got == {("G1", "G1"): 4, ("G2", "G2"): 3, ("G3", "G3"): 3, ("G1", "G2"): 2, ("G2", "G1"): 2, ("G1", "G3"): 2, ("G3", "G1"): 2, ("G2", "G3"): 1, ("G3", "G2"): 1}


def test_row_max_takes_the_first_of_ties(spark):
    long = long_of(spark, {"a": {"g2": 0.95, "g1": 0.95}, "b": {"g1": 0.0, "g2": 0.0}})
    got = {r.sample: (r.max_containment, r.max_containment_annotation) for r in containment.row_max(long).collect()}
    assert got == {"a": (0.95, "g1"), "b": (0.0, "g1")}
    w = containment.wide(long, ["g1", "g2"])
    assert [tuple(r) for r in w.collect()] == [("a", 0.95, 0.95, 0.95, "g1"), ("b", 0.0, 0.0, 0.0, "g1")]
    assert containment.to_long(w).count() == 4
    with pytest.raises(ValueError):
        containment.genome_columns(w, w.columns)


def test_threshold_histogram(spark):
    long = long_of(spark, {"a": {"g": 0.95}, "b": {"g": 0.92}})
    got = [(r.threshold, r.n) for r in containment.threshold_histogram(containment.row_max(long), 0.1).collect()]
    assert got == [(1.0, 0)] + [(round(i / 10, 1), 2) for i in range(9, -1, -1)]
    with pytest.raises(ValueError):
        containment.threshold_histogram(containment.row_max(long), 0.0)


def test_presence_distances(spark):
    one = long_of(spark, {"a": {"1": 1, "2": 1, "3": 0, "4": 1}, "b": {"1": 1, "2": 0, "3": 1, "4": 1}, "x": {"1": 0}, "y": {"1": 0}})
    d = {m: {(r.a, r.b): r.distance for r in containment.presence_distance(one, 0.1, m).collect()} for m in ("jaccard", "dice", "cosine")}
    assert d["jaccard"]["a", "b"] == pytest.approx(0.5)
    assert d["dice"]["a", "b"] == pytest.approx(1 - 4 / 6)
    assert [d[m]["x", "y"] for m in d] == [1.0, 1.0, 1.0]
    two = long_of(spark, {"a": {"1": 1, "2": 1}, "b": {"1": 1, "3": 1}})
    assert containment.presence_distance(two, 0.1, "cosine").first().distance == pytest.approx(0.5)
    with pytest.raises(ValueError):
        containment.presence_distance(two, 0.1, "euclid")


def test_metadata_counts(spark):
    g = {"g1": (0.8, 0.9, 0.3, 0.7), "g2": (0.6, 0.2, 0.8, 0.9)}
    long = long_of(spark, {f"s{i}": {k: v[i] for k, v in g.items()} for i in range(4)})
    meta = spark.createDataFrame([("s0", "E. coli"), ("s1", "S. aureus"), ("s2", "B. subtilis"), ("s3", "E. coli"), ("s0", None)], "sample string, organism string")
    rows = {r.value: (r.g1, r.g2) for r in metadata.counts_wide(long, meta, "organism", ["g1", "g2"], 0.5).collect()}
    assert rows == {"E. coli": (2, 2), "S. aureus": (1, 0), "B. subtilis": (0, 1)}
    assert [(r.genome, r.n) for r in metadata.column_sums(metadata.counts_by_genome(long, meta, "organism", 0.5)).collect()] == [("g1", 3), ("g2", 3)]
    with pytest.raises(ValueError):
        metadata.counts_by_genome(long, meta, "nothing")


def test_column_summary_of_an_empty_table(spark):
    r = metadata.column_summary(spark.createDataFrame([], "x string"), "x").first()
    assert (r.non_null, r.total, r.percent, r.distinct) == (0, 0, None, 0)


ROWS = [[10, 5, 2, 0], [0, 8, 3, 1], [15, 0, 0, 5], [5, 5, 5, 5], [2, 2, 2, 14]]


@pytest.fixture(scope="module")
def matrix(spark):
    a = spark.createDataFrame([(i + 1, j, float(v)) for i, r in enumerate(ROWS) for j, v in enumerate(r) if v], "sample int, feature int, a double")
    return a, spark.createDataFrame([(i,) for i in range(1, 7)], "sample int")


def test_alpha(matrix):
    a, samples = matrix
    got = {r.sample: r for r in diversity.alpha(a, samples, 4).collect()}
    want = {1: (0.923841, 0.553633, 3, 3, 0.840916), 2: (0.823959, 0.486111, 3, 3, 0.75), 3: (0.562335, 0.375, 2, 2, 0.811278), 4: (1.386294, 0.75, 4, 4, 1.0), 5: (0.940448, 0.48, 4, 4, 0.678390), 6: (0, 0, 0, 0, 0)}
    for s, w in want.items():
        r = got[s]
        assert (r.shannon, r.simpson, r.chao1, r.observed_species, r.pielou) == pytest.approx(w, abs=1e-6)


def test_beta_dispersion_permanova(spark, matrix):
    a, samples = matrix
    five = samples.filter("sample < 6")
    d = diversity.beta(a, five)
    got = {(r.a, r.b): r.distance for r in d.collect()}
    want = {(1, 2): 0.517241, (1, 3): 0.459459, (1, 4): 0.351351, (1, 5): 0.675676, (2, 3): 0.9375, (2, 4): 0.4375, (2, 5): 0.6875, (3, 4): 0.5, (3, 5): 0.65, (4, 5): 0.45}
    assert got == pytest.approx(want, abs=1e-6)
    groups = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "B"), (5, "B")], "sample int, group string")
    disp = {r.group: (r.mean, r.median, r.std) for r in diversity.dispersion(d, groups).collect()}
    assert disp["A"] == pytest.approx((0.517241, 0.517241, 0.0), abs=1e-6)
    assert disp["B"] == pytest.approx((0.533333, 0.5, 0.084984), abs=1e-6)
    f = diversity.permanova_f(d, groups).first()
    assert (f.total, f.within, f.f_statistic) == pytest.approx((0.347660, -0.133769, 0.0), abs=1e-6)
    p = diversity.permanova_p(d, groups, 20, 3).first()
    assert (p.f_statistic, p.p_value) == (0.0, 1.0)
    assert math.isnan(diversity.permanova_p(d, groups, 0).first().p_value)
    with pytest.raises(ValueError):
        diversity.beta(a, five, "nothing")
    meta = groups.withColumn("half", F.col("sample") % 2)
    both = diversity.permanova(d, five, meta, "group + half", 20, 3)
    assert {r.variable for r in both.collect()} == {"group", "half"}
    with pytest.raises(KeyError):
        diversity.permanova(d, five, meta.filter("sample <> 2"), "group")
    with pytest.raises(KeyError):
        diversity.permanova(d, five, meta, "nothing")
    assert diversity.plot_frame(five, meta, "group", "half").columns == ["sample", "color", "size"]
    gap = meta.withColumn("half", F.when(F.col("sample") > 1, F.col("half")))
    assert diversity.plot_frame(five, gap, "group", "half").columns == ["sample", "color"]


def test_small_matrices(spark):
    wide = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(ROWS)], "sample int, a double, b double, c double, d double")
    out = diversity.pca(wide, ["a", "b", "c", "d"], 2).first()
    assert len(out.components) == 2 and 0 < sum(out.explained) <= 1 + 1e-9
    assert diversity.permanova_variables("a + b c") == ["a", "b", "c"]


def test_enrichment(spark):
    o = spark.createDataFrame([("x", 10), ("y", 5), ("z", 15)], "key string, n int")
    e = spark.createDataFrame([("x", 5), ("y", 10), ("z", 15)], "key string, n int")
    got = {r.key: (r.fold_enrichment, r.p_value, r.adjusted_p_value) for r in statistics.enrichment(o, e).collect()}
    assert got["x"] == pytest.approx((2.0, 0.232598, 0.348898), abs=1e-6)
    assert got["y"] == pytest.approx((0.5, 0.232598, 0.348898), abs=1e-6)
    assert got["z"] == pytest.approx((1.0, 1.0, 1.0), abs=1e-6)
    h = spark.createDataFrame([(5, 100, 10, 1000), (11, 100, 10, 1000), (0, 0, 0, 10)], "k int, n int, s int, p int")
    rows = statistics.hypergeometric(h, "k", "n", "s", "p").collect()
    assert (rows[0].fold_enrichment, rows[0].p_value) == pytest.approx((5.0, 0.00152142), abs=1e-6)
    assert rows[1].p_value is None and rows[2].fold_enrichment == 1.0


def test_outliers_and_tests(spark):
    d = spark.createDataFrame([(f"SRR{i}", float(v), "ab"[i % 2]) for i, v in enumerate((150, 155, 148, 152, 500), 1)], "acc string, len double, g string")
    assert [r.acc for r in statistics.iqr_outliers(d, "acc", ["len"]).collect()] == ["SRR5"]
    assert statistics.iqr_outliers(d.limit(3), "acc", ["len"]).count() == 0
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "g string, x double")
    r = statistics.group_tests(flat, "g", ["x"]).first()
    assert (r.test, r.statistic, r.p_value, r.significant) == ("skipped (identical values)", None, 1.0, False)
    apart = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    r = statistics.group_tests(apart, "g", ["x"]).first()  # constant in each group, but different
    assert (r.test, r.statistic, r.p_value, r.significant) == ("t-test", -math.inf, 0.0, True)
    two = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 4.0), ("b", 6.0)], "g string, x double")
    r = statistics.group_tests(two, "g", ["x"]).first()
    assert (r.test, r.statistic) == ("t-test", pytest.approx(-math.sqrt(2.4))) and r.p_value == pytest.approx(0.196266, abs=1e-5)
    three = two.unionByName(spark.createDataFrame([("c", 9.0), ("c", 11.0)], "g string, x double"))
    turned = statistics.group_tests(two, "g", ["x"], order=["b", "a"]).first()
    assert turned.statistic == -r.statistic and turned.p_value == r.p_value  # the groups as they were given
    r = statistics.group_tests(three, "g", ["x"]).first()
    assert r.test == "ANOVA" and r.statistic == pytest.approx(16.5625) and r.significant
    assert statistics.group_tests(two.filter("g = 'a'"), "g", ["x"]).count() == 0
    c = {(x.a, x.b): x.r for x in statistics.correlation(two.withColumn("y", F.col("x") * 2), ["x", "y"], "kendall").collect()}
    assert c["x", "y"] == pytest.approx(1.0)
    assert {x.metric for x in statistics.describe(two, "g", ["x"]).collect()} == {"x"}
    said = lambda tests, out: [x.text for x in statistics.comparative_recommendations(tests, out, ["y", "x"], "acc").orderBy("ordinal").collect()]
    tests = spark.createDataFrame([("x", True), ("y", True), ("z", False)], "metric string, significant boolean")
    assert said(tests, d) == ["Significant differences detected in: y, x", "Consider including group as covariate in downstream analysis", "Outlier datasets detected: SRR1, SRR2, SRR3, SRR4, SRR5", "Review outlier datasets for quality issues"]
    six = d.select("acc").unionByName(spark.createDataFrame([("SRR9",)], "acc string"))
    assert said(tests.filter("metric = 'z'"), six)[0] == "Outlier datasets detected: SRR1, SRR2, SRR3, SRR4, SRR5..."
    assert said(tests.filter("metric = 'z'"), d.limit(0)) == ["No major issues detected in comparative analysis"]
    groups = spark.createDataFrame([("SRR1", "a"), ("SRR2", "b"), ("SRR3", "a"), ("SRR5", "b")], "acc string, group string")
    whole = statistics.compare_groups(d, groups, ["len"], "acc")
    assert whole["frame"].count() == 4 and [x.acc for x in whole["outliers"].collect()] == ["SRR5"] and whole["statistics"].count() == 2
    none = statistics.compare_groups(d, groups.limit(0), ["len"], "acc")["recommendations"].collect()
    assert [x.text for x in none] == ["No data available for analysis"]


def test_taxonomy(spark):
    long = long_of(spark, {"s1": {"a": 0.9, "b": 0.4}, "s2": {"a": 0.6, "c": 0.3}})
    tax = spark.createDataFrame([("a", "Fam", "Gen", "Gen one"), ("b", "Fam", "Other", None)], "genome string, family string, genus string, species string")
    ann = taxonomy.annotate(long, tax)
    assert ann.count() == 4
    assert taxonomy.filter_taxa(ann, family="FAM").count() == 3
    assert taxonomy.filter_taxa(ann, 0.6, species="gen ONE").count() == 2
    got = {(r.sample, r.taxon): r.v for r in taxonomy.summarize_max(ann, "family").collect()}
    assert got == {("s1", "Fam"): 0.9, ("s2", "Fam"): 0.6}
    rows = taxonomy.explorer_rows(long, tax, spark.createDataFrame([], "sample string, location string, date string"))
    assert {r.family for r in rows.collect()} == {"Fam", "Unknown"}
    assert taxonomy.explorer_header(rows).first().families == 1
    assert taxonomy.hierarchy(rows).filter("family = 'Fam' AND genus IS NULL").first().samples == 2
    ref = spark.createDataFrame([("Escherichia coli", 562, "species", "genus:Escherichia")], "name string, tax_id int, rank string, lineage string")
    names = spark.createDataFrame([("Escherichia coli",), ("nothing known",)], "name string")
    v = taxonomy.validate(names, ref, F.col("name"))
    assert {r.name: r.confidence for r in v.collect()} == {"Escherichia coli": "high", "nothing known": "low"}
    assert taxonomy.corrections(v).count() == 1
    recs = spark.createDataFrame([("S", None, "g1", None, False, 0), ("S", "A2", None, None, True, 1)], "species string, accession string, gid string, ncbi_accession string, is_rep boolean, ordinal int")
    recs = recs.withColumn("query", F.lit("Q"))
    assert [r.acc for r in taxonomy.species_accessions(recs).collect()] == ["A2"]
    assert [r.acc for r in taxonomy.species_accessions(recs.filter("ordinal = 0")).collect()] == ["g1"]
    assert {r.acc for r in taxonomy.species_accessions(recs, only=False).collect()} == {"g1", "A2"}
    # Of a genus the first record of each species counts; where none of those is flagged, all do.
    assert {r.acc for r in taxonomy.genus_accessions(recs).collect()} == {"g1", "A2"}
    assert [r.acc for r in taxonomy.genus_accessions(recs.withColumn("ordinal", -F.col("ordinal"))).collect()] == ["A2"]
    grid = taxonomy.annotate_grid(long, tax, ["a", "b", "c"])
    assert grid.count() == 6 and {(r.sample, r.v) for r in grid.filter("genome = 'b'").collect()} == {("s1", 0.4), ("s2", 0.0)}
    assert [taxonomy.query_level(**x) for x in ({}, {"family": "F"}, {"family": "F", "genus": "G"}, {"species": "S"})] == ["family", "family", "genus", "species"]
    answers = spark.createDataFrame([('[{"gtdbTaxonomy": "g__A", "taxId": 7}]',), ('{"rows": [{"taxonomy": "g__B", "organismName": "b"}, {"x": 1}]}',), ("{}",)], "response string")
    assert {(r.lineage, r.organism, r.tax_id) for r in taxonomy.record_taxonomy(taxonomy.search_rows(answers)).collect()} == {("g__A", None, "7"), ("g__B", "b", None)}


def test_read_profiles(spark):
    reads = spark.createDataFrame([("S1", "S1_1.fastq", i, "ATCG" * 15, "I" * 60) for i in range(10)], "accession string, file string, read_no long, seq string, qual string")
    s = readqc.read_statistics(reads).first()
    assert (s.total_reads, s.total_bases, s.n50, s.gc_percent, s.mean_quality) == (10, 600, 60, 50.0, 40.0)
    p = readqc.profile(reads).first()
    assert (p.reads, p.gc, p.mean_quality, p.n_content) == (10, 0.5, 40.0, 0.0)
    assert p.duplication_rate == pytest.approx(0.9)
    assert readqc.quality_distribution(reads).first().high == 1.0
    assert readqc.quality_summary(readqc.profile(reads)).first().datasets == 1
    assert readqc.anomaly_report(readqc.profile(reads)).count() == 1  # four 3-mers in 58: low complexity
    failed = spark.createDataFrame([("S2", "no reads")], "key string, error string")
    report = {r.key: r for r in readqc.anomaly_report(readqc.profile(reads), failed).collect()}
    assert report["S1"].explanation.startswith("Very low sequence complexity") and report["S2"].explanation == "Analysis failed: no reads" and report["S2"].severity == 0.1
    assert {(r.anomaly, r.key) for r in readqc.anomaly_types(readqc.profile(reads), failed).collect()} == {("low_complexity", "S1"), ("analysis_failed", "S2")}
    groups = spark.createDataFrame([("S1", "T"), ("S7", "T")], "accession string, group string")
    both = {r.key: r for r in readqc.group_profiles(reads, groups).collect()}
    none = both["S7"]  # a dataset without reads has a profile of zeros
    assert both["S1"].reads == 10 and (none.group, none.reads, none.bases, none.mean_length, none.gc, none.complexity, none.adapter, none.duplication_rate, none.grade) == ("T", 0, 0, 0.0, 0.0, 0.0, 0.0, None, "poor")
    assert none.recommendations == ["Apply quality trimming with Q20 threshold", "Check for PCR duplicates and low-complexity regions"] and none.anomalies == ["low_complexity", "unusual_gc", "poor_quality"]
    names = reads.select("accession", "file").distinct()
    row = readqc.statistics_report(readqc.read_statistics(reads), names).first()
    assert len(row) == 11 and (row.accession, row.num_files, row.layout, row.n50, row.avg_quality) == ("S1", 1, "SINGLE", 60, 40.0)
    files = spark.createDataFrame([("S1", "S1_1.fastq", 0, True), ("S1", "S1_2.fastq", 5, True), ("S1", "S1_2b.fastq", 5, True)], "accession string, file string, bytes long, parsable boolean")
    assert readqc.file_issues(files).first().issues == "1 empty files; unequal numbers of mates"
    assert readqc.layouts(files).first().layout == "PAIRED"


def test_planning(spark):
    acc = lambda *x: spark.createDataFrame([(a, i) for i, a in enumerate(x)], "accession string, ordinal int")
    p = planning.plan(acc("a", "b", "c", "d"), acc("b"), acc("c", "b"))
    assert {r.accession: r.status for r in p.collect()} == {"a": "download", "b": "blacklisted", "c": "present", "d": "download"}
    assert [r.accession for r in planning.first_downloads(p, 1, "ordinal").collect()] == ["a"]
    forced = planning.plan(acc("c"), acc("b"), acc("c"), force=True)
    assert forced.first().status == "download"
    files = spark.createDataFrame([("x_1.fq",), ("x_2.fq",), ("y_1.fq",)], "file string")
    assert [tuple(r) for r in planning.pairs(files).collect()] == [("x_1.fq", "x_2.fq")]
    names = lambda tech, *fs: [r.canonical for r in planning.canonical_names(spark.createDataFrame([("A", f, tech) for f in fs], "accession string, file string, technology string")).orderBy("file").collect()]
    assert names("illumina", "a.fastq", "b.fastq") == ["A_R1.fastq.gz", "A_R2.fastq.gz"] and names("illumina", "a.fastq") == ["A_R1.fastq.gz"]
    assert names("nanopore", "a.fastq.gz") == ["A_long.fastq.gz"] and names("pacbio", "a.fastq", "b.fastq.gz") == ["A_long_1.fastq", "A_long_2.fastq.gz"]
    assert names("unknown", "a.fastq") == ["A.fastq"] and names("unknown", "a.fastq", "b.fastq") == ["A_1.fastq", "A_2.fastq"]
    done = planning.full_download_report(spark.createDataFrame([("a", "illumina", 5), ("b", "pacbio", 7)], "accession string, technology string, downloaded_reads int"), acc("a").select("accession", F.lit("ok").alias("message")), acc("b"))
    assert len(done.columns) == 13 and {(r.accession, r.status, r.message, r.platform) for r in done.collect()} == {("a", "Success", "ok", ""), ("b", "Failed", "", "")}
    s = planning.download_summary(done).first()
    assert (s.datasets, s.successful, s.failed, s.reads, s.technologies) == (2, 1, 1, 5, {"illumina": 1})
    state = spark.createDataFrame([("a", "downloading", 1, 1), ("a", "completed", 2, 1), ("b", "downloading", 1, 1), ("c", "downloading", 1, 1)], "accession string, status string, updated int, attempt int")
    kept = planning.checkpoints(state.limit(1), state, acc("c"))
    assert {(r.accession, r.status) for r in kept.collect()} == {("a", "completed"), ("b", "downloading")} and [r.accession for r in planning.resumable(kept).collect()] == ["b"]
    g = spark.createDataFrame([(0, "T", ["a", "b"]), (1, "C", ["b", "c"])], "ordinal int, group string, members array<string>")
    assert {r.accession: r.group for r in planning.groups_of(g).collect()} == {"a": "T", "b": "T", "c": "C"}
    s = planning.session_summary(spark.createDataFrame([(True, 10.0, 30.0), (False, 5.0, 30.0)], "success boolean, size_mb double, seconds double")).first()
    assert (s.succeeded, s.failed, s.rate, s.mb, s.mb_per_minute) == (1, 1, 0.5, 10.0, 10.0)
