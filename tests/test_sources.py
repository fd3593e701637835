import gzip
import json

import pytest
from pyspark.sql import functions as F

from silvatide.operators import containment
from silvatide.plans import commands, workflows
from silvatide.plans.registry import Registry, discover
from silvatide.sources import delimited, fastq, sinks, xml
from silvatide.streaming import incremental


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "g1.csv").write_text('acc,containment,cANI,lat_lon\nSRR1,0.95,0.9,"[1, 2]"\nSRR2,0.92,,\nXYZ1,0.5,,\nSRR3,1.5,,\nSRR4,0.5d,,\nSRR1,0.2,,\n')
    (d / "g2.csv").write_text("containment,acc\n0.7,SRR2\nnan,SRR1\n")
    (d / "bad.csv").write_text("a,b\n1,2\n")
    return d


def test_containment_folder(spark, folder):
    rows, bad = delimited.containment_folder(spark, str(folder))
    long = containment.build(rows)
    assert {(r.sample, r.genome): r.v for r in long.collect()} == {("SRR1", "g1"): 0.95, ("SRR2", "g1"): 0.92, ("SRR2", "g2"): 0.7}
    assert len(bad) == 1 and "bad.csv" in bad[0][0]
    extra = {r.sample: r.extra for r in rows.filter("genome = 'g1' AND v > 0.9").collect()}
    assert extra == {"SRR1": {"cANI": "0.9", "lat_lon": "[1, 2]"}, "SRR2": {}}


def test_formats(spark, folder, tmp_path):
    assert delimited.detect_format(spark, str(folder / "g2.csv")) == "containment"
    for bad in ("bad.csv",):
        with pytest.raises(delimited.FormatError):
            delimited.detect_format(spark, str(folder / bad))
    empty = tmp_path / "e.csv"
    empty.write_text("acc,containment\n")
    with pytest.raises(delimited.FormatError):
        delimited.validate_csv(spark, str(empty))
    assert delimited.validate_csv(spark, str(folder / "g1.csv")).count() == 6
    assert delimited.list_files(spark, str(tmp_path / "nowhere")) == []


def test_workflow(spark, folder, tmp_path):
    bad = workflows.parse_containment(spark, str(folder), str(tmp_path / "wide"), str(tmp_path / "summary"))
    assert len(bad) == 1
    m = delimited.matrix(spark, str(tmp_path / "wide"))
    assert {r.sample: (r.g1, r.g2, r.max_containment_annotation) for r in m.collect()} == {"SRR1": (0.95, 0.0, "g1"), "SRR2": (0.92, 0.7, "g1")}
    assert delimited.csv(spark, str(tmp_path / "summary"), "\t").count() == 11
    meta = workflows.extract_metadata(spark, str(folder), str(tmp_path / "meta"))
    assert {r.Run_ID for r in meta.collect()} >= {"SRR1", "SRR2"}
    workflows.count_metadata(spark, str(tmp_path / "wide"), str(tmp_path / "meta"), "cANI", 0.5, str(tmp_path / "counts"))
    assert delimited.csv(spark, str(tmp_path / "counts"), "\t").count() == 1


def test_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿SRR1\n\n# note\n SRR2 \nSRR1\n")
    assert [r.value for r in delimited.lines(spark, str(tmp_path / "a.txt"), comments=True).orderBy("ordinal").collect()] == ["SRR1", "SRR2", "SRR1"]
    got = delimited.blacklist(spark, [str(tmp_path / "a.txt"), str(tmp_path / "none.txt")])
    assert {r.value for r in got.collect()} == {"SRR1", "SRR2", "# note"}
    assert delimited.blacklist(spark, [str(tmp_path / "none.txt")]).count() == 0
    (tmp_path / "g.json").write_text(json.dumps({"T": ["a", "b"], "C": ["c"]}))
    assert {(r.group, tuple(r.members)) for r in delimited.groups_json(spark, str(tmp_path / "g.json")).collect()} == {("T", ("a", "b")), ("C", ("c",))}
    (tmp_path / "bad.json").write_text("{")
    assert delimited.groups_json(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "sp.csv").write_text("x,name\n1,A\n2,\n")
    assert [r.name for r in delimited.species_list(spark, str(tmp_path / "sp.csv"), "name").collect()] == ["A"]
    (tmp_path / "t.tsv").write_text("genome_id\tfamily\tgenus\nG1\tF1\t\nG1\tF2\tX\n\tF3\t\n")
    assert [(r.genome_id, r.family, r.genus, r.phylum) for r in delimited.taxonomy_cache(spark, str(tmp_path / "t.tsv")).collect()] == [("G1", "F2", "X", None)]
    (tmp_path / "ab.csv").write_text("s,f1,f2\na,1,2\nb,0,x\n")
    assert delimited.abundance(spark, str(tmp_path / "ab.csv")).count() == 3


def test_fastq(spark, tmp_path):
    text = "".join(f"@r{i}\nATCG\n+\n@III\n" for i in range(5))
    (tmp_path / "SRR1_1.fastq").write_text(text)
    with gzip.open(tmp_path / "SRR1_2.fastq.gz", "wt") as f:
        f.write(text)
    paths = delimited.fastq_files(spark, str(tmp_path), "SRR1")
    reads = fastq.read(spark, paths)
    assert reads.count() == 10 and reads.filter("qual = '@III' AND accession = 'SRR1'").count() == 10
    assert fastq.read(spark, paths, 2).count() == 4
    assert sorted(r.read_no for r in fastq.head(spark, paths[:1], 3).collect()) == [0, 1, 2] and fastq.zero_length(reads).count() == 0
    (tmp_path / "SRR2.fastq").write_text("@a\nAC\n+\nII\n@b\nAC\nII\n")
    (tmp_path / "SRR3.fastq").write_text("")
    (tmp_path / "SRR4.fastq").write_text("@a\n\n+\n\n\n\n")
    with pytest.raises(Exception, match="broken record 1 in SRR2.fastq"):
        fastq.read(spark, [str(tmp_path / "SRR2.fastq")]).collect()
    assert fastq.read(spark, [str(tmp_path / "SRR2.fastq")], strict=False).count() == 1
    with pytest.raises(ValueError):
        fastq.head(spark, [str(tmp_path / "SRR3.fastq")])
    assert [r.file for r in fastq.zero_length(fastq.read(spark, [str(tmp_path / "SRR4.fastq")])).collect()] == ["SRR4.fastq"]
    deep = tmp_path / "x" / "y"
    deep.mkdir(parents=True)
    (deep / "SRR8_1.fastq").write_text(text)
    assert [p.rpartition("/")[2] for p in delimited.fastq_files(spark, str(tmp_path), "SRR8")] == ["SRR8_1.fastq"]


@pytest.mark.parametrize("size", [40, 97, 1000])
def test_fastq_records_across_splits(spark, tmp_path, size):
    """Splits of a few lines, lines longer than a split, blank lines at the end, names with blanks and signs, a compressed file beside them."""
    want = {}
    for name, n in (("SRR1_1.fastq", 37), ("SRR2 x+y.fastq", 5), ("SRR3.fastq", 1)):
        reads = [("ACGT" * (1 + i * 7 % 40), "@+" * (2 + i * 14 % 80)) for i in range(n)]
        (tmp_path / name).write_text("".join(f"@r{i}\n{s}\n+\n{q}\n" for i, (s, q) in enumerate(reads)) + ("\n" * 3 if n == 5 else ""))
        want |= {(name, i): r for i, r in enumerate(reads)}
    with gzip.open(tmp_path / "SRR4.fastq.gz", "wt") as f:
        f.write("@a\nAC\n+\nII\n")
    want["SRR4.fastq.gz", 0] = ("AC", "II")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        reads = fastq.read(spark, [str(tmp_path)])
        got = [((r.file, r.read_no), (r.seq, r.qual)) for r in reads.collect()]
        assert len(got) == len(want) and dict(got) == want
        first = [((r.file, r.read_no), (r.seq, r.qual)) for r in fastq.read(spark, [str(tmp_path)], 4).collect()]
        assert len(first) == 4 + 4 + 1 + 1 and all(want[k] == v and k[1] < 4 for k, v in first)
        (tmp_path / "SRR5.fastq").write_text("@a\nAC\n+\nII\n@b\nACGT\n+\n")
        for limit in (0, 2):
            with pytest.raises(Exception, match="broken record 1 in SRR5.fastq"):
                fastq.read(spark, [str(tmp_path / "SRR5.fastq")], limit).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_fastq_moves_edges_alone_and_head_stops(spark, tmp_path):
    (tmp_path / "SRR1.fastq").write_text("".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(60000)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        plan = fastq.read(spark, [str(tmp_path)])._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("MapInArrow")]
        assert "Exchange" not in above.replace("BroadcastExchange", "")  # of whole records
        head = fastq.read(spark, [str(tmp_path)], 500)
        assert head.count() == 500
        text = spark.read.text(str(tmp_path)).coalesce(1).limit(2000)
        assert text.collect()
        leaves = text._jdf.queryExecution().executedPlan().collectLeaves()
        assert leaves.apply(0).metrics().apply("numOutputRows").value() < 20000  # of 240,000 lines
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fastq_in_splits(spark, tmp_path):
    """A plain file that is read in several splits keeps its records."""
    (tmp_path / "SRR1.fastq").write_text("".join(f"@r{i}\nA{i}\n+\n@{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = fastq.read(spark, [str(tmp_path / "SRR1.fastq")])
        assert [(r.read_no, r.seq, r.qual) for r in got.orderBy("read_no").collect()] == [(i, f"A{i}", f"@{i}") for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_archives_and_folders(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        for name, body in (("README.md", "x"), ("ncbi_dataset/data/GCA_1.1/b.fna", ">b\nAC\n"), ("ncbi_dataset/data/GCA_1.1/a.fasta", ">a\nGT\n"), ("ncbi_dataset/data/GCF_2.1/p.faa", "x"), ("ncbi_dataset/data/GCF_3.1/z.fna", ">z\n")):
            z.writestr(name, body)
    assert {(r.accession, r.fasta) for r in delimited.genome_archives(spark, str(tmp_path / "g.zip")).collect()} == {("GCA_1.1", ">a\nGT\n"), ("GCF_3.1", ">z\n")}
    (tmp_path / "l1.txt").write_text("a\nb\n")
    good, bad = delimited.mapped_files(spark, str(tmp_path), lambda df: df.filter("value = 'a'"), "*.txt")
    assert {k: v.count() for k, v in good.items()} == {"l1.txt": 1} and bad == []
    fails = lambda df: (_ for _ in ()).throw(ValueError("no"))
    assert delimited.mapped_files(spark, str(tmp_path), fails, "*.txt")[1][0][1] == "no"
    with pytest.raises(ValueError):
        delimited.mapped_files(spark, str(tmp_path), fails, "*.txt", strict=True)


def test_ingest_adds_new_genomes(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "g1", 0.5), ("s2", "g2", 0.6)], "sample string, genome string, v double")
    out = str(tmp_path / "long")
    assert sinks.ingest(rows.filter("genome = 'g1'"), out) == []
    assert sinks.ingest(rows.withColumn("v", F.lit(0.9)), out) == ["g1"]
    assert {(r.genome, r.v) for r in spark.read.parquet(out).collect()} == {("g1", 0.5), ("g2", 0.9)}


def test_files_that_fail_in_a_row(spark, tmp_path):
    """What a row makes fail is met with the file, not later."""
    (tmp_path / "a.txt").write_text("1\n2\n")
    (tmp_path / "b.txt").write_text("1\nx\n")
    good, bad = delimited.mapped_files(spark, str(tmp_path), lambda df: df.select(F.col("value").cast("int").alias("n")), "*.txt")
    assert {k: sorted(r.n for r in v.collect()) for k, v in good.items()} == {"a.txt": [1, 2]} and [p.rpartition("/")[2] for p, _ in bad] == ["b.txt"]


def test_status_by_folder_and_ending(spark, tmp_path):
    for name in ("fastq/SRR1/r_1.fastq.gz", "fastq/SRR_2/r.fastq", "fastq/SRR3/notes.txt", "meta/SRR_2_metadata.xml", "meta/SRR3_metadata.xml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "want.txt").write_text("SRR1\nSRR_2\nSRR3\n")
    folders = {"fastq": (str(tmp_path / "fastq"), "*/*.fastq*"), "metadata": (str(tmp_path / "meta"), "*_metadata.xml")}
    got = {r.kind: (r.present, r.missing) for r in workflows.status(spark, str(tmp_path / "want.txt"), folders, str(tmp_path / "out")).collect()}
    assert got == {"fastq": (2, 1), "metadata": (2, 1)}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "accession string, note string")
    p = lambda n: str(tmp_path / n)
    text = lambda n: [r.value for r in spark.read.text(p(n)).collect()]
    sinks.lines(df, "accession", p("l"))
    sinks.lines(df, "accession", p("t"), "note")
    assert text("l") == ["a", "b"] and text("t") == ["a\tx", "b"]
    sinks.column_report(df, "note", p("c"))
    assert text("c") == ["Column: note", "Non-null values: 1/2 (50.0%)", "Unique values: 1", "", "Value counts:", "x\t1"]
    assert sinks.report(df, p("r")) and not sinks.report(df.limit(0), p("none")) and delimited.csv(spark, p("r")).count() == 2
    with pytest.raises(ValueError):
        sinks.exported(df, p("e"), "excel")
    sinks.exported(df, p("e"), "csv")
    sinks.replaced_cache(df, p("o"), p("k"))
    assert delimited.csv(spark, p("k")).count() == 2
    sinks.progress(spark.createDataFrame([(1, 2)], "done int, failed int"), df, p("p"))
    assert json.loads(text("p")[0]) == {"done": 1, "failed": 2, "failed_accessions": ["a", "b"]}
    inv = spark.createDataFrame([("reads", 1, 2)], "kind string, present int, missing int")
    sinks.inventory_report(inv, p("i"), "text")
    assert text("i") == ["kind\tpresent\tmissing", "reads\t1\t2"]
    long = spark.createDataFrame([("s", "g", 0.5, "F"), ("s", "h", 0.7, "F")], "sample string, genome string, v double, family string")
    assert sinks.taxonomy_query(long, p("q"), "family") and delimited.csv(spark, p("q"), "\t").first().F == "0.7"
    assert not sinks.taxonomy_query(long.limit(0), p("q0"))


def test_commands(spark, folder, tmp_path, capsys):
    p = lambda n: str(tmp_path / n)
    assert commands.main(["parse_containment", str(folder), p("wide"), p("summary"), "--step", "0.5"], spark) == 0
    assert "bad.csv" in capsys.readouterr().out and delimited.csv(spark, p("summary"), "\t").count() == 3
    (tmp_path / "tax.tsv").write_text("genome_id\tfamily\ng1\tF1\n")
    assert commands.main(["find_by_taxonomy", p("wide"), p("tax.tsv"), p("found"), "--family", "f1", "--min_containment", "0.93"], spark) == 0
    assert delimited.csv(spark, p("found"), "\t").count() == 1
    assert commands.main(["find_by_taxonomy", p("wide"), p("tax.tsv"), p("none"), "--family", "F2"], spark) == 1  # nothing found, nothing written
    (tmp_path / "want.txt").write_text("g1\nzz\n")
    assert commands.main(["status", p("want.txt"), f"csv={folder}/*.csv", p("status"), "--kind", "text"], spark) == 0
    assert [r.value for r in spark.read.text(p("status")).collect()] == ["kind\tpresent\tmissing", "csv\t1\t1"]
    with pytest.raises(SystemExit):
        commands.main(["no_such_command"], spark)
    assert set(commands.COMMANDS) <= set(dir(workflows)) and len(commands.COMMANDS) == 20


def test_workflows(spark, folder, tmp_path):
    p = lambda n: str(tmp_path / n)
    workflows.parse_containment(spark, str(folder), p("wide"), p("summary"))
    assert len(workflows.ingest_containment(spark, str(folder), p("long"))) == 1 and spark.read.parquet(p("long")).count() == 3
    (tmp_path / "SRR9_metadata.xml").write_text(XML)
    assert workflows.parse_metadata(spark, p("SRR9_metadata.xml"), p("meta")).count() == 1
    workflows.check_attributes(spark, p("meta"), p("attrs"))
    assert "host\t1" in [r.value for r in spark.read.text(p("attrs")).collect()]
    assert workflows.dataset_info(spark, p("SRR9_metadata.xml"), p("info")) and len(delimited.csv(spark, p("info")).columns) == 17
    (tmp_path / "runs.tsv").write_text("Run_ID\thost\tplace\tday\nSRR1\tcow\tUSA: x\t2020\nSRR2\tcow\t\t\n")
    workflows.single_sample(spark, p("wide"), p("runs.tsv"), "g1", "host", 0.1, 5, p("single"))
    assert delimited.csv(spark, p("single"), "\t").first().n == "2"
    workflows.summarize_column(spark, p("runs.tsv"), "host", p("column"))
    (tmp_path / "tax.tsv").write_text("genome_id\tfamily\tgenus\tspecies\ng1\tF1\tG1\tS1\ng2\tF1\tG2\tS2\n")
    assert workflows.find_by_taxonomy(spark, p("wide"), p("tax.tsv"), p("found"), genus="g2") and delimited.csv(spark, p("found"), "\t").count() == 2
    assert workflows.find_by_taxonomy(spark, p("wide"), p("tax.tsv"), p("foundw"), summary=True, family="F1") and delimited.csv(spark, p("foundw"), "\t").first().F1 == "0.95"
    assert workflows.explore(spark, p("wide"), p("tax.tsv"), p("runs.tsv"), p("ex"), "place", "day").count() == 3
    (tmp_path / "reads").mkdir()
    (tmp_path / "reads" / "SRR1_1.fastq").write_text("@a\nACGTACGT\n+\nIIIIIIII\n" * 3)
    (tmp_path / "want.txt").write_text("SRR1\nSRR7\nSRR7\n# no\n")
    inv = workflows.status(spark, p("want.txt"), {"reads": (p("reads"), "*.fastq")}, p("status"))
    assert [(r.kind, r.present, r.missing) for r in inv.collect()] == [("reads", 1, 1)]
    todo = workflows.plan_downloads(spark, p("want.txt"), [], spark.createDataFrame([("SRR1",)], "accession string"), p("todo"))
    assert [r.accession for r in todo.collect()] == ["SRR7"]
    assert workflows.read_statistics(spark, p("reads"), ["SRR1"], p("stats")) and delimited.csv(spark, p("stats")).first().total_reads == "3"
    profiles = workflows.quality_profiles(spark, p("reads"), ["SRR1"], p("qc"))
    (tmp_path / "groups.json").write_text(json.dumps({"T": ["SRR1"], "C": ["SRR2"]}))
    assert workflows.compare_datasets(spark, profiles, p("groups.json"), p("cmp"))["frame"].count() == 1
    (tmp_path / "ab.csv").write_text("s,f1,f2\na,1,2\nb,3,4\nc,5,1\nd,2,2\n")
    (tmp_path / "m.tsv").write_text("id\tgrp\na\tX\nb\tX\nc\tY\nd\tY\n")
    workflows.diversity_analysis(spark, p("ab.csv"), p("div"), "bray_curtis", p("m.tsv"), "grp", 19)
    assert delimited.csv(spark, p("div/beta_diversity_bray_curtis.csv")).count() == 16 and spark.read.text(p("div/permanova_results.txt")).count() == 2
    (tmp_path / "names.txt").write_text("f1\nf2\n")
    ref = spark.createDataFrame([("f1", 1, "species", "phylum:P;family:F")], "name string, tax_id int, rank string, lineage string")
    v = workflows.validate_taxonomy(spark, p("names.txt"), ref, p("valid"), p("cache"))
    assert {r.name: r.confidence for r in v.collect()} == {"f1": "high", "f2": "low"} and delimited.csv(spark, p("cache")).count() == 2
    again = workflows.validate_taxonomy(spark, p("names.txt"), ref.limit(0), p("valid2"), p("cache"))
    assert {r.name: r.confidence for r in again.collect()} == {"f1": "high", "f2": "low"}
    workflows.summarize_taxonomy(spark, p("ab.csv"), p("valid"), p("levels"), ("phylum", "family"))
    assert {r.taxon for r in delimited.csv(spark, p("levels/taxonomy_summary_family.csv")).collect()} == {"F", "Unclassified_family"}
    (tmp_path / "gen").mkdir()
    for n in ("GCA_1.1.fna", "GCA_1.1.faa", "GCA_2.1.fna"):
        (tmp_path / "gen" / n).write_text(">x\n")
    workflows.genome_manifest(spark, p("gen"), p("man"))
    assert [(r.name, r.protein_filename is None) for r in delimited.csv(spark, p("man")).collect()] == [("GCA_1.1", False), ("GCA_2.1", True)]


XML = """<SET><EXPERIMENT_PACKAGE><EXPERIMENT accession="SRX1"><TITLE>t</TITLE><PLATFORM><ILLUMINA><INSTRUMENT_MODEL>HiSeq</INSTRUMENT_MODEL></ILLUMINA></PLATFORM>
<DESIGN><LIBRARY_DESCRIPTOR><LIBRARY_STRATEGY>WGS</LIBRARY_STRATEGY><LIBRARY_LAYOUT><PAIRED/></LIBRARY_LAYOUT></LIBRARY_DESCRIPTOR></DESIGN></EXPERIMENT>
<SAMPLE accession="SRS1"><SAMPLE_NAME><SCIENTIFIC_NAME>E. coli</SCIENTIFIC_NAME></SAMPLE_NAME><SAMPLE_ATTRIBUTES><SAMPLE_ATTRIBUTE><TAG>host</TAG><VALUE>cow</VALUE></SAMPLE_ATTRIBUTE></SAMPLE_ATTRIBUTES></SAMPLE>
<RUN_SET><RUN total_spots="10" total_bases="1000" size="1048576"/><RUN total_spots="10" total_bases="500" size="1048576"/></RUN_SET></EXPERIMENT_PACKAGE></SET>"""


def test_xml(spark, tmp_path):
    (tmp_path / "SRR9_metadata.xml").write_text(XML)
    docs = xml.documents(spark, str(tmp_path / "SRR9_metadata.xml"))
    r = xml.sample_metadata(docs).first()
    assert (r.run, r.Sample_Scientific_Name, r.Project_ID, r.Experiment_Title, r.attributes) == ("SRR9", "E. coli", None, "t", {"host": "cow"})
    assert len(xml.SAMPLE_FIELDS) == 28
    run = "<S><RUN><IDENTIFIERS><PRIMARY_ID>SRR9</PRIMARY_ID></IDENTIFIERS><Total_spots>5</Total_spots><SRAFiles><SRAFile url='u1'/>%s</SRAFiles></RUN></S>"
    urls = spark.createDataFrame([("a_metadata.xml", run % "<SRAFile url='u2'/>"), ("b_metadata.xml", run % "")], "file string, xml string")
    assert {(x.run, x.Run_ID, x.Run_Total_Spots, x.SRA_Normalized_URL) for x in xml.sample_metadata(urls).collect()} == {("a", "SRR9", "5", "u2"), ("b", "SRR9", "5", None)}
    assert [x.name for x in xml.attribute_names(docs).collect()] == ["host"]
    assert xml.widened(xml.sample_metadata(docs), ["host"]).first().host == "cow"
    p = xml.packages(docs).first()
    assert (p.accession, p.platform, p.instrument, p.layout, p.spots, p.bases, p.size_mb, p.avg_length) == ("SRX1", "ILLUMINA", "HiSeq", "PAIRED", 20, 1500, 2.0, 75.0)


def test_xml_documents_that_are_not_well_formed_or_unusual(spark):
    sample = "<S><SAMPLE><TITLE> %s </TITLE><SAMPLE_ATTRIBUTES>%s</SAMPLE_ATTRIBUTES></SAMPLE></S>"
    pair = "<SAMPLE_ATTRIBUTE><TAG>%s</TAG><VALUE>%s</VALUE></SAMPLE_ATTRIBUTE>"
    docs = [
        ("a_metadata.xml", '<?xml version="1.0" encoding="UTF-8"?>\n' + sample % ("x &amp; <b>y</b>", pair % ("k", "1") + pair % ("", "2") + pair % ("k", "3") + "<SAMPLE_ATTRIBUTE><TAG>alone</TAG></SAMPLE_ATTRIBUTE>" + pair % ("e", ""))),
        ("b_metadata.xml", "<S><SAMPLE>"), ("c_metadata.xml", ""), ("d_metadata.xml", None), ("other.xml", "\ufeff<S/>"),
        ("e_metadata.xml", '<!DOCTYPE S [<!ENTITY f SYSTEM "file:///etc/hostname">]><S><SAMPLE><TITLE>&f;</TITLE></SAMPLE></S>'),
    ]
    df = spark.createDataFrame(docs, "file string, xml string")
    got = {r.run: (r.Sample_Title, r.attributes) for r in xml.sample_metadata(df).collect()}
    assert got == {"a": ("x & y", {"k": "3", "e": ""}), None: (None, {})}
    assert [r.name for r in xml.attribute_names(df).collect()] == ["alone", "e", "k"]
    assert xml.packages(df).count() == 0 and xml.sample_metadata(df.limit(0)).count() == 0
    runs = "".join(f"<RUN total_spots='{s}' size='{s}'/>" for s in ("5", " 7 ", "1_0", "x", ""))
    p = xml.packages(spark.createDataFrame([(f"<A><EXPERIMENT_PACKAGE><RUN_SET>{runs}</RUN_SET></EXPERIMENT_PACKAGE><EXPERIMENT_PACKAGE a='1'/></A>",)], "xml string")).orderBy("spots").collect()
    assert [(r.spots, r.accession, r.layout, r.platform, r.avg_length) for r in p] == [(0, "", "SINGLE", "", 0.0), (12, "", "SINGLE", "", 0.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("family", "A", 1), ("genus", "B", 2)], "level string, taxon string, n int")
    sinks.by_level(df, str(tmp_path / "levels"))
    assert (tmp_path / "levels" / "level=genus").exists()
    sinks.text_report(df, str(tmp_path / "txt"), ["taxon", "n"], ["head"])
    assert [r.value for r in spark.read.text(str(tmp_path / "txt")).collect()] == ["head", "A\t1", "B\t2"]
    sinks.json_lines(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    sinks.merged_cache(df.limit(1), df, "level", str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2
    sinks.manifest(spark.createDataFrame([("G2", "p2"), ("G1", "p1")], "accession string, path string"), str(tmp_path / "man"))
    assert [r.name for r in delimited.csv(spark, str(tmp_path / "man")).collect()] == ["G1", "G2"]


def test_streaming_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", "g", 0.5), ("a", "g", 0.7), ("b", "g", 0.1)], incremental.SCHEMA)
    for k in range(2):
        rows.limit(k + 2).write.mode("append").parquet(str(tmp_path / "land"))
    q = incremental.run_available(incremental.running_max(incremental.landing(spark, str(tmp_path / "land"))), str(tmp_path / "ck"), "running")
    q.awaitTermination(120)
    got = {(r.sample, r.genome): r.v for r in spark.table("running").collect()}
    assert got == {(r.sample, r.genome): r.v for r in containment.build(spark.read.parquet(str(tmp_path / "land"))).collect()}


def test_registry():
    r = Registry()
    r.register("a", int)
    with pytest.raises(ValueError):
        r.register("a", int)
    r.unregister("a")
    with pytest.raises(KeyError):
        r.unregister("a")
    assert r.names() == [] and delimited.FormatError in list(discover("silvatide.sources", ValueError))
