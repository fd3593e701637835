"""Registered queries of readers and sinks: tables are written in each format and what is read back is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import BRAND_NAMES, C, brand_taxa, cells, r, register, t
from .operators import containment, metadata, planning, readqc
from .scratch import place
from .sources import delimited, fastq, sinks, xml
from .sources.snapshots import Snapshots, load_checkpoint, save_checkpoint


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there is deleted when the application ends."""
    return place(spark, f"files-{name}")


def _renamed(spark: SparkSession, source: str, target: str) -> str:
    """The one part file of each `genome=<g>` folder as <g>.csv in one folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(target))
    for s in fs.globStatus(path(f"{source}/genome=*/*.csv")):
        genome = s.getPath().getParent().getName().partition("=")[2]
        fs.rename(s.getPath(), path(target, f"{genome}.csv"))
    return target


@register("scan_containment_folder", f"WITH {C} SELECT 'SRR' || sample AS sample, replace(genome, '#', '_') AS genome, v FROM c")
def scan_containment_folder(spark, d):
    """A file for each genome, with values and accessions that are not valid among them."""
    rows = cells(spark, d).select(F.concat(F.lit("SRR"), F.col("sample").cast("string")).alias("acc"), F.col("v").cast("string").alias("containment"), F.translate("genome", "#", "_").alias("genome"))
    bad = rows.select(F.concat(F.lit("X"), "acc").alias("acc"), "containment", "genome").unionByName(rows.select("acc", F.lit("1.5").alias("containment"), "genome"))
    out = folder(spark, "genomes")
    rows.unionByName(bad).repartition("genome").write.partitionBy("genome").option("header", True).csv(out)
    return containment.build(delimited.containment_folder(spark, _renamed(spark, out, folder(spark, "flat")))[0])


@register("ingested_cells", f"WITH {C} SELECT sample, genome, v FROM c")
def ingested_cells(spark, d):
    """Half of the genomes first, then all: those that are there stay, the others are added."""
    out, long = folder(spark, "long"), cells(spark, d)
    sinks.ingest(long.filter("genome < 'Brand#3'"), out)
    sinks.ingest(long.withColumn("v", F.when(F.col("genome") < "Brand#3", -1.0).otherwise(F.col("v"))), out)
    return spark.read.parquet(out).select("sample", "genome", "v")


@register("scan_matrix", f"WITH {C}, ids AS (SELECT DISTINCT sample FROM c), g AS (SELECT DISTINCT p_brand AS genome FROM part) SELECT CAST(ids.sample AS VARCHAR) AS sample, g.genome, coalesce(c.v, 0) AS v FROM ids CROSS JOIN g LEFT JOIN c ON c.sample = ids.sample AND c.genome = g.genome")
def scan_matrix(spark, d):
    out = folder(spark, "wide")
    sinks.wide_table(containment.wide(cells(spark, d), BRAND_NAMES), out)
    return containment.to_long(delimited.matrix(spark, out))


@register("scan_threshold_table", f"WITH {C}, m AS (SELECT max(v) AS v FROM c GROUP BY sample) SELECT CAST(round(i * 0.1::DOUBLE, 2) AS VARCHAR) AS threshold, (SELECT count(*) FROM m WHERE v > i * 0.1::DOUBLE)::VARCHAR AS n FROM range(0, 11) x(i)")
def scan_threshold_table(spark, d):
    out = folder(spark, "thresholds")
    sinks.threshold_table(containment.threshold_histogram(containment.row_max(cells(spark, d)), 0.1), out)
    return delimited.csv(spark, out, "\t").select(F.col("Threshold").alias("threshold"), F.col("Count").alias("n"))


@register("scan_metadata_table", "SELECT c_custkey AS sample, c_mktsegment, c_acctbal FROM customer")
def scan_metadata_table(spark, d):
    """Types are found by the reader."""
    out = folder(spark, "metadata")
    sinks.delimited(t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), out)
    m = delimited.metadata_table(spark, out, "sample")
    return m.select(F.col("sample").cast("long").alias("sample"), "c_mktsegment", "c_acctbal")


@register("scan_abundance", "SELECT CAST(s_nationkey AS VARCHAR) AS sample, p_brand AS feature, sum(l_quantity)::DOUBLE AS a FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def scan_abundance(spark, d):
    from .catalog import supplied

    out = folder(spark, "abundance")
    sinks.delimited(supplied(spark, d).groupBy("sample").pivot("feature", BRAND_NAMES).sum("a"), out, ",")
    return delimited.abundance(spark, out)


@register("scan_lines", "SELECT DISTINCT p_name AS value FROM part WHERE p_name <> ''")
def scan_lines(spark, d):
    """A list with comments, blank lines and repeated entries."""
    p, out = t(spark, d, "part"), folder(spark, "lines")
    text = p.select(F.explode(F.array(F.concat(F.lit("  "), "p_name", F.lit(" ")), F.lit(""), F.concat(F.lit("# "), "p_name"), F.col("p_name"))).alias("value"))
    text.write.text(out)
    return delimited.lines(spark, out, comments=True).select("value").distinct()


@register("scan_json", "SELECT event_id, event_type, value FROM events")
def scan_json(spark, d):
    out = folder(spark, "json")
    sinks.exported(t(spark, d, "events").select("event_id", "event_type", "value"), out, "json")
    return spark.read.schema("event_id long, event_type string, value double").json(out)


@register("scan_taxonomy_cache", "SELECT DISTINCT p_brand AS genome_id, NULL::VARCHAR AS phylum, r_name AS family, n_name AS genus FROM part JOIN nation ON n_nationkey = CAST(substr(p_brand, 7, 2) AS INTEGER) % 25 JOIN region ON n_regionkey = r_regionkey")
def scan_taxonomy_cache(spark, d):
    out = folder(spark, "cache")
    sinks.taxonomy_cache(brand_taxa(spark, d).withColumnRenamed("genome", "genome_id"), out, delimited.TAXONOMY_COLUMNS)
    return delimited.taxonomy_cache(spark, out).select("genome_id", "phylum", "family", "genus")


@register("scan_counts_table", f"WITH {C} SELECT genome, count(*)::VARCHAR AS n FROM c JOIN customer ON sample = c_custkey WHERE v > 0.5 GROUP BY ALL")
def scan_counts_table(spark, d):
    """The column sums that are written beside the count table."""
    from .catalog import people

    counts, out = metadata.counts_by_genome(cells(spark, d), people(spark, d), "segment", 0.5), folder(spark, "counts")
    sinks.counts_with_sums(counts, counts.groupBy("value").pivot("genome", BRAND_NAMES).sum("n").na.fill(0), out)
    return spark.read.schema("genome string, n string").option("sep", "\t").csv(f"{out}_stats")


@register("scan_attribute_counts", "SELECT name, n::VARCHAR AS n FROM (SELECT 'lang' AS name, count(lang) AS n FROM documents UNION ALL SELECT 'source', count(source) FROM documents UNION ALL SELECT 'doc_id', count(doc_id) FROM documents)")
def scan_attribute_counts(spark, d):
    out = folder(spark, "attributes")
    sinks.attribute_counts(metadata.non_null_counts(t(spark, d, "documents").select("doc_id", "lang", "source")), out)
    return spark.read.schema("name string, n string").option("sep", "\t").csv(out)


@register("scan_levels", "SELECT 'genus' AS level, n_name AS taxon, n_regionkey::VARCHAR AS n FROM nation UNION ALL SELECT 'family', r_name, r_regionkey::VARCHAR FROM region")
def scan_levels(spark, d):
    rows = t(spark, d, "nation").select(F.lit("genus").alias("level"), F.col("n_name").alias("taxon"), F.col("n_regionkey").alias("n")).unionByName(t(spark, d, "region").select(F.lit("family").alias("level"), F.col("r_name").alias("taxon"), F.col("r_regionkey").alias("n")))
    out = folder(spark, "levels")
    sinks.by_level(rows, out, ("family", "genus"))
    back = [delimited.csv(spark, f"{out}/taxonomy_summary_{x}.csv").select(F.lit(x).alias("level"), "taxon", "n") for x in ("family", "genus")]
    return back[0].unionByName(back[1])


@register("containment_records", f"WITH {C} SELECT 'SRR' || sample AS \"Run_ID\", genome AS \"Sample_ID\", CAST(v AS VARCHAR) AS \"cANI\", 'x' AS other FROM c")
def containment_records(spark, d):
    extra = F.create_map(F.lit("biosample"), F.col("genome"), F.lit("cANI"), F.col("v").cast("string"), F.lit("other"), F.lit("x"))
    rows = cells(spark, d).select(F.concat(F.lit("SRR"), F.col("sample").cast("string")).alias("sample"), "genome", "v", extra.alias("extra"))
    return delimited.containment_records(rows).select("Run_ID", "Sample_ID", "cANI", F.try_element_at("attributes", F.lit("other")).alias("other"))


# Documents of the archive: parts are experiments.
def _package(first: int) -> F.Column:
    k = F.col("p_partkey").cast("string")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    text = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    layout = F.when(F.col("p_size") % 2 == 0, "<PAIRED/>").otherwise("<SINGLE/>")
    library = tag("LIBRARY_DESCRIPTOR", F.concat(tag("LIBRARY_STRATEGY", text("p_type")), tag("LIBRARY_LAYOUT", layout)))
    experiment = F.concat(F.lit('<EXPERIMENT accession="SRX'), k, F.lit('">'), tag("IDENTIFIERS", tag("PRIMARY_ID", F.concat(F.lit("SRX"), k))), tag("TITLE", text("p_name")), library, tag("PLATFORM", tag("ILLUMINA", tag("INSTRUMENT_MODEL", F.lit("HiSeq")))), F.lit("</EXPERIMENT>"))
    attribute = tag("SAMPLE_ATTRIBUTE", F.concat(tag("TAG", F.lit("brand")), tag("VALUE", F.col("p_brand"))))
    sample = F.concat(F.lit("<SAMPLE>"), tag("IDENTIFIERS", tag("PRIMARY_ID", F.concat(F.lit("SRS"), k))), tag("SAMPLE_NAME", tag("SCIENTIFIC_NAME", text("p_name"))), tag("SAMPLE_ATTRIBUTES", attribute), F.lit("</SAMPLE>"))
    size = F.col("p_size").cast("string")
    one = lambda n: F.concat(F.lit('<RUN total_spots="'), size, F.lit('" total_bases="'), (F.col("p_size") * 100 * n).cast("string"), F.lit('" size="1048576">'), tag("IDENTIFIERS", tag("PRIMARY_ID", F.concat(F.lit("SRR"), k))), F.lit("</RUN>"))
    return F.concat(F.lit("<EXPERIMENT_PACKAGE>"), experiment, sample, tag("RUN_SET", F.concat(one(1), one(2))), F.lit("</EXPERIMENT_PACKAGE>"))


@register(
    "scan_packages",
    "SELECT 'SRX' || p_partkey AS accession, p_name AS title, p_name AS organism, p_type AS library_strategy, 'ILLUMINA' AS platform, 'HiSeq' AS instrument, CASE WHEN p_size % 2 = 0 THEN 'PAIRED' ELSE 'SINGLE' END AS layout, 2 * p_size AS spots, 300 * p_size AS bases, 2.0::DOUBLE AS size_mb, round(CASE WHEN p_size > 0 THEN 150.0::DOUBLE ELSE 0 END, 6) AS avg_length FROM part",
)
def scan_packages(spark, d):
    """Payloads of several packages, as the archive sends them."""
    p = t(spark, d, "part").select((F.col("p_partkey") % 500).alias("batch"), _package(1).alias("x"))
    payloads = p.groupBy("batch").agg(F.concat(F.lit("<EXPERIMENT_PACKAGE_SET>"), F.array_join(F.collect_list("x"), ""), F.lit("</EXPERIMENT_PACKAGE_SET>")).alias("xml"))
    found = xml.packages(payloads)
    return found.select("accession", "title", "organism", "library_strategy", "platform", "instrument", "layout", F.col("spots").cast("int").alias("spots"), F.col("bases").cast("int").alias("bases"), "size_mb", r("avg_length", 6).alias("avg_length"))


@register("scan_sample_documents", "SELECT 'SRR' || p_partkey AS run, 'SRR' || p_partkey AS \"Run_ID\", 'SRS' || p_partkey AS \"Sample_ID\", p_name AS \"Sample_Scientific_Name\", 'SRX' || p_partkey AS \"Experiment_ID\", p_name AS \"Experiment_Title\", p_type AS \"Experiment_Library_Strategy\", NULL::VARCHAR AS \"Project_ID\", NULL::VARCHAR AS \"SRA_Normalized_URL\", p_brand AS brand FROM part")
def scan_sample_documents(spark, d):
    k = F.col("p_partkey").cast("string")
    docs = t(spark, d, "part").select(F.concat(F.lit("SRR"), k, F.lit("_metadata.xml")).alias("file"), _package(1).alias("xml"))
    wide = xml.widened(xml.sample_metadata(docs.filter(xml.well_formed(F.col("xml"), "EXPERIMENT_PACKAGE"))), ["brand"])
    return wide.select("run", "Run_ID", "Sample_ID", "Sample_Scientific_Name", "Experiment_ID", "Experiment_Title", "Experiment_Library_Strategy", "Project_ID", "SRA_Normalized_URL", "brand")


@register("attribute_names", "SELECT 'brand' AS name WHERE EXISTS (SELECT 1 FROM part)")
def attribute_names(spark, d):
    return xml.attribute_names(t(spark, d, "part").select(_package(1).alias("xml")))


@register("scan_fastq", "SELECT p_name AS seq, reverse(p_name) AS qual, count(*) AS n FROM part GROUP BY ALL")
def scan_fastq(spark, d):
    """Reads of several files, some of whose quality lines begin like a record."""
    p, out = t(spark, d, "part"), folder(spark, "fastq")
    record = F.concat(F.lit("@r"), F.col("p_partkey").cast("string"), F.lit("\n"), "p_name", F.lit("\n+\n"), F.reverse("p_name"))
    p.select(record.alias("value")).repartition(3, "p_partkey").write.option("compression", "gzip").text(out)
    reads = fastq.read(spark, delimited.list_files(spark, out, "part-*"))
    return reads.groupBy("seq", "qual").agg(F.count("*").alias("n"))


@register("fastq_head", "SELECT 1 AS files, 40 AS reads, 0 AS most FROM region WHERE r_regionkey = 0")
def fastq_head(spark, d):
    """The first 40 reads of a file: the limit is the feature. Returns the number of files and reads, and how many read numbers are out of range."""
    p, out = t(spark, d, "part"), folder(spark, "head")
    p.select(F.concat(F.lit("@x\n"), "p_name", F.lit("\n+\n"), "p_name").alias("value")).coalesce(1).write.text(out)
    reads = fastq.head(spark, delimited.list_files(spark, out, "part-*"), 40)
    return reads.agg(F.count_distinct("file").cast("int").alias("files"), F.count("*").cast("int").alias("reads"), F.count_if(F.col("read_no") >= 40).cast("int").alias("most"))


@register("scan_manifest", "SELECT 'GCA_' || s_suppkey AS name, s_name AS genome_filename, CASE WHEN s_suppkey % 2 = 0 THEN s_name || '.faa' END AS protein_filename FROM supplier")
def scan_manifest(spark, d):
    s, out = t(spark, d, "supplier"), folder(spark, "manifest")
    acc = F.concat(F.lit("GCA_"), F.col("s_suppkey").cast("string")).alias("accession")
    sinks.manifest(s.select(acc, F.col("s_name").alias("path")), out, s.filter("s_suppkey % 2 = 0").select(acc, F.concat("s_name", F.lit(".faa")).alias("path")))
    return delimited.csv(spark, out)


@register("read_layouts", "SELECT l_returnflag AS accession, 'PAIRED' AS layout FROM lineitem GROUP BY ALL")
def read_layouts(spark, d):
    """The layout that file names tell: every return flag has a second mate."""
    f = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("accession"), F.concat("l_returnflag", F.lit("_"), (1 + F.col("l_orderkey") % 2).cast("string"), F.lit(".fastq")).alias("file")).distinct()
    return readqc.layouts(f)


@register("snapshot_merge", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 2 * c_acctbal ELSE c_acctbal END AS c_acctbal FROM customer")
def snapshot_merge(spark, d):
    """A cache that is merged into itself: a third of its rows are read from it, changed and put in place of themselves."""
    cache = Snapshots(spark, folder(spark, "cache"))
    cache.save(t(spark, d, "customer").select("c_custkey", "c_acctbal"))
    cache.merge(cache.load().filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") * 2), ["c_custkey"])
    return cache.load()


@register("session_checkpoint", "SELECT CAST(o_orderkey AS VARCHAR) AS accession, CASE WHEN o_orderkey % 4 = 0 THEN 'done' ELSE o_orderstatus END AS status FROM orders")
def session_checkpoint(spark, d):
    """A session of downloads that is saved twice."""
    top, o = folder(spark, "sessions"), t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("accession"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("detail"), "o_orderkey")
    save_checkpoint(spark, top, "s", o)
    save_checkpoint(spark, top, "s", o.filter("o_orderkey % 4 = 0").withColumn("status", F.lit("done")))
    return load_checkpoint(spark, top, "s").select("accession", "status")


def _text(df, column: str, path: str) -> str:
    """A column as lines of text files; returns a pattern of the files."""
    df.select(F.col(column).cast("string").alias("value")).write.text(path)
    return f"{path}/*.txt"


@register("scan_blacklist", "SELECT DISTINCT trim(value) AS value FROM (SELECT CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT ' ' || o_orderpriority || ' ' FROM orders) WHERE trim(value) <> ''")
def scan_blacklist(spark, d):
    """Two files of names that repeat, with blanks round them and blank lines between, and one that is not there."""
    o, top = t(spark, d, "orders"), folder(spark, "blacklist")
    one = _text(o.select(F.col("o_custkey").cast("string").alias("p")).unionByName(o.select(F.lit("").alias("p"))), "p", f"{top}/one")
    two = _text(o.select(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("p")), "p", f"{top}/two")
    return delimited.blacklist(spark, [one, two, f"{top}/none.txt"])


@register("scan_species_list", "SELECT p_name AS name FROM part")
def scan_species_list(spark, d):
    out = f"{folder(spark, 'species')}/list.csv"
    sinks.delimited(t(spark, d, "part").select("p_partkey", "p_name"), out, ",")
    return delimited.species_list(spark, out, "p_name")


@register("scan_groups", "SELECT CAST(c_custkey AS VARCHAR) AS accession, min(c_mktsegment) AS \"group\" FROM customer GROUP BY c_custkey")
def scan_groups(spark, d):
    """An object of lists: the customers of each market segment; each once more in a last group, which does not count."""
    c = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("a"), F.col("c_mktsegment").alias("g"))
    every = c.unionByName(c.withColumn("g", F.lit("~all"))).groupBy("g").agg(F.array_sort(F.collect_list("a")).alias("members"))  # the lists of one file
    one = every.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("g", "members"))))).alias("value"))
    groups = delimited.groups_json(spark, _text(one, "value", folder(spark, "groups")))
    return planning.groups_of(groups.filter("members IS NOT NULL")).select("accession", "group")


@register("written_accessions", "SELECT 'SRR' || o_orderkey AS accession, o_orderstatus AS label FROM orders")
def written_accessions(spark, d):
    """Accessions with what was found of them, two columns without a header."""
    out = folder(spark, "accessions")
    sinks.lines(t(spark, d, "orders").select(F.concat(F.lit("SRR"), F.col("o_orderkey").cast("string")).alias("accession"), "o_orderstatus"), "accession", out, "o_orderstatus")
    return spark.read.schema("accession string, label string").option("sep", "\t").csv(out)


@register(
    "column_report",
    """WITH v AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT count(o_orderpriority) AS k, count(*) AS n, count(DISTINCT o_orderpriority) AS u FROM orders),
l AS (SELECT unnest(['Column: o_orderpriority', 'Non-null values: ' || k || '/' || n || printf(' (%.1f%%)', 100.0::DOUBLE * k / n), 'Unique values: ' || u, '', 'Value counts:']) AS value, unnest([1, 2, 3, 4, 5]) AS line FROM s)
SELECT line, value FROM l UNION ALL SELECT 5 + row_number() OVER (ORDER BY n DESC, value), value || chr(9) || n FROM v""",
)
def column_report(spark, d):
    out = folder(spark, "column")
    sinks.column_report(t(spark, d, "orders").select("o_orderpriority"), "o_orderpriority", out)
    lines = spark.read.text(out, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("line", "value"))
    return lines.select((F.col("line") + 1).cast("long").alias("line"), "value")


@register(
    "session_progress",
    "SELECT count(*) FILTER (o_orderstatus <> 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'F') AS failed, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS names, min(CAST(o_custkey AS VARCHAR)) FILTER (o_orderstatus = 'F') AS first_name FROM orders",
)
def session_progress(spark, d):
    """Totals and failed names of a session, as one JSON object."""
    o, out = t(spark, d, "orders"), folder(spark, "progress")
    results = o.select((F.col("o_orderstatus") != "F").alias("success"), F.col("o_totalprice").cast("double").alias("size_mb"), F.lit(1.0).alias("seconds"))
    sinks.progress(planning.session_summary(results), o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("accession")), out)
    back = delimited.json_object(spark, out)
    return back.select("succeeded", "failed", F.size("failed_accessions").cast("long").alias("names"), F.get("failed_accessions", F.lit(0)).alias("first_name"))


@register("taxonomy_query", f"WITH {C}, m AS (SELECT sample, genome AS taxon, max(v) AS v FROM c WHERE genome < 'Brand#3' GROUP BY ALL) SELECT CAST(sample AS VARCHAR) AS sample, taxon, v FROM m")
def taxonomy_query(spark, d):
    """The found cells as a table; nothing is written where nothing is found."""
    found, out = cells(spark, d).filter("genome < 'Brand#3'"), folder(spark, "query")
    if sinks.taxonomy_query(found.limit(0), out) or not sinks.taxonomy_query(found, out):
        raise ValueError("an empty result was written, or none")
    return delimited.csv(spark, out, "\t").select("sample", F.col("genome").alias("taxon"), F.col("v").cast("double").alias("v"))
