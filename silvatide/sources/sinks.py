"""Thin sinks: delimited text, JSON and plain lines. Small reports are one file; the rest keep their partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metadata, taxonomy


def delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = True, single: bool = False) -> None:
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").options(sep=sep, header=header, emptyValue="", nullValue="").csv(path)


def wide_table(wide: DataFrame, path: str) -> None:
    """The sample-by-genome table, largest maximum first."""
    delimited(wide.orderBy(F.desc("max_containment"), "sample"), path)


def threshold_table(histogram: DataFrame, path: str) -> None:
    delimited(histogram.orderBy(F.desc("raw")).select(F.col("threshold").alias("Threshold"), F.col("n").alias("Count")), path, single=True)


def counts_with_sums(counts: DataFrame, wide: DataFrame, path: str, stats_path: str | None = None) -> None:
    """The count table and its column sums; the sums go to `<path>_stats` by default."""
    delimited(wide, path, single=True)
    sums = counts.groupBy("genome").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "genome")
    delimited(sums, stats_path or f"{path}_stats", header=False, single=True)


def text_report(df: DataFrame, path: str, lines: Sequence, head: Sequence[str] = ()) -> None:
    """Formatted lines below fixed ones."""
    spark = df.sparkSession
    body = df.select(F.concat_ws("\t", *lines).alias("value"))
    top = spark.createDataFrame([(h,) for h in head], "value string")
    top.coalesce(1).union(body.coalesce(1)).coalesce(1).write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def by_level(df: DataFrame, path: str, levels: Sequence[str] = ()) -> None:
    """One folder a taxonomic level: level=<level>, or with levels given taxonomy_summary_<level>.csv."""
    if not levels:
        df.write.mode("overwrite").partitionBy("level").option("header", True).csv(path)
    for x in levels:
        delimited(df.filter(F.col("level") == x).drop("level"), f"{path}/taxonomy_summary_{x}.csv", ",")


def exported(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A table as csv or json; other formats are an error."""
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown format {kind}")
    delimited(df, path, ",") if kind == "csv" else json_lines(df, path)


def attribute_counts(counts: DataFrame, path: str) -> None:
    """name, n without a header, most frequent first."""
    delimited(counts.orderBy(F.desc("n"), "name").select("name", "n"), path, header=False, single=True)


# The lines of a column's report.
COLUMN_LINES = ("Column: ", "Non-null values: %d/%d (%.1f%%)", "Unique values: ", "", "Value counts:")


def column_report(df: DataFrame, column: str, path: str, limit: int | None = None) -> None:
    """The lines about a column, then its values and counts, most frequent first."""
    s, values = metadata.column_summary(df, column), metadata.value_counts(df, column, limit)
    name, share, distinct, blank, counts = COLUMN_LINES
    told = F.format_string(share, F.col("non_null"), F.col("total"), F.coalesce("percent", F.lit(0.0)).cast("double"))
    head = s.select(F.explode(F.array(F.lit(name + column), told, F.concat(F.lit(distinct), F.col("distinct").cast("string")), F.lit(blank), F.lit(counts))).alias("value"))
    body = values.orderBy(F.desc("n"), "value").select(F.concat_ws("\t", "value", "n").alias("value"))
    head.coalesce(1).union(body.coalesce(1)).coalesce(1).write.mode("overwrite").text(path)


def lines(df: DataFrame, column: str, path: str, label: str | None = None) -> None:
    """One value a line, or with a label two tab-separated columns: failed accessions, the accessions of a search."""
    out = df.select(F.concat_ws("\t", column, label) if label else F.col(column).cast("string"))
    out.coalesce(1).write.mode("overwrite").text(path)


def report(df: DataFrame, path: str) -> bool:
    """A report with a header, in one file; nothing is written for an empty one. Returns whether it was."""
    if df.isEmpty():
        return False
    delimited(df, path, ",", single=True)
    return True


def taxonomy_query(annotated: DataFrame, path: str, level: str | None = None) -> bool:
    """The long table, or with a level the maxima of each sample as a wide one; nothing is written where nothing was found."""
    if annotated.isEmpty():
        return False
    if level:
        found = taxonomy.summarize_max(annotated, level)
        taxa = [r.taxon for r in found.select("taxon").distinct().orderBy("taxon").collect()]  # the columns of the result
        annotated = taxonomy.pivoted(found, taxa).orderBy("sample")
    delimited(annotated, path, single=True)
    return True


def inventory_report(inventory: DataFrame, path: str, kind: str = "json") -> None:
    """Present and missing items of each kind, as JSON or as lines of text."""
    if kind == "json":
        json_lines(inventory.orderBy("kind"), path, single=True)
    else:
        text_report(inventory.orderBy("kind"), path, ["kind", "present", "missing"], ["kind\tpresent\tmissing"])


def progress(summary: DataFrame, failed: DataFrame, path: str, key: str = "accession") -> None:
    """The totals of a session with its failed accessions, as one JSON object."""
    names = failed.agg(F.array_sort(F.collect_set(key)).alias("failed_accessions"))  # as many as one session tried
    json_lines(summary.crossJoin(names), path, single=True)  # one row by one row


def taxonomy_cache(taxa: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The cache's columns, tab-separated, null as nothing."""
    delimited(taxa.select(*[F.col(c) if c in taxa.columns else F.lit(None).cast("string").alias(c) for c in columns]), path)


def manifest(genomes: DataFrame, path: str, proteins: DataFrame | None = None) -> None:
    """name, genome_filename, protein_filename (blank where there is none) by accession."""
    named = genomes.select(F.col("accession").alias("name"), F.col("path").alias("genome_filename"))
    if proteins is None:
        out = named.withColumn("protein_filename", F.lit(""))
    else:
        out = named.join(proteins.select(F.col("accession").alias("name"), F.col("path").alias("protein_filename")), "name", "left").na.fill("", ["protein_filename"])
    delimited(out.orderBy("name"), path, ",", single=True)


def replaced_cache(df: DataFrame, path: str, cache: str) -> None:
    """The same table as output and as cache; the cache is replaced."""
    for p in (path, cache):
        delimited(df, p, ",", single=True)


def merged_cache(new: DataFrame, old: DataFrame, key: str, path: str) -> None:
    """A cache with new rows in place of old ones of the same key. Write to another path than the one read."""
    new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True).write.mode("overwrite").parquet(path)


def ingest(rows: DataFrame, path: str) -> list[str]:
    """The canonical long table, partitioned by genome: genomes already there are left as they are, new ones are added. Returns what was there."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = []
    if fs.exists(top) and [s for s in fs.listStatus(top) if s.getPath().getName().startswith("genome=")]:
        there = sorted(r.genome for r in spark.read.parquet(path).select(F.col("genome").cast("string").alias("genome")).distinct().collect())  # names of folders
    known = spark.createDataFrame([(g,) for g in there], "genome string")
    rows.join(known, "genome", "left_anti").repartition("genome").write.mode("append").partitionBy("genome").parquet(path)
    return there
