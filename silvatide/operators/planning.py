"""Work planning: what is wanted, present, blacklisted and still to do; sizes, order and times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean


def plan(wanted: DataFrame, blacklist: DataFrame, present: DataFrame, key: str = "accession", force: bool = False) -> DataFrame:
    """Each wanted key with its status: blacklisted, present (unless forced) or download."""
    b = blacklist.select(key).distinct().withColumn("_b", F.lit(True))
    p = present.select(key).distinct().withColumn("_p", F.lit(True))
    j = wanted.join(b, key, "left").join(p, key, "left")
    there = F.lit(False) if force else F.col("_p").isNotNull()
    return j.withColumn("status", F.when(F.col("_b").isNotNull(), "blacklisted").when(there, "present").otherwise("download")).drop("_b", "_p")


def first_downloads(planned: DataFrame, limit: int | None, ordinal: str) -> DataFrame:
    todo = planned.filter("status = 'download'").orderBy(ordinal)
    return todo if limit is None else todo.limit(limit)


def download_order(df: DataFrame, size_mb: str, ordinal: str) -> DataFrame:
    """Small, medium, unknown, large; inside a bucket as given."""
    return df.withColumn("bucket", clean.size_bucket(F.col(size_mb))).orderBy("bucket", ordinal)


def preview(df: DataFrame, size_mb: str = "size_mb", technology: str = "technology") -> DataFrame:
    """Datasets and GB by technology."""
    return df.groupBy(technology).agg(F.count("*").alias("n"), (F.sum(size_mb) / 1024.0).alias("gb"))


# The columns of the download report.
REPORT_COLUMNS = ("technology", "platform", "layout", "spots", "bases", "avg_length", "size_mb", "downloaded_reads", "downloaded_bases", "gc_content")
_TEXT = ("technology", "platform", "layout")


def full_download_report(datasets: DataFrame, results: DataFrame, failed: DataFrame, key: str = "accession") -> DataFrame:
    """The 13 columns of the download report: status by membership in the failed list, the result's message, and what is known of
    the dataset (blank or 0 where it is not). results: key, message."""
    out = download_report(datasets, failed, key).join(results.select(key, "message").dropDuplicates([key]), key, "left")
    known = [F.coalesce(F.col(c), F.lit("" if c in _TEXT else 0)).alias(c) if c in datasets.columns else F.lit("" if c in _TEXT else 0).alias(c) for c in REPORT_COLUMNS]
    return out.select(key, F.col("result").alias("status"), F.coalesce("message", F.lit("")).alias("message"), *known)


def download_summary(report: DataFrame) -> DataFrame:
    """One row: datasets, successes, failures; reads, bases and mean GC over the successes, and their number by technology."""
    ok = F.col("status") == "Success"
    by = report.filter(ok).groupBy("technology").agg(F.count("*").alias("n"))
    counts = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("technology", "n")))).alias("technologies"))  # a handful of technologies
    one = report.agg(
        F.count("*").alias("datasets"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("downloaded_reads"))), F.lit(0)).alias("reads"),
        F.coalesce(F.sum(F.when(ok, F.col("downloaded_bases"))), F.lit(0)).alias("bases"), F.avg(F.when(ok, F.col("gc_content"))).alias("mean_gc"),
    )
    return one.crossJoin(counts)


def layout_counts(df: DataFrame, columns: Sequence[str] = ("platform", "layout")) -> DataFrame:
    """column, value, n: datasets by each of the columns."""
    return df.unpivot([], list(columns), "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))


# The columns of the metadata report before `technology`.
METADATA_COLUMNS = ("accession", "title", "organism", "platform", "instrument", "strategy", "layout", "spots", "bases", "avg_length", "size_mb", "release_date", "bioproject", "biosample", "library_selection", "library_source")


def metadata_report(datasets: DataFrame) -> DataFrame:
    """The 17 columns of the metadata report: what is known of each dataset, and the technology that it tells."""
    return datasets.select(*METADATA_COLUMNS, clean.technology(F.col("platform"), F.col("instrument"), F.col("strategy")).alias("technology"))


CHECKPOINT = "accession string, status string, bytes_done long, attempt int, parts map<int,string>, updated timestamp"


def checkpoints(current: DataFrame, changes: DataFrame, removed: DataFrame | None = None, key: str = "accession") -> DataFrame:
    """The state of each accession after some changes: the latest row by `updated` of each, without those removed."""
    every = current.unionByName(changes, allowMissingColumns=True)
    if removed is not None:
        every = every.join(removed.select(key), key, "left_anti")
    w = Window.partitionBy(key).orderBy(F.desc("updated"), F.desc("attempt"))
    return every.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def resumable(states: DataFrame, key: str = "accession") -> DataFrame:
    """Accessions that were begun and not finished."""
    return states.filter(~F.col("status").isin("completed", "failed")).select(key)


def size_statistics(df: DataFrame, size_mb: str = "size_mb") -> DataFrame:
    gb = F.col(size_mb) / 1024.0
    return df.agg(F.count("*").alias("n"), F.avg(gb).alias("avg_gb"), F.max(gb).alias("max_gb"), F.min(gb).alias("min_gb"), F.sum(gb).alias("total_gb"))


def session_summary(results: DataFrame) -> DataFrame:
    """Successes, failures, rate, MB and MB a minute of rows of success, size_mb, seconds."""
    ok = F.count_if("success")
    mb = F.sum(F.when(F.col("success"), F.col("size_mb")))
    return results.agg(ok.alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), (ok / F.nullif(F.count("*"), F.lit(0))).alias("rate"), mb.alias("mb"), (mb / F.nullif(F.sum("seconds") / 60.0, F.lit(0.0))).alias("mb_per_minute"))


def inventory(items: DataFrame, wanted: DataFrame, key: str = "accession") -> DataFrame:
    """kind, present, missing over rows of kind and key."""
    kinds = items.select("kind").distinct()
    need = wanted.select(key).distinct()
    total = need.agg(F.count("*").alias("wanted"))
    have = items.join(need, key, "left_semi").groupBy("kind").agg(F.count_distinct(key).alias("present"))
    return kinds.join(have, "kind", "left").crossJoin(F.broadcast(total)).select("kind", F.coalesce("present", F.lit(0)).alias("present"), (F.col("wanted") - F.coalesce("present", F.lit(0))).alias("missing"))


def download_report(planned: DataFrame, failed: DataFrame, key: str = "accession") -> DataFrame:
    """Success or Failed by membership in the failed list."""
    f = failed.select(key).distinct().withColumn("_f", F.lit(True))
    return planned.join(f, key, "left").withColumn("result", F.when(F.col("_f").isNotNull(), "Failed").otherwise("Success")).drop("_f")


def pairs(files: DataFrame, name: str = "file") -> DataFrame:
    """first and second file of each pair whose mate exists."""
    f = files.select(F.col(name).alias("first"), clean.mate_name(F.col(name)).alias("second")).filter("second IS NOT NULL")
    return f.join(files.select(F.col(name).alias("second")), "second", "left_semi").select("first", "second")


def canonical_names(files: DataFrame, key: str = "accession", name: str = "file", technology: str = "technology") -> DataFrame:
    """<key>_R<i>.fastq.gz for illumina (one file too); <key>_long for the one file of a long-read technology and <key>_long_<i> for
    several; else <key> or <key>_<i>. The latter keep whether they are compressed. Files count by name."""
    w = Window.partitionBy(key)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(name)).cast("string")
    suffix = F.when(F.col(name).endswith(".gz"), ".fastq.gz").otherwise(".fastq")
    number = F.when(n > 1, F.concat(F.lit("_"), i)).otherwise("")
    long = F.when(F.col(technology).isin("nanopore", "pacbio"), "_long").otherwise("")
    other = F.concat(F.col(key), long, number, suffix)
    return files.withColumn("canonical", F.when(F.col(technology) == "illumina", F.concat(F.col(key), F.lit("_R"), i, F.lit(".fastq.gz"))).otherwise(other))


def groups_of(groups: DataFrame, members: str = "members") -> DataFrame:
    """accession and the first group that lists it; groups: ordinal, group, members."""
    m = groups.select("ordinal", "group", F.posexplode(members).alias("pos", "accession"))
    w = Window.partitionBy("accession").orderBy("ordinal", "pos")
    return m.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("accession", "group")


def batches(df: DataFrame, ordinal: str, size: int = 200) -> DataFrame:
    """A batch number by ordinal (from 0)."""
    return df.withColumn("batch", F.floor(F.col(ordinal) / size).cast("long"))
