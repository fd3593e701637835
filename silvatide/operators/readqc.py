"""Sequencing-read statistics: reads are rows of accession, file, read_no, seq and (if known) qual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean

SAMPLE_READS, COMPLEXITY_READS = 10_000, 1_000


def phred(qual: Column) -> Column:
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)


def mean_phred(qual: Column) -> Column:
    n = F.length(qual)
    return F.when(n > 0, F.aggregate(phred(qual), F.lit(0), lambda a, x: a + x) / n)


def n50(reads: DataFrame, key: str, length: str) -> DataFrame:
    """The length at which, longest first, half of all bases are reached. Lengths are counted first: the window runs over distinct lengths."""
    g = reads.groupBy(F.col(key).alias("key"), F.col(length).alias("len")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("key")
    run = whole.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumns({"cum": F.sum(F.col("len") * F.col("n")).over(run), "total": F.sum(F.col("len") * F.col("n")).over(whole)})
    return g.filter(F.col("cum") >= F.col("total") / 2.0).groupBy("key").agg(F.max("len").alias("n50"))


def read_statistics(reads: DataFrame, key: str = "accession", seq: str = "seq", qual: str | None = "qual") -> DataFrame:
    """All reads of a key: counts, lengths, N50, GC in percent of all bases, and the mean, least and largest of per-read mean qualities."""
    r = reads.select(F.col(key).alias("key"), F.length(seq).alias("len"), F.length(F.regexp_replace(seq, "[^GC]", "")).alias("gc"), (mean_phred(F.col(qual)) if qual else F.lit(None).cast("double")).alias("q"))
    s = r.groupBy("key").agg(
        F.count("*").alias("total_reads"), F.sum("len").alias("total_bases"), F.avg("len").alias("mean_length"), F.min("len").alias("min_length"), F.max("len").alias("max_length"),
        (100.0 * F.sum("gc") / F.nullif(F.sum("len"), F.lit(0))).alias("gc_percent"), F.avg("q").alias("mean_quality"), F.min("q").alias("min_quality"), F.max("q").alias("max_quality"),
    )
    return s.join(n50(r, "key", "len"), "key", "left").withColumn("n50", F.coalesce("n50", F.lit(0)))


def layouts(files: DataFrame, key: str = "accession", name: str = "file") -> DataFrame:
    """PAIRED if any file name says it is a second mate."""
    paired = F.max(F.col(name).rlike("_2|_R2"))
    return files.groupBy(key).agg(F.when(paired, "PAIRED").otherwise("SINGLE").alias("layout"))


def statistics_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(F.sum("total_reads").alias("reads"), F.sum("total_bases").alias("bases"), F.avg("mean_length").alias("mean_length"), F.count_if(F.col("layout") == "PAIRED").alias("paired"), F.count_if(F.col("layout") == "SINGLE").alias("single"))


def length_distribution(reads: DataFrame, key: str, length: Column) -> DataFrame:
    """Reads of each key in each length bucket, zeros too."""
    bounds = clean.LENGTH_BOUNDS
    labels = [f"{lo + 1}-{hi}" for lo, hi in zip((0, *bounds), bounds, strict=False)] + [f">{bounds[-1]}"]
    r = reads.select(F.col(key).alias("key"), clean.length_bucket(length).alias("bucket"))
    t = r.groupBy("key").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in labels])
    return t.unpivot(["key"], [f"`{b}`" for b in labels], "bucket", "n")


def quality_distribution(reads: DataFrame, key: str = "accession", qual: str = "qual") -> DataFrame:
    """Share of all bases in each quality bucket. Bases are counted by quality inside each read's row before anything is shuffled."""
    q = phred(F.col(qual))
    count = lambda lo, hi: F.size(F.filter(q, lambda x: (x >= lo) & (x < hi)))
    parts = {"high": (30, 1000), "medium": (20, 30), "low": (10, 20), "very_low": (-1000, 10)}
    r = reads.select(F.col(key).alias("key"), F.length(qual).alias("n"), *[count(*b).alias(name) for name, b in parts.items()])
    return r.groupBy("key").agg(*[(F.sum(p) / F.nullif(F.sum("n"), F.lit(0))).alias(p) for p in parts])


def base_quality(reads: DataFrame, key: str = "accession", qual: str = "qual") -> DataFrame:
    """Mean, median and quartiles over all bases, from counts by quality."""
    h = reads.select(F.col(key).alias("key"), F.explode(phred(F.col(qual))).alias("q")).groupBy("key", "q").agg(F.count("*").alias("n"))
    p = F.expr("percentile(q, array(0.25D, 0.5D, 0.75D), n)")
    out = h.groupBy("key").agg((F.sum(F.col("q") * F.col("n")) / F.sum("n")).alias("mean"), p.alias("p"))
    return out.select("key", "mean", F.get("p", F.lit(1)).alias("median"), F.get("p", F.lit(0)).alias("q25"), F.get("p", F.lit(2)).alias("q75"))


def over_represented(reads: DataFrame, key: str, seq: str) -> DataFrame:
    """total, distinct, duplication_rate and the share of the most frequent sequence."""
    g = reads.groupBy(F.col(key).alias("key"), F.col(seq).alias("s")).agg(F.count("*").alias("n"))
    out = g.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.max("n").alias("most"))
    return out.select("key", "total", "distinct", (1 - F.col("distinct") / F.col("total")).alias("duplication_rate"), (F.col("most") / F.col("total")).alias("over_represented"))


def profile(reads: DataFrame, key: str = "accession", seq: str = "seq", qual: str = "qual", read_no: str = "read_no", sample_reads: int = SAMPLE_READS, wanted: DataFrame | None = None) -> DataFrame:
    """The quality profile of a dataset's first `sample_reads` reads, as its definition says: lengths, GC, base quality, N content,
    complexity and homopolymers of the first 1000, adapters, duplicates, grade, recommendations and anomalies. With `wanted` (key) a profile of
    each of those: one without reads has zeros, no duplication rate, and the grade that follows from them."""
    r = reads.filter(F.col(read_no) < sample_reads)
    s, n = F.col(seq), F.length(seq)
    early = F.col(read_no) < COMPLEXITY_READS
    ns = F.when(n > 0, F.length(F.regexp_replace(s, "[^N]", "")) / n)
    a = r.groupBy(F.col(key).alias("key")).agg(
        F.count("*").alias("reads"), F.avg(n).alias("mean_length"), F.median(n).alias("median_length"), F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias("std_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"),
        F.avg(clean.gc_fraction(s)).alias("gc"), F.median(clean.gc_fraction(s)).alias("median_gc"), F.coalesce(F.stddev_samp(clean.gc_fraction(s)), F.lit(0.0)).alias("std_gc"),
        F.avg(ns).alias("n_content"), F.max(ns).alias("max_n_content"), F.count_if(ns > 0.05).alias("high_n_reads"),
        F.avg(F.when(early, clean.kmer_diversity(s))).alias("complexity"), F.avg(F.when(early, clean.homopolymer_rate(s))).alias("homopolymer_rate"),
        F.avg(clean.has_adapter(s).cast("double")).alias("adapter"), F.sum(n).alias("bases"),
    )
    a = a.join(over_represented(r, key, seq).drop("total", "distinct"), "key").join(base_quality(r, key, qual).select("key", F.col("mean").alias("mean_quality"), F.col("median").alias("median_quality"), "q25", "q75"), "key", "left")
    if wanted is not None:
        a = wanted.select("key").distinct().join(a, "key", "left")
        zero = {c: F.when(F.col("reads").isNull(), F.lit(0)).otherwise(F.col(c)).cast(k) for c, k in a.dtypes if c not in ("key", "reads", "duplication_rate") and k in ("int", "bigint", "double")}
        a = a.withColumns(zero).withColumn("reads", F.coalesce("reads", F.lit(0)).cast("long"))
    grade = clean.quality_grade(F.col("mean_quality"), F.col("adapter"), F.col("complexity"))
    a = a.withColumn("grade", grade)
    flags = clean.anomaly_flags(F.col("complexity"), F.col("adapter"), F.col("gc"), F.col("n_content"), F.col("grade"))
    return a.withColumns(
        {
            "recommendations": clean.quality_recommendations(F.col("mean_quality"), F.col("adapter"), F.col("complexity")),
            "anomalies": flags,
            "severity": clean.anomaly_severity(flags),
            "parameters": clean.processing_parameters(*[F.col(c) for c in ("mean_length", "grade", "adapter", "over_represented", "complexity", "reads", "bases")]),
        }
    )


def anomaly_report(profiles: DataFrame, failed: DataFrame | None = None, threshold: float = 0.2) -> DataFrame:
    """key, severity, anomalies, explanation, actions of datasets whose severity is above the threshold, and (with no actions) of those whose
    analysis failed. failed: key, error."""
    reasons = clean.anomaly_reasons(F.col("anomalies"), F.col("adapter"), F.col("gc"), F.col("n_content"))
    out = profiles.filter(F.col("severity") > threshold).select("key", "severity", "anomalies", reasons.alias("explanation"), clean.anomaly_actions(F.col("anomalies")).alias("actions"))
    if failed is None:
        return out
    kind, weight = clean.FAILED_ANALYSIS
    lost = failed.select("key", F.lit(weight).alias("severity"), F.array(F.lit(kind)).alias("anomalies"), F.concat(F.lit("Analysis failed: "), "error").alias("explanation"), F.array().cast("array<string>").alias("actions"))
    return out.unionByName(lost)


def anomaly_types(profiles: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """anomaly, key: every dataset under each type that it shows, whatever its severity."""
    out = profiles.select(F.explode("anomalies").alias("anomaly"), "key")
    return out if failed is None else out.unionByName(failed.select(F.lit(clean.FAILED_ANALYSIS[0]).alias("anomaly"), "key"))


def statistics_report(stats: DataFrame, files: DataFrame, key: str = "accession") -> DataFrame:
    """The 11 columns of the statistics report. stats: of read_statistics; files: key, file. Datasets without files or reads have no row."""
    n = files.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("num_files")).join(layouts(files, key).withColumnRenamed(key, "key"), "key")
    j = stats.join(n, "key")
    names = {"mean_length": "avg_read_length", "min_length": "min_read_length", "max_length": "max_read_length", "n50": "n50", "gc_percent": "gc_content", "mean_quality": "avg_quality"}
    return j.select(F.col("key").alias("accession"), "num_files", "layout", "total_reads", "total_bases", *[F.col(a).alias(b) for a, b in names.items()])


def group_profiles(reads: DataFrame, groups: DataFrame, key: str = "accession", **options) -> DataFrame:
    """The profile of every dataset of the groups (key, group), with its group; datasets without reads have a profile of zeros."""
    members = groups.select(F.col(key).alias("key"), "group")
    kept = reads.join(members.select(F.col("key").alias(key)).distinct(), key, "left_semi")
    return profile(kept, key, wanted=members, **options).join(members, "key")


def quality_summary(profiles: DataFrame) -> DataFrame:
    grades = [F.count_if(F.col("grade") == g).alias(g) for g in ("excellent", "good", "fair", "poor")]
    return profiles.agg(F.count("*").alias("datasets"), F.sum("reads").alias("reads"), F.sum("bases").alias("bases"), F.avg("gc").alias("gc"), F.avg("complexity").alias("complexity"), F.avg("adapter").alias("adapter"), *grades, F.count_if(F.col("adapter") > 0.05).alias("high_adapter"), F.count_if(F.col("n_content") > 0.01).alias("high_n"), F.count_if(F.col("duplication_rate") > 0.2).alias("high_duplication"))


def file_issues(files: DataFrame, key: str = "accession") -> DataFrame:
    """Issues of each accession's files (file, bytes, parsable of the first): empty files, unequal numbers of mates, unreadable format."""
    mate1, mate2 = F.count_if(F.col("file").rlike("_1|_R1")), F.count_if(F.col("file").rlike("_2|_R2"))
    a = files.groupBy(key).agg(F.count_if(F.col("bytes") == 0).alias("empty"), mate1.alias("m1"), mate2.alias("m2"), F.min_by("parsable", "file").alias("ok"))
    text = F.concat_ws("; ", F.when(F.col("empty") > 0, F.format_string("%d empty files", "empty")), F.when((F.col("m2") > 0) & (F.col("m1") != F.col("m2")), "unequal numbers of mates"), F.when(~F.col("ok"), "unreadable format"))
    return a.select(key, text.alias("issues")).filter("issues <> ''")
