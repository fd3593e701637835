"""Registered queries of read quality, group comparison, planning and taxonomy records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import AB, BC, BRAND_NAMES, C, RUNS, TX, brand_taxa, cells, nations, purchases, r, register, runs, supplied, t
from .functions import clean
from .operators import containment, diversity, metadata, planning, readqc, statistics, taxonomy, ward


# Reads: parts by brand. A part's name is its sequence, and its quality line too.
def reads(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_brand").alias("accession"), F.concat("p_brand", F.lit("_1.fastq")).alias("file"), F.col("p_partkey").alias("read_no"), F.upper("p_name").alias("seq"), F.col("p_name").alias("qual"))


RD = "rd AS (SELECT p_brand AS key, p_partkey AS read_no, upper(p_name) AS seq, p_name AS qual, list_transform(string_split(p_name, ''), lambda x: ascii(x) - 33) AS q FROM part)"


@register(
    "read_statistics_quality",
    f"""WITH {RD}, m AS (SELECT key, length(seq) AS len, length(regexp_replace(seq, '[^GC]', '', 'g')) AS gc, list_sum(q) / CAST(len(q) AS DOUBLE) AS mq FROM rd),
n AS (SELECT key, len, sum(len) OVER (PARTITION BY key ORDER BY len DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(len) OVER (PARTITION BY key) AS tot FROM m),
n50 AS (SELECT key, max(len) FILTER (cum >= tot / 2.0::DOUBLE) AS n50 FROM n GROUP BY key)
SELECT key AS accession, 1 AS num_files, 'SINGLE' AS layout, count(*) AS total_reads, sum(len)::BIGINT AS total_bases, round(avg(len), 6) AS avg_read_length, any_value(n50)::BIGINT AS n50,
  round(100.0::DOUBLE * sum(gc) / sum(len), 6) AS gc_content, round(avg(mq), 6) AS avg_quality FROM m JOIN n50 USING (key) GROUP BY key""",
)
def read_statistics_quality(spark, d):
    files = reads(spark, d).select("accession", "file").distinct()
    out = readqc.statistics_report(readqc.read_statistics(reads(spark, d)), files)
    return out.select("accession", F.col("num_files").cast("int").alias("num_files"), "layout", "total_reads", "total_bases", r("avg_read_length", 6).alias("avg_read_length"), F.col("n50").cast("long").alias("n50"), r("gc_content", 6).alias("gc_content"), r("avg_quality", 6).alias("avg_quality"))


@register(
    "statistics_totals",
    "WITH s AS (SELECT p_brand, count(*) AS n, sum(length(p_name)) AS b, avg(length(p_name)) AS m FROM part GROUP BY p_brand) SELECT sum(n)::BIGINT AS reads, sum(b)::BIGINT AS bases, round(avg(m), 6) AS mean_length, 0 AS paired, count(*) AS single FROM s",
)
def statistics_totals(spark, d):
    files = reads(spark, d).select("accession", "file").distinct()
    stats = readqc.read_statistics(reads(spark, d)).join(readqc.layouts(files).withColumnRenamed("accession", "key"), "key")
    return readqc.statistics_summary(stats).select("reads", "bases", r("mean_length", 6).alias("mean_length"), F.col("paired").cast("int").alias("paired"), "single")


@register(
    "quality_distribution",
    f"""WITH {RD}, u AS (SELECT key, unnest(q) AS q FROM rd) SELECT key, round(avg(CASE WHEN q >= 30 THEN 1.0::DOUBLE ELSE 0 END), 9) AS high, round(avg(CASE WHEN q >= 20 AND q < 30 THEN 1.0::DOUBLE ELSE 0 END), 9) AS medium,
round(avg(CASE WHEN q >= 10 AND q < 20 THEN 1.0::DOUBLE ELSE 0 END), 9) AS low, round(avg(CASE WHEN q < 10 THEN 1.0::DOUBLE ELSE 0 END), 9) AS very_low FROM u GROUP BY key""",
)
def quality_distribution(spark, d):
    return readqc.quality_distribution(reads(spark, d)).select("key", *[r(c).alias(c) for c in ("high", "medium", "low", "very_low")])


@register(
    "base_quality",
    f"WITH {RD}, u AS (SELECT key, unnest(q) AS q FROM rd) SELECT key, round(avg(q), 6) AS mean, quantile_cont(q, 0.5)::DOUBLE AS median, quantile_cont(q, 0.25)::DOUBLE AS q25, quantile_cont(q, 0.75)::DOUBLE AS q75 FROM u GROUP BY key",
)
def base_quality(spark, d):
    return readqc.base_quality(reads(spark, d)).select("key", r("mean", 6).alias("mean"), "median", "q25", "q75")


# The profile of every brand's reads; all of them are its sample.
PR = f"""{RD}, m AS (SELECT *, length(seq) AS n, string_split(seq, '') AS c, length(regexp_replace(seq, '[^GC]', '', 'g')) / CAST(length(seq) AS DOUBLE) AS gc, length(regexp_replace(seq, '[^N]', '', 'g')) / CAST(length(seq) AS DOUBLE) AS ns FROM rd),
k AS (SELECT *, CASE WHEN n >= 3 THEN len(list_distinct(list_transform(range(1, n - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) / CAST(n - 2 AS DOUBLE) ELSE 0 END AS div FROM m),
a AS (SELECT key, count(*) AS reads, avg(n) AS mean_length, median(n) AS median_length, coalesce(stddev_samp(n), 0) AS std_length, min(n) AS min_length, max(n) AS max_length, avg(gc) AS gc, median(gc) AS median_gc, coalesce(stddev_samp(gc), 0) AS std_gc,
  avg(ns) AS n_content, max(ns) AS max_n_content, count(*) FILTER (ns > 0.05::DOUBLE) AS high_n_reads, avg(div) AS complexity, sum(n)::BIGINT AS bases FROM k GROUP BY key),
b AS (SELECT key, avg(q) AS mean_quality FROM (SELECT key, unnest(q) AS q FROM rd) GROUP BY key),
g AS (SELECT key, 1 - count(*) / CAST(sum(n) AS DOUBLE) AS duplication_rate, max(n) / CAST(sum(n) AS DOUBLE) AS over_represented FROM (SELECT key, seq, count(*) AS n FROM rd GROUP BY ALL) GROUP BY key),
p0 AS (SELECT *, CASE WHEN mean_quality >= 30 THEN 40 WHEN mean_quality >= 20 THEN 20 ELSE 0 END + 30 + CASE WHEN complexity > 0.7 THEN 30 WHEN complexity > 0.4 THEN 15 ELSE 0 END AS points FROM a JOIN b USING (key) JOIN g USING (key)),
pr AS (SELECT *, CASE WHEN points >= 80 THEN 'excellent' WHEN points >= 60 THEN 'good' WHEN points >= 40 THEN 'fair' ELSE 'poor' END AS grade FROM p0),
fl AS (SELECT *, list_filter([CASE WHEN complexity < 0.1 THEN 'low_complexity' END, CASE WHEN gc < 0.2 OR gc > 0.8 THEN 'unusual_gc' END, CASE WHEN n_content > 0.05 THEN 'high_n_content' END, CASE WHEN grade = 'poor' THEN 'poor_quality' END], lambda v: v IS NOT NULL) AS flags FROM pr)"""
ALL_READS = 1 << 40


def profiles(spark: SparkSession, d: str) -> DataFrame:
    # Reads are numbered from 0, so that the complexity of the first ones is that of all.
    return readqc.profile(reads(spark, d).withColumn("read_no", F.lit(0)), sample_reads=ALL_READS)


@register(
    "read_profile",
    f"""WITH {PR} SELECT key, reads, round(mean_length, 6) AS mean_length, median_length, round(std_length, 6) AS std_length, min_length, max_length, round(gc, 8) AS gc, round(median_gc, 8) AS median_gc, round(std_gc, 8) AS std_gc,
  round(n_content, 8) AS n_content, round(max_n_content, 8) AS max_n_content, high_n_reads, round(complexity, 8) AS complexity, bases, round(mean_quality, 6) AS mean_quality, round(duplication_rate, 8) AS duplication_rate, round(over_represented, 8) AS over_represented, grade FROM pr""",
)
def read_profile(spark, d):
    p = profiles(spark, d)
    six, eight = ("mean_length", "std_length", "mean_quality"), ("gc", "median_gc", "std_gc", "n_content", "max_n_content", "complexity", "duplication_rate", "over_represented")
    return p.select("key", "reads", "median_length", *[F.col(c).cast("long").alias(c) for c in ("min_length", "max_length", "high_n_reads", "bases")], *[r(c, 6).alias(c) for c in six], *[r(c, 8).alias(c) for c in eight], "grade")


@register(
    "anomaly_report",
    f"""WITH {PR}, s AS (SELECT *, least(10, CASE WHEN list_contains(flags, 'low_complexity') THEN 3 ELSE 0 END + CASE WHEN list_contains(flags, 'unusual_gc') THEN 2 ELSE 0 END + CASE WHEN list_contains(flags, 'high_n_content') THEN 3 ELSE 0 END + CASE WHEN list_contains(flags, 'poor_quality') THEN 5 ELSE 0 END) / 10.0::DOUBLE AS severity FROM fl)
SELECT key, severity, array_to_string(flags, ',') AS anomalies, array_to_string(list_concat(CASE WHEN list_contains(flags, 'poor_quality') THEN ['Apply quality filtering', 'Consider excluding from analysis'] ELSE [] END, CASE WHEN list_contains(flags, 'low_complexity') THEN ['Check for PCR artifacts', 'Verify sample preparation'] ELSE [] END), ',') AS actions FROM s WHERE severity > 0.2""",
)
def anomaly_report(spark, d):
    return readqc.anomaly_report(profiles(spark, d)).select("key", "severity", F.array_join("anomalies", ",").alias("anomalies"), F.array_join("actions", ",").alias("actions"))


@register("anomaly_types", f"WITH {PR} SELECT unnest(flags) AS anomaly, key FROM fl")
def anomaly_types(spark, d):
    return readqc.anomaly_types(profiles(spark, d))


@register(
    "quality_summary",
    f"""WITH {PR} SELECT count(*) AS datasets, sum(reads)::BIGINT AS reads, sum(bases)::BIGINT AS bases, round(avg(gc), 8) AS gc, round(avg(complexity), 8) AS complexity, count(*) FILTER (grade = 'excellent') AS excellent, count(*) FILTER (grade = 'good') AS good,
  count(*) FILTER (grade = 'fair') AS fair, count(*) FILTER (grade = 'poor') AS poor, count(*) FILTER (n_content > 0.01) AS high_n, count(*) FILTER (duplication_rate > 0.2) AS high_duplication FROM pr""",
)
def quality_summary(spark, d):
    s = readqc.quality_summary(profiles(spark, d))
    return s.select("datasets", "reads", "bases", r("gc", 8).alias("gc"), r("complexity", 8).alias("complexity"), "excellent", "good", "fair", "poor", "high_n", "high_duplication")


# Orders stand for datasets: their price for reads, their customer for what was measured.
@register(
    "processing_parameters",
    """WITH x AS (SELECT o_orderkey, o_custkey % 1500 AS len, ['poor', 'fair', 'good', 'excellent'][CAST(o_custkey % 4 AS BIGINT) + 1] AS grade, (o_custkey % 25) / 100.0::DOUBLE AS adapter, (o_custkey % 9) / 100.0::DOUBLE AS rep, (o_custkey % 11) / 10.0::DOUBLE AS cx, CAST(o_totalprice * 1000 AS BIGINT) AS n FROM orders),
h AS (SELECT *, n / 5000000.0::DOUBLE * CASE WHEN grade IN ('poor', 'fair') THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN adapter > 0.05 OR rep > 0.05 THEN 1.3::DOUBLE ELSE 1 END AS hours FROM x)
SELECT o_orderkey, CASE WHEN len > 1000 THEN 'long_read' WHEN len > 250 THEN 'paired_end' ELSE 'short_read' END AS pipeline, grade IN ('poor', 'fair') AS trim, CASE WHEN grade = 'poor' THEN 20 ELSE 15 END AS quality_threshold, CAST(greatest(50, floor(len * 0.7::DOUBLE)) AS INTEGER) AS min_length,
  adapter > 0.01 AS strip, CASE WHEN adapter > 0.1 THEN 'high' ELSE 'medium' END AS stringency, adapter > 0.05 OR rep > 0.05 AS filtering, cx < 0.3 AS complexity_filter, CASE WHEN len < 150 THEN 'auto' ELSE '31' END AS kmer_size,
  CASE WHEN grade IN ('good', 'excellent') THEN 5 ELSE 10 END AS coverage_cutoff, grade <> 'excellent' AS error_correction, CAST(greatest(8, n // 10000000 * 2) AS BIGINT) AS memory_gb, CASE WHEN n < 50000000 THEN 4 ELSE 8 END AS cpu_cores, CAST(greatest(10, n * 150 // 1000000000 * 5) AS BIGINT) AS storage_gb FROM h""",
)
def processing_parameters(spark, d):
    k, n = F.col("o_custkey"), (F.col("o_totalprice") * 1000).cast("decimal(30,0)").cast("long")
    grade = F.get(F.array(*[F.lit(x) for x in ("poor", "fair", "good", "excellent")]), (k % 4).cast("int"))
    p = clean.processing_parameters(k % 1500, grade, (k % 25) / 100.0, (k % 9) / 100.0, (k % 11) / 10.0, n, n * 150)
    x = t(spark, d, "orders").select("o_orderkey", p.alias("p"))
    names = {
        "pipeline": "pipeline", "trim": "quality_trimming.enabled", "quality_threshold": "quality_trimming.quality_threshold", "min_length": "quality_trimming.min_length", "strip": "adapter_removal.enabled",
        "stringency": "adapter_removal.stringency", "filtering": "contamination_filtering.enabled", "complexity_filter": "contamination_filtering.complexity_filter", "kmer_size": "assembly_parameters.kmer_size",
        "coverage_cutoff": "assembly_parameters.coverage_cutoff", "error_correction": "assembly_parameters.error_correction", "memory_gb": "computational_requirements.memory_gb",
        "cpu_cores": "computational_requirements.cpu_cores", "storage_gb": "computational_requirements.storage_gb",
    }
    return x.select("o_orderkey", *[F.col(f"p.{v}").alias(c) for c, v in names.items()])


_TEXTS = "'Apply quality trimming with Q20 threshold', 'Remove adapter sequences', 'Check for PCR duplicates and low-complexity regions'"


@register(
    "quality_recommendations",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, list_filter(list_transform(range(1, 4), lambda i: CASE WHEN [l_quantity < 20, l_discount > 0.05::DOUBLE, l_tax * 10 < 0.3::DOUBLE][i] THEN [{_TEXTS}][i] END), lambda v: v IS NOT NULL) AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN len(f) > 0 THEN array_to_string(f, ';') ELSE 'Dataset appears to be high quality' END AS advice FROM x""",
)
def quality_recommendations(spark, d):
    advice = clean.quality_recommendations(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax") * 10)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(advice, ";").alias("advice"))


@register("gc_fraction", "SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^GC]', '', 'g')) / CAST(length(text) AS DOUBLE) ELSE 0 END, 9) AS gc FROM documents")
def gc_fraction(spark, d):
    return t(spark, d, "documents").select("doc_id", r(clean.gc_fraction(F.col("text"))).alias("gc"))


@register(
    "file_issues",
    """WITH f AS (SELECT l_orderkey AS accession, l_linenumber, l_orderkey || '_' || (1 + l_linenumber % 2) || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS file, CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE l_partkey END AS bytes, l_suppkey % 10 <> 0 AS parsable FROM lineitem),
a AS (SELECT accession, count(*) FILTER (bytes = 0) AS e, count(*) FILTER (regexp_matches(file, '_1|_R1')) AS m1, count(*) FILTER (regexp_matches(file, '_2|_R2')) AS m2, min_by(parsable, file) AS ok FROM f GROUP BY accession),
i AS (SELECT accession, concat_ws('; ', CASE WHEN e > 0 THEN e || ' empty files' END, CASE WHEN m2 > 0 AND m1 <> m2 THEN 'unequal numbers of mates' END, CASE WHEN NOT ok THEN 'unreadable format' END) AS issues FROM a) SELECT * FROM i WHERE issues <> ''""",
)
def file_issues(spark, d):
    k = F.col("l_orderkey").cast("string")
    f = t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("accession"), F.concat(k, F.lit("_"), (1 + F.col("l_linenumber") % 2).cast("string"), *[x for c in ("l_linenumber", "l_partkey", "l_suppkey") for x in (F.lit("."), F.col(c).cast("string"))]).alias("file"),
        F.when(F.col("l_partkey") % 9 == 0, 0).otherwise(F.col("l_partkey")).alias("bytes"), (F.col("l_suppkey") % 10 != 0).alias("parsable"),
    )
    return readqc.file_issues(f)


# Comparison of groups: lineitems by ship mode are datasets of groups.
_METRICS = ("l_quantity", "l_extendedprice", "l_discount")


@register(
    "describe_groups",
    " UNION ALL ".join(
        f"""SELECT l_linestatus AS "group", '{m}' AS metric, count({m}) AS n, round(avg({m}), 5) AS mean, round(stddev_samp({m}), 5) AS std, min({m})::DOUBLE AS min, round(quantile_cont({m}, 0.25), 5) AS q25, round(quantile_cont({m}, 0.5), 5) AS q50, round(quantile_cont({m}, 0.75), 5) AS q75, max({m})::DOUBLE AS max FROM lineitem GROUP BY ALL"""
        for m in _METRICS
    ),
)
def describe_groups(spark, d):
    x = statistics.describe(t(spark, d, "lineitem").select("l_linestatus", *[F.col(m).cast("double").alias(m) for m in _METRICS]), "l_linestatus", _METRICS)
    return x.select("group", "metric", "n", *[r(c, 5).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@register(
    "comparative_recommendations",
    """WITH q AS (SELECT quantile_cont(s_acctbal, 0.25) AS a, quantile_cont(s_acctbal, 0.75) AS b FROM supplier) SELECT 0 AS ordinal, 'No major issues detected in comparative analysis' AS text FROM q WHERE NOT EXISTS (SELECT 1 FROM supplier, q WHERE s_acctbal < a - 1.5::DOUBLE * (b - a) OR s_acctbal > b + 1.5::DOUBLE * (b - a))""",
)
def comparative_recommendations(spark, d):
    """Suppliers by whether their key is even: nothing tells the two apart."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit(1.0).alias("flat"), "s_acctbal")
    g = s.select("key", (F.col("key") % 2).cast("string").alias("group"))
    out = statistics.compare_groups(s, g, ("flat",))["recommendations"]
    return out.select("ordinal", "text")


@register(
    "comparative_differences",
    """WITH p AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_totalprice AS price, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS dear FROM orders),
q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM p), o AS (SELECT key FROM p, q WHERE price < a - 1.5::DOUBLE * (b - a) OR price > b + 1.5::DOUBLE * (b - a)),
f AS (SELECT array_to_string(list_slice(list(key ORDER BY key), 1, 5), ', ') || CASE WHEN count(*) > 5 THEN '...' ELSE '' END AS names, count(*) AS n FROM o),
t AS (SELECT 'Significant differences detected in: price' AS text, 0 AS k UNION ALL SELECT 'Consider including group as covariate in downstream analysis', 1
  UNION ALL SELECT 'Outlier datasets detected: ' || names, 2 FROM f WHERE n > 0 UNION ALL SELECT 'Review outlier datasets for quality issues', 3 FROM f WHERE n > 0)
SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS ordinal, text FROM t""",
)
def comparative_differences(spark, d):
    """Orders below and above the mean price: their prices differ, their numbers of letters do not; outliers are named."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_totalprice").alias("price"), F.lit(3.0).alias("same"))
    mean = o.agg(F.avg("price").alias("mean"))
    g = o.crossJoin(F.broadcast(mean)).select("key", (F.col("price") > F.col("mean")).cast("string").alias("group"))  # one row
    return statistics.compare_groups(o, g, ("price", "same"))["recommendations"].select("ordinal", "text")


@register(
    "correlation_kendall",
    """WITH p AS (SELECT n_regionkey AS x, length(n_name) AS y FROM nation), s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM p a, p b), n AS (SELECT count(*) * (count(*) - 1) / 2.0::DOUBLE AS n0 FROM p),
tx AS (SELECT sum(c * (c - 1) / 2.0::DOUBLE) AS t FROM (SELECT count(*) AS c FROM p GROUP BY x)), ty AS (SELECT sum(c * (c - 1) / 2.0::DOUBLE) AS t FROM (SELECT count(*) AS c FROM p GROUP BY y)) SELECT round(s / sqrt((n0 - tx.t) * (n0 - ty.t)), 7) AS r FROM s, n, tx, ty""",
)
def correlation_kendall(spark, d):
    n = t(spark, d, "nation").select("n_regionkey", F.length("n_name").alias("size"))
    return statistics.correlation(n, ["n_regionkey", "size"], "kendall").filter("a <> b").select(r("r", 7).alias("r"))


@register(
    "correlation_kendall_lines",
    """WITH c AS (SELECT l_quantity AS x, l_extendedprice AS y, count(*) AS w FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY ALL),
k AS (SELECT DISTINCT x FROM c), m AS (SELECT k.x AS x, y, coalesce(sum(w) FILTER (c.x < k.x), 0)::HUGEINT AS low, coalesce(sum(w) FILTER (c.x = k.x), 0)::HUGEINT AS own FROM k CROSS JOIN c GROUP BY k.x, y),
s AS (SELECT sum(own * (2 * coalesce(b, 0) + low - t)) AS s FROM (SELECT own, low, sum(low) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, sum(low) OVER (PARTITION BY x) AS t FROM m)),
n AS (SELECT sum(w)::DOUBLE * (sum(w)::DOUBLE - 1) / 2 AS n0 FROM c),
tx AS (SELECT sum(w * (w - 1) / 2.0::DOUBLE) AS t FROM (SELECT sum(w)::DOUBLE AS w FROM c GROUP BY x)), ty AS (SELECT sum(w * (w - 1) / 2.0::DOUBLE) AS t FROM (SELECT sum(w)::DOUBLE AS w FROM c GROUP BY y))
SELECT round(s::DOUBLE / (sqrt(n0 - tx.t) * sqrt(n0 - ty.t)), 9) AS r FROM s, n, tx, ty""",
)
def correlation_kendall_lines(spark, d):
    """Quantity (50 values) against price (nearly all different) of all lineitems."""
    l = t(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    return statistics.correlation(l, ["l_quantity", "l_extendedprice"], "kendall").filter("a <> b").select(r("r", 9).alias("r"))


@register("pca")  # signs and ties of components are free: the share of variance is checked in the tests
def pca(spark, d):
    """All genomes are columns."""
    names = [f"g{k}" for k in range(len(BRAND_NAMES))]
    wide = containment.wide(cells(spark, d), BRAND_NAMES).select("sample", *[F.col(f"`{g}`").alias(n) for g, n in zip(BRAND_NAMES, names, strict=True)])
    out = diversity.pca(wide, names, 2)
    part = lambda c, k: F.get(c, F.lit(k))
    return out.select("sample", *[r(part("components", k)).alias(f"pc{k + 1}") for k in (0, 1)], *[r(part("explained", k)).alias(f"share{k + 1}") for k in (0, 1)])


def heatmap_table(spark, d):
    names = [f"g{k}" for k in range(len(BRAND_NAMES))]
    return containment.wide(cells(spark, d), BRAND_NAMES).select("sample", *[F.col(f"`{g}`").alias(n) for g, n in zip(BRAND_NAMES, names, strict=True)]), names


@register("heatmap_rows")  # a clustering: held against merging the nearest two again and again in the tests
def heatmap_rows(spark, d):
    """The order of all samples in a clustered heatmap of containments."""
    return ward.row_order(*heatmap_table(spark, d))


@register("heatmap_columns")  # as heatmap_rows
def heatmap_columns(spark, d):
    """The order of all genomes in a clustered heatmap of containments."""
    return ward.column_order(*heatmap_table(spark, d)).select(F.element_at(F.array(*map(F.lit, BRAND_NAMES)), F.col("id").cast("int") + 1).alias("genome"), "place")


@register("permanova_variables")  # shuffled labels: held against brute force in the tests
def permanova_variables(spark, d):
    samples, groups = nations(spark, d)
    m = groups.withColumn("half", F.col("sample") % 2)
    return diversity.permanova(diversity.beta(supplied(spark, d), samples), samples, m, "group + half", 99, 1)


# Planning
@register("estimated_sizes", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice WHEN o_orderkey % 3 = 0 THEN 500 WHEN o_orderkey % 3 = 1 THEN 800 ELSE 1024 END::DOUBLE AS mb FROM orders")
def estimated_sizes(spark, d):
    k = F.col("o_orderkey")
    acc = F.concat(F.when(k % 3 == 0, "ERR").when(k % 3 == 1, "SRR").otherwise("DRR"), k.cast("string"))
    return t(spark, d, "orders").select("o_orderkey", clean.estimated_size_mb(acc, F.when(k % 4 == 0, F.col("o_totalprice"))).cast("double").alias("mb"))


@register("size_statistics", "SELECT count(*) AS n, round(avg(o_totalprice / 1024.0::DOUBLE), 6) AS avg_gb, round(max(o_totalprice) / 1024.0::DOUBLE, 6) AS max_gb, round(min(o_totalprice) / 1024.0::DOUBLE, 6) AS min_gb, round(sum(o_totalprice) / 1024.0::DOUBLE, 3) AS total_gb FROM orders")
def size_statistics(spark, d):
    return planning.size_statistics(t(spark, d, "orders"), "o_totalprice").select("n", *[r(c, 6).alias(c) for c in ("avg_gb", "max_gb", "min_gb")], r("total_gb", 3).alias("total_gb"))


@register("layout_counts", f"WITH {RUNS} SELECT 'platform' AS \"column\", platform AS value, count(*) AS n FROM runs GROUP BY ALL UNION ALL SELECT 'instrument', instrument, count(*) FROM runs GROUP BY ALL")
def layout_counts(spark, d):
    return planning.layout_counts(runs(spark, d), ("platform", "instrument"))


@register("session_summary", "SELECT count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus <> 'F') AS failed, round(count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 9) AS rate, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS mb, round(sum(o_totalprice) FILTER (o_orderstatus = 'F') / (sum(o_custkey % 60 + 1) / 60.0::DOUBLE), 4) AS mb_per_minute FROM orders")
def session_summary(spark, d):
    o = t(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("success"), F.col("o_totalprice").alias("size_mb"), (F.col("o_custkey") % 60 + 1).alias("seconds"))
    s = planning.session_summary(o)
    return s.select("succeeded", "failed", r("rate").alias("rate"), r("mb", 2).alias("mb"), r("mb_per_minute", 4).alias("mb_per_minute"))


@register("first_downloads", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50) ORDER BY o_orderdate, o_orderkey LIMIT 50")
def first_downloads(spark, d):
    """The limit is the feature: as many as may be fetched."""
    o = t(spark, d, "orders").select("o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("place"))
    l = t(spark, d, "lineitem").filter("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return planning.first_downloads(planning.plan(o, l, l, "o_orderkey"), 50, "place").select("o_orderkey")


@register(
    "canonical_names",
    f"""WITH {RUNS}, f AS (SELECT p_brand || '-' || technology AS accession, technology, 'run' || lpad(CAST(part.p_partkey AS VARCHAR), 8, '0') || CASE WHEN part.p_partkey % 2 = 0 THEN '.fastq.gz' ELSE '.fastq' END AS file FROM part JOIN tech USING (p_partkey)),
w AS (SELECT *, count(*) OVER (PARTITION BY accession) AS n, row_number() OVER (PARTITION BY accession ORDER BY file) AS i, CASE WHEN ends_with(file, '.gz') THEN '.fastq.gz' ELSE '.fastq' END AS ext FROM f)
SELECT file, CASE WHEN technology = 'illumina' THEN accession || '_R' || i || '.fastq.gz' ELSE accession || CASE WHEN technology IN ('nanopore', 'pacbio') THEN '_long' ELSE '' END || CASE WHEN n > 1 THEN '_' || i ELSE '' END || ext END AS canonical FROM w""",
)
def canonical_names(spark, d):
    tech = clean.technology(F.col("platform"), F.col("instrument"), F.col("strategy"))
    k = F.col("p_partkey")
    x = runs(spark, d).withColumn("technology", tech).join(t(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    name = F.concat(F.lit("run"), F.lpad(k.cast("string"), 8, "0"), F.when(k % 2 == 0, ".fastq.gz").otherwise(".fastq"))
    return planning.canonical_names(x.select(F.concat("p_brand", F.lit("-"), "technology").alias("accession"), "technology", name.alias("file"))).select("file", "canonical")


@register("file_pairs", "SELECT p_partkey || '_R1.fastq' AS first, p_partkey || '_R2.fastq' AS second FROM part WHERE p_size % 3 = 0")
def file_pairs(spark, d):
    k = F.col("p_partkey").cast("string")
    p = t(spark, d, "part")
    f = p.select(F.concat(k, F.lit("_R1.fastq")).alias("file")).unionByName(p.filter("p_size % 3 = 0").select(F.concat(k, F.lit("_R2.fastq")).alias("file")))
    return planning.pairs(f)


@register("group_membership", "SELECT o_custkey AS accession, arg_min(o_orderpriority, o_orderkey) AS \"group\" FROM orders GROUP BY ALL")
def group_membership(spark, d):
    g = t(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("group"), F.array("o_custkey").alias("members"))
    return planning.groups_of(g)


@register(
    "download_report",
    """WITH d AS (SELECT o_orderkey AS accession, o_orderstatus AS technology, o_totalprice AS size_mb, o_custkey AS downloaded_reads FROM orders), f AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT accession, CASE WHEN accession IN (SELECT l_orderkey FROM f) THEN 'Failed' ELSE 'Success' END AS status, CASE WHEN accession % 5 = 0 THEN 'done' ELSE '' END AS message, technology, '' AS platform, size_mb, downloaded_reads, 0 AS gc_content FROM d""",
)
def download_report(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("accession"), F.col("o_orderstatus").alias("technology"), F.col("o_totalprice").alias("size_mb"), F.col("o_custkey").alias("downloaded_reads"))
    failed = t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("accession"))
    out = planning.full_download_report(o, o.filter("accession % 5 = 0").select("accession", F.lit("done").alias("message")), failed)
    return out.select("accession", "status", "message", "technology", "platform", "size_mb", "downloaded_reads", "gc_content")


@register(
    "download_summary",
    """WITH s AS (SELECT o_orderkey, o_orderstatus, o_custkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS bad FROM orders)
SELECT count(*) AS datasets, count(*) FILTER (NOT bad) AS successful, count(*) FILTER (bad) AS failed, sum(o_custkey) FILTER (NOT bad)::BIGINT AS reads, (SELECT string_agg(o_orderstatus || '=' || n, ',' ORDER BY o_orderstatus) FROM (SELECT o_orderstatus, count(*) AS n FROM s WHERE NOT bad GROUP BY ALL)) AS technologies FROM s""",
)
def download_summary(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("accession"), F.col("o_orderstatus").alias("technology"), F.col("o_custkey").alias("downloaded_reads"))
    failed = t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("accession"))
    s = planning.download_summary(planning.full_download_report(o, o.limit(0).select("accession", F.lit("").alias("message")), failed))
    named = F.array_join(F.transform(F.map_entries("technologies"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select("datasets", "successful", "failed", "reads", named.alias("technologies"))


@register("checkpoints", "SELECT o_custkey AS accession, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max(o_orderdate) AS updated FROM orders WHERE o_custkey % 7 <> 0 GROUP BY ALL")
def checkpoints(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("accession"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated"), F.col("o_orderkey").alias("attempt"))
    gone = t(spark, d, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("accession"))
    return planning.checkpoints(o.filter("attempt % 2 = 0"), o.filter("attempt % 2 = 1"), gone).select("accession", "status", "updated")


# Metadata
@register("category_top", "SELECT p_type AS value, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, value LIMIT 10")
def category_top(spark, d):
    return metadata.value_counts(t(spark, d, "part"), "p_type", 10)


@register("plot_rows", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def plot_rows(spark, d):
    return metadata.plot_rows(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", 100)


@register("top_samples", f"WITH {C}, m AS (SELECT sample, max(v) AS max_containment FROM c GROUP BY sample) SELECT sample, max_containment FROM m ORDER BY max_containment DESC, sample LIMIT 10")
def top_samples(spark, d):
    return containment.top_samples(containment.row_max(cells(spark, d))).select("sample", "max_containment")


@register("heatmap_presence", f"WITH {C} SELECT sample, genome, CAST(v > 0.5 AS INTEGER) AS v FROM c")
def heatmap_presence(spark, d):
    return containment.heatmap_cells(cells(spark, d), 0.5)


@register("plot_frame", f"WITH {C}, m AS (SELECT sample, max(v) AS max_containment FROM c GROUP BY sample) SELECT sample, max_containment, c_mktsegment AS color, c_acctbal AS size FROM m JOIN customer ON sample = c_custkey")
def plot_frame(spark, d):
    m = t(spark, d, "customer").select(F.col("c_custkey").alias("sample"), "c_mktsegment", "c_acctbal")
    points = containment.row_max(cells(spark, d)).select("sample", "max_containment")
    return diversity.plot_frame(points, m, "c_mktsegment", "c_acctbal")


@register("aligned_metadata", f"WITH {AB} SELECT DISTINCT sample, c_mktsegment FROM ab JOIN customer ON sample = c_custkey")
def aligned_metadata(spark, d):
    m = t(spark, d, "customer").select(F.col("c_custkey").alias("sample"), "c_mktsegment")
    return diversity.aligned(purchases(spark, d).select("sample").distinct(), m)


# Taxonomy
@register("annotate_grid", f"WITH {C}, {TX}, ids AS (SELECT DISTINCT sample FROM c) SELECT ids.sample, tx.genome, coalesce(c.v, 0) AS v, family, genus FROM ids CROSS JOIN tx LEFT JOIN c ON c.sample = ids.sample AND c.genome = tx.genome")
def annotate_grid(spark, d):
    return taxonomy.annotate_grid(cells(spark, d), brand_taxa(spark, d), BRAND_NAMES).select("sample", "genome", "v", "family", "genus")


_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@register("family_pivot", f"WITH {C}, {TX} SELECT sample, " + ", ".join(f"""coalesce(max(v) FILTER (family = '{x}'), 0) AS "{x}\"""" for x in _REGIONS) + " FROM c JOIN tx ON c.genome = tx.genome WHERE family IS NOT NULL GROUP BY sample")
def family_pivot(spark, d):
    return taxonomy.pivoted(taxonomy.summarize_max(taxonomy.annotate(cells(spark, d), brand_taxa(spark, d)), "family"), _REGIONS)


@register("distinct_taxa", f"WITH {TX} SELECT DISTINCT species FROM tx WHERE species IS NOT NULL UNION SELECT genus FROM tx WHERE genus IS NOT NULL")
def distinct_taxa(spark, d):
    x = brand_taxa(spark, d)
    return x.select("species").filter("species IS NOT NULL").unionByName(x.select(F.col("genus").alias("species")).filter("species IS NOT NULL")).distinct()


def validated(spark: SparkSession, d: str) -> DataFrame:
    """Parts' names, with a qualifier before some, looked up among the names of parts of even size, in capitals."""
    p = t(spark, d, "part")
    names = p.select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "uncultured ").otherwise(""), "p_name").alias("name"))
    reference = p.filter("p_size % 2 = 0").groupBy("p_name").agg(F.min("p_partkey").alias("tax_id")).select(F.when(F.col("tax_id") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), "tax_id", F.lit("species").alias("rank"), F.concat(F.lit("genus:"), "p_name").alias("lineage"))
    return taxonomy.validate(names, reference, clean.clean_species(F.col("name")))


VD = """nm AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'uncultured ' ELSE '' END || p_name AS name FROM part), rf AS (SELECT CASE WHEN min(p_partkey) % 2 = 0 THEN upper(p_name) ELSE p_name END AS matched, p_name FROM part WHERE p_size % 2 = 0 GROUP BY p_name),
vd AS (SELECT name, matched, matched IS NOT NULL AS is_valid, CASE WHEN matched IS NULL THEN 'low' WHEN lower(name) = lower(matched) THEN 'high' ELSE 'medium' END AS confidence FROM nm LEFT JOIN rf ON regexp_replace(name, '^uncultured ', '') = p_name)"""


@register("validation", f"WITH {VD} SELECT name, matched, is_valid, confidence FROM vd")
def validation(spark, d):
    return validated(spark, d).select("name", "matched", "is_valid", "confidence")


@register("confidence_distribution", f"WITH {VD} SELECT confidence, count(*) AS n, count(*) FILTER (is_valid) AS valid FROM vd GROUP BY ALL")
def confidence_distribution(spark, d):
    return taxonomy.confidence_distribution(validated(spark, d))


@register("corrections", f"WITH {VD} SELECT name, 'Manual review required' AS suggestion FROM vd WHERE NOT is_valid")
def corrections(spark, d):
    return taxonomy.corrections(validated(spark, d))


@register("lineage_text", "SELECT n_nationkey, 'family:' || r_name || ';genus:' || n_name AS lineage FROM nation JOIN region ON n_regionkey = r_regionkey")
def lineage_text(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pair = lambda a, b: F.struct(F.lit(a).alias("rank"), F.col(b).alias("name"))
    return n.select("n_nationkey", clean.lineage_text(F.array(pair("family", "r_name"), pair("genus", "n_name"))).alias("lineage"))


# Records of a search: parts of a brand are what a query finds, their type its species.
def records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    acc = lambda m: F.when(k % 5 == m, F.concat(F.lit("GCA_"), k.cast("string")))
    flagged = (F.col("p_size") > 45) & (F.col("p_brand") < "Brand#5")
    return t(spark, d, "part").select(F.col("p_brand").alias("query"), F.col("p_type").alias("species"), k.alias("ordinal"), acc(1).alias("accession"), acc(2).alias("gid"), acc(3).alias("ncbi_accession"), flagged.alias("is_rep"))


RC = "rc AS (SELECT p_brand AS query, p_type AS species, p_partkey AS ordinal, CASE WHEN p_partkey % 5 IN (1, 2, 3) THEN 'GCA_' || p_partkey END AS acc, p_size > 45 AND p_brand < 'Brand#5' AS rep FROM part)"


@register(
    "species_accessions",
    f"""WITH {RC}, k AS (SELECT query, acc FROM rc WHERE acc IS NOT NULL AND rep) SELECT * FROM k UNION ALL SELECT query, acc FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ordinal) AS rn FROM rc) WHERE rn = 1 AND acc IS NOT NULL AND query NOT IN (SELECT query FROM k)""",
)
def species_accessions(spark, d):
    return taxonomy.species_accessions(records(spark, d))


@register(
    "genus_accessions",
    f"""WITH {RC}, k AS (SELECT query, acc FROM (SELECT *, row_number() OVER (PARTITION BY query, species ORDER BY ordinal) AS rn FROM rc) WHERE rn = 1 AND acc IS NOT NULL AND rep) SELECT * FROM k UNION ALL SELECT DISTINCT query, acc FROM rc WHERE acc IS NOT NULL AND query NOT IN (SELECT query FROM k)""",
)
def genus_accessions(spark, d):
    return taxonomy.genus_accessions(records(spark, d))


@register("record_taxonomy", "SELECT p_partkey, 'd__X;g__' || p_type AS lineage, p_name AS organism, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS VARCHAR) END AS tax_id FROM part WHERE p_partkey % 7 <> 0")
def record_taxonomy(spark, d):
    k = F.col("p_partkey")
    key = lambda m, *names: F.get(F.array(*[F.lit(n) for n in names]), (k % m).cast("int"))
    fields = F.map_from_arrays(
        F.array(key(3, "gtdb_taxonomy", "gtdbTaxonomy", "taxonomy"), key(2, "organism_name", "organismName"), key(2, "ncbi_taxid", "taxId")),
        F.array(F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("d__X;g__"), "p_type")), F.col("p_name"), F.when(k % 4 == 0, "").otherwise(F.col("p_size").cast("string"))),
    )
    many = F.to_json(F.array(fields))
    response = F.when(k % 3 == 0, many).otherwise(F.concat(F.lit('{"'), key(2, "rows", "results"), F.lit('": '), many, F.lit("}")))
    found = taxonomy.search_rows(t(spark, d, "part").select("p_partkey", response.alias("response")))
    return taxonomy.record_taxonomy(found).select("p_partkey", "lineage", "organism", "tax_id")
