"""The registered queries of the engine, bound to the star schema, and their oracles for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import clean
from .operators import bitmaps, containment, diversity, metadata, planning, readqc, statistics, taxonomy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 9) -> Column:
    return F.round(c, digits)


# Containment: customers are samples, brands genomes.
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_quantity") / 50.0).alias("v"))
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("sample"))
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("genome"))
    return containment.build(l.join(p, "l_partkey").join(o, "l_orderkey"))


C = """c AS (SELECT o_custkey AS sample, p_brand AS genome, max(l_quantity / CAST(50 AS DOUBLE)) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
MX = "mx AS (SELECT sample, max(v) AS max_containment FROM c GROUP BY sample)"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("segment"), "c_nationkey", "c_acctbal")
    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return c.join(n, "c_nationkey")


# Abundance: parts bought by customers; brands supplied by nations, grouped by region.
def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("sample"))
    return t(spark, sf_dir, "lineitem").join(o, "l_orderkey").groupBy("sample", F.col("l_partkey").alias("feature")).agg(F.count("*").alias("a"))


AB = "ab AS (SELECT o_custkey AS sample, l_partkey AS feature, count(*) AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("sample"))
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("feature"))
    return t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").join(s, "l_suppkey").join(p, "l_partkey").groupBy("sample", "feature").agg(F.sum("l_quantity").alias("a"))


def nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = t(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("sample")), n.select(F.col("n_nationkey").alias("sample"), F.col("n_regionkey").alias("group"))


BC = """bc AS (SELECT s_nationkey AS sample, p_brand AS feature, sum(l_quantity) AS a FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey GROUP BY ALL),
ids AS (SELECT n_nationkey AS sample, n_regionkey AS grp FROM nation), feats AS (SELECT DISTINCT feature FROM bc),
dense AS (SELECT ids.sample, feats.feature, coalesce(bc.a, 0) AS a FROM ids CROSS JOIN feats LEFT JOIN bc ON bc.sample = ids.sample AND bc.feature = feats.feature)"""
BRAY = """bray AS (SELECT x.sample AS a, y.sample AS b, CASE WHEN sum(x.a + y.a) > 0 THEN sum(abs(x.a - y.a)) / sum(x.a + y.a) ELSE 0 END AS distance
  FROM dense x JOIN dense y ON x.feature = y.feature AND x.sample < y.sample GROUP BY ALL)"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment_max_annotation(spark, sf_dir).orderBy(F.desc("max_containment"), "sample")


@register("containment_build", f"WITH {C} SELECT sample, genome, v FROM c")
def containment_build(spark, d):
    return cells(spark, d)


@register(
    "containment_max_annotation",
    f"""WITH {C}, k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY v DESC, genome) AS rn FROM c)
SELECT sample, v AS max_containment, genome AS max_containment_annotation FROM k WHERE rn = 1""",
)
def containment_max_annotation(spark, d):
    return containment.row_max(cells(spark, d))


BRAND_NAMES = sorted(f"Brand#{k}" for k in range(1, 26))
_GRID = ", ".join(f"""coalesce(max(v) FILTER (genome = '{g}'), 0) AS "{g}\"""" for g in BRAND_NAMES)


@register(
    "containment_wide",
    f"""WITH {C}, k AS (SELECT sample AS s, genome AS max_containment_annotation FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY v DESC, genome) AS rn FROM c) WHERE rn = 1),
w AS (SELECT sample, {_GRID}, max(v) AS max_containment FROM c GROUP BY sample) SELECT w.*, max_containment_annotation FROM w JOIN k ON sample = s""",
)
def containment_wide(spark, d):
    return containment.wide(cells(spark, d), BRAND_NAMES)


@register(
    "threshold_histogram",
    f"""WITH {C}, {MX}, s AS (SELECT i, i * CAST(0.05 AS DOUBLE) AS raw FROM range(0, 21) x(i))
SELECT round(raw, 2) AS threshold, raw, (SELECT count(*) FROM mx WHERE max_containment > raw) AS n FROM s""",
)
def threshold_histogram(spark, d):
    return containment.threshold_histogram(containment.row_max(cells(spark, d)), 0.05)


@register("genome_to_samples", f"WITH {C} SELECT genome, count(DISTINCT sample) AS n, min(sample) AS first_sample FROM c WHERE v > 0 GROUP BY genome")
def genome_to_samples(spark, d):
    lists, samples = containment.genome_to_samples(cells(spark, d))
    per = lists.groupBy("genome").agg(F.sum("n").cast("long").alias("n"), F.min(F.col("block") * bitmaps.BLOCK + F.get("offsets", F.lit(0))).alias("place"))
    return per.join(samples, "place").select("genome", "n", F.col("sample").alias("first_sample"))


@register("posting_lists", f"WITH {C} SELECT genome, sample FROM c WHERE v > 0")
def posting_lists(spark, d):
    """All lists, written in blocks and read back."""
    lists, samples = containment.genome_to_samples(cells(spark, d))
    return bitmaps.listed(lists, samples)


@register("sample_to_genomes", f"WITH {C} SELECT sample, string_agg(genome, ',' ORDER BY genome) AS genomes FROM c WHERE v > 0 GROUP BY sample")
def sample_to_genomes(spark, d):
    return containment.sample_to_genomes(cells(spark, d)).select("sample", F.array_join("genomes", ",").alias("genomes"))


@register("filter_by_containment", f"WITH {C}, {MX} SELECT sample, max_containment FROM mx WHERE max_containment > 0.95")
def filter_by_containment(spark, d):
    return containment.above(cells(spark, d), 0.95).select("sample", "max_containment")


@register("filter_one_genome", f"WITH {C} SELECT sample, v FROM c WHERE genome = 'Brand#23' AND v > 0.5")
def filter_one_genome(spark, d):
    return containment.above(cells(spark, d), 0.5, "Brand#23")


@register("select_samples_inclusive", f"WITH {C} SELECT sample FROM c WHERE genome = 'Brand#23' AND v >= 0.5")
def select_samples_inclusive(spark, d):
    return containment.select_samples(cells(spark, d), "Brand#23", 0.5)


@register("accessions_above", f"WITH {C} SELECT DISTINCT sample AS acc FROM c WHERE v > 0.98")
def accessions_above(spark, d):
    return containment.accessions_above(cells(spark, d).toDF("acc", "genome", "containment"), 0.98)


@register("threshold_to_zero", f"WITH {C} SELECT sample, genome, CASE WHEN v > 0.5 THEN v ELSE 0 END AS v FROM c")
def threshold_to_zero(spark, d):
    return containment.threshold_to_zero(cells(spark, d), 0.5)


@register(
    "cooccurrence",
    f"""WITH {C}, p AS (SELECT sample, genome FROM c WHERE v > 0.5), f AS (SELECT genome FROM p GROUP BY genome HAVING count(*) >= 5)
SELECT x.genome AS genome_a, y.genome AS genome_b, count(b.sample) AS n FROM f x CROSS JOIN f y LEFT JOIN p a ON a.genome = x.genome LEFT JOIN p b ON b.genome = y.genome AND b.sample = a.sample GROUP BY ALL""",
)
def cooccurrence(spark, d):
    return containment.cooccurrence(cells(spark, d), 0.5, 5)


def _distance_sql(expr: str) -> str:
    return f"""WITH {C}, ids AS (SELECT c_custkey AS sample FROM customer), p AS (SELECT sample, genome FROM c WHERE v > 0.9),
s AS (SELECT ids.sample, count(p.genome) AS n FROM ids LEFT JOIN p ON p.sample = ids.sample GROUP BY ids.sample),
i AS (SELECT x.sample AS a, y.sample AS b, count(*) AS i FROM p x JOIN p y ON x.genome = y.genome AND x.sample < y.sample GROUP BY ALL),
k AS (SELECT x.sample AS a, y.sample AS b, x.n AS na, y.n AS nb, coalesce(i.i, 0) AS i FROM s x JOIN s y ON x.sample < y.sample LEFT JOIN i ON i.a = x.sample AND i.b = y.sample)
SELECT a, b, round({expr}, 9) AS distance FROM k"""


def _distance(method: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        samples = t(spark, d, "customer").select(F.col("c_custkey").alias("sample"))
        return containment.presence_distance(cells(spark, d), 0.9, method, samples, 9)

    return query


for _m, _e in (
    ("jaccard", "CASE WHEN na + nb - i = 0 THEN 1.0 ELSE 1.0 - i / CAST(na + nb - i AS DOUBLE) END"),
    ("dice", "CASE WHEN na + nb = 0 THEN 1.0 ELSE 1.0 - 2.0 * i / CAST(na + nb AS DOUBLE) END"),
    ("cosine", "CASE WHEN na = 0 OR nb = 0 THEN 1.0 ELSE 1.0 - i / sqrt(CAST(na AS DOUBLE) * nb) END"),
):
    register(f"distance_{_m}", _distance_sql(_e))(_distance(_m))


@register("rank_plot", f"WITH {C}, {MX} SELECT sample, max_containment, row_number() OVER (ORDER BY max_containment DESC, sample) AS rank FROM mx")
def rank_plot(spark, d):
    return containment.rank_plot(containment.row_max(cells(spark, d)))


@register("top_correlated_genomes", f"WITH {C} SELECT genome, count(*) AS n FROM c WHERE v > 0.9 GROUP BY genome ORDER BY n DESC, genome LIMIT 20")
def top_correlated_genomes(spark, d):
    return containment.top_correlated_genomes(cells(spark, d), 0.9)


@register("report_summary", f"WITH {C}, {MX} SELECT count(*) AS samples, count(*) FILTER (max_containment > 0.98) AS above, (SELECT count(DISTINCT genome) FROM c) AS genomes FROM mx")
def report_summary(spark, d):
    return containment.report_summary(cells(spark, d), 0.98)


@register("displayed_containment", f"WITH {C} SELECT sample, genome, printf('%.3f', least(1, greatest(0, v))) AS shown FROM c")
def displayed_containment(spark, d):
    return cells(spark, d).select("sample", "genome", clean.displayed_containment(F.col("v")).alias("shown"))


@register(
    "metadata_counts",
    f"WITH {C} SELECT genome, c_mktsegment AS value, count(*) AS n FROM c JOIN customer ON sample = c_custkey WHERE v > 0.5 AND c_mktsegment IS NOT NULL GROUP BY ALL",
)
def metadata_counts(spark, d):
    return metadata.counts_by_genome(cells(spark, d), people(spark, d), "segment", 0.5)


_COUNTS = ", ".join(f"""count(*) FILTER (genome = '{g}') AS "{g}\"""" for g in BRAND_NAMES)


@register("metadata_counts_wide", f"WITH {C} SELECT c_mktsegment AS value, {_COUNTS} FROM c JOIN customer ON sample = c_custkey WHERE v > 0.5 AND c_mktsegment IS NOT NULL GROUP BY ALL")
def metadata_counts_wide(spark, d):
    return metadata.counts_wide(cells(spark, d), people(spark, d), "segment", BRAND_NAMES, 0.5)


@register("metadata_column_sums", f"WITH {C} SELECT genome, count(*) AS n FROM c JOIN customer ON sample = c_custkey WHERE v > 0.5 GROUP BY ALL")
def metadata_column_sums(spark, d):
    return metadata.column_sums(metadata.counts_by_genome(cells(spark, d), people(spark, d), "segment", 0.5))


@register(
    "single_genome_top_n",
    f"WITH {C} SELECT n_name AS value, count(*) AS n FROM c JOIN customer ON sample = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE genome = 'Brand#23' AND v > 0.1 GROUP BY ALL ORDER BY n DESC, value LIMIT 10",
)
def single_genome_top_n(spark, d):
    return metadata.single_genome_counts(cells(spark, d), people(spark, d), "Brand#23", "nation", 0.1, 10)


@register(
    "category_crosstab",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P"
FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY ALL""",
)
def category_crosstab(spark, d):
    return metadata.crosstab(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ("F", "O", "P"))


DL = "dl AS (SELECT documents.doc_id, lang, source, quality, toxic FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id)"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", "lang", "source").join(t(spark, d, "labels"), "doc_id", "left")


@register("column_summary", f"WITH {DL} SELECT count(quality) AS non_null, count(*) AS total, round(100.0 * count(quality) / CAST(count(*) AS DOUBLE), 9) AS percent, count(DISTINCT quality) AS distinct_values FROM dl")
def column_summary(spark, d):
    return metadata.column_summary(labelled(spark, d), "quality").select("non_null", "total", r("percent").alias("percent"), F.col("distinct").alias("distinct_values"))


@register("value_counts", "SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL")
def value_counts(spark, d):
    return metadata.value_counts(t(spark, d, "events"), "event_type")


@register(
    "non_null_counts",
    f"WITH {DL} SELECT * FROM (SELECT 'doc_id' AS name, count(doc_id) AS n FROM dl UNION ALL SELECT 'lang', count(lang) FROM dl UNION ALL SELECT 'source', count(source) FROM dl UNION ALL SELECT 'quality', count(quality) FROM dl UNION ALL SELECT 'toxic', count(toxic) FROM dl)",
)
def non_null_counts(spark, d):
    return metadata.non_null_counts(labelled(spark, d))


@register(
    "dedup_keep_first",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedup_keep_first(spark, d):
    return metadata.keep_first(t(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@register("grouped_pivot_top", """SELECT o_orderpriority, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0)::DECIMAL(20, 2)::VARCHAR AS f, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0)::DECIMAL(20, 2)::VARCHAR AS o FROM orders GROUP BY ALL ORDER BY sum(o_totalprice) FILTER (o_orderstatus IN ('F', 'O')) DESC LIMIT 3""")
def grouped_pivot_top(spark, d):
    g = metadata.grouped_pivot(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ("F", "O"), 3)
    return g.select("o_orderpriority", *[F.col(x).cast("decimal(20,2)").cast("string").alias(x.lower()) for x in ("F", "O")])


@register("mean_by_country", "SELECT n_name AS nation, round(avg(c_acctbal), 6) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def mean_by_country(spark, d):
    return metadata.mean_by(people(spark, d), "nation", "c_acctbal").select("nation", r("mean", 6).alias("mean"))


# Diversity
_TOT = "tot AS (SELECT sample, sum(a) AS total FROM ab GROUP BY sample), pr AS (SELECT ab.sample, a, a / CAST(total AS DOUBLE) AS p FROM ab JOIN tot USING (sample))"
_H = "sum(-(p + 1e-12::DOUBLE) * ln(p + 1e-12::DOUBLE)) + ((SELECT count(*) FROM part) - count(*)) * (-1e-12::DOUBLE * ln(1e-12::DOUBLE))"


@register(
    "alpha_diversity",
    f"""WITH {AB}, {_TOT}, m AS (SELECT sample, {_H} AS h, 1 - sum(p * p) AS simpson, count(*) FILTER (a > 0) AS obs, count(*) FILTER (a = 1) AS f1, count(*) FILTER (a = 2) AS f2 FROM pr GROUP BY sample)
SELECT c_custkey AS sample, round(coalesce(h, 0), 9) AS shannon, round(coalesce(simpson, 0), 9) AS simpson,
  round(coalesce(obs + CASE WHEN f2 > 0 THEN f1 * f1 / (2.0::DOUBLE * f2) ELSE f1 * (f1 - 1) / 2.0::DOUBLE END, 0), 9) AS chao1,
  coalesce(obs, 0) AS observed_species, round(CASE WHEN coalesce(obs, 0) <= 1 THEN 0 ELSE h / ln(obs::DOUBLE) END, 9) AS pielou FROM customer LEFT JOIN m ON c_custkey = sample""",
)
def alpha_diversity(spark, d):
    samples = t(spark, d, "customer").select(F.col("c_custkey").alias("sample"))
    n = t(spark, d, "part").count()
    a = diversity.alpha(purchases(spark, d), samples, n)
    return a.select("sample", *[r(m).alias(m) for m in ("shannon", "simpson", "chao1")], "observed_species", r("pielou").alias("pielou"))


_BETA = {
    "bray_curtis": "CASE WHEN sum(x.a + y.a) > 0 THEN sum(abs(x.a - y.a)) / sum(x.a + y.a) ELSE 0 END",
    "jaccard": "CASE WHEN count(*) FILTER (x.a > 0 OR y.a > 0) > 0 THEN 1 - count(*) FILTER (x.a > 0 AND y.a > 0) / CAST(count(*) FILTER (x.a > 0 OR y.a > 0) AS DOUBLE) ELSE 0 END",
    "euclidean": "sqrt(sum((x.a - y.a) * (x.a - y.a)))",
    "manhattan": "sum(abs(x.a - y.a))",
    "cosine": "CASE WHEN sum(x.a * x.a) = 0 OR sum(y.a * y.a) = 0 THEN 1 ELSE 1 - sum(x.a * y.a) / (sqrt(sum(x.a * x.a)) * sqrt(sum(y.a * y.a))) END",
}


def _beta(metric: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return diversity.beta(supplied(spark, d), nations(spark, d)[0], metric).select("a", "b", r("distance", 6).alias("distance"))

    return query


for _m, _e in _BETA.items():
    register(f"beta_{_m}", f"WITH {BC} SELECT x.sample AS a, y.sample AS b, round({_e}, 6) AS distance FROM dense x JOIN dense y ON x.feature = y.feature AND x.sample < y.sample GROUP BY ALL")(_beta(_m))


@register(
    "dispersion",
    f"""WITH {BC}, {BRAY} SELECT g.grp AS "group", round(avg(distance), 9) AS mean, round(median(distance), 9) AS median, round(stddev_pop(distance), 9) AS std
FROM bray JOIN ids g ON g.sample = bray.a JOIN ids h ON h.sample = bray.b WHERE g.grp = h.grp GROUP BY ALL""",
)
def dispersion(spark, d):
    s, g = nations(spark, d)
    out = diversity.dispersion(diversity.beta(supplied(spark, d), s), g)
    return out.select("group", *[r(c).alias(c) for c in ("mean", "median", "std")])


@register(
    "permanova_f",
    f"""WITH {BC}, {BRAY}, sz AS (SELECT grp, count(*) AS n FROM ids GROUP BY grp),
u AS (SELECT g.grp, sum(distance * distance) AS u FROM bray JOIN ids g ON g.sample = a JOIN ids h ON h.sample = b WHERE g.grp = h.grp GROUP BY ALL),
w AS (SELECT sum(u / n - 2 * u / (n * (n - 1.0::DOUBLE))) AS within FROM sz JOIN u USING (grp) WHERE n > 1), k AS (SELECT sum(n)::BIGINT AS n, count(*) AS g FROM sz),
tt AS (SELECT sum(distance * distance) AS u FROM bray), q AS (SELECT u / n - 2 * u / (n * (n - 1.0::DOUBLE)) AS total, within, n, g FROM tt, k, w)
SELECT round(total, 9) AS total, round(within, 9) AS within, round(total - within, 9) AS between_groups, round(((total - within) / (g - 1)) / (within / (n - g)), 6) AS f_statistic, n, g FROM q""",
)
def permanova_f(spark, d):
    s, g = nations(spark, d)
    out = diversity.permanova_f(diversity.beta(supplied(spark, d), s), g)
    return out.select(r("total").alias("total"), r("within").alias("within"), r("between").alias("between_groups"), r("f_statistic", 6).alias("f_statistic"), "n", "g")


@register("permanova_p")
def permanova_p(spark, d):
    s, g = nations(spark, d)
    return diversity.permanova_p(diversity.beta(supplied(spark, d), s), g, 199, 1)


# Taxonomy: regions are families, nations genera, over brands dealt to nations by number.
def brand_taxa(spark: SparkSession, d: str) -> DataFrame:
    b = t(spark, d, "part").select(F.col("p_brand").alias("genome")).distinct().withColumn("k", (F.substring("genome", 7, 2).cast("int") % 25).cast("int"))
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k"), F.col("r_name").alias("family"), F.col("n_name").alias("genus"))
    lineage = F.concat(F.lit("d__X;p__;f__"), "family", F.lit("; g__"), "genus", F.lit(";s__"), "genus", F.lit(" "), "genome")
    return taxonomy.parse_gtdb(b.join(n, "k").select("genome", lineage.alias("lineage")), "lineage").select("genome", "phylum", "family", "genus", "species")


TX = """tx AS (SELECT b.genome, NULL::VARCHAR AS phylum, r_name AS family, n_name AS genus, n_name || ' ' || b.genome AS species
  FROM (SELECT DISTINCT p_brand AS genome FROM part) b JOIN nation ON n_nationkey = CAST(substr(b.genome, 7, 2) AS INTEGER) % 25 JOIN region ON n_regionkey = r_regionkey)"""


@register("taxonomy_annotate", f"WITH {C}, {TX} SELECT c.sample, c.genome, v, phylum, family, genus, species FROM c LEFT JOIN tx ON c.genome = tx.genome")
def taxonomy_annotate(spark, d):
    return taxonomy.annotate(cells(spark, d), brand_taxa(spark, d)).select("sample", "genome", "v", "phylum", "family", "genus", "species")


@register("taxonomy_filter", f"WITH {C}, {TX} SELECT c.sample, c.genome, v FROM c JOIN tx ON c.genome = tx.genome WHERE lower(family) = 'asia' AND v >= 0.9")
def taxonomy_filter(spark, d):
    return taxonomy.filter_taxa(taxonomy.annotate(cells(spark, d), brand_taxa(spark, d)), 0.9, family="AsIa").select("sample", "genome", "v")


@register("taxonomy_summary", f"WITH {C}, {TX} SELECT sample, family AS taxon, max(v) AS v FROM c JOIN tx ON c.genome = tx.genome WHERE family IS NOT NULL GROUP BY ALL")
def taxonomy_summary(spark, d):
    return taxonomy.summarize_max(taxonomy.annotate(cells(spark, d), brand_taxa(spark, d)), "family")


@register(
    "taxonomic_summary_levels",
    f"""WITH {BC}, {TX}, k AS (SELECT sample, feature, a FROM bc WHERE a >= 100), l AS (SELECT k.*, 'family' AS level, family AS taxon FROM k LEFT JOIN tx ON feature = genome UNION ALL SELECT k.*, 'genus', genus FROM k LEFT JOIN tx ON feature = genome UNION ALL SELECT k.*, 'order', NULL FROM k)
SELECT level, sample, coalesce(taxon, 'Unclassified_' || level) AS taxon, round(sum(a), 6) AS abundance FROM l GROUP BY ALL""",
)
def taxonomic_summary_levels(spark, d):
    x = brand_taxa(spark, d).select(F.col("genome").alias("name"), F.concat(F.lit("Family:"), "family", F.lit(";genus:"), "genus").alias("lineage"), F.lit(True).alias("is_valid"), F.lit(0).alias("ordinal"))
    a = supplied(spark, d).select("sample", "feature", F.col("a").alias("abundance"))
    out = taxonomy.taxonomic_summary(a, taxonomy.lineages(x), ("family", "genus", "order"), 100.0)
    return out.select("level", "sample", "taxon", r("abundance", 6).alias("abundance"))


def explorer(spark: SparkSession, d: str) -> DataFrame:
    m = people(spark, d).select("sample", F.col("nation").alias("location"), F.lit(None).cast("string").alias("date"))
    return taxonomy.explorer_rows(cells(spark, d), brand_taxa(spark, d), m, 0.2)


EX = f"""{C}, {TX}, ex AS (SELECT c.sample, c.genome, v, coalesce(family, 'Unknown') AS family, coalesce(genus, 'Unknown') AS genus, coalesce(species, 'Unknown') AS species, coalesce(n_name, '') AS location, '' AS date
  FROM c LEFT JOIN tx ON c.genome = tx.genome LEFT JOIN customer ON c.sample = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE v > 0.2)"""


@register("explorer_rows", f"WITH {EX} SELECT * FROM ex")
def explorer_rows(spark, d):
    return explorer(spark, d)


@register("explorer_header", f"WITH {EX} SELECT count(DISTINCT sample) AS samples, count(DISTINCT genome) AS genomes, count(DISTINCT nullif(family, 'Unknown')) AS families, count(DISTINCT nullif(genus, 'Unknown')) AS genera, min(v) AS min_v, max(v) AS max_v FROM ex")
def explorer_header(spark, d):
    return taxonomy.explorer_header(explorer(spark, d))


@register("explorer_genus_top", f"WITH {EX} SELECT genus AS taxon, count(DISTINCT sample) AS samples FROM ex WHERE genus <> 'Unknown' GROUP BY ALL ORDER BY samples DESC, taxon LIMIT 30")
def explorer_genus_top(spark, d):
    return taxonomy.top_taxa(explorer(spark, d), "genus", 30)


@register("explorer_hierarchy", f"WITH {EX} SELECT family, genus, species, count(DISTINCT sample) AS samples, round(avg(v), 9) AS mean_v FROM ex GROUP BY GROUPING SETS ((family), (family, genus), (family, genus, species))")
def explorer_hierarchy(spark, d):
    return taxonomy.hierarchy(explorer(spark, d)).withColumn("mean_v", r("mean_v"))


# Statistics
BRANDS = """oc AS (SELECT p_brand AS key, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL),
ec AS (SELECT p_brand AS key, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY ALL)"""


def brand_counts(spark: SparkSession, d: str, flag: str) -> DataFrame:
    p = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("key"))
    return t(spark, d, "lineitem").filter(F.col("l_returnflag") == flag).select("l_partkey").join(p, "l_partkey").groupBy("key").agg(F.count("*").alias("n"))


_LC = "lgamma(({n}) + 1.0::DOUBLE) - lgamma(({k}) + 1.0::DOUBLE) - lgamma(({n}) - ({k}) + 1.0::DOUBLE)"
_HG = lambda k, pop, suc, dr: "(" + _LC.format(n=suc, k=k) + ") + (" + _LC.format(n=f"{pop} - {suc}", k=f"{dr} - {k}") + ") - (" + _LC.format(n=pop, k=dr) + ")"


@register(
    "enrichment_fisher_bh",
    f"""WITH {BRANDS}, tot AS (SELECT (SELECT sum(n)::BIGINT FROM oc) AS tob, (SELECT sum(n)::BIGINT FROM ec) AS te),
j AS (SELECT oc.key, oc.n AS observed, ec.n AS expected, tob, te, tob + te AS pop FROM oc JOIN ec USING (key), tot WHERE oc.n >= 5 OR ec.n >= 5),
s AS (SELECT key, observed, expected, pop, tob, observed + expected AS suc, {_HG('observed', 'pop', '(observed + expected)', 'tob')} AS seen, unnest(range(greatest(0, tob + observed + expected - pop), least(tob, observed + expected) + 1)) AS k FROM j),
p AS (SELECT key, any_value(observed) AS observed, any_value(expected) AS expected, least(1, sum(CASE WHEN {_HG('k', 'pop', 'suc', 'tob')} <= seen + 1e-7 THEN exp({_HG('k', 'pop', 'suc', 'tob')}) ELSE 0 END)) AS p FROM s GROUP BY key),
q AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p, key) AS rk FROM p)
SELECT key, observed, expected, round(observed / CAST(expected AS DOUBLE), 9) AS fold_enrichment, round(p, 7) AS p_value,
  round(least(1, min(p * n / rk) OVER (ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 7) AS adjusted_p_value FROM q""",
)
def enrichment_fisher_bh(spark, d):
    out = statistics.enrichment(brand_counts(spark, d, "R"), brand_counts(spark, d, "A"))
    return out.select("key", "observed", "expected", r("fold_enrichment").alias("fold_enrichment"), r("p_value", 7).alias("p_value"), r("adjusted_p_value", 7).alias("adjusted_p_value"))


@register(
    "hypergeometric_tail",
    f"""WITH {BRANDS}, j AS (SELECT oc.key, oc.n AS k, (SELECT sum(n)::BIGINT FROM oc) AS draws, oc.n + ec.n AS suc, (SELECT sum(n)::BIGINT FROM oc) + (SELECT sum(n)::BIGINT FROM ec) AS pop FROM oc JOIN ec USING (key)),
s AS (SELECT key, draws, suc, pop, unnest(range(k, least(suc, draws) + 1)) AS i FROM j), p AS (SELECT key, least(1, sum(exp({_HG('i', 'pop', 'suc', 'draws')}))) AS p FROM s GROUP BY key)
SELECT key, k, round(k / (draws * suc / CAST(pop AS DOUBLE)), 9) AS fold_enrichment, round(p, 7) AS p_value FROM j JOIN p USING (key)""",
)
def hypergeometric_tail(spark, d):
    o, e = brand_counts(spark, d, "R"), brand_counts(spark, d, "A").withColumnRenamed("n", "e")
    tot = o.agg(F.sum("n").alias("draws")).crossJoin(e.agg(F.sum("e").alias("te")))
    j = o.join(e, "key").crossJoin(F.broadcast(tot)).select("key", F.col("n").alias("k"), "draws", (F.col("n") + F.col("e")).alias("suc"), (F.col("draws") + F.col("te")).alias("pop"))
    return statistics.hypergeometric(j, "k", "draws", "suc", "pop").select("key", "k", r("fold_enrichment").alias("fold_enrichment"), r("p_value", 7).alias("p_value"))


@register("group_statistics", "SELECT o_orderpriority AS \"group\", 'o_totalprice' AS metric, count(*) AS n, round(avg(o_totalprice), 5) AS mean, round(stddev_samp(o_totalprice), 5) AS std, round(median(o_totalprice), 5) AS median, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY ALL")
def group_statistics(spark, d):
    g = statistics.group_statistics(t(spark, d, "orders"), "o_orderpriority", ["o_totalprice"])
    return g.select("group", "metric", "n", *[r(c, 5).alias(c) for c in ("mean", "std", "median")], "min", "max")


@register(
    "group_anova",
    """WITH g AS (SELECT o_orderpriority AS k, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) * (count(*) - 1) AS ss FROM orders GROUP BY ALL), a AS (SELECT count(*) AS g, sum(n)::BIGINT AS n, sum(ss) AS w, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b FROM g)
SELECT 'o_totalprice' AS metric, 'ANOVA' AS test, g AS groups, round((b / (g - 1)) / (w / (n - g)), 5) AS statistic FROM a""",
)
def group_anova(spark, d):
    return statistics.group_tests(t(spark, d, "orders"), "o_orderpriority", ["o_totalprice"]).select("metric", "test", "groups", r("statistic", 5).alias("statistic"))


@register(
    "group_t_test",
    """WITH g AS (SELECT l_linestatus AS k, 'l_quantity' AS metric, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) * (count(*) - 1) AS ss FROM lineitem GROUP BY ALL UNION ALL SELECT l_linestatus, 'l_extendedprice', count(*), avg(l_extendedprice), var_samp(l_extendedprice) * (count(*) - 1) FROM lineitem GROUP BY ALL),
a AS (SELECT metric, count(*) AS g, sum(n)::BIGINT AS n, sum(ss) AS w, min_by(m, k) - max_by(m, k) AS gap, sum(1.0::DOUBLE / n) AS inv FROM g GROUP BY metric)
SELECT metric, 't-test' AS test, g AS groups, round(gap / sqrt(w / (n - 2) * inv), 5) AS statistic FROM a""",
)
def group_t_test(spark, d):
    return statistics.group_tests(t(spark, d, "lineitem"), "l_linestatus", ["l_quantity", "l_extendedprice"]).select("metric", "test", "groups", r("statistic", 5).alias("statistic"))


@register("group_tests_p")
def group_tests_p(spark, d):
    two = t(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "O"))
    return statistics.group_tests(two, "o_orderstatus", ["o_totalprice"])


@register(
    "iqr_outliers",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, 'value' AS metric, value AS x FROM events, q WHERE value < a - 1.5::DOUBLE * (b - a) OR value > b + 1.5::DOUBLE * (b - a)""",
)
def iqr_outliers(spark, d):
    return statistics.iqr_outliers(t(spark, d, "events"), "event_id", ["value"])


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 7) AS r FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i:]))
def correlation_matrix(spark, d):
    return statistics.correlation(t(spark, d, "lineitem"), _NUM).withColumn("r", r("r", 7))


@register(
    "correlation_spearman",
    """WITH k AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0::DOUBLE AS y FROM part) SELECT round(corr(x, y), 7) AS r FROM k""",
)
def correlation_spearman(spark, d):
    c = statistics.correlation(t(spark, d, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"], "spearman")
    return c.filter("a <> b").select(r("r", 7).alias("r"))


# Reads: documents by language.
@register(
    "n50",
    """WITH k AS (SELECT lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(n_chars) OVER (PARTITION BY lang) AS tot FROM documents) SELECT lang AS key, max(n_chars) FILTER (cum >= tot / 2.0::DOUBLE) AS n50 FROM k GROUP BY lang""",
)
def n50(spark, d):
    return readqc.n50(t(spark, d, "documents"), "lang", "n_chars")


@register(
    "read_statistics",
    """SELECT lang AS key, count(*) AS total_reads, sum(length(text))::BIGINT AS total_bases, round(avg(length(text)), 6) AS mean_length, min(length(text))::BIGINT AS min_length, max(length(text))::BIGINT AS max_length,
round(100.0::DOUBLE * sum(length(regexp_replace(text, '[^GC]', '', 'g'))) / sum(length(text)), 6) AS gc_percent FROM documents GROUP BY ALL""",
)
def read_statistics(spark, d):
    s = readqc.read_statistics(t(spark, d, "documents"), "lang", "text", None)
    return s.select("key", "total_reads", "total_bases", r("mean_length", 6).alias("mean_length"), F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"), r("gc_percent", 6).alias("gc_percent"))


@register(
    "length_distribution",
    """WITH b AS (SELECT lang, CASE WHEN n_chars <= 50 THEN '1-50' WHEN n_chars <= 100 THEN '51-100' WHEN n_chars <= 150 THEN '101-150' WHEN n_chars <= 250 THEN '151-250' WHEN n_chars <= 500 THEN '251-500' WHEN n_chars <= 1000 THEN '501-1000' ELSE '>1000' END AS bucket FROM documents),
k AS (SELECT unnest(['1-50', '51-100', '101-150', '151-250', '251-500', '501-1000', '>1000']) AS bucket) SELECT l.lang AS key, k.bucket, count(b.lang) AS n FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN k LEFT JOIN b ON b.lang = l.lang AND b.bucket = k.bucket GROUP BY ALL""",
)
def length_distribution(spark, d):
    return readqc.length_distribution(t(spark, d, "documents"), "lang", F.col("n_chars"))


@register(
    "kmer_diversity",
    """WITH l AS (SELECT doc_id, string_split(text, '') AS c, length(text) AS n FROM documents) SELECT doc_id, round(CASE WHEN n >= 3 THEN len(list_distinct(list_transform(range(1, n - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) / CAST(n - 2 AS DOUBLE) ELSE 0 END, 9) AS diversity FROM l""",
)
def kmer_diversity(spark, d):
    return t(spark, d, "documents").select("doc_id", r(F.coalesce(clean.kmer_diversity(F.col("text")), F.lit(0.0))).alias("diversity"))


@register("homopolymer_rate")  # its pattern refers back to a group, which the oracle's engine cannot
def homopolymer_rate(spark, d):
    return t(spark, d, "documents").select("doc_id", r(clean.homopolymer_rate(F.col("text"))).alias("rate"))


@register("duplication_rate", "WITH g AS (SELECT lang, text, count(*) AS n FROM documents GROUP BY ALL) SELECT lang AS key, sum(n)::BIGINT AS total, count(*) AS distinct_reads, round(1 - count(*) / CAST(sum(n) AS DOUBLE), 9) AS duplication_rate, round(max(n) / CAST(sum(n) AS DOUBLE), 9) AS over_represented FROM g GROUP BY ALL")
def duplication_rate(spark, d):
    return readqc.over_represented(t(spark, d, "documents"), "lang", "text").select("key", "total", F.col("distinct").alias("distinct_reads"), r("duplication_rate").alias("duplication_rate"), r("over_represented").alias("over_represented"))


@register("adapter_contamination", "SELECT lang AS key, round(avg(CASE WHEN contains(text, 'idiot') OR contains(text, 'License') THEN 1.0 ELSE 0.0 END), 9) AS adapter FROM documents GROUP BY ALL")
def adapter_contamination(spark, d):
    return t(spark, d, "documents").groupBy(F.col("lang").alias("key")).agg(r(F.avg(clean.has_adapter(F.col("text"), ("idiot", "License")).cast("double"))).alias("adapter"))


@register(
    "quality_grade",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS a, l_tax * 10 AS c FROM lineitem), s AS (SELECT *, CASE WHEN q >= 30 THEN 40 WHEN q >= 20 THEN 20 ELSE 0 END + CASE WHEN a < 0.01::DOUBLE THEN 30 WHEN a < 0.05::DOUBLE THEN 10 ELSE 0 END + CASE WHEN c > 0.7::DOUBLE THEN 30 WHEN c > 0.4::DOUBLE THEN 15 ELSE 0 END AS p FROM x)
SELECT CASE WHEN p >= 80 THEN 'excellent' WHEN p >= 60 THEN 'good' WHEN p >= 40 THEN 'fair' ELSE 'poor' END AS grade, count(*) AS n FROM s GROUP BY ALL""",
)
def quality_grade(spark, d):
    g = clean.quality_grade(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax") * 10)
    return t(spark, d, "lineitem").select(g.alias("grade")).groupBy("grade").agg(F.count("*").alias("n"))


@register(
    "anomaly_flags",
    """WITH x AS (SELECT p_partkey, p_size / 100.0::DOUBLE AS c, p_size / 200.0::DOUBLE AS a, p_size / 50.0::DOUBLE AS gc, p_size / 400.0::DOUBLE AS n FROM part),
f AS (SELECT p_partkey, list_filter([CASE WHEN c < 0.1::DOUBLE THEN 'low_complexity' END, CASE WHEN a > 0.1::DOUBLE THEN 'high_contamination' END, CASE WHEN gc < 0.2::DOUBLE OR gc > 0.8::DOUBLE THEN 'unusual_gc' END, CASE WHEN n > 0.05::DOUBLE THEN 'high_n_content' END], lambda v: v IS NOT NULL) AS fl FROM x)
SELECT p_partkey, array_to_string(fl, ',') AS flags, least(10, CASE WHEN list_contains(fl, 'low_complexity') THEN 3 ELSE 0 END + CASE WHEN list_contains(fl, 'high_contamination') THEN 4 ELSE 0 END + CASE WHEN list_contains(fl, 'unusual_gc') THEN 2 ELSE 0 END + CASE WHEN list_contains(fl, 'high_n_content') THEN 3 ELSE 0 END) / 10.0::DOUBLE AS severity FROM f""",
)
def anomaly_flags(spark, d):
    s = F.col("p_size")
    f = clean.anomaly_flags(s / 100.0, s / 200.0, s / 50.0, s / 400.0, F.lit("good"))
    return t(spark, d, "part").select("p_partkey", F.array_join(f, ",").alias("flags"), clean.anomaly_severity(f).alias("severity"))


# What the instruments and platforms of the archive look like, dealt to the parts.
PLATFORMS = ("ILLUMINA", "OXFORD_NANOPORE", "PACBIO_SMRT", "LS454", None, "BGISEQ", "Ion Torrent")
INSTRUMENTS = ("Illumina HiSeq 2500", "MinION", "Sequel II", "PacBio RS II", "454 GS FLX", None, "GridION", "DNBSEQ-G400", "PromethION", "NextSeq 500")
STRATEGIES = ("WGS", "Nanopore WGS", "PacBio HiFi", "ILLUMINA AMPLICON", None)


def _dealt(values, key: str = "p_partkey", by: int = 1) -> Column:
    """The value at floor(key / by) modulo their number."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.floor(F.col(key) / by) % len(values)).cast("int"))


def _dealt_sql(values, key: str = "p_partkey", by: int = 1) -> str:
    listed = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[CAST({key} // {by} % {len(values)} AS BIGINT) + 1]"


def runs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", _dealt(PLATFORMS).alias("platform"), _dealt(INSTRUMENTS, by=7).alias("instrument"), _dealt(STRATEGIES, by=3).alias("strategy"))


RUNS = f"""runs AS (SELECT p_partkey, {_dealt_sql(PLATFORMS)} AS platform, {_dealt_sql(INSTRUMENTS, by=7)} AS instrument, {_dealt_sql(STRATEGIES, by=3)} AS strategy FROM part),
tech AS (SELECT p_partkey, platform, instrument, CASE WHEN lower(platform) = 'illumina' OR contains(lower(instrument), 'illumina') THEN 'illumina'
  WHEN lower(platform) = 'oxford_nanopore' OR regexp_matches(lower(instrument), 'nanopore|minion|gridion') THEN 'nanopore'
  WHEN lower(platform) = 'pacbio_smrt' OR regexp_matches(lower(instrument), 'pacbio|sequel|rs ii') THEN 'pacbio'
  WHEN contains(lower(strategy), 'nanopore') THEN 'nanopore' WHEN contains(lower(strategy), 'pacbio') THEN 'pacbio' ELSE 'unknown' END AS technology FROM runs)"""


@register(
    "technology_detect",
    f"""WITH {RUNS} SELECT p_partkey, technology, round(least(1, 0.5::DOUBLE + CASE WHEN platform <> '' THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN instrument <> '' THEN 0.2::DOUBLE ELSE 0 END), 9) AS confidence FROM tech""",
)
def technology_detect(spark, d):
    tech = clean.technology(F.col("platform"), F.col("instrument"), F.col("strategy"))
    return runs(spark, d).select("p_partkey", tech.alias("technology"), r(clean.technology_confidence(F.col("platform"), F.col("instrument"))).alias("confidence"))


@register("species_clean", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('Uncultured ' || p_name || ' strain K' || p_size || ' [x] (y)', '(?i)^(candidate|unclassified|uncultured)\s+', ''), '(?i)\s+(sp\.|strain|isolate|clone)(\s+.*|$)', ''), '\[.*?\]|\(.*?\)', '', 'g'), '\s+', ' ', 'g')) AS name FROM part")
def species_clean(spark, d):
    raw = F.concat(F.lit("Uncultured "), "p_name", F.lit(" strain K"), F.col("p_size").cast("string"), F.lit(" [x] (y)"))
    return t(spark, d, "part").select("p_partkey", clean.clean_species(raw).alias("name"))


LOCATIONS = ("USA: Texas", "Germany", "not collected", "Brazil:Amazon: north", ":x", None, "", "Viet Nam: Hanoi")


@register("country_split", f"""SELECT p_partkey, CASE WHEN contains(l, ':') THEN string_split(l, ':')[1] ELSE l END AS country FROM (SELECT p_partkey, {_dealt_sql(LOCATIONS)} AS l FROM part)""")
def country_split(spark, d):
    return t(spark, d, "part").select("p_partkey", clean.country(_dealt(LOCATIONS)).alias("country"))


#: Texts as they stand in metadata, with what they say.
PLACES = (
    ("40.7128, -74.0060", 40.7128, -74.006), ("40.7128N, 74.0060W", 40.7128, -74.006), ("[35.5, 100]", 35.5, 100.0), ("12.5 S 45.25 E", None, None), ("-33.9 18.4", -33.9, 18.4),
    ("not collected", None, None), ("1,2,3", None, None), (None, None, None), ("35.7N 100.2W", 35.7, -100.2), ("", None, None), ("10S,20E", -10.0, 20.0),
)
_WHERE = ", ".join(f"({k}, {a if a is not None else 'NULL'}::DOUBLE, {b if b is not None else 'NULL'}::DOUBLE)" for k, (_, a, b) in enumerate(PLACES))


@register("coordinates_parse", f"SELECT c_custkey, lat, lon FROM customer JOIN (VALUES {_WHERE}) w(k, lat, lon) ON c_custkey % {len(PLACES)} = k")
def coordinates_parse(spark, d):
    c = clean.coordinates(_dealt([p[0] for p in PLACES], "c_custkey"))
    return t(spark, d, "customer").select("c_custkey", c["lat"].alias("lat"), c["lon"].alias("lon"))


@register("containment_values", "SELECT l_orderkey, l_linenumber, l_quantity / 25.0::DOUBLE AS v FROM lineitem WHERE l_quantity / 25.0::DOUBLE <= 1")
def containment_values(spark, d):
    v = clean.containment_value((F.col("l_quantity") / 25.0).cast("string"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v")).filter("v IS NOT NULL")


ACCESSIONS = ("SRR", "ERR", "DRR", "XRR", "srr", "SRX", "GCA_", "")
SUFFIXES = ("", "x", ".1", " ")


@register(
    "valid_accessions",
    f"""SELECT p_partkey, coalesce(regexp_full_match(a, '(SRR|ERR|DRR)[0-9]+'), false) AS run_ok, coalesce(regexp_full_match(g, 'GC[AF]_[0-9]{{9}}\\.[0-9]+'), false) AS genome_ok
FROM (SELECT p_partkey, {_dealt_sql(ACCESSIONS)} || p_partkey || {_dealt_sql(SUFFIXES, by=8)} AS a, 'GC' || {_dealt_sql(("A", "F", "X"))} || '_' || lpad(CAST(p_partkey AS VARCHAR), CAST(7 + p_partkey % 4 AS INTEGER), '0') || {_dealt_sql(SUFFIXES, by=3)} AS g FROM part)""",
)
def valid_accessions(spark, d):
    k = F.col("p_partkey").cast("string")
    acc = F.concat(_dealt(ACCESSIONS), k, _dealt(SUFFIXES, by=8))
    genome = F.concat(F.lit("GC"), _dealt(("A", "F", "X")), F.lit("_"), F.lpad(k, (F.lit(7) + F.col("p_partkey") % 4).cast("int"), F.lit("0")), _dealt(SUFFIXES, by=3))
    return t(spark, d, "part").select("p_partkey", clean.valid_run(acc).alias("run_ok"), clean.valid_genome(genome).alias("genome_ok"))


# Planning: orders are work items.
@register(
    "download_plan",
    """SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50) THEN 'blacklisted' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'present' ELSE 'download' END AS status FROM orders""",
)
def download_plan(spark, d):
    l = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return planning.plan(t(spark, d, "orders").select("o_orderkey"), l.filter("l_quantity >= 50"), l.filter("l_returnflag = 'R'"), "o_orderkey")


@register("download_order", "SELECT o_orderkey, CASE WHEN s IS NULL OR s <= 0 THEN 2 WHEN s < 100 THEN 0 WHEN s < 1000 THEN 1 ELSE 3 END AS bucket FROM (SELECT o_orderkey, o_totalprice / 100.0::DOUBLE AS s FROM orders)")
def download_order(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 100.0).alias("size"))
    return planning.download_order(o, "size", "o_orderkey").select("o_orderkey", "bucket")


@register(
    "download_times",
    """SELECT o_orderkey, round(o_totalprice / 1000.0::DOUBLE * 1024 * 8 / (100 * 4 * 0.8::DOUBLE) / 3600, 9) AS hours,
round(o_totalprice / (8.0::DOUBLE * CASE WHEN k > 1 THEN k * (1 - 0.1::DOUBLE * (k - 1)) ELSE 1.0::DOUBLE END), 9) AS minutes FROM (SELECT *, least(o_custkey % 7, 4) AS k FROM orders)""",
)
def download_times(spark, d):
    minutes = clean.planned_transfer_minutes(F.col("o_totalprice"), F.col("o_custkey") % 7)
    return t(spark, d, "orders").select("o_orderkey", r(clean.transfer_hours(F.col("o_totalprice") / 1000.0)).alias("hours"), r(minutes).alias("minutes"))


@register("download_preview", "SELECT o_orderpriority AS technology, count(*) AS n, round(sum(o_totalprice) / 1024.0::DOUBLE, 4) AS gb FROM orders GROUP BY ALL")
def download_preview(spark, d):
    return planning.preview(t(spark, d, "orders"), "o_totalprice", "o_orderpriority").select(F.col("o_orderpriority").alias("technology"), "n", r("gb", 4).alias("gb"))


@register("plan_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def plan_missing(spark, d):
    return metadata.missing(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id")


@register("plan_present", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def plan_present(spark, d):
    return metadata.present(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id")


@register("inventory", "SELECT lang AS kind, count(DISTINCT documents.doc_id) FILTER (labels.doc_id IS NOT NULL) AS present, (SELECT count(DISTINCT doc_id) FROM labels) - count(DISTINCT documents.doc_id) FILTER (labels.doc_id IS NOT NULL) AS missing FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id GROUP BY ALL")
def inventory(spark, d):
    return planning.inventory(t(spark, d, "documents").select(F.col("lang").alias("kind"), "doc_id"), t(spark, d, "labels"), "doc_id")


@register("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return t(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_SETS = {"union": ("unionByName", "UNION"), "intersect": ("intersect", "INTERSECT"), "except": ("subtract", "EXCEPT")}


def _sets(method: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        c = t(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
        s = t(spark, d, "supplier").filter("s_acctbal < 4000").select(F.col("s_nationkey").alias("nation"))
        return getattr(c, method)(s).distinct()

    return query


for _n, (_f, _s) in _SETS.items():
    register(f"set_{_n}", f"SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 {_s} SELECT s_nationkey FROM supplier WHERE s_acctbal < 4000")(_sets(_f))


@register("ordered_distinct", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def ordered_distinct(spark, d):
    return metadata.ordered_distinct(t(spark, d, "orders"), "o_custkey", "o_orderkey")


from . import catalog_files, catalog_reads  # noqa: E402, F401 - they register their queries here
