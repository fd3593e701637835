"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import delete, written


def _large_star(e: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node among itself and its neighbours."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    others = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v")))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, component (its smallest node) for every node with a link that is not the smallest itself.

    Minima are combined before shuffling and the joins are plain equi-joins that Spark can split, so a node with very many
    links is no bottleneck; nothing is collected but two numbers a round.
    """
    e = written(spark, links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        nxt = written(spark, _small_star(_large_star(e).distinct()).distinct(), "links")
        delete(spark, e)
        e = nxt
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
