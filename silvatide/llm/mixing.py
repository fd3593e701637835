"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws u in (0, 1) from a hash of its id. Its key u ** (1 / w) for
its quality weight w falls as its time -ln(u) / w rises: sorted by rising time
within its source, any prefix is a weighted sample without replacement. A source
that must give E whole epochs and a remainder takes every document E times and
then the prefix of the order whose words fill the remainder.

Weights are learned from the labels: the share of good documents among labelled
ones of like length and word length.

The order is never sorted as a whole: times are cut into ranges, words are summed
by (source, range) before the shuffle, and only inside a range are documents
sorted. Ranges are equal steps of the time's logarithm. The times of one weight
are exponential, so their logarithms have a density of 1/e at most, whatever the
weight; hence a step of 1 / STEPS holds no more than 1 / (e * STEPS) of a source's
documents, whatever mixture of weights they have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import only, table, written

#: The weights that the contract states, repeated over the sources in code point order.
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
#: Ranges for each factor of e of the time: one holds 0.04 % of its source at most, up to chance.
STEPS = 1024


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_cell(chars: Column, size: Column) -> Column:
    """A number for documents of like length and mean word length: binary digits of the number of words, and code points a word (up to 15)."""
    return (F.length(F.bin(size)) * 16 + F.least(F.floor(chars / F.greatest(size, F.lit(1))), F.lit(15))).cast("int")


def quality_weights(sized: DataFrame, labels: DataFrame) -> DataFrame:
    """cell, w of every cell that a labelled document lies in: (good + 1) / (labelled + 2). There are a few hundred cells. sized: doc_id, chars, size."""
    known = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", "quality")
    cells = sized.join(known, "doc_id").groupBy(quality_cell(F.col("chars"), F.col("size")).alias("cell"))
    return cells.agg(((F.sum("quality") + 1.0) / (F.count("*") + 2.0)).alias("w"))


#: The weight of a document like none that is labelled: that of a cell without labels.
UNKNOWN = 0.5


def uniform(id_col: Column) -> Column:
    """In (0, 1), from the first 48 bits of the id's MD5; a null id counts as an empty one."""
    return (F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes: source, source_size, a row for each source (null too). Adds target.

    Sources in code point order (null last) get the repeating weights. All share the sum of sizes by weight; a source
    that would exceed cap times its own size stops there and the rest share the excess, until none is above. That fixed
    point is reached by filling sources in rising order of size / weight: the first j of them are capped, for the least
    j whose successor stays below its cap.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    at = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at + 1).cast("int"))
    full = Window.partitionBy()
    fill = Window.orderBy("ratio", F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("weight", w).withColumn("limit", F.col("source_size") * cap).withColumn("ratio", F.col("limit") / F.col("weight"))
    s = s.withColumn("total", F.sum("source_size").over(full)).withColumn("all_weight", F.sum("weight").over(full))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # level: what one unit of weight gets if all before are capped; the right one is the first that its own source can hold.
    s = s.withColumn("share", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(full)["level"])
    share = F.coalesce(F.col("share"), F.lit(0.0))
    return s.select("source", "source_size", F.when(share >= F.col("ratio"), F.col("limit").cast("double")).otherwise(share * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, labels: DataFrame | None = None, weights: Sequence[float] = WEIGHTS, cap: int = CAP, steps: int = STEPS, quality: Column | None = None, id_col: str = "doc_id", key: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_copies for every document, and `key` (a column over `docs`) if given.

    taken is n_copies * size. A document of the fractional part is taken whole if the middle of its words lies within
    the budget, so that a source misses its target by at most half of one document. Null text has size 0 and is never
    taken; a null source is a source of its own, last in order; documents with equal ids have equal draws and are taken
    in order of time, then size, then all alike; repeated rows are counted and taken one by one. An empty table gives no rows.
    Weights come from `quality` (a column over `docs`), else from `labels` (doc_id, quality; rows that repeat an id all count), else all are equal.
    The texts are read once: what is needed of them is written.
    """
    spark = docs.sparkSession
    size = n_words(F.col("text"))
    given = quality if quality is not None else F.lit(1.0) if labels is None else F.lit(None)
    slim = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col("source"), size.alias("size"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), given.cast("double").alias("w"), (F.lit(None).cast("string") if key is None else key).alias("key")
    )
    d = written(spark, slim, "sizes")
    if quality is None and labels is not None:
        known = quality_weights(d, only(labels, "doc_id", "quality"))
        d = d.drop("w").withColumn("cell", quality_cell(F.col("chars"), F.col("size"))).join(F.broadcast(known), "cell", "left")  # a row a cell
    time = -F.ln(uniform(F.col("doc_id"))) / F.greatest(F.coalesce("w", F.lit(UNKNOWN)), F.lit(1e-6))
    d = d.select("doc_id", "source", "size", "key", time.alias("time")).withColumn("range", F.floor(F.ln("time") * steps).cast("int"))
    by_range = d.groupBy("source", "range").agg(F.sum("size").alias("words"))
    sizes = by_range.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, weights, cap)
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
    starts = starts.join(goal, starts["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    within = Window.partitionBy("source", "range").orderBy("time", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(starts, d["source"].eqNullSafe(starts["source"]) & (d["range"] == starts["range"])).drop(starts["source"]).drop(starts["range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    more = F.when((F.col("size") > 0) & (F.col("ahead") + F.col("inside") + F.col("size") / 2.0 <= rest), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.least(epochs + more, F.lit(cap))).otherwise(F.lit(0)).cast("long")
    out = d.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("n_copies"), "key")
    return out.drop("key") if key is None else out


def mixed(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The mix itself: every document, with all its columns, as often as it is taken. Rows that agree in id, source and text are taken
    alike, so repeated rows are each taken as often as the one of them that is taken most; null ids and sources are values like others, null and empty
    texts are never taken, and an empty table gives no rows."""
    own = {c: c if c in ("doc_id", "source", "text") else f"_own{k}" for k, c in enumerate(docs.columns)}
    safe = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    part = lambda c: F.coalesce(F.sha2(F.col(c).cast("string").cast("binary"), 256), F.lit("-"))
    key = F.concat_ws("|", part("doc_id"), part("source"), part("text"))
    copies = mix_sources(safe, labels, key=key).groupBy("key").agg(F.max("n_copies").cast("int").alias("_n")).filter("_n > 0")
    out = safe.withColumn("_key", key).join(copies, F.col("_key") == F.col("key"))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return out.select(*[F.col(f"`{a}`").alias(c) for c, a in own.items()])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; what mix_sources says of nulls, ties, repeated rows and empty tables holds."""
    return mix_sources(only(table(spark, sf_dir, "documents"), "doc_id", "source", "text"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, length(text) AS chars FROM documents),
q AS (
  SELECT doc_id, source, size, length(bin(size)) * 16 + least(coalesce(chars, 0) // greatest(size, 1), 15) AS cell,
         (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE AS u FROM d),
z AS (SELECT cell, (sum(quality) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE) AS w FROM q JOIN labels ON q.doc_id = labels.doc_id WHERE quality IN (0, 1) GROUP BY cell),
k AS (SELECT q.*, -ln(u) / greatest(coalesce(w, 0.5::DOUBLE), 1e-6::DOUBLE) AS time FROM q LEFT JOIN z ON q.cell = z.cell),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
r AS (SELECT *, 3 * source_size AS lim, 3 * source_size / weight AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight FROM w),
l AS (SELECT *, (total - coalesce(sum(lim) OVER b, 0)) / (all_weight - coalesce(sum(weight) OVER b, 0)) AS level FROM r
      WINDOW b AS (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1) AS share FROM l),
g AS (SELECT source, source_size, CASE WHEN share >= ratio THEN lim::DOUBLE ELSE coalesce(share, 0) * weight END AS target FROM m),
o AS (SELECT k.doc_id, k.size, g.source_size, g.target,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.time, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
             CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CASE WHEN size > 0 THEN least(epochs + CASE WHEN ahead + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END, 3) ELSE 0 END::BIGINT AS n_copies FROM o)
SELECT doc_id, size, source_size, target, n_copies * size AS taken, n_copies FROM c
"""
