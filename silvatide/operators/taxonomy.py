"""Taxonomic annotation, filters and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import gtdb_rank, lineage_map, validation_confidence
from .bitmaps import rolled_up

RANKS = ("phylum", "class", "order", "family", "genus", "species")


def parse_gtdb(df: DataFrame, lineage: str = "lineage") -> DataFrame:
    return df.withColumns({r: gtdb_rank(F.col(lineage), r) for r in RANKS})


def annotate(long: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Every cell with its genome's taxonomy; nulls where there is none. The taxonomy holds one row a genome; Spark broadcasts it if it is small."""
    return long.join(taxonomy, "genome", "left")


def annotate_grid(long: DataFrame, taxonomy: DataFrame, genomes: Sequence[str]) -> DataFrame:
    """The same for every cell of the matrix, 0 where it is absent: one row a sample and genome. genomes are the columns of the matrix."""
    held = long.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("genome", "v"))).alias("cells"))  # no more cells than columns
    grid = held.select("sample", "cells", F.explode(F.array(*[F.lit(g) for g in genomes])).alias("genome"))
    return annotate(grid.select("sample", "genome", F.coalesce(F.try_element_at("cells", "genome"), F.lit(0.0)).alias("v")), taxonomy)


def filter_taxa(df: DataFrame, min_containment: float = 0.0, **taxa: str | None) -> DataFrame:
    """Equality without regard to case on each taxon given; a containment bound (inclusive) if above 0. A null taxon never matches."""
    for rank, name in taxa.items():
        if name is not None:
            df = df.filter(F.lower(rank) == name.lower())
    return df.filter(F.col("v") >= min_containment) if min_containment > 0 else df


def summarize_max(annotated: DataFrame, level: str) -> DataFrame:
    """sample, taxon, v: the maximum by taxon; cells without one are dropped."""
    if level not in ("family", "genus", "species"):
        raise ValueError(f"unknown level {level}")
    return annotated.filter(F.col(level).isNotNull()).groupBy("sample", F.col(level).alias("taxon")).agg(F.max("v").alias("v"))


def pivoted(df: DataFrame, taxa: Sequence[str], value: str = "v") -> DataFrame:
    return df.groupBy("sample").pivot("taxon", list(taxa)).max(value).na.fill(0.0)


def lineages(validated: DataFrame) -> DataFrame:
    """name, ranks (map) of valid rows with a lineage; of a name that repeats the last (by `ordinal`) counts."""
    last = Window.partitionBy("name").orderBy(F.desc("ordinal"))
    kept = validated.filter("is_valid AND lineage IS NOT NULL AND lineage <> ''").withColumn("_rn", F.row_number().over(last)).filter("_rn = 1")
    return kept.select("name", lineage_map(F.col("lineage")).alias("ranks"))


def taxonomic_summary(abundance: DataFrame, known: DataFrame, levels: Sequence[str] = ("phylum", "class", "order", "family", "genus"), min_abundance: float = 0.001) -> DataFrame:
    """level, sample, taxon, abundance. Small abundances go first; a feature without a name at a level is Unclassified_<level>. Levels are independent."""
    a = abundance.filter(F.col("abundance") >= min_abundance).join(known, abundance["feature"] == known["name"], "left")
    a = a.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    name = F.try_element_at("ranks", F.col("level"))
    taxon = F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Unclassified_"), F.col("level")))
    return a.groupBy("level", "sample", taxon.alias("taxon")).agg(F.sum("abundance").alias("abundance"))


def explorer_rows(long: DataFrame, taxonomy: DataFrame, metadata: DataFrame, min_containment: float = 0.0) -> DataFrame:
    """Cells above the bound with taxonomy (Unknown where null or empty), location and date ('' where absent)."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown")).alias(c)
    rows = long.filter(F.col("v") > min_containment).join(taxonomy, "genome", "left").join(metadata, "sample", "left")
    return rows.select("sample", "genome", "v", *[known(c) for c in ("family", "genus", "species")], F.coalesce("location", F.lit("")).alias("location"), F.coalesce("date", F.lit("")).alias("date"))


def explorer_header(rows: DataFrame) -> DataFrame:
    named = lambda c: F.count_distinct(F.when(F.col(c) != "Unknown", F.col(c)))
    return rows.agg(F.count_distinct("sample").alias("samples"), F.count_distinct("genome").alias("genomes"), named("family").alias("families"), named("genus").alias("genera"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))


def top_taxa(rows: DataFrame, rank: str, limit: int) -> DataFrame:
    """Taxa by distinct samples."""
    return rows.filter(F.col(rank) != "Unknown").groupBy(F.col(rank).alias("taxon")).agg(F.count_distinct("sample").alias("samples")).orderBy(F.desc("samples"), "taxon").limit(limit)


def hierarchy(rows: DataFrame) -> DataFrame:
    """Distinct samples and mean containment of each (family, genus, species) and of their parents."""
    return rolled_up(rows, ("family", "genus", "species"), "sample", "v").withColumnRenamed("mean", "mean_v")


def validate(names: DataFrame, reference: DataFrame, cleaned: Column) -> DataFrame:
    """Distinct names looked up by their cleaned form in a local reference (name, tax_id, rank, lineage)."""
    n = names.select("name").distinct().withColumn("cleaned", cleaned)
    r = reference.select(F.col("name").alias("matched"), "tax_id", "rank", "lineage", F.lower("name").alias("_key"))
    out = n.join(r, F.lower("cleaned") == F.col("_key"), "left").drop("_key")
    return out.withColumns({"is_valid": F.col("matched").isNotNull(), "confidence": validation_confidence(F.col("name"), F.col("matched"), F.lit(False))})


def confidence_distribution(validated: DataFrame) -> DataFrame:
    return validated.groupBy("confidence").agg(F.count("*").alias("n"), F.count_if("is_valid").alias("valid"))


def corrections(validated: DataFrame) -> DataFrame:
    return validated.filter(~F.col("is_valid")).select("name", F.lit("Manual review required").alias("suggestion"))


def record_taxonomy(records: DataFrame, column: str = "record") -> DataFrame:
    """genome record JSON to lineage, organism and tax_id; the keys have several spellings, and a record without a lineage has no row."""
    spell = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(column, f"$.{n}"), F.lit("")) for n in names])
    out = records.withColumns(
        {"lineage": spell("gtdb_taxonomy", "gtdbTaxonomy", "taxonomy"), "organism": spell("organism_name", "organismName"), "tax_id": spell("ncbi_taxid", "taxId")}
    )
    return out.filter("lineage IS NOT NULL")


def search_rows(responses: DataFrame, column: str = "response") -> DataFrame:
    """Search responses to one row a record: a bare list, or an object with rows or results. Other columns are kept."""
    text = F.col(column)
    listed = F.when(F.trim(text).startswith("["), text).otherwise(F.coalesce(F.get_json_object(text, "$.rows"), F.get_json_object(text, "$.results"), F.lit("[]")))
    return responses.withColumn("record", F.explode(F.from_json(listed, "array<string>"))).drop(column)


def _with_accession(records: DataFrame) -> DataFrame:
    return records.withColumns({"acc": F.coalesce("accession", "gid", "ncbi_accession"), "is_rep": F.coalesce("is_rep", F.lit(False))})


def species_accessions(records: DataFrame, only: bool = True, query: str = "query") -> DataFrame:
    """query, acc for the records (ordinal, accession, gid, ncbi_accession, is_rep) found for each species: all that have an accession and, if
    `only`, are flagged; where none is flagged, the first record's."""
    r = _with_accession(records)
    if not only:
        return r.filter("acc IS NOT NULL").select(query, "acc")
    whole = Window.partitionBy(query)
    kept = F.col("acc").isNotNull() & F.col("is_rep")
    r = r.withColumns({"_kept": kept, "_any": F.max(kept).over(whole), "_first": F.row_number().over(whole.orderBy("ordinal")) == 1})
    return r.filter(F.col("_kept") | (~F.col("_any") & F.col("_first") & F.col("acc").isNotNull())).select(query, "acc")


def genus_accessions(records: DataFrame, only: bool = True, query: str = "query") -> DataFrame:
    """query, acc for the records found for each genus: the first record of each species if it has an accession and, if `only`, is flagged;
    where that leaves none for a genus, all distinct accessions."""
    r = _with_accession(records)
    first = F.row_number().over(Window.partitionBy(query, "species").orderBy("ordinal")) == 1
    kept = F.col("acc").isNotNull() & (F.col("is_rep") if only else F.lit(True))
    r = r.withColumn("_kept", first).withColumn("_kept", F.col("_kept") & kept)
    r = r.withColumn("_any", F.max("_kept").over(Window.partitionBy(query)))
    if not only:
        return r.filter("_kept").select(query, "acc")
    return r.filter(F.col("_kept")).select(query, "acc").unionByName(r.filter(~F.col("_any") & F.col("acc").isNotNull()).select(query, "acc").distinct())


def query_level(family: str | None = None, genus: str | None = None, species: str | None = None) -> str:
    """The level of a summary: that of the most specific filter given, else family."""
    return "species" if species else "genus" if genus else "family"
