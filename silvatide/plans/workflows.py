"""Whole workflows from files to files, composed of the operators."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import containment, diversity, metadata, planning, readqc, statistics, taxonomy
from ..scratch import written
from ..sources import delimited, fastq, sinks, xml


def parse_containment(spark: SparkSession, folder: str, output: str, summary: str, step: float = 0.1) -> list[tuple[str, str]]:
    """Per-genome files to the wide table and the threshold table. Returns the files left out, with reasons."""
    rows, bad = delimited.containment_folder(spark, folder)
    long = containment.build(rows)
    genomes = [r.genome for r in long.select("genome").distinct().orderBy("genome").collect()]  # the columns of the result
    sinks.wide_table(containment.wide(long, genomes), output)
    sinks.threshold_table(containment.threshold_histogram(containment.row_max(long), step), summary)
    return bad


def extract_metadata(spark: SparkSession, folder: str, output: str) -> DataFrame:
    """The metadata of all containment files, written as a table."""
    out = delimited.containment_metadata(spark, delimited.list_files(spark, folder, "*.csv"))
    sinks.delimited(out, output)
    return out


def count_metadata(spark: SparkSession, table: str, metadata_table: str, column: str, threshold: float, output: str) -> None:
    """Metadata counts of each genome's samples, from the files of the steps before."""
    wide = delimited.matrix(spark, table)
    long = containment.to_long(wide)
    genomes = containment.genome_columns(wide, ("sample", "max_containment", "max_containment_annotation"))
    meta = delimited.csv(spark, metadata_table, "\t")
    counts = metadata.counts_by_genome(long, meta, column, threshold, meta.columns[0])
    sinks.counts_with_sums(counts, counts.groupBy("value").pivot("genome", genomes).sum("n").na.fill(0), output)


def _long(spark: SparkSession, table: str) -> DataFrame:
    return containment.to_long(delimited.matrix(spark, table))


def ingest_containment(spark: SparkSession, folder: str, target: str) -> list[tuple[str, str]]:
    """Per-genome files to the partitioned long table; genomes that it has stay as they are. Returns the files left out, with reasons."""
    rows, bad = delimited.containment_folder(spark, folder)
    sinks.ingest(containment.build(rows), target)
    return bad


def parse_metadata(spark: SparkSession, files: str, output: str) -> DataFrame:
    """Metadata documents to one table, a column for each attribute."""
    samples = written(xml.sample_documents(xml.documents(spark, files)), "documents")  # parsed once
    names = [r.name for r in xml.tag_names(samples).collect()]  # the columns of the result
    out = xml.widened(samples.drop("tags"), names)
    sinks.delimited(out, output)
    return out


def check_attributes(spark: SparkSession, table: str, output: str) -> None:
    """How often each attribute of a metadata table is given."""
    sinks.attribute_counts(metadata.non_null_counts(delimited.csv(spark, table, "\t")), output)


def single_sample(spark: SparkSession, table: str, metadata_table: str, genome: str, column: str, threshold: float, top_n: int, output: str) -> None:
    """The most frequent metadata values of the samples that hold one genome."""
    meta = delimited.csv(spark, metadata_table, "\t")
    counts = metadata.single_genome_counts(_long(spark, table), meta, genome, column, threshold, top_n, meta.columns[0])
    sinks.delimited(counts, output, single=True)


def summarize_column(spark: SparkSession, table: str, column: str, output: str) -> None:
    df = delimited.csv(spark, table, "\t")
    metadata.require_column(df, column)
    sinks.column_report(df, column, output)


def status(spark: SparkSession, wanted: str, folders: dict[str, tuple[str, str]], output: str, kind: str = "json") -> DataFrame:
    """What of the wanted accessions is there. folders: kind to (folder, pattern). Files belong to the accession that their names begin with, up to the
    pattern's own ending or else the first `_` or `.`; a pattern with a slash (`*/*.fastq*`) looks into folders that are named by accession."""

    def accession(path: str, pattern: str) -> str:
        *_, above, name = path.split("/")
        if "/" in pattern:
            return above
        ending = pattern.removeprefix("*")
        return name.removesuffix(ending) if ending.startswith("_") and "*" not in ending else re.split(r"[_.]", name)[0]

    found = sorted({(k, accession(p, pattern)) for k, (folder, pattern) in folders.items() for p in delimited.list_files(spark, folder, pattern)})
    items = spark.createDataFrame(found, "kind string, accession string")
    out = planning.inventory(items, delimited.lines(spark, wanted, comments=True).select(F.col("value").alias("accession")))
    sinks.inventory_report(out, output, kind)
    return out


def plan_downloads(spark: SparkSession, wanted: str, blacklists: Sequence[str], present: DataFrame, output: str, limit: int | None = None, force: bool = False) -> DataFrame:
    """The accessions still to fetch, one a line."""
    acc = delimited.lines(spark, wanted, comments=True).select(F.col("value").alias("accession"), "ordinal")
    black = delimited.blacklist(spark, blacklists).select(F.col("value").alias("accession"))
    out = planning.first_downloads(planning.plan(metadata.ordered_distinct(acc, "accession", "ordinal"), black, present, force=force), limit, "ordinal")
    sinks.lines(out, "accession", output)
    return out


def dataset_info(spark: SparkSession, files: str, output: str) -> bool:
    """Experiment packages to the metadata report."""
    p = xml.packages(xml.documents(spark, files)).withColumnRenamed("library_strategy", "strategy")
    return sinks.report(planning.metadata_report(p), output)


def _reads(spark: SparkSession, folder: str, accessions: Sequence[str], limit: int = 0) -> tuple[DataFrame, DataFrame]:
    paths = [(a, p) for a in accessions for p in delimited.fastq_files(spark, folder, a)]
    return fastq.read(spark, [p for _, p in paths], limit), spark.createDataFrame([(a, p.rpartition("/")[2]) for a, p in paths], "accession string, file string")


def read_statistics(spark: SparkSession, folder: str, accessions: Sequence[str], output: str) -> bool:
    """The statistics report of the accessions' reads."""
    reads, files = _reads(spark, folder, accessions)
    return sinks.report(readqc.statistics_report(readqc.read_statistics(reads), files), output)


def quality_profiles(spark: SparkSession, folder: str, accessions: Sequence[str], output: str, sample_reads: int = readqc.SAMPLE_READS) -> DataFrame:
    """Profiles of the first reads of each dataset as JSON, their summary and anomalies beside them. Datasets with a read of no length fail."""
    reads, _ = _reads(spark, folder, accessions, sample_reads)
    failed = fastq.zero_length(reads).select(F.col("accession").alias("key"), F.lit("division by zero").alias("error")).distinct()
    profiles = readqc.profile(reads.join(failed.select(F.col("key").alias("accession")), "accession", "left_anti"), sample_reads=sample_reads)
    sinks.json_lines(profiles, f"{output}/profiles")
    sinks.json_lines(readqc.quality_summary(profiles), f"{output}/summary", single=True)
    sinks.json_lines(readqc.anomaly_report(profiles, failed), f"{output}/anomalies")
    return profiles


def compare_datasets(spark: SparkSession, profiles: DataFrame, groups_file: str, output: str, metrics: Sequence[str] = ("mean_length", "gc", "reads", "complexity")) -> dict[str, DataFrame]:
    """Groups of datasets (a JSON object of lists) compared by their profiles; each frame as JSON."""
    given = delimited.groups_json(spark, groups_file)
    groups = planning.groups_of(given).select(F.col("accession").alias("key"), "group")
    order = [r.group for r in given.orderBy("ordinal").collect()]  # the names of one file's groups
    out = statistics.compare_groups(profiles, groups, metrics, order=order or None)
    for name, df in out.items():
        sinks.json_lines(df, f"{output}/{name}")
    return out


def genome_manifest(spark: SparkSession, folder: str, output: str) -> None:
    """The genome (.fna) and protein (.faa) files of a folder, by accession."""
    frame = lambda pattern: spark.createDataFrame([(p.rpartition("/")[2].rpartition(".")[0], p) for p in delimited.list_files(spark, folder, pattern)], "accession string, path string")
    sinks.manifest(frame("*.fna"), output, frame("*.faa"))


def find_by_taxonomy(spark: SparkSession, table: str, cache: str, output: str, min_containment: float = 0.0, summary: bool = False, **taxa: str | None) -> bool:
    """Cells of the taxa given, or their maxima by the most specific of the taxa."""
    w = delimited.matrix(spark, table)
    genomes = containment.genome_columns(w, ("sample", "max_containment", "max_containment_annotation"))
    known = delimited.taxonomy_cache(spark, cache).withColumnRenamed("genome_id", "genome")
    found = taxonomy.filter_taxa(taxonomy.annotate_grid(containment.to_long(w), known, genomes), min_containment, **taxa)
    return sinks.taxonomy_query(found, output, taxonomy.query_level(**taxa) if summary else None)


def explore(spark: SparkSession, table: str, cache: str, metadata_file: str, output: str, location: str, date: str, min_containment: float = 0.0) -> DataFrame:
    """The rows of the explorer, and its header and hierarchy, as JSON."""
    meta = delimited.csv(spark, metadata_file, "\t")
    meta = meta.select(F.col(f"`{meta.columns[0]}`").alias("sample"), F.col(f"`{location}`").alias("location"), F.col(f"`{date}`").alias("date"))
    known = delimited.taxonomy_cache(spark, cache).withColumnRenamed("genome_id", "genome")
    rows = taxonomy.explorer_rows(_long(spark, table), known, meta, min_containment)
    for name, df in (("rows", rows.withColumn("shown", clean.displayed_containment(F.col("v")))), ("header", taxonomy.explorer_header(rows)), ("hierarchy", taxonomy.hierarchy(rows))):
        sinks.json_lines(df, f"{output}/{name}")
    return rows


def diversity_analysis(spark: SparkSession, abundance_file: str, output: str, metric: str = "bray_curtis", metadata_file: str | None = None, formula: str | None = None, permutations: int = 999) -> None:
    """Alpha and beta diversity of an abundance table, and PERMANOVA by the metadata if a formula is given."""
    a = delimited.abundance(spark, abundance_file)
    samples = a.select("sample").distinct()
    sinks.delimited(diversity.alpha(a, samples, a.select("feature").distinct().count()), f"{output}/alpha_diversity.csv", ",")
    pairs = diversity.beta(a, samples, metric)
    sinks.delimited(containment.mirrored(pairs, samples), f"{output}/beta_diversity_{metric}.csv", ",")
    if metadata_file and formula:
        meta = delimited.metadata_table(spark, metadata_file, "sample")
        result = diversity.permanova(pairs, samples, meta, formula, permutations)
        sinks.text_report(result, f"{output}/permanova_results.txt", ["variable", "f_statistic", "p_value", "permutations"], ["variable\tf_statistic\tp_value\tpermutations"])


def validate_taxonomy(spark: SparkSession, species_file: str, reference: DataFrame, output: str, cache: str | None = None) -> DataFrame:
    """Species names validated against a local reference; names in the cache are not looked up again. The cache, if given, is replaced by the result."""
    names = delimited.species_list(spark, species_file).distinct()
    known = None
    if cache and delimited.list_files(spark, cache, "*.csv"):
        known = delimited.csv(spark, cache).join(names, "name", "left_semi")
        names = names.join(known.select("name"), "name", "left_anti")
    found = taxonomy.validate(names, reference, clean.clean_species(F.col("name")))
    found = found.select(*[F.col(c).cast("string").alias(c) for c in found.columns])
    out = found if known is None else found.unionByName(known, allowMissingColumns=True)
    sinks.delimited(out, output, ",", single=True)
    if cache:
        sinks.delimited(delimited.csv(spark, output), cache, ",", single=True)
    return delimited.csv(spark, output)


def summarize_taxonomy(spark: SparkSession, abundance_file: str, validated_file: str, output: str, levels: Sequence[str] = ("phylum", "class", "order", "family", "genus"), min_abundance: float = 0.001) -> None:
    """Abundance by taxon at each level, a table a level."""
    a = delimited.abundance(spark, abundance_file).withColumnRenamed("a", "abundance")
    v = delimited.csv(spark, validated_file).select("name", F.col("is_valid").cast("boolean").alias("is_valid"), "lineage", F.monotonically_increasing_id().alias("ordinal"))
    sinks.by_level(taxonomy.taxonomic_summary(a, taxonomy.lineages(v), levels, min_abundance), output, levels)
