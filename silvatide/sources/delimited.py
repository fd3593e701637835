"""Readers of containment, matrix, metadata and list files. Everything is read as text first and cast by expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clean import containment_value, number, valid_run
from ..scratch import written

REQUIRED = ("acc", "containment")
# The metadata columns taken from containment files, and their names here.
METADATA_FIELDS = {
    "acc": "Run_ID",
    "biosample": "Sample_ID",
    "bioproject": "Project_ID",
    "organism": "Sample_Scientific_Name",
    "geo_loc_name_country_calc": "geo_loc_name_country_calc",
    "collection_date_sam": "collection_date_sam",
    "assay_type": "assay_type",
    "lat_lon": "lat_lon",
    "cANI": "cANI",
}
TAXONOMY_COLUMNS = ("genome_id", "domain", "phylum", "class", "order", "family", "genus", "species", "ncbi_taxid")


class FormatError(ValueError):
    """A file is not of a known format, or lacks required columns."""


def missing_columns(columns: Sequence[str], required: Sequence[str] = REQUIRED) -> list[str]:
    return [c for c in required if c not in columns]


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The header's names, from the first line alone."""
    first = spark.read.text(path).first()
    if first is None:
        raise FormatError(f"{path} is empty")
    return [c.strip() for c in first[0].lstrip("﻿").split(sep)]


def detect_format(spark: SparkSession, path: str) -> str:
    if missing_columns(header(spark, path)):
        raise FormatError(f"{path} has no known format")
    return "containment"


def csv(spark: SparkSession, path: str | list[str], sep: str = ",", **options) -> DataFrame:
    """Delimited text with a header, every column a string."""
    return spark.read.options(header=True, sep=sep, escape='"', **options).csv(path)


def validate_csv(spark: SparkSession, path: str, required: Sequence[str] = REQUIRED) -> DataFrame:
    """The file as a table, if it has the columns and a row."""
    df = csv(spark, path)
    if lost := missing_columns(df.columns, required):
        raise FormatError(f"{path} lacks {', '.join(lost)}")
    if df.isEmpty():
        raise FormatError(f"{path} has no rows")
    return df


def list_files(spark: SparkSession, directory: str, pattern: str = "*") -> list[str]:
    """Paths that match, in order; none for a directory that cannot be listed. Works on any file system Spark knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{directory.rstrip('/')}/{pattern}")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(s.getPath().toString() for s in found if s.isFile()) if found else []


def headers(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> dict[str, tuple[str, ...]]:
    """The header of every file, in one job: its first line. Empty files have none."""
    if not paths:
        return {}
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value")
    first = lines.filter("split = 0").groupBy("path").agg(F.min_by("value", "id").alias("value")).collect()  # a line a file
    return {r.path: tuple(c.strip() for c in r.value.lstrip("\ufeff").split(sep)) for r in first}


def _by_header(spark: SparkSession, paths: Sequence[str]) -> tuple[dict[tuple[str, ...], list[str]], list[tuple[str, str]]]:
    """Containment files by their header, and (path, problem) of the others."""
    found = headers(spark, paths)
    names = {p.rpartition("/")[2]: p for p in paths}
    groups: dict[tuple[str, ...], list[str]] = {}
    bad = [(p, "empty") for p in paths if p.rpartition("/")[2] not in {f.rpartition("/")[2] for f in found}]
    for path, columns in sorted(found.items()):
        path = names.get(path.rpartition("/")[2], path)
        lost = missing_columns(columns)
        if lost:
            bad.append((path, f"{path} lacks {', '.join(lost)}"))
        else:
            groups.setdefault(columns, []).append(path)
    return groups, bad


def containment_file(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """sample, genome (the file's stem), v and extra (map of other non-empty columns) of files of one header; rows without a valid accession or value are left out."""
    df = csv(spark, path)
    if lost := missing_columns(df.columns):
        raise FormatError(f"{path} lacks {', '.join(lost)}")
    others = [c for c in df.columns if c not in REQUIRED]
    names = F.array(*[F.lit(c) for c in others]).cast("array<string>")
    values = F.array(*[F.col(f"`{c}`") for c in others]).cast("array<string>")
    extra = F.map_filter(F.map_from_arrays(names, values), lambda k, v: v.isNotNull() & (v != ""))
    genome = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1)
    out = df.select(F.trim("acc").alias("sample"), genome.alias("genome"), containment_value(F.col("containment")).alias("v"), extra.alias("extra"))
    return out.filter(valid_run(F.col("sample")) & F.col("v").isNotNull())


def containment_folder(spark: SparkSession, directory: str, pattern: str = "*.csv") -> tuple[DataFrame, list[tuple[str, str]]]:
    """All files by name of column, and (path, problem) of those left out. A common read would take every file's columns in the order
    of the first, so files are read together by header: a branch of the plan for each header, not for each file."""
    groups, bad = _by_header(spark, list_files(spark, directory, pattern))
    if not groups:
        raise FormatError(f"no containment file in {directory}")
    return reduce(DataFrame.unionByName, [containment_file(spark, paths) for paths in groups.values()]), bad


def containment_metadata(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The metadata columns of the files, the first row of each run by file and line; only columns that are there."""
    parts = []
    for columns, files in _by_header(spark, sorted(paths))[0].items():
        cols = [F.col(f"`{a}`").alias(b) for a, b in METADATA_FIELDS.items() if a in columns]
        place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_line")]
        parts.append(csv(spark, files).select(*cols, *place))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    w = Window.partitionBy("Run_ID").orderBy("_file", "_split", "_line")
    return every.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1 AND Run_ID IS NOT NULL").drop("_rn", "_file", "_split", "_line")


def containment_records(rows: DataFrame) -> DataFrame:
    """One metadata record a row of containment_file: the mapped fields by their names here, and what else there is as attributes (null if nothing)."""
    mapped = {a: b for a, b in METADATA_FIELDS.items() if a != "acc"}
    rest = F.map_filter("extra", lambda k, v: ~k.isin(*mapped))
    return rows.select(F.col("sample").alias("Run_ID"), *[F.try_element_at("extra", F.lit(a)).alias(b) for a, b in mapped.items()], F.when(F.size(rest) > 0, rest).alias("attributes"))


def metadata_table(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """A tab-separated table with inferred types; with `index`, its first column has that name."""
    df = spark.read.options(header=True, sep="\t", escape='"', inferSchema=True).csv(path)
    return df.withColumnRenamed(df.columns[0], index) if index else df


def matrix(spark: SparkSession, path: str, sep: str = "\t", index: str = "sample", text_columns: Sequence[str] = ("max_containment_annotation",)) -> DataFrame:
    """A table whose first column is the index, whatever its header, and whose others are numbers but for the text columns."""
    df = csv(spark, path, sep)
    df = df.withColumnRenamed(df.columns[0], index)
    return df.select(index, *[(F.col(f"`{c}`") if c in text_columns else number(F.col(f"`{c}`"))).alias(c) for c in df.columns[1:]])


def abundance(spark: SparkSession, path: str) -> DataFrame:
    """sample, feature, a of a comma-separated matrix."""
    m = matrix(spark, path, ",", text_columns=())
    return m.unpivot(["sample"], [f"`{c}`" for c in m.columns[1:]], "feature", "a").filter("a IS NOT NULL")


def lines(spark: SparkSession, paths: str | Sequence[str], comments: bool = False) -> DataFrame:
    """value: trimmed, non-blank lines in file order; with `comments`, lines that begin with # are left out."""
    text = F.trim(F.regexp_replace("value", "^﻿", ""))
    out = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(text.alias("value"), F.monotonically_increasing_id().alias("ordinal")).filter("value <> ''")
    return out.filter(~F.col("value").startswith("#")) if comments else out


def blacklist(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Distinct lines of all files that can be read."""
    there = []
    for p in paths:
        directory, _, name = p.rpartition("/")
        there += list_files(spark, directory or ".", name)
    if not there:
        return spark.createDataFrame([], "value string")
    return lines(spark, there).select("value").distinct()


def species_list(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """name: a column (the first by default) of a .csv file, else lines of text."""
    if path.endswith(".csv"):
        df = csv(spark, path)
        c = column if column in df.columns else df.columns[0]
        return df.select(F.col(f"`{c}`").alias("name")).filter("name IS NOT NULL")
    return lines(spark, path).select(F.col("value").alias("name"))


def groups_json(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, group, members of an object of lists; no rows if it cannot be parsed."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return m.select(F.posexplode("m").alias("ordinal", "group", "members"))


def json_object(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def taxonomy_cache(spark: SparkSession, path: str) -> DataFrame:
    """Nine string columns; blanks are null, rows without a genome go, the last of a repeated genome counts."""
    df = csv(spark, path, "\t").withColumn("_line", F.monotonically_increasing_id())
    df = df.select(*[(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in TAXONOMY_COLUMNS], "_line").filter("genome_id IS NOT NULL")
    w = Window.partitionBy("genome_id").orderBy(F.desc("_line"))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_line")


def fastq_files(spark: SparkSession, directory: str, accession: str) -> list[str]:
    """The FASTQ files of an accession's folder, else of the directory itself, else of any folder below it."""
    top = directory.rstrip("/")
    return list_files(spark, f"{top}/{accession}", "*.fastq*") or list_files(spark, top, f"{accession}*.fastq*") or files_below(spark, top, f"{accession}*.fastq*")


def files_below(spark: SparkSession, directory: str, pattern: str) -> list[str]:
    """Paths of files in any folder below, in order; their contents are not read."""
    found = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(directory).select("path")
    return sorted(r.path for r in found.collect())


def mapped_files(spark: SparkSession, directory: str, f: Callable[[DataFrame], DataFrame], pattern: str = "*.csv", strict: bool = False) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """What `f` makes of the text lines of each file, by name, and (path, problem) of files where it fails, in its plan or in a row; with `strict` the first failure is raised."""
    good, bad = {}, []
    for path in list_files(spark, directory, pattern):
        try:
            good[path.rpartition("/")[2]] = written(f(lines(spark, path)), "mapped")  # rows are read here, so that their errors are met here
        except Exception as e:
            if strict:
                raise
            bad.append((path, str(e)))
    return good, bad


def genome_archives(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """accession, member, fasta of zipped genome packages: of each assembly's folder the first .fna or .fasta file. A task unpacks an archive."""

    def unpack(batches):
        import io
        import re
        import zipfile

        import pandas as pd

        for b in batches:
            for raw in b["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    found = {}
                    for name in sorted(z.namelist()):
                        m = re.fullmatch(r"ncbi_dataset/data/(GC[^/]*)/[^/]*\.(fna|fasta)", name)
                        if m:
                            found.setdefault(m[1], name)
                    for acc, name in found.items():
                        yield pd.DataFrame({"accession": [acc], "member": [name], "fasta": [z.read(name).decode()]})

    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select("content")
    return files.mapInPandas(unpack, "accession string, member string, fasta string")
