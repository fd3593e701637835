"""Sample and run metadata from XML: a document is parsed once, and all its fields and attributes are taken from that.

A document that is not well-formed has no rows; nothing outside a document is ever resolved.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import arrow_map

# Fields of the experiment packages and where they stand.
PACKAGE_FIELDS = {
    "accession": "EXPERIMENT/@accession",
    "title": "EXPERIMENT/TITLE",
    "library_name": "EXPERIMENT//LIBRARY_NAME",
    "library_strategy": "EXPERIMENT//LIBRARY_STRATEGY",
    "library_source": "EXPERIMENT//LIBRARY_SOURCE",
    "library_selection": "EXPERIMENT//LIBRARY_SELECTION",
    "instrument": "EXPERIMENT/PLATFORM/*/INSTRUMENT_MODEL",
    "organism": "SAMPLE/SAMPLE_NAME/SCIENTIFIC_NAME",
    "bioproject": "STUDY/@accession",
    "release_date": "SUBMISSION/@received",
}
SAMPLE_FIELDS = {
    "Run_ID": "//RUN/IDENTIFIERS/PRIMARY_ID",
    "Run_Total_Spots": "//RUN/Total_spots",
    "Run_Total_Bases": "//RUN/Total_bases",
    "Run_Size": "//RUN/size",
    "Run_Download_Path": "//RUN/download_path",
    "Run_MD5": "//RUN/md5",
    "Run_Filename": "//RUN/filename",
    "Run_Spot_Length": "//RUN/spot_length",
    "Run_Reads": "//RUN/reads",
    "Run_FTP": "//RUN/ftp",
    "Run_Aspera": "//RUN/aspera",
    "Run_Galaxy": "//RUN/galaxy",
    "Project_ID": "//STUDY/IDENTIFIERS/PRIMARY_ID",
    "Project_Title": "//STUDY/DESCRIPTOR/STUDY_TITLE",
    "Project_Abstract": "//STUDY/DESCRIPTOR/STUDY_ABSTRACT",
    "Sample_ID": "//SAMPLE/IDENTIFIERS/PRIMARY_ID",
    "Sample_External_ID": "//SAMPLE/IDENTIFIERS/EXTERNAL_ID",
    "Sample_Name": "//SAMPLE/SAMPLE_NAME/TAXON_ID",
    "Sample_Scientific_Name": "//SAMPLE/SAMPLE_NAME/SCIENTIFIC_NAME",
    "Sample_Title": "//SAMPLE/TITLE",
    "Experiment_ID": "//EXPERIMENT/IDENTIFIERS/PRIMARY_ID",
    "Experiment_Title": "//EXPERIMENT/TITLE",
    "Experiment_Design": "//EXPERIMENT/DESIGN/DESIGN_DESCRIPTION",
    "Experiment_Library_Name": "//EXPERIMENT/LIBRARY_DESCRIPTOR/LIBRARY_NAME",
    "Experiment_Library_Strategy": "//EXPERIMENT/LIBRARY_DESCRIPTOR/LIBRARY_STRATEGY",
    "Experiment_Library_Source": "//EXPERIMENT/LIBRARY_DESCRIPTOR/LIBRARY_SOURCE",
    "Experiment_Library_Selection": "//EXPERIMENT/LIBRARY_DESCRIPTOR/LIBRARY_SELECTION",
    "SRA_Normalized_URL": "(//RUN/SRAFiles/SRAFile)[2]/@url",
}


def field(xml: Column, path: str, default: str | None = None) -> Column:
    """The text of an element or attribute; a missing or empty one is the default."""
    return F.coalesce(F.nullif(F.trim(F.xpath_string(xml, F.lit(path))), F.lit("")), F.lit(default).cast("string"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """file, xml: whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("xml"))


def well_formed(xml: Column, root: str) -> Column:
    """A cheap test that a document was not cut off: it holds the root's end tag."""
    return F.coalesce(xml.contains(f"</{root}>"), F.lit(False))


_ATTRIBUTE = re.compile(r"(.*)/@(\w+)")
_NTH = re.compile(r"\((.*)\)\[(\d+)\](.*)")
_WHOLE = re.compile(r"[+-]?[0-9]{1,18}")


def _found(top: ElementTree.Element, path: str) -> str | None:
    """The trimmed text of the first element or attribute at a path below `top`; None for a missing or empty one."""
    nth = _NTH.fullmatch(path)
    if nth:
        nodes = top.findall(_below(nth[1]))
        at = int(nth[2]) - 1
        text = nodes[at].get(nth[3].removeprefix("/@")) if at < len(nodes) else None
    elif (m := _ATTRIBUTE.fullmatch(path)) is not None:
        text = next((n.get(m[2]) for n in top.iterfind(_below(m[1])) if n.get(m[2]) is not None), None)
    else:
        node = top.find(_below(path))
        text = None if node is None else "".join(node.itertext())
    return (text or "").strip(" ") or None


def _below(path: str) -> str:
    return f".{path}" if path.startswith("//") else path


def _parsed(docs: DataFrame, rows: Callable[[str | None, ElementTree.Element], Iterator[tuple]], fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """The rows that rows(file, element over the root) gives of each well-formed document of docs (file, xml)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    top = ElementTree.Element("documents")
                    top.append(ElementTree.fromstring((text or "").removeprefix("\ufeff")))
                except ElementTree.ParseError:
                    continue
                out.extend(rows(file, top))
            columns = list(zip(*out, strict=True)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, _, kind) in zip(columns, fields, strict=True)], names=[n for n, _, _ in fields])

    file = F.col("file") if "file" in docs.columns else F.lit(None).cast("string").alias("file")
    return arrow_map(docs.select(file, "xml"), run, ", ".join(f"`{n}` {sql}" for n, sql, _ in fields))


_TEXT = ("string", pa.string())


def sample_documents(docs: DataFrame) -> DataFrame:
    """run (from the file name), the 28 fixed fields (the first that fits; null where missing), attributes (a map of tag to value; of repeated
    tags the last counts) and tags (all that occur): a row for each well-formed document of docs (file, xml)."""

    def rows(file: str | None, top: ElementTree.Element) -> Iterator[tuple]:
        run = re.match(r"(.*?)_metadata\.xml", file or "")
        held: dict[str, str | None] = {}
        nodes = top.findall(".//SAMPLE_ATTRIBUTES/SAMPLE_ATTRIBUTE")
        for node in nodes:
            tag = node.findtext("TAG")
            if tag and node.find("VALUE") is not None:
                held.pop(tag, None)
                held[tag] = node.findtext("VALUE")
        tags = sorted({t for n in nodes for x in n.findall("TAG") if (t := x.text)})
        yield ((run[1] if run else None) or None, *[_found(top, path) for path in SAMPLE_FIELDS.values()], list(held.items()), tags)

    fields = [(n, *_TEXT) for n in ("run", *SAMPLE_FIELDS)]
    return _parsed(docs, rows, [*fields, ("attributes", "map<string,string>", pa.map_(pa.string(), pa.string())), ("tags", "array<string>", pa.list_(pa.string()))])


def sample_metadata(docs: DataFrame) -> DataFrame:
    """run, the 28 fixed fields and attributes: see sample_documents."""
    return sample_documents(docs).drop("tags")


def attribute_names(docs: DataFrame) -> DataFrame:
    """Sorted distinct tags over all documents."""
    return tag_names(sample_documents(docs.select("xml")))


def tag_names(samples: DataFrame) -> DataFrame:
    return samples.select(F.explode("tags").alias("name")).distinct().orderBy("name")


def widened(samples: DataFrame, names: list[str]) -> DataFrame:
    """Attributes as columns."""
    return samples.select(*[c for c in samples.columns if c != "attributes"], *[F.try_element_at("attributes", F.lit(n)).alias(n) for n in names])


def packages(docs: DataFrame) -> DataFrame:
    """One row for each experiment package: fields, platform, layout, sums over its runs, size in MB and mean read length (0 without spots)."""

    def total(package: ElementTree.Element, name: str) -> int:
        return sum(int(v) for r in package.iterfind("RUN_SET/RUN") if (v := (r.get(name) or "").strip()) and _WHOLE.fullmatch(v))

    def rows(_: str | None, top: ElementTree.Element) -> Iterator[tuple]:
        for p in top.iter("EXPERIMENT_PACKAGE"):
            platform = next((n[0].tag for n in p.iter("PLATFORM") if len(n)), "")
            layout = "SINGLE" if next(p.iter("PAIRED"), None) is None else "PAIRED"
            biosample = _found(p, "//EXTERNAL_ID[@namespace='BioSample']") or ""
            yield (*[_found(p, path) or "" for path in PACKAGE_FIELDS.values()], platform, layout, biosample, total(p, "total_spots"), total(p, "total_bases"), total(p, "size"))

    fields = [(n, *_TEXT) for n in (*PACKAGE_FIELDS, "platform", "layout", "biosample")]
    out = _parsed(docs, rows, fields + [(n, "bigint", pa.int64()) for n in ("spots", "bases", "size")])
    out = out.withColumn("size_mb", F.col("size") / 1048576.0).drop("size")
    return out.withColumn("avg_length", F.when(F.col("spots") > 0, F.col("bases") / F.nullif("spots", F.lit(0))).otherwise(0.0))
