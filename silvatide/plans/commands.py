"""The workflows as commands: `python -m silvatide <command> ...`. Arguments follow from each workflow's signature."""

from __future__ import annotations

import argparse
import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from . import workflows

COMMANDS: dict[str, Callable] = {
    f.__name__: f
    for f in (
        workflows.ingest_containment, workflows.parse_containment, workflows.extract_metadata, workflows.parse_metadata, workflows.check_attributes, workflows.count_metadata,
        workflows.single_sample, workflows.summarize_column, workflows.status, workflows.plan_downloads, workflows.dataset_info, workflows.read_statistics, workflows.quality_profiles,
        workflows.compare_datasets, workflows.genome_manifest, workflows.find_by_taxonomy, workflows.explore, workflows.diversity_analysis, workflows.validate_taxonomy, workflows.summarize_taxonomy,
    )
}


def table(spark: SparkSession, path: str) -> DataFrame:
    """A table by the ending of its path: .csv and .tsv with a header, .json, else Parquet."""
    if path.endswith((".csv", ".tsv")):
        return spark.read.options(header=True, sep="\t" if path.endswith(".tsv") else ",").csv(path)
    return spark.read.json(path) if path.endswith(".json") else spark.read.parquet(path)


def parser() -> argparse.ArgumentParser:
    """A sub-parser for each command: parameters without a default are positional, the others options; tables are paths."""
    top = argparse.ArgumentParser(prog="silvatide")
    subs = top.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        sub = subs.add_parser(name, help=(f.__doc__ or "").split("\n")[0])
        for p in list(inspect.signature(f).parameters.values())[1:]:
            kind = str(p.annotation)
            if p.kind is p.VAR_KEYWORD:
                for rank in ("family", "genus", "species"):
                    sub.add_argument(f"--{rank}")
            elif kind == "bool":
                sub.add_argument(f"--{p.name}", action="store_true")
            else:
                number = int if kind.startswith("int") else float if kind.startswith("float") else str
                many = {"nargs": "*"} if kind.startswith(("Sequence", "dict")) else {}
                if p.default is p.empty:
                    sub.add_argument(p.name, type=number, **({"nargs": "+"} if many else {}))
                else:
                    sub.add_argument(f"--{p.name}", type=number, default=p.default, **many)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command. A folder of a kind is given as kind=folder/pattern."""
    given = vars(parser().parse_args(argv))
    f = COMMANDS[given.pop("command")]
    spark = spark or SparkSession.builder.getOrCreate()
    kinds = {p.name: str(p.annotation) for p in inspect.signature(f).parameters.values()}
    for name, value in given.items():
        kind = kinds.get(name, "")
        if kind.startswith("DataFrame") and value is not None:
            given[name] = table(spark, value)
        elif kind.startswith("dict"):
            pairs = [x.partition("=") for x in value]
            given[name] = {k: (path.rpartition("/")[0], path.rpartition("/")[2]) for k, _, path in pairs}
    out = f(spark, **given)
    if isinstance(out, list):  # files left out, with reasons
        for row in out:
            print(*row, sep="\t")
    return 0 if out is not False else 1
