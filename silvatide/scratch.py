"""Tables that an operator writes between two of its passes, in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is named a folder of this machine will do in local mode (tests); on a cluster that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        d = f"file://{tempfile.gettempdir()}/silvatide-{spark.sparkContext.applicationId}"
    return d.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet and read it back: its lineage is cut, later passes see the same rows, and a lost executor costs a retry."""
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application: they may not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent
    to = f"{tempfile.mkdtemp()}/own_{top.name}_{app}.zip".replace("-", "_")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(to)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with this package at hand on every worker."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def arrow_groups(df: DataFrame, keys: list[str], f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """applyInArrow with this package at hand on every worker. Groups must be bounded."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(f, schema)
