"""Reading inputs and keeping intermediate tables where every executor can see them."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where it names none a folder of this machine will do in local mode (tests); on a cluster that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        d = f"file://{tempfile.gettempdir()}/silvatide-{spark.sparkContext.applicationId}"
    return d.rstrip("/")


#: Paths that place() gave in this process.
_made: list[str] = []


def place(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, which swept() deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(spark: SparkSession, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: this cuts the lineage and survives lost executors."""
    path = place(spark, name)
    with _shuffles_freed(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside are deleted when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def delete(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by written() once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for p in {f.rpartition("/")[0] for df in tables for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete what written() makes inside, but for the tables put into the list; all of it, if what runs inside fails."""
    before, kept = len(_made), []
    try:
        yield kept
    except BaseException:
        kept.clear()
        raise
    finally:
        keep = {f.rpartition("/")[2] for df in kept for f in {x.rpartition("/")[0] for x in df.inputFiles()}}
        for path in [p for p in _made[before:] if p.rpartition("/")[2] not in keep]:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        _made[before:] = [p for p in _made[before:] if p.rpartition("/")[2] in keep]


def only(df: DataFrame, *names: str) -> DataFrame:
    """These columns alone, whatever others there are."""
    return df.select(*[F.col(f"`{n}`") for n in names])


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application: they may not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parents[1]
    to = f"{tempfile.mkdtemp()}/{top.name}_{app}.zip".replace("-", "_")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(to)


def _give_back() -> None:
    """Return what a task has freed to the system: its process goes on to serve other tasks beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def arrow_map(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """mapInArrow with this package at hand on every worker."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        _give_back()

    return df.mapInArrow(run, schema)


def filtered(docs: DataFrame, op: Callable[[DataFrame, tuple[str, ...]], DataFrame], condition: Column) -> DataFrame:
    """The rows of docs that meet a condition on what op(docs, columns to keep) adds, with the columns of docs alone, whatever their names."""
    own = {c: c if c in ("doc_id", "text") else f"_own{k}" for k, c in enumerate(docs.columns)}
    safe = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    kept = op(safe, tuple(a for a in own.values() if a != "doc_id")).filter(condition)
    return kept.select(*[F.col(a).alias(c) for c, a in own.items()])
