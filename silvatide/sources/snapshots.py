"""Tables that are replaced as a whole: snapshots, and a pointer that is replaced in one step.

A folder holds its snapshots (`snapshot-<id>`) and the file `current`, which names one of them. A new snapshot is written
completely before the pointer is renamed over the old one, so a reader sees the one or the other, a table can be merged into
itself, and a run that fails leaves everything as it was. Old snapshots stay for those who still read them until `prune`.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

POINTER = "current"


class Snapshots:
    """A replaceable table at a path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str | None:
        at = self._path(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def current(self) -> str | None:
        """The name of the snapshot that readers get; None before the first."""
        return self._text(POINTER)

    def names(self) -> list[str]:
        """All snapshots that are there, those that no pointer names too."""
        top = self._path(self.path)
        if not self._fs.exists(top):
            return []
        return sorted(n for s in self._fs.listStatus(top) if (n := s.getPath().getName()).startswith("snapshot-"))

    def load(self) -> DataFrame | None:
        name = self.current()
        return None if name is None else self.spark.read.parquet(f"{self.path}/{name}")

    def save(self, df: DataFrame, expected: str | None = None) -> str:
        """Write df as the new table and return its snapshot's name. df may read the table that it replaces. With `expected` (what current() said when
        df was planned) a table that another writer has replaced since then is an error; the new snapshot is then removed."""
        name = f"snapshot-{uuid.uuid4().hex}"
        try:
            df.write.parquet(f"{self.path}/{name}")
            if expected is not None and self.current() != expected:
                raise RuntimeError(f"{self.path} was replaced by another writer")
            self._point(name)
        except BaseException:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
            raise
        return name

    def _point(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        new = self._path(f"{self.path}/.{POINTER}-{uuid.uuid4().hex}")
        out = self._fs.create(new, False)
        out.write(bytearray(name.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, self._path(f"{self.path}/{POINTER}"), over)

    def merge(self, new: DataFrame, keys: Sequence[str]) -> str:
        """Rows of `new` in place of the rows of the same keys; the other rows stay. Columns that one side lacks are null there."""
        name = self.current()
        if name is None:
            return self.save(new)
        old = self.spark.read.parquet(f"{self.path}/{name}")
        return self.save(new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True), name)

    def prune(self, keep: int = 1) -> list[str]:
        """Delete all snapshots but the current and the `keep` - 1 newest of the others; returns what went. Not while a writer is at work."""
        now, top = self.current(), self._path(self.path)
        if not self._fs.exists(top):
            return []
        aged = sorted((s.getModificationTime(), s.getPath().getName()) for s in self._fs.listStatus(top) if s.getPath().getName().startswith("snapshot-"))
        others = [n for _, n in reversed(aged) if n != now][keep - 1 if now else keep :]
        for n in others:
            self._fs.delete(self._path(f"{self.path}/{n}"), True)
        return sorted(others)

    def remove(self) -> bool:
        """Delete the table, pointer first; returns whether there was one."""
        there = self._fs.delete(self._path(f"{self.path}/{POINTER}"), False)
        self._fs.delete(self._path(self.path), True)
        return bool(there)


# Checkpoints of download sessions.
CHECKPOINT_SCHEMA = "accession string, status string, detail string"


def save_checkpoint(spark: SparkSession, folder: str, session: str, items: DataFrame) -> str:
    """What became of each accession of a session: accession, status, detail; of an accession that the session has already, the new row counts."""
    return Snapshots(spark, f"{folder.rstrip('/')}/{session}").merge(items.select("accession", "status", "detail").dropDuplicates(["accession"]), ["accession"])


def load_checkpoint(spark: SparkSession, folder: str, session: str) -> DataFrame:
    found = Snapshots(spark, f"{folder.rstrip('/')}/{session}").load()
    return spark.createDataFrame([], CHECKPOINT_SCHEMA) if found is None else found


def remove_checkpoint(spark: SparkSession, folder: str, session: str) -> bool:
    return Snapshots(spark, f"{folder.rstrip('/')}/{session}").remove()


def checkpoints(spark: SparkSession, folder: str) -> list[str]:
    """The sessions that have a checkpoint."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    return sorted(n for n in found if Snapshots(spark, f"{folder.rstrip('/')}/{n}").current() is not None)
