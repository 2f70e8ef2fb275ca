"""The folder that driver and executors share, and small files in it."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset, a temporary folder, but only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below it that no one has used."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class File:
    """A small file or a folder, in any file system that Spark reaches."""

    spark: SparkSession
    path: str

    @property
    def _hadoop(self):
        return self.spark._jvm.org.apache.hadoop.fs

    @property
    def _at(self):
        return self._hadoop.Path(self.path)

    @property
    def _system(self):
        return self._at.getFileSystem(self.spark._jsc.sc().hadoopConfiguration())

    @property
    def name(self) -> str:
        """The last part of the path, as it was before it was escaped."""
        return self._at.getName()

    def exists(self) -> bool:
        return self._system.exists(self._at)

    def read(self) -> str | None:
        """The text of a file, or None where there is none."""
        if not self.exists():
            return None
        stream = self._system.open(self._at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, text: str) -> None:
        """Writes a file beside this one and moves it here, in one step for those who read."""
        parent = self._at.getParent()
        other = self._hadoop.Path(parent, f".{self.name}-{uuid.uuid4().hex}")
        self._system.mkdirs(parent)
        stream = self._system.create(other, False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        rename = getattr(self._hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.valueOf("OVERWRITE")
        self._hadoop.FileContext.getFileContext(self._at.toUri(), self.spark._jsc.sc().hadoopConfiguration()).rename(other, self._at, how)

    def children(self) -> list[File]:
        """What a folder holds; nothing where there is none."""
        if not self.exists():
            return []
        found = [s.getPath() for s in self._system.listStatus(self._at)]
        return sorted((File(self.spark, p.toString()) for p in found if not p.getName().startswith(".")), key=lambda f: f.path)

    def delete(self) -> None:
        self._system.delete(self._at, True)


def drop_made(spark: SparkSession) -> int:
    """Deletes what this application's operators have stored so far; DataFrames that read it can't be used any more. Returns the number of paths."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        File(spark, path).delete()
    return len(paths)
