"""Small control files in any store that Spark reads, and a folder for what the engine itself writes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, which driver and executors share; it goes when the driver ends.

    Where the session names none and runs on one machine, a temporary folder is set for it; on
    a cluster that is an error, as other machines would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tallyboard-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    store = Store(spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    store.fs.mkdirs(store.path())
    store.fs.deleteOnExit(store.path())
    return store.root


class Store:
    """Files under one root, read and written whole; for control files of a few kilobytes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(self._conf)

    def path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str | None:
        """The text of a file; null if it is not there."""
        if not self.exists(name):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path, text: str) -> None:
        out = self.fs.create(path, False)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def _rename(self, src, dst, over: bool) -> None:
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE if over else rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.toUri(), self._conf)
        context.rename(src, dst, options)

    def replace(self, name: str, text: str) -> None:
        """Writes beside and renames over, so that a reader sees the old text or the new one, never a part."""
        temp = self.path(f".{name}.{uuid.uuid4().hex}")
        self._put(temp, text)
        self._rename(temp, self.path(name), over=True)

    def create(self, name: str, text: str) -> bool:
        """Writes a file only if there is none of that name; false if there is."""
        if self.exists(name):
            return False
        temp = self.path(f".{name}.{uuid.uuid4().hex}")
        self._put(temp, text)
        try:
            self._rename(temp, self.path(name), over=False)
        except Exception:
            self.fs.delete(temp, False)
            if self.exists(name):
                return False
            raise
        return True

    def names(self, folder: str = "") -> list[str]:
        """The names in a folder, hidden ones left out, in order; none if it is not there."""
        if not self.exists(folder):
            return []
        return sorted(n for s in self.fs.listStatus(self.path(folder)) if not (n := s.getPath().getName()).startswith("."))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Tables:
    """Tables written in turn to one folder, so that a loop's plan stays short and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.store, self.n = spark, Store(spark, work_folder(spark, name)), 0

    def write(self, df):
        """The table as read back from the folder."""
        self.n += 1
        path = f"{self.store.root}/{self.n:04d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
