"""What the operators of this subpackage share: scratch tables, batches of texts, hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python helper holds as numpy arrays at one time.
SLICE_CHARS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none and runs on one machine, a temporary folder is made, set
    for the session and removed at exit. On a cluster that is an error: a folder of one
    machine would lose the rows that the others write.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tallyboard-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor costs no recomputation.

    ``write`` returns the table read back. ``drop`` and ``keep`` remove tables that no later
    plan reads, ``clear`` all; what is left then goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._paths: list[str] = []
        fs, path = self._on_store(self.base)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        self._paths.append(f"{self.base}/{len(self._paths):03d}-{name}")
        return self._paths[-1]

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table._scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Removes all tables so far but these."""
        kept = {t._scratch_path for t in tables}
        for path in self._paths:
            if path not in kept:
                self._delete(path)

    def clear(self) -> None:
        """Removes all of it, once what reads it has been written elsewhere."""
        self._delete(self.base)

    def _delete(self, name: str) -> None:
        fs, path = self._on_store(name)
        fs.delete(path, True)

    def _on_store(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path


def batches(
    fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that maps a single non-empty batch."""

    def run(stream):
        for batch in stream:
            if batch.num_rows:
                yield from fn(batch)

    return run


def slices(sizes, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters, given each row's; a longer text stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A full-width integer mixer (multiply, xor-shift), element by element."""
    x = x.astype(np.uint64) + np.uint64(seed)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as remainder null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_if_small(df: DataFrame, most: int) -> bool:
    """Whether ``df`` (a scratch table) has at most ``most`` rows, so that it may be broadcast."""
    return df.limit(most + 1).count() <= most


def sorted_groups(frames, keys: list[str]):
    """DataFrames of whole groups from a stream sorted by ``keys``; groups may cross batches.

    Yields (frame, cuts): ``cuts`` are the bounds of the groups in the frame.
    """
    import pandas as pd

    def bounds(pdf):
        k = pdf[keys].to_numpy()
        return np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, len(pdf)]

    rest = []
    for pdf in frames:
        if not len(pdf):
            continue
        if rest and (rest[-1][keys].iloc[-1] == pdf[keys].iloc[-1]).all():
            rest.append(pdf)
            continue
        cuts = bounds(pdf)
        whole = pd.concat([*rest, pdf.iloc[: cuts[-2]]], ignore_index=True) if rest or cuts[-2] else None
        rest = [pdf.iloc[cuts[-2] :]]
        if whole is not None and len(whole):
            yield whole, bounds(whole)
    if rest:
        whole = pd.concat(rest, ignore_index=True)
        yield whole, bounds(whole)
