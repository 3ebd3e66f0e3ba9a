"""Control files of durable runs: one folder a run, small JSON files in it, read tolerantly and written once.

A file that is missing, broken or lacks a required field is as absent as one that was never
written. A run's folder is made whole beside and renamed into place, and only if there is none of
that name, so a second writer of a run fails and a lost task leaves nothing half done.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..streaming.log_files import open_store
from .snapshots import is_date

# The files of a run and their fields; those that end in ? may be missing.
FILES = {
    "configuration": "runID string, executable string, arguments array<string>, workingDirectory string, environment map<string, string>",
    "manifest": "runID string, workerPID int, cliPID int, startedAt string",
    "heartbeat": "runID string, workerPID int, updatedAt string",
    "result": "runID string, exitCode int, endedAt string, launchError string",
}
#: Runs whose files one task reads, and folders that are renamed at a time.
FOLDERS, MOVES = 1024, 16
OPTIONAL, DATES = {"launchError"}, {"startedAt", "updatedAt", "endedAt"}


def decode(kind: str, text: Column) -> Column:
    """The struct of a control file, dates as timestamps; null for one that cannot be decoded."""
    spec = FILES[kind]
    names = [f.split()[0] for f in spec.replace("map<string, string>", "map").split(", ")]
    d = F.from_json(text, f"{spec}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    ok = d["_broken"].isNull()
    for n in names:
        ok = ok & (d[n].isNotNull() if n not in OPTIONAL else F.lit(True)) & (is_date(d[n]) if n in DATES else F.lit(True))
    fields = [F.try_to_timestamp(d[n]).alias(n) if n in DATES else d[n].alias(n) for n in names]
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(*fields))


def read(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(directory, file fields) of each run under ``root`` that has a whole file of the kind.

    ``directory`` is the name of the run's folder. An empty or missing root gives no rows.
    """
    spark.dataSource.register(RunFolders)
    d = spark.read.format("run_folders").options(path=root, kind=kind).load()
    return d.select("directory", decode(kind, F.col("text")).alias("f")).filter("f IS NOT NULL").select("directory", "f.*")


@dataclass
class Folders(InputPartition):
    """Names of run folders that one task reads."""

    names: list[str]


class RunFolders(DataSource):
    """Writes (run_id, name, text) rows as ``path/<run_id>/<name>``; rows of a run lie in one partition.

    Reads (directory, text) of each file ``path/<directory>/<kind>.json``: one listing of the names, and the
    files of ``FOLDERS`` runs a task, so that small files cost neither a task nor a listing each.
    """

    @classmethod
    def name(cls):
        return "run_folders"

    def schema(self):
        return "directory string, text string"

    def reader(self, schema):
        return _Reader(self.options["path"], self.options["kind"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, root: str, kind: str):
        self.root, self.kind = root, kind

    def partitions(self):
        fs, root = open_store(self.root)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        names = sorted(i.base_name for i in found if i.type == pafs.FileType.Directory)
        return [Folders(names[i : i + FOLDERS]) for i in range(0, len(names), FOLDERS)] or [Folders([])]

    def read(self, partition):
        fs, root = open_store(self.root)
        for name in partition.names:
            try:
                with fs.open_input_stream(f"{root}/{name}/{self.kind}.json") as f:
                    text = f.read()
            except FileNotFoundError:
                continue
            yield name, text.decode(errors="replace")


class _Made(WriterCommitMessage):
    def __init__(self, runs: list[str], staged: str):
        self.runs, self.staged = runs, staged


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.staging = root, f".staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        fs, root = open_store(self.root)
        staged, runs = f"{root}/{self.staging}/{uuid.uuid4().hex}", set()
        for row in iterator:
            if not row["run_id"] or "/" in row["run_id"]:
                raise ValueError(f"no name of a folder: {row['run_id']!r}")
            if row["run_id"] not in runs:
                runs.add(row["run_id"])
                fs.create_dir(f"{staged}/{row['run_id']}")
            with fs.open_output_stream(f"{staged}/{row['run_id']}/{row['name']}") as f:
                f.write((row["text"] or "").encode())
        return _Made(sorted(runs), staged)

    def commit(self, messages):
        fs, root = open_store(self.root)
        made = [(r, m.staged) for m in messages if m for r in m.runs]
        names = [r for r, _ in made]
        try:
            there = [i.base_name for i in fs.get_file_info([f"{root}/{r}" for r in names]) if i.type != pafs.FileType.NotFound]
            if there or len(set(names)) < len(names):
                raise FileExistsError(f"runs that exist already: {sorted(there)[:5] or 'twice in one write'}")
            with ThreadPoolExecutor(MOVES) as pool:
                list(pool.map(lambda m: fs.move(f"{m[1]}/{m[0]}", f"{root}/{m[0]}"), made))
        finally:
            self._clear(fs, root)

    def abort(self, messages):
        self._clear(*open_store(self.root))

    def _clear(self, fs, root):
        if fs.get_file_info(f"{root}/{self.staging}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.staging}")


def write_runs(files: DataFrame, root: str) -> None:
    """Makes the folders of new runs from (run_id, name, text) rows; fails, and makes none, if one of them exists.

    One writer at a time under a root. A null text is an empty file.
    """
    spark = files.sparkSession
    spark.dataSource.register(RunFolders)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many, as small files take time by their number and not by their bytes
    files.select("run_id", "name", "text").repartition(parts, "run_id").write.format("run_folders").option("path", root).mode("append").save()
