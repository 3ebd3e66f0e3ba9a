"""A streaming source over the growing logs of many runs: bounded batches, read in parallel by byte range.

``spark.readStream.format("log_files").option("path", folder)`` watches ``folder/<run>/<file>`` and
gives (run_id, line, byte_offset), the offset being that behind the line's end. Planning looks at
sizes and at a block before each new end, never at whole files: a batch takes about
``batch_bytes``, shared by the runs that have news, each up to a line's end. Tasks read ranges of
``range_bytes``; a line belongs to the range in which it starts, whose task reads on to its end.

Blank lines are consumed and not given, a carriage return before the end is dropped, broken
UTF-8 is repaired, a file shorter than its offset is read anew from its start. A last line without
an end is given once the run's result file is there.
"""

from __future__ import annotations

import fnmatch
import json
import os
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 1 << 16


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address or local path, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


class LogFiles(DataSource):
    """Options: path; progress (a file that remembers what was planned, kept with the checkpoint);
    file (a pattern, ``stdout.log``), result (``result.json``), batch_bytes (64 MiB), range_bytes (16 MiB);
    offsets (JSON: where each run is to start, as a recovery knows it)."""

    @classmethod
    def name(cls):
        return "log_files"

    def schema(self):
        return "run_id string, line string, byte_offset bigint"

    def streamReader(self, schema):
        return Tail(self.options)


@dataclass
class Range(InputPartition):
    """The lines of a file that start in [start, stop); the file is read to ``end`` at most."""

    run: str
    path: str
    first: int
    start: int
    stop: int
    end: int


def line_end_before(f, low: int, high: int) -> int:
    """The place behind the last line end in [low, high), else ``low``; reads backwards by blocks."""
    while high > low:
        start = max(low, high - BLOCK)
        f.seek(start)
        at = f.read(high - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        high = start
    return low


def line_end_after(f, at: int, size: int) -> int | None:
    """The place behind the next line end from ``at`` on, if there is one."""
    while at < size:
        f.seek(at)
        block = f.read(min(BLOCK, size - at))
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return None


def lines_between(f, first: int, start: int, stop: int, end: int):
    """(line, offset behind it) of the lines that start in [start, stop) of a batch [first, end)."""
    if start > first:  # the line that crosses into this range belongs to the one before
        at = line_end_after(f, start - 1, end)
        if at is None:
            return
    else:
        at = start
    f.seek(at)
    buf, pos, base = b"", 0, at  # buf[pos] is the byte at ``base``
    while base < stop:
        cut = buf.find(b"\n", pos)
        if cut < 0:
            parts, held = [buf[pos:]], len(buf) - pos
            while cut < 0 and (more := f.read(min(BLOCK * 16, end - base - held))):
                cut = more.find(b"\n")
                cut = cut if cut < 0 else held + cut
                held += len(more)
                parts.append(more)
            buf, pos = b"".join(parts), 0
        if cut < 0:  # the last line of a run that has ended
            if buf:
                yield buf.decode("utf-8", "replace"), base + len(buf)
            return
        raw = buf[pos:cut].removesuffix(b"\r")
        base += cut + 1 - pos
        pos = cut + 1
        if raw:
            yield raw.decode("utf-8", "replace"), base


class Tail(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.file, self.result = options["path"], options.get("file", "stdout.log"), options.get("result", "result.json")
        self.batch, self.range = int(options.get("batch_bytes", 64 << 20)), int(options.get("range_bytes", 16 << 20))
        self.progress, self.first = options.get("progress"), json.loads(options.get("offsets", "{}"))
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {k: int(v) for k, v in self.first.items()}

    def _known(self) -> dict[str, int]:
        """What was planned last: by this reader, or as the progress file has it."""
        if self.at is None:
            self.at = self.initialOffset()
            if self.progress:
                fs, path = open_store(self.progress)
                if fs.get_file_info(path).type == pafs.FileType.File:
                    with fs.open_input_stream(path) as f:
                        self.at = json.loads(f.read())
        return self.at

    def _remember(self, end: dict) -> None:
        self.at = dict(end)
        if self.progress:
            fs, path = open_store(self.progress)
            with fs.open_output_stream(f"{path}.new") as f:
                f.write(json.dumps(self.at).encode())
            fs.move(f"{path}.new", path)

    def _files(self) -> dict[str, tuple[str, int, bool]]:
        """(path, size, ended) of each run's log; a run of which the result is there has ended."""
        fs, root = open_store(self.root)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        ended = {os.path.dirname(i.path) for i in found if os.path.basename(i.path) == self.result}
        logs = [i for i in found if i.type == pafs.FileType.File and fnmatch.fnmatch(os.path.basename(i.path), self.file)]
        return {os.path.basename(os.path.dirname(i.path)).rpartition("=")[2]: (i.path, i.size, os.path.dirname(i.path) in ended) for i in logs}

    def latestOffset(self) -> dict:
        known, files = self._known(), self._files()
        out = dict(known)
        news = {run: f for run, f in files.items() if f[1] != known.get(run, 0)}
        share = max(1, self.batch // max(1, len(news)))
        fs, _ = open_store(self.root)
        for run, (path, size, ended) in news.items():
            at = known.get(run, 0)
            at = 0 if at > size else at
            to = min(size, at + share)
            if to == size and ended:
                out[run] = size
                continue
            with fs.open_input_file(path) as f:
                end = line_end_before(f, at, to)
                if end == at and to < size:  # one line is longer than the share
                    end = line_end_after(f, to, size) or (size if ended else at)
            if end > at or at != known.get(run, 0):
                out[run] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self._remember(end)
        files, out = self._files(), []
        for run, to in sorted(end.items()):
            at = start.get(run, 0)
            at = 0 if to < at else at
            if to > at and run in files:
                out += [Range(run, files[run][0], at, a, min(a + self.range, to), to) for a in range(at, to, self.range)]
        return out

    def read(self, partition: Range):
        fs, _ = open_store(self.root)
        with fs.open_input_file(partition.path) as f:
            for line, offset in lines_between(f, partition.first, partition.start, partition.stop, partition.end):
                yield partition.run, line, offset


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogFiles)
