"""A streaming source that tails an append-only log by byte offset.

``spark.readStream.format("log_tail").option("path", ...)`` gives (line, byte_offset), the
offset after the line's end, so the stream's checkpoint is the place to go on from. Blank
lines are consumed and not given, a carriage return before the end is dropped, broken
UTF-8 is repaired, and a file shorter than the offset is read from its start. A last line
without an end is given only with option ``final`` (the run has ended).
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class LogTail(DataSource):
    @classmethod
    def name(cls):
        return "log_tail"

    def schema(self):
        return "line string, byte_offset bigint"

    def simpleStreamReader(self, schema):
        return _Reader(self.options)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path, self.final = options["path"], options.get("final", "false") == "true"

    def initialOffset(self):
        return {"at": 0}

    def _lines(self, at: int, to: int | None):
        size = os.path.getsize(self.path) if os.path.exists(self.path) else 0
        at = 0 if at > size else at
        if not size:
            return [], at
        with open(self.path, "rb") as f:
            f.seek(at)
            data = f.read(-1 if to is None else to - at)
        out, pos = [], at
        for raw in [x + b"\n" for x in data.split(b"\n")[:-1]] + data.split(b"\n")[-1:]:
            ended = raw.endswith(b"\n")
            if not raw or not (ended or self.final or to is not None):
                break
            pos += len(raw)
            line = raw.removesuffix(b"\n").removesuffix(b"\r")
            if line:
                out.append((line.decode("utf-8", "replace"), pos))
        return out, pos

    def read(self, start):
        rows, end = self._lines(start["at"], None)
        return iter(rows), {"at": end}

    def readBetweenOffsets(self, start, end):
        return iter(self._lines(start["at"], end["at"])[0])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTail)
