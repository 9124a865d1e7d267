"""A streaming source that follows growing JSON-lines files by byte offsets.

Spark's file source reads a file once and never sees what is appended later.
This one keeps an offset for each file; a batch reads whole lines between the
last offset and the file's size, new files join as they appear.  The folder must
be mounted on every executor (a live trace is written beside its reader).
"""

from __future__ import annotations

import glob
import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str):
        self.folder, self.pattern = folder, pattern

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path in sorted(glob.glob(os.path.join(self.folder, self.pattern))):
            out[path] = _whole_lines(path)
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(p, start.get(p, 0), size) for p, size in end.items() if size > start.get(p, 0)]

    def read(self, partition: Range):
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            data = f.read(partition.end - partition.start)
        at = partition.start
        for line in data.splitlines(keepends=True):
            if line.strip():
                yield (partition.path, at, line.decode("utf-8").rstrip("\r\n"))
            at += len(line)

    def commit(self, end: dict) -> None:
        pass


def _whole_lines(path: str, block: int = 1 << 16) -> int:
    """Offset behind the file's last line break."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        at = size
        while at > 0:
            lo = max(0, at - block)
            f.seek(lo)
            found = f.read(at - lo).rfind(b"\n")
            if found >= 0:
                return lo + found + 1
            at = lo
    return 0


class TailSource(DataSource):
    """``spark.readStream.format("tail").option("path", folder).option("pattern", "trace_*")``: (path, offset, value)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, offset long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("pattern", "trace_*"))
