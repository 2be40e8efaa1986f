"""A stream of the lines that are appended to files: what was read of each file is the stream's offset, in bytes."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_BLOCK = 1 << 16


def whole_lines(path: str) -> int:
    """Where the last line that has ended ends: a line that is still being written isn't read yet."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at:
            begin = max(0, at - _BLOCK)
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return 0


@dataclass
class Piece(InputPartition):
    path: str
    begin: int
    end: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.from_end = options.get("from", "start") == "end"

    def initialOffset(self) -> dict:  # noqa: N802
        return self.latestOffset() if self.from_end else {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {path: whole_lines(path) for path in sorted(glob.glob(self.pattern, recursive=True)) if os.path.isfile(path)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        """A partition a file. A file that is shorter than what was read of it was cut or replaced, and is read from its start."""
        begins = {path: start.get(path, 0) if start.get(path, 0) <= upto else 0 for path, upto in end.items()}
        return [Piece(path, begins[path], upto) for path, upto in end.items() if upto > begins[path]]

    def read(self, partition: Piece) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            at = f.seek(partition.begin)
            while at < partition.end:
                raw = f.readline()
                if not raw:
                    return  # cut since the batch was planned
                yield partition.path, at, raw.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(raw)

    def commit(self, end: dict) -> None:
        """Nothing is held for batches that are done."""


class Tail(DataSource):
    """Options: path (a pattern of files that all executors see) and from (`start` or `end`)."""

    @classmethod
    def name(cls) -> str:
        return "skerry_tail"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader(self.options)


def lines(spark: SparkSession, path: str, start: str = "start") -> DataFrame:
    """A stream of file, at (the byte where the line begins) and line, of all files that the pattern names now or later."""
    spark.dataSource.register(Tail)
    return spark.readStream.format(Tail.name()).option("path", path).option("from", start).load()
