"""A paged register as a data source: pages stored as files named window_offset.json are read window by window."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def windows(start: int, end: int, years: int = 2, last: date | None = None) -> list[tuple[str, str]]:
    """Date windows of so many years from start to end (years, inclusive); the last is cut at a given date."""
    out = []
    for y in range(start, end + 1, years):
        until = date(min(y + years - 1, end), 12, 31)
        if last and until > last:
            until = last
        if date(y, 1, 1) <= until:
            out.append((f"{y}-01-01", until.isoformat()))
    return out


class _Window(InputPartition):
    def __init__(self, begin: str, end: str):
        super().__init__((begin, end))
        self.begin, self.end = begin, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.folder, self.fields = options["path"], [f.name for f in schema.fields]
        self.start, self.stop, self.length = int(options.get("start_year", 1955)), int(options.get("end_year", 2026)), int(options.get("length", 1000))

    def partitions(self) -> list[InputPartition]:
        return [_Window(*w) for w in windows(self.start, self.stop)]

    def read(self, partition: _Window) -> Iterator[tuple]:
        offset = 0
        while True:  # pages until an empty or absent one
            rows = self.page(partition.begin, partition.end, offset)
            if not rows:
                return
            for r in rows:
                yield tuple(None if r.get(f) is None else str(r[f]) for f in self.fields)
            offset += self.length

    def page(self, begin: str, end: str, offset: int) -> list[dict]:
        from pyarrow import fs

        try:
            store, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
            with store.open_input_stream(f"{path}/{begin}_{end}_{offset}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return []


class ReplaySource(DataSource):
    """spark.dataSource.register(ReplaySource); spark.read.format("register_replay").schema(...).option("path", ...)."""

    @classmethod
    def name(cls) -> str:
        return "register_replay"

    def schema(self) -> str:
        return "itemid string, ecli string, languageisocode string, doctype string, appno string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)
