"""Spark data source for report XML: spark.read.format("report_xml").

Options: rowTag (Row), columns (JSON list of names; all are found first, if absent), ranges (JSON list of
[start, end, state]; of RANGE bytes, if absent: their states are then found in one scan of the file by the planner).
Reads in parallel by byte range; nothing but the asked columns is built.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from rowloom.sources.blocks import BlockReader
from rowloom.sources.flatten import RowReader, Shape
from rowloom.sources.splits import SMALL, chained, leads_to, ranges, read_range, records_of, rows_of, size_of, transfer


#: Bytes of a range that the reader plans by itself.
RANGE = 16 << 20


class Range(InputPartition):
    def __init__(self, start: int, end: int, state: int):
        self.start, self.end, self.state = start, end, state


class ReportReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.tag = options["path"], options.get("rowtag", options.get("rowTag", "Row"))
        self.names = schema.fieldNames()
        self.ranges = json.loads(options["ranges"]) if "ranges" in options else None

    def partitions(self) -> list[Range]:
        if self.ranges is None:
            size = size_of(self.path)
            parts = ranges(self.path, size, max(1, size // RANGE)) if size else []
            states = [0]
            for a, z in parts[:-1]:
                states.append(leads_to(read_range(self.path, a, z), states[-1]))
            self.ranges = [(a, z, s) for (a, z), s in zip(parts, states, strict=False)]
        return [Range(*r) for r in self.ranges] or [Range(0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.start:
            return
        yield from BlockReader(self.tag, self.names).read(self.path, partition.start, partition.end, size_of(self.path), partition.state)


class ReportDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report_xml"

    def schema(self) -> StructType:
        if "columns" in self.options:
            names = json.loads(self.options["columns"])
        else:
            path, tag, seen = self.options["path"], self.options.get("rowTag", "Row"), {}
            size = size_of(path)
            for _, row in rows_of(path, 0, size, size, 0, RowReader(tag)):
                seen |= dict.fromkeys(k for k, _ in row)
            names = list(seen)
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ReportReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReportDataSource)


def plan_ranges(spark: SparkSession, path: str, count: int | None = None, most_bytes: int | None = None) -> list[list[int]]:
    """Ranges with the state each begins in. One, for a small file; else of maxPartitionBytes (or most_bytes)."""
    size = size_of(path)
    if not size:
        return []
    if count is None:
        most = most_bytes or int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
        count = 1 if size < SMALL and not most_bytes else max(1, -(-size // most), min(spark.sparkContext.defaultParallelism, size // (1 << 20)))
    parts = ranges(path, size, count)
    if len(parts) == 1:
        return [[*parts[0], 0]]

    def sums(start: int, end: int) -> list[tuple[int, str]]:
        return [(start, json.dumps(transfer(read_range(path, start, end))))]

    got = {r["start"]: json.loads(r["t"]) for r in _each(spark, parts, sums, "start long, t string").collect()}  # four numbers a range
    return [[a, z, s] for (a, z), s in zip(parts, chained([got[a] for a, _ in parts]), strict=True)]


def _each(spark: SparkSession, parts: list, run: Callable, schema: str) -> DataFrame:
    """The rows that run(*part) makes of every part, one task for each."""
    held = spark.sparkContext.broadcast(parts)  # two or three numbers a range
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    to = [{"long": pa.int64(), "string": pa.string()}[t] for t in types]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b["id"].to_pylist():
                rows = run(*held.value[k])
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(to)], names=list(names))

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(task, schema)


def discover(spark: SparkSession, path: str, row_tag: str, parts: list[list[int]]) -> list[str]:
    """All column names, in order of first appearance; every range reports each of its names once."""
    if not parts:
        return []
    size = size_of(path)

    def names(start: int, end: int, state: int) -> list[tuple[str, int, int]]:
        first: dict[str, tuple[int, int]] = {}
        seen: set[Shape] = set()
        for at, _, shape, got in records_of(path, start, end, size, state, RowReader(row_tag)):
            if shape is not None:
                if shape in seen:
                    continue
                seen.add(shape)
            for k, name in enumerate(shape.plan if shape else [n for n, _ in got]):
                first.setdefault(name, (at, k))
        return [(name, *p) for name, p in first.items()]

    got = _each(spark, parts, names, "name string, at long, k long").groupBy("name").agg(F.min(F.struct("at", "k")).alias("p"))
    return [r["name"] for r in sorted(got.collect(), key=lambda r: tuple(r["p"]))]  # a row per column
