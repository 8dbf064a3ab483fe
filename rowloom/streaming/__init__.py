"""Python over rows: record functions, record streams, predicates. Rows travel in Arrow batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

#: Rows that are run to find a function's output columns.
SAMPLE = 1000


def filtered(df: DataFrame, predicate: Callable[[dict], object]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([bool(predicate(r)) for r in b.to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def applied(df: DataFrame, functions: list[Callable[[dict], dict | None]], schema: T.StructType | None = None) -> DataFrame:
    """Each record through all functions in turn; None drops it. Without schema, columns come from the first rows;
    a name that turns up later is an error."""

    def through(record: dict) -> dict | None:
        for f in functions:
            record = f(record)
            if record is None:
                return None
        return record

    return streamed(df, lambda records: (out for r in records if (out := through(r)) is not None), schema)


def streamed(df: DataFrame, function: Callable[[Iterable[dict]], Iterable[dict]], schema: T.StructType | None = None, stateful: bool = False) -> DataFrame:
    """A function from records to records, a partition at a time; stateful: over all of them in order, in one task."""
    if stateful:
        df = df.coalesce(1)
    if schema is None:
        rows = [r for b in df.limit(SAMPLE).toArrow().to_batches() for r in b.to_pylist()]
        found = inferred(list(function(iter(rows))))
        had = {f.name: f.dataType for f in df.schema if isinstance(f.dataType, T.IntegralType)}
        schema = T.StructType([T.StructField(f.name, had.get(f.name, f.dataType) if f.dataType == T.LongType() else f.dataType) for f in found])
    arrow = to_arrow_schema(schema)
    names = set(schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for r in function(r for b in batches for r in b.to_pylist()):
            if not names.issuperset(r):
                raise ValueError(f"new field(s) {sorted(set(r) - names)}: outputs must keep a stable key set ({sorted(names)})")
            held.append(r)
            if len(held) == 4096:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return df.mapInArrow(run, schema)


def inferred(rows: list[dict]) -> T.StructType:
    """Types of records with any keys; a column of nulls is text, one of several types too."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    fields = []
    for n in names:
        values = [r[n] for r in rows if r.get(n) is not None]
        try:
            kind = pa.array(values).type if values else pa.string()
        except (pa.ArrowInvalid, pa.ArrowTypeError):
            kind = pa.string()
        fields.append((n, kind))
    return from_arrow_schema(pa.schema(fields))


def check_picklable(stages: Iterable[object]) -> None:
    from pyspark import cloudpickle

    for s in stages:
        try:
            cloudpickle.dumps(s)
        except (pickle.PicklingError, TypeError, AttributeError) as e:
            raise TypeError(f"stage {s!r} cannot be sent to workers: {e}") from e
