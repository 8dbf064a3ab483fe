"""Where rows end up: pandas, Arrow, Parquet, CSV, plain dicts."""

from __future__ import annotations

import csv
import shutil
import warnings
from collections.abc import Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame


def _frame(pipeline: object) -> DataFrame:
    return pipeline if isinstance(pipeline, DataFrame) else pipeline.df


def to_dataframe(pipeline: object, chunksize: int | None = None, dtype_backend: str = "pyarrow") -> pd.DataFrame:
    """All rows as one frame; with chunksize they come to the driver that many at a time, so text is never held twice."""
    if not isinstance(pipeline, DataFrame) and not hasattr(pipeline, "df"):
        return pd.DataFrame.from_records(list(pipeline))
    mapper = pd.ArrowDtype if dtype_backend == "pyarrow" else None
    if chunksize is not None:
        from rowloom.plans import batched

        chunks = [b.to_pandas(types_mapper=mapper) for b in batched(_frame(pipeline), chunksize)]
        if chunks:
            return pd.concat(chunks, ignore_index=True)
    table = pipeline.to_arrow() if hasattr(pipeline, "to_arrow") else pipeline.toArrow()
    return table.to_pandas(types_mapper=mapper)


def collect(pipeline: object, drop_missing: bool = False) -> list[dict]:
    """All rows as dicts; drop_missing leaves out nulls, as in ragged records."""
    rows = (r.asDict() for r in _frame(pipeline).collect()) if isinstance(pipeline, DataFrame) or hasattr(pipeline, "df") else pipeline
    return [{k: v for k, v in r.items() if v is not None} for r in rows] if drop_missing else list(rows)


def to_csv(pipeline: Iterable[dict], path: str | Path, encoding: str = "utf-8", delimiter: str = ",", fieldnames: list[str] | None = None) -> None:
    """One CSV file, row by row. Header: fieldnames, or the columns (of plain dicts the first one's); fields that are not
    in it are left out with one warning each, missing ones are empty; no rows give an empty file."""
    rows = (r.asDict() for r in pipeline.toLocalIterator()) if isinstance(pipeline, DataFrame) else iter(pipeline)
    with open(path, "w", encoding=encoding, newline="") as f:
        writer, said = None, set()
        for row in rows:
            if writer is None:
                names = list(row) if fieldnames is None else fieldnames
                writer = csv.DictWriter(f, names, delimiter=delimiter, extrasaction="ignore")
                writer.writeheader()
            for k in row.keys() - set(writer.fieldnames) - said:
                said.add(k)
                warnings.warn(f"to_csv: field {k!r} is not in the header and is left out; name it in fieldnames", UserWarning, stacklevel=2)
            writer.writerow(row)


def write_csv(pipeline: object, path: str, delimiter: str = ",") -> None:
    """A folder of CSV files, written by the executors."""
    _frame(pipeline).write.option("header", True).option("sep", delimiter).option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def to_parquet(pipeline: object, path: str | Path, single: bool = True, **options) -> None:
    """One Parquet file (through one task), or with single=False a folder written by all."""
    df = _frame(pipeline)
    if not single:
        df.write.options(**options).parquet(str(path))
        return
    folder = Path(f"{path}.parts")
    df.coalesce(1).write.mode("overwrite").options(**options).parquet(str(folder))
    next(folder.glob("part-*")).replace(path)
    shutil.rmtree(folder)
