"""Stages: rename, drop, cast, filter and reorder columns. Each is a DataFrame -> DataFrame step, also as `stage(df)`,
and a record -> record step (`apply`) for plain dicts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.errors import PlanError
from rowloom.functions import SPARK_TYPES, Equals, condition, parsed, plain, rendered, type_of
from rowloom.names import check_cases, col


class Stage:
    def to_spark(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def apply(self, record: dict) -> dict | None:
        raise NotImplementedError

    def __call__(self, rows: DataFrame | Iterable[dict]) -> DataFrame | Iterator[dict]:
        if isinstance(rows, DataFrame):
            return self.to_spark(rows)
        return (out for r in rows if (out := self.apply(r)) is not None)


class RenameFields(Stage):
    """Rename all at once; unknown names are skipped. Names that meet become one column: the later one that has a
    value in the row holds."""

    def __init__(self, mapping: dict[str, str]):
        self.mapping = dict(mapping)

    def apply(self, record: dict) -> dict:
        return {self.mapping.get(k, k): v for k, v in record.items()}

    def to_spark(self, df: DataFrame) -> DataFrame:
        to: dict[str, list[str]] = {}
        for c in df.columns:
            to.setdefault(self.mapping.get(c, c), []).append(c)
        kinds = dict(df.dtypes)
        for new, old in to.items():
            if len({kinds[c] for c in old}) > 1:
                raise PlanError(f"columns {old} become {new!r} but differ in type")
        return check_cases(df.select(*((col(old[0]) if len(old) == 1 else F.coalesce(*map(col, reversed(old)))).alias(new) for new, old in to.items())))


class DropFields(Stage):
    """Drop columns; unknown names are skipped. Without any column left rows still count."""

    def __init__(self, fields: Iterable[str]):
        if isinstance(fields, str):
            raise TypeError("DropFields takes a list of names, not one string")
        self.fields = list(fields)

    def apply(self, record: dict) -> dict:
        return {k: v for k, v in record.items() if k not in self.fields}

    def to_spark(self, df: DataFrame) -> DataFrame:
        return df.select(*(col(c) for c in df.columns if c not in self.fields))


class OrderFields(Stage):
    """Listed columns first, in that order; the others after. A hint: absent names are skipped."""

    def __init__(self, names: Iterable[str]):
        self.names = list(names)

    def apply(self, record: dict) -> dict:
        return {k: record[k] for k in [n for n in self.names if n in record] + [k for k in record if k not in self.names]}

    def to_spark(self, df: DataFrame) -> DataFrame:
        there = [n for n in dict.fromkeys(self.names) if n in df.columns]
        return df.select(*(col(c) for c in there + [c for c in df.columns if c not in there]))


class CastTypes(Stage):
    """Cast columns: {name: int | float | bool | str | "int64" | ... | any callable}; absent names are skipped.

    errors: "raise" (ValueError, with field and value), "coerce" (null) or "skip" (a column with any text that does
    not parse stays text, decided per value: it keeps the text). None: coerce in a report's own pipeline, else raise.
    Other callables run as Python per value and return text.
    """

    def __init__(self, types: dict[str, object], errors: str | None = None):
        if errors not in (None, "raise", "coerce", "skip"):
            raise ValueError("errors must be raise, coerce or skip")
        self.types, self.errors = dict(types), errors
        for spec in self.types.values():
            if type_of(spec) is None and not callable(spec):
                raise PlanError(f"not a type: {spec!r}")

    def apply(self, record: dict) -> dict:
        out = dict(record)
        for k, spec in self.types.items():
            if out.get(k) is not None:
                try:
                    out[k] = {"int": int, "float": float, "bool": _bool, "string": str}.get(type_of(spec), spec)(out[k])
                except (ValueError, TypeError) as e:
                    if self.errors == "coerce":
                        out[k] = None
                    elif self.errors != "skip":
                        raise ValueError(f"cannot cast field {k!r}, value {out[k]!r}: {e}") from e
        return out

    def to_spark(self, df: DataFrame, errors: str = "raise") -> DataFrame:
        errors, new = self.errors or errors, {}
        for name, spec in self.types.items():
            if name not in df.columns:
                continue
            kind, c = type_of(spec), col(name)
            if kind == "string":
                continue
            if kind is None:
                new[name] = _python(spec, name, errors)(c.cast("string"))
                continue
            text = rendered(c, df.schema[name].dataType)
            value = parsed(text, kind)
            if errors == "skip":
                new[name] = text
            elif errors == "raise":
                said = F.concat(F.lit(f"cannot cast field {name!r}, value "), text)
                new[name] = F.when(c.isNotNull() & value.isNull(), F.raise_error(said).cast(SPARK_TYPES[kind])).otherwise(value)
            else:
                new[name] = value
        return df.select(*(new[c].alias(c) if c in new else col(c) for c in df.columns))


def _bool(text: object) -> bool:
    if text in ("true", "false", True, False):
        return text in ("true", True)
    raise ValueError("neither true nor false")


def _python(fn: Callable, name: str, errors: str) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            try:
                got = None if v is None or v is pd.NA or v != v else fn(v)
                out.append(None if got is None else str(got))
            except Exception as e:
                if errors == "raise":
                    raise ValueError(f"cannot cast field {name!r}, value {v!r}: {e}") from e
                out.append(v if errors == "skip" else None)
        return pd.Series(out, dtype=object)

    return run


class FilterRows(Stage):
    """FilterRows(field=, op=, value=): equal or not to a text; null and missing are not equal to any.
    FilterRows(field_a=, op=, field_b=): two columns, null drops the row. FilterRows(column) or FilterRows(function)."""

    def __init__(self, predicate: Column | Callable[[dict], object] | None = None, *, field: str | None = None, op: str | None = None, value: object = None, field_a: str | None = None, field_b: str | None = None):
        self.predicate, self.spec = predicate, None
        if predicate is None:
            given = {"field": field, "op": op, "value": value, "field_a": field_a, "field_b": field_b}
            self.spec = condition({k: v for k, v in given.items() if v is not None})

    @classmethod
    def of(cls, spec: dict) -> FilterRows:
        out = cls(lambda _: True)
        out.predicate, out.spec = None, condition(spec)
        return out

    def apply(self, record: dict) -> dict | None:
        s = self.spec
        if s is None:
            keep = self.predicate(record)
        elif isinstance(s, Equals):
            v = record.get(s.field)
            keep = (v is not None and plain(v) == str(s.value)) == s.wanted
        else:
            a, b = record.get(s.left), record.get(s.right)
            keep = a is not None and b is not None and s(a, b)
        return record if keep else None

    def to_spark(self, df: DataFrame) -> DataFrame:
        if isinstance(self.predicate, Column):
            return df.where(self.predicate)
        if self.predicate is not None:
            from rowloom.streaming import filtered

            return filtered(df, self.predicate)
        s, there = self.spec, set(df.columns)
        if isinstance(s, Equals):
            same = rendered(col(s.field), df.schema[s.field].dataType).eqNullSafe(F.lit(str(s.value))) if s.field in there else F.lit(False)
            return df.where(same if s.wanted else ~same)
        kinds = [df.schema[c].dataType for c in (s.left, s.right) if c in there]
        if len(kinds) == 2 and sum(isinstance(k, T.StringType) for k in kinds) == 1:
            raise PlanError(f"cannot compare {s.left!r} with {s.right!r}: only one of them is text")
        a, b = (col(c) if c in there else F.lit(None).cast("string") for c in (s.left, s.right))
        return df.where(s(a, b))
