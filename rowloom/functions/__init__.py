"""Casts and comparisons as expressions; nothing here leaves the JVM."""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.errors import PlanError

INT_RE = r"^[+-]?[0-9]+$"
FLOAT_RE = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|inf|infinity|nan)$"
#: Spellings of types, as text and as Python callables.
TYPES = {"string": "string", "int64": "int", "float64": "float", "bool": "bool", "boolean": "bool", "dictionary": "string"}
CALLABLES = {int: "int", float: "float", bool: "bool", str: "string"}
SPARK_TYPES = {"int": "bigint", "float": "double", "bool": "boolean", "string": "string"}


def type_of(spec: object) -> str | None:
    """int, float, bool or string; None for any other callable."""
    if isinstance(spec, str):
        if spec not in TYPES:
            raise PlanError(f"unknown type {spec!r}; valid: {', '.join(TYPES)}")
        return TYPES[spec]
    return CALLABLES.get(spec) if callable(spec) else None


def parsed(text: Column, kind: str) -> Column:
    """The value that a text spells, null if it spells none. No white space, no suffixes; bool: true or false only."""
    if kind == "int":
        return F.when(text.rlike(INT_RE), text.try_cast("bigint"))
    if kind == "float":
        return F.when(F.lower(text).rlike(FLOAT_RE), text.try_cast("double"))
    if kind == "bool":
        return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))
    return text


def rendered(value: Column, kind: T.DataType) -> Column:
    """A value as text, as a constant filter compares it: the shortest plain decimal that is read back as the same
    number, never an exponent; 42.0 is 42, minus zero is -0; NaN, inf and -inf. The same as plain() below."""
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return value.cast("string")
    bits, most = ("double", 17) if isinstance(kind, T.DoubleType) else ("float", 9)
    size = F.abs(value)
    # Java's own text now and then has a digit more than is needed: a shorter one that is read back alike replaces it.
    shorter = lambda digits: F.coalesce(*(F.when(x.try_cast(bits) == size, F.upper(x)) for x in (F.format_string(f"%#.{k}e", size.cast("double")) for k in digits)))
    own, tiny = size.cast("string"), size < (2.2250738585072014e-308 if bits == "double" else 1.1754944e-38)  # with fewer digits of their own
    number = F.when(tiny & (size > 0), F.coalesce(shorter(range(most - 1)), own)).when(F.length(own) > most, F.coalesce(shorter((most - 3, most - 2, most - 1)), own)).otherwise(own)
    number = _let(number, lambda t: F.when(F.contains(t, F.lit("E")), _shifted(t)).otherwise(t))
    number = F.regexp_replace(number, r"(\.[0-9]*?)0+$", "$1")
    minus = F.when(F.startswith(value.cast("string"), F.lit("-")), "-").otherwise("")
    number = F.when(size == float("inf"), "inf").otherwise(F.rtrim(number, F.lit(".")))
    return F.when(value.isNull(), None).when(F.isnan(value), "NaN").otherwise(F.concat(minus, number))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shifted(text: Column) -> Column:
    """A number d.dddE[-]dd without its exponent."""
    part = lambda k: F.get(F.split(text, "[.E]"), F.lit(k))
    parts = F.struct(F.concat(part(0), part(1)).alias("d"), (1 + F.element_at(F.split(text, "E"), -1).cast("int")).alias("p"))
    moved = lambda x: F.when(x["p"] < 1, F.concat(F.lit("0."), F.repeat(F.lit("0"), -x["p"]), x["d"])).when(x["p"] >= F.length(x["d"]), F.rpad(x["d"], x["p"], "0")).otherwise(F.concat(F.substring(x["d"], F.lit(1), x["p"]), F.lit("."), F.substring(x["d"], x["p"] + 1, F.length(x["d"]))))
    return _let(parts, moved)


def plain(value: object) -> str:
    """rendered() of a Python value."""
    if not isinstance(value, float):
        return str(value)
    if not math.isfinite(value):
        return "NaN" if math.isnan(value) else "inf" if value > 0 else "-inf"
    text = format(Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


#: Spellings of comparisons (fixed values), by the function that each names.
SPELLINGS = {"gt": ">", "lt": "<", "ge": ">=", "le": "<=", "eq": "==", "ne": "!="}


def comparison(spelling: str) -> str:
    """The name in the operator module that a spelling stands for."""
    for name, sign in SPELLINGS.items():
        if spelling in (name, sign):
            return name
    raise ValueError(f"no comparison {spelling!r}; there are {', '.join([*SPELLINGS.values(), *SPELLINGS])}")


@dataclass(frozen=True)
class Equals:
    """A column against a text; wanted: whether they are to be equal."""

    field: str
    value: object
    wanted: bool

    def columns(self) -> tuple[str, ...]:
        return (self.field,)


@dataclass(frozen=True)
class Compares:
    """Two columns."""

    left: str
    right: str
    name: str

    def columns(self) -> tuple[str, ...]:
        return (self.left, self.right)

    def __call__(self, a: object, b: object) -> object:
        compare: Callable = getattr(operator, self.name)
        return compare(a, b)


def condition(spec: object) -> Equals | Compares:
    """What a filter's dict asks for; ValueError now rather than when the plan is built."""
    try:
        given = dict(spec)
        name = comparison(given.pop("op"))
    except KeyError:
        raise ValueError("a filter names its comparison as 'op'") from None
    except TypeError:
        raise ValueError(f"a filter is a dict, not {spec!r}") from None
    names = set(given)
    if names >= {"field_a", "field_b"}:
        return Compares(given["field_a"], given["field_b"], name)
    if names >= {"field", "value"} and not names & {"field_a", "field_b"}:
        if name in ("eq", "ne"):
            return Equals(given["field"], given["value"], name == "eq")
        raise ValueError(f"a constant can be equal or not, it has no order: {given}")
    raise ValueError(f"a filter has 'field' and 'value', or 'field_a' and 'field_b', not {sorted(names)}")
