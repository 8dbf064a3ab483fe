"""Column names as they are: any characters, case kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.errors import PlanError


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def check_cases(df: DataFrame) -> DataFrame:
    """Two names that differ by case only need a case-sensitive session."""
    if df.sparkSession.conf.get("spark.sql.caseSensitive") != "true":
        seen: dict[str, str] = {}
        for c in df.columns:
            if seen.setdefault(c.lower(), c) != c:
                raise PlanError(f"columns {seen[c.lower()]!r} and {c!r} differ by case only; set spark.sql.caseSensitive")
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df does not have."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any(f"{mark}{n}" in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]
