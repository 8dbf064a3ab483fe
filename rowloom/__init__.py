"""Report XML to typed tables, as Spark plans."""

from rowloom.errors import MergeError, PlanError, XmlError
from rowloom.operators import CastTypes, DropFields, FilterRows, OrderFields, RenameFields
from rowloom.plans import Pipeline, ReportSource
from rowloom.sinks import collect, to_csv, to_dataframe, to_parquet

__all__ = ["CastTypes", "DropFields", "FilterRows", "MergeError", "OrderFields", "Pipeline", "PlanError", "RenameFields", "ReportSource", "XmlError", "collect", "to_csv", "to_dataframe", "to_parquet"]
