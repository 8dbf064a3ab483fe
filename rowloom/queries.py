"""Queries of the report engine, with the SQL each must agree with."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom import CastTypes, DropFields, FilterRows, OrderFields, Pipeline, RenameFields, ReportSource, to_csv, to_parquet
from rowloom.functions import rendered
from rowloom.names import col
from rowloom.plans import dictionary_candidates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None):  # noqa: ANN201
    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def place(name: str) -> str:
    """A new file of this machine: report files are read by path. On a cluster the folder must be shared."""
    folder = os.path.join(os.environ.get("ROWLOOM_REPORTS", tempfile.gettempdir()), "rowloom-reports")
    os.makedirs(folder, exist_ok=True)
    return os.path.join(folder, f"{uuid.uuid4().hex}-{name}")


def escape(text: object) -> str:
    return str(text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("\r", "&#13;")


def write_report(df: DataFrame, path: str, row_tag: str = "Row") -> str:
    """df as a report: a row element each, a Field for each value, none for null; an empty text as an empty element."""
    names = df.columns
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<Report>\n')
        for r in df.toLocalIterator():
            fields = "".join(f'<Field Name="{escape(n)}"><Value>{escape(v)}</Value></Field>' for n, v in zip(names, r, strict=True) if v is not None)
            f.write(f"<{row_tag}>{fields}</{row_tag}>\n")
        f.write("</Report>\n")
    return path


def report(df: DataFrame, name: str, **options) -> ReportSource:
    return ReportSource(write_report(df, place(name)), spark=df.sparkSession, columns=options.pop("columns", df.columns), **options)


# --- rename, drop, order


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey, c_acctbal, c_mktsegment AS segment FROM customer")
def rename_basic(spark, sf):
    return (Pipeline(table(spark, sf, "customer")) | RenameFields({"c_custkey": "id", "c_name": "name", "c_mktsegment": "segment"})).df


@query("SELECT c_custkey, c_mktsegment AS c_name, c_name AS c_mktsegment FROM customer")
def rename_swap(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return (Pipeline(c) | RenameFields({"c_name": "c_mktsegment", "c_mktsegment": "c_name"})).df


@query("SELECT r_regionkey, r_name FROM region")
def rename_unknown(spark, sf):
    return (Pipeline(table(spark, sf, "region")) | RenameFields({"nothing": "r_name"})).df


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linestatus END, l_returnflag) AS flag FROM lineitem")
def rename_collision(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linestatus")).alias("l_linestatus"))
    return (Pipeline(x) | RenameFields({"l_returnflag": "flag", "l_linestatus": "flag"})).df


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def drop_fields(spark, sf):
    return (Pipeline(table(spark, sf, "orders")) | DropFields(["o_orderstatus", "o_orderdate", "o_orderpriority"])).df


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def drop_unknown(spark, sf):
    return (Pipeline(table(spark, sf, "nation")) | DropFields(["nothing"])).df


@query("SELECT s_name, s_suppkey, s_nationkey, s_acctbal FROM supplier")
def schema_order(spark, sf):
    return (Pipeline(table(spark, sf, "supplier")) | OrderFields(["s_name", "nothing", "s_suppkey"])).df


# --- casts

MESSY = "CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 4 = 1 THEN '' WHEN l_linenumber % 4 = 2 THEN {x} ELSE ' ' || {x} END"


def messy(df: DataFrame, text: str) -> DataFrame:
    return df.selectExpr("l_orderkey", "l_linenumber", f"{MESSY.format(x=text)} AS x")


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN TRY_CAST(x AS BIGINT) END AS x FROM (SELECT l_orderkey, l_linenumber, {MESSY.format(x='CAST(l_partkey AS VARCHAR)')} AS x FROM lineitem)")
def cast_coerce_int(spark, sf):
    return (Pipeline(messy(table(spark, sf, "lineitem"), "CAST(l_partkey AS STRING)")) | CastTypes({"x": int}, errors="coerce")).df


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(x, '[0-9]+\\.?[0-9]*') THEN TRY_CAST(x AS DOUBLE) END AS x FROM (SELECT l_orderkey, l_linenumber, {MESSY.format(x='CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' + chr(39) + '.25' + chr(39))} AS x FROM lineitem)")
def cast_coerce_float(spark, sf):
    return (Pipeline(messy(table(spark, sf, "lineitem"), "CAST(CAST(l_quantity AS INT) AS STRING) || '.25'")) | CastTypes({"x": "float64"}, errors="coerce")).df


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN true WHEN 1 THEN false END AS x FROM lineitem")
def cast_coerce_bool(spark, sf):
    x = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE l_linenumber % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'True' ELSE '1' END AS x")
    return (Pipeline(x) | CastTypes({"x": bool}, errors="coerce")).df


@query(f"SELECT l_orderkey, l_linenumber, {MESSY.format(x='CAST(l_partkey AS VARCHAR)')} AS x FROM lineitem")
def cast_skip(spark, sf):
    return (Pipeline(messy(table(spark, sf, "lineitem"), "CAST(l_partkey AS STRING)")) | CastTypes({"x": int}, errors="skip")).df


@query("SELECT o_orderkey, lower(o_orderpriority) || '!' AS o_orderpriority FROM orders")
def cast_callable(spark, sf):
    return (Pipeline(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")) | CastTypes({"o_orderpriority": lambda t: t.lower() + "!"})).df


@query("SELECT o_orderkey, o_custkey FROM orders")
def cast_raise(spark, sf):
    return (Pipeline(table(spark, sf, "orders").selectExpr("o_orderkey", "CAST(o_custkey AS STRING) AS o_custkey")) | CastTypes({"o_custkey": int}, errors="raise")).df


# --- filters

FLAG = "CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN '' ELSE l_returnflag END"


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{FLAG} AS flag")


FLAGGED = f"(SELECT l_orderkey, l_linenumber, {FLAG} AS flag FROM lineitem)"


@query(f"SELECT * FROM {FLAGGED} WHERE flag IS NOT DISTINCT FROM 'R'")
def filter_eq(spark, sf):
    return (Pipeline(flagged(spark, sf)) | FilterRows(field="flag", op="==", value="R")).df


@query(f"SELECT * FROM {FLAGGED} WHERE flag IS DISTINCT FROM 'R'")
def filter_ne_null(spark, sf):
    return (Pipeline(flagged(spark, sf)) | FilterRows(field="flag", op="!=", value="R")).df


@query("SELECT * FROM region WHERE false")
def filter_eq_absent(spark, sf):
    return (Pipeline(table(spark, sf, "region")) | FilterRows(field="nothing", op="eq", value="x")).df


@query("SELECT * FROM region")
def filter_ne_absent(spark, sf):
    return (Pipeline(table(spark, sf, "region")) | FilterRows(field="nothing", op="ne", value="x")).df


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = 42")
def filter_float_text(spark, sf):
    return (Pipeline(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")) | FilterRows(field="l_quantity", op="==", value="42")).df


@query("SELECT o_orderkey, CAST(123456789.125 AS DOUBLE) + o_orderkey % 3 AS x FROM orders WHERE o_orderkey % 3 = 1")
def filter_float_large(spark, sf):
    x = table(spark, sf, "orders").selectExpr("o_orderkey", "123456789.125D + o_orderkey % 3 AS x")
    return (Pipeline(x) | FilterRows(field="x", op="==", value="123456790.125")).df


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 1e-5 WHEN 1 THEN 1e15 ELSE 0.1 END AS x FROM orders WHERE o_orderkey % 3 = 0")
def filter_float_small(spark, sf):
    x = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN 1e-5D WHEN 1 THEN 1e15D ELSE 0.1D END AS x")
    return (Pipeline(x) | FilterRows(field="x", op="==", value="0.00001")).df


def _compare(op: str) -> None:
    @query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 7 {'=' if op == '==' else op} l_suppkey % 7", f"filter_cmp_{ {'>': 'gt', '<': 'lt', '>=': 'ge', '<=': 'le', '==': 'eq', '!=': 'ne'}[op]}")
    def run(spark, sf):
        x = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_partkey % 7 AS a", "l_suppkey % 7 AS b")
        return (Pipeline(x) | FilterRows(field_a="a", op=op, field_b="b") | DropFields(["a", "b"])).df


for _op in (">", "<", ">=", "<=", "==", "!="):
    _compare(_op)


@query(f"SELECT l_orderkey, l_linenumber, flag, l_linestatus FROM (SELECT l_orderkey, l_linenumber, {FLAG} AS flag, l_linestatus FROM lineitem) WHERE flag < l_linestatus")
def filter_cmp_text(spark, sf):
    x = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{FLAG} AS flag", "l_linestatus")
    return (Pipeline(x) | FilterRows(field_a="flag", op="<", field_b="l_linestatus")).df


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000")
def filter_column(spark, sf):
    return (Pipeline(table(spark, sf, "orders").select("o_orderkey", "o_totalprice")) | FilterRows(F.col("o_totalprice") > 250000)).df


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 = 3")
def filter_callable(spark, sf):
    return (Pipeline(table(spark, sf, "customer").select("c_custkey", "c_name")) | FilterRows(lambda r: r["c_custkey"] % 10 == 3)).df


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def filter_two(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return (Pipeline(o) | FilterRows(field="o_orderstatus", op="==", value="F") | FilterRows(field="o_orderpriority", op="==", value="1-URGENT")).df


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'O'")
def filter_then_rename(spark, sf):
    return (Pipeline(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")) | FilterRows(field="o_orderstatus", op="==", value="O") | RenameFields({"o_orderstatus": "status"})).df


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'O'")
def rename_then_filter(spark, sf):
    return (Pipeline(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")) | RenameFields({"o_orderstatus": "status"}) | FilterRows(field="status", op="!=", value="O")).df


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def filter_then_drop(spark, sf):
    return (Pipeline(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")) | FilterRows(field="o_orderstatus", op="==", value="P") | DropFields(["o_orderstatus"])).df


@query("SELECT l_shipmonth, l_orderkey, l_linenumber, price FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS price, month(l_shipdate) AS l_shipmonth, l_returnflag FROM lineitem) WHERE l_returnflag = 'A'")
def chain_all(spark, sf):
    x = table(spark, sf, "lineitem").selectExpr("CAST(l_orderkey AS STRING) l_orderkey", "CAST(l_linenumber AS STRING) l_linenumber", "CAST(l_extendedprice AS STRING) l_extendedprice", "l_returnflag", "CAST(month(l_shipdate) AS STRING) l_shipmonth")
    p = Pipeline(x) | RenameFields({"l_extendedprice": "price"}) | CastTypes({"price": float, "l_orderkey": int, "l_linenumber": int, "l_shipmonth": int}) | FilterRows(field="l_returnflag", op="==", value="A") | DropFields(["l_returnflag"]) | OrderFields(["l_shipmonth"])
    return p.df


# --- stages in Python, other sources


class Doubled:
    def apply(self, record: dict) -> dict | None:
        return None if record["c_custkey"] % 2 else record | {"double": record["c_custkey"] * 2}


@query("SELECT c_custkey, c_name, c_custkey * 2 AS \"double\" FROM customer WHERE c_custkey % 2 = 0")
def stage_apply(spark, sf):
    return (Pipeline(table(spark, sf, "customer").select("c_custkey", "c_name")) | Doubled()).df


def twice(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        yield r
        yield r


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def stage_generator(spark, sf):
    return (Pipeline(table(spark, sf, "nation").select("n_nationkey", "n_name")) | twice).df


def numbered(rows: Iterator[dict]) -> Iterator[dict]:
    for k, r in enumerate(rows):
        yield r | {"place": k}


numbered.stateful = True


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation")
def stage_stateful(spark, sf):
    return (Pipeline(table(spark, sf, "nation").select("n_nationkey").orderBy("n_nationkey")) | numbered).df


@query("SELECT r_regionkey, r_name, CASE WHEN r_regionkey % 2 = 0 THEN 'even' END AS kind FROM region")
def stage_stable_keys(spark, sf):
    class Kind:
        def apply(self, r: dict) -> dict:
            return r | {"kind": "even"} if r["r_regionkey"] % 2 == 0 else r

    return (Pipeline(table(spark, sf, "region")) | Kind()).df


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region WHERE r_name <> 'ASIA'")
def source_iterable(spark, sf):
    rows = [r.asDict() for r in table(spark, sf, "region").collect()]
    return (Pipeline(iter(rows), spark=spark) | FilterRows(field="r_name", op="!=", value="ASIA")).df


@query("SELECT n_name AS nation FROM nation")
def source_arrow(spark, sf):
    t: pa.Table = table(spark, sf, "nation").select("n_name").toArrow()
    return (Pipeline(t, spark=spark) | RenameFields({"n_name": "nation"})).df


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def parallel_pipeline(spark, sf):
    p = Pipeline(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")) | FilterRows(field="c_mktsegment", op="==", value="BUILDING") | DropFields(["c_mktsegment"])
    return p.parallel(workers=4).df


@query("SELECT o_orderkey, 'F' AS branch FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'O' AS branch FROM orders WHERE o_orderstatus = 'O'")
def branching(spark, sf):
    base = Pipeline(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("branch")))
    return (base | FilterRows(field="branch", op="==", value="F")).df.unionByName((base | FilterRows(field="branch", op="==", value="O")).df)


# --- report files

ROUND_TRIPS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "lineitem": ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"],
    "events": ["event_id", "user_id", "event_type", "props"],
}


def _round_trip(name: str, columns: list[str], key: str) -> None:
    @query(f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in columns)} FROM {name}", key)
    def run(spark, sf):
        return report(table(spark, sf, name).select(*(F.col(c).cast("string").alias(c) for c in columns)), name, columns=None).df


for _name, _columns in ROUND_TRIPS.items():
    _round_trip(_name, _columns, f"xml_roundtrip_{_name}")
_round_trip("documents", ["doc_id", "text"], "text_documents")
_round_trip("conversations", ["conv_id", "turn", "role", "text"], "text_conversations")
_round_trip("pages", ["page_id", "html"], "text_pages")


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, {FLAG} AS flag FROM lineitem")
def xml_empty_vs_missing(spark, sf):
    return report(flagged(spark, sf), "flags").df


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS even, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS fifth FROM orders")
def xml_ragged(spark, sf):
    return report(table(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END even", "CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END fifth"), "ragged", columns=None).df


def _lines(df: DataFrame, line: str, path: str) -> str:
    """A report whose rows are the text column `line`."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("<Report>\n" + "\n".join(r[0] for r in df.select(F.expr(line)).toLocalIterator()) + "\n</Report>")
    return path


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS x FROM nation")
def xml_dup_key(spark, sf):
    row = "concat('<Row><Field Name=\"key\"><Value>', n_nationkey, '</Value></Field><Field Name=\"x\"><Value>old</Value></Field><Field Name=\"x\"><Value>', n_name, '</Value></Field></Row>')"
    return ReportSource(_lines(table(spark, sf, "nation"), row, place("dup")), spark=spark).df


@query("SELECT CAST(r_regionkey AS VARCHAR) AS \"Level\", '0' AS \"Section\", r_name || '<&>\"' AS name FROM region")
def xml_sections(spark, sf):
    row = "concat('<!-- <Row/> --><Row Level=\"', r_regionkey, '\"><Section SectionNumber=\"0\"><Text Name=\"name\"><TextValue>', r_name, '&lt;&amp;&gt;&quot;</TextValue></Text></Section></Row>')"
    return ReportSource(_lines(table(spark, sf, "region"), row, place("sections")), spark=spark).df


@query("SELECT CAST(r_regionkey AS VARCHAR) AS key, '<&>\"\''é' || chr(128) || '€' || r_name AS name FROM region")
def xml_entities(spark, sf):
    row = "concat('<Row key=\"&#', 48 + r_regionkey, ';\"><Field Name=\"name\"><Value>&lt;&amp;&gt;&quot;&apos;&#233;&#128;&#x20AC;', r_name, '</Value></Field></Row>')"
    return ReportSource(_lines(table(spark, sf, "region"), row, place("entities")), spark=spark).df


@query("SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_returnflag FROM lineitem")
def xml_partitions(spark, sf):
    return report(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "parts", partitions=7, columns=None).df


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders")
def xml_memory_cap(spark, sf):
    return report(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "capped", memory="100KB").df


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'")
def xml_source_options(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    src = report(o, "options", field_mapping={"o_orderkey": "id", "o_totalprice": "price"}, drop_fields=["o_orderpriority"], field_types={"id": "int64", "price": "float64"}, filter={"field": "o_orderstatus", "op": "==", "value": "F"})
    return (src | DropFields(["o_orderstatus"])).df


# --- sinks


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def sink_parquet(spark, sf):
    path = place("customer.parquet")
    to_parquet(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return spark.read.parquet(path)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def sink_csv(spark, sf):
    path = place("nation.csv")
    to_csv(Pipeline(table(spark, sf, "nation").select("n_nationkey", "n_name")), path)
    return spark.read.option("header", True).csv(path)


@query("SELECT s_suppkey, s_name FROM supplier")
def sink_arrow(spark, sf):
    return spark.createDataFrame(Pipeline(table(spark, sf, "supplier").select("s_suppkey", "s_name")).to_arrow())


@query("""
SELECT column_name FROM (
  SELECT 'o_orderstatus' AS column_name, count(*) AS n, count(DISTINCT o_orderstatus) AS d FROM orders UNION ALL
  SELECT 'o_orderpriority', count(*), count(DISTINCT o_orderpriority) FROM orders UNION ALL
  SELECT 'o_orderkey', count(*), count(DISTINCT o_orderkey) FROM orders)
WHERE n >= 512 AND d <= greatest(16, least(256, n // 20))""")
def auto_dict_candidates(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string").alias("o_orderkey"))
    return spark.createDataFrame([(c,) for c in dictionary_candidates(o)], "column_name string")


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS price FROM orders WHERE o_totalprice = floor(o_totalprice)")
def rendered_whole(spark, sf):
    o = table(spark, sf, "orders")
    whole = ~rendered(col("o_totalprice"), o.schema["o_totalprice"].dataType).contains(".")
    return o.where(whole).select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


#: The first query: a report written, read, filtered and renamed.
@query("SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region WHERE r_name = 'ASIA'")
def report_flagship(spark, sf):
    src = report(table(spark, sf, "region").select("r_regionkey", "r_name"), "region")
    return (src | FilterRows(field="r_name", op="==", value="ASIA") | CastTypes({"r_regionkey": int}) | RenameFields({"r_regionkey": "id", "r_name": "name"})).df


