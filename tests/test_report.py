"""The report engine: flattening, splitting, stages, sinks."""

import random
import xml.etree.ElementTree as ET

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from rowloom import CastTypes, DropFields, FilterRows, OrderFields, Pipeline, PlanError, RenameFields, ReportSource, XmlError, collect, to_csv, to_dataframe
from rowloom.plans import memory_bytes
from rowloom.sources import blocks
from rowloom.sources.flatten import RowReader, flatten
from rowloom.sources.splits import chained, leads_to, ranges, rows_of, transfer

CASES = [
    (b'<Row a="1" b="2"/>', [[("a", "1"), ("b", "2")]]),
    (b'<Row><Field Name="n" FieldName="f"><Value>1</Value></Field></Row>', [[("n", "1")]]),
    (b'<Row><Field FieldName="f" Name="n"><Value>1</Value></Field></Row>', [[("f", "1")]]),
    (b'<Row><Field Name="n"><FormattedValue>x</FormattedValue><Value>y</Value></Field></Row>', [[("n", "y")]]),
    (b'<Row><Field Name="n"><FormattedValue>x</FormattedValue><Value></Value></Field></Row>', [[("n", "x")]]),
    (b'<Row><Field Name="n"/><Field Name="m"></Field></Row>', [[("n", ""), ("m", "")]]),
    (b'<Row><Field><Value>1</Value></Field><Text><TextValue>t</TextValue></Text></Row>', [[("Field", "1"), ("Text", "t")]]),
    (b'<Row><Section SectionNumber="3"><Field Name="n"><Value>1</Value></Field></Section></Row>', [[("Section", "3"), ("n", "1")]]),
    (b"<Row><Other>text</Other></Row>", [[("Other", "")]]),
    (b'<Row><Field Name="n"><Value><![CDATA[x]]></Value></Field></Row>', [[("n", "")]]),
    (b'<Row><Field Name="n"><Value>a<!-- c -->b</Value></Field></Row>', [[("n", "a")]]),
    (b'<Row><Field Name="n"><Value> 1 &amp; 2 </Value></Field></Row>', [[("n", " 1 & 2 ")]]),
    (b'<Row><Field Name="n"><Value>1</Value></Field><Field Name="m"><Value>2</Value></Field><Field Name="n"><Value>3</Value></Field></Row>', [[("n", "3"), ("m", "2")]]),
    (b"<RowItem/><Row/>", [[]]),
    (b"<!-- <Row/> --><![CDATA[<Row/>]]><?p <Row/>?><Row/>", [[]]),
    (b'<Row><Field Name="n"><Value>1', []),
    (b"", []),
    ('<Row><Field Name="é"><Value>日本</Value></Field></Row>'.encode(), [[("é", "日本")]]),
]


@pytest.mark.parametrize("data, rows", CASES)
def test_flatten(data, rows):
    assert flatten(data) == rows
    assert flatten(data, shapes=False) == rows


@pytest.mark.parametrize("data", [b'<Row><Field Name="n', b"<Row><Field Name='n'><Value>\xff</Value></Field></Row>"])
def test_malformed(data):
    with pytest.raises(XmlError):
        flatten(data)


@pytest.mark.parametrize("text", ["&nbsp;", "&copy=1", "a &lt b", "a & b", "&#0;", "&#xD800;", "&#99999999;", "&;", "&#x;"])
def test_unknown_entities(text):
    for data in (f'<Row><Field Name="n"><Value>{text}</Value></Field></Row>', f'<Row a="{text}"/>'):
        with pytest.raises(XmlError):
            flatten(data.encode())


def test_entities():
    assert flatten(b'<Row a="&quot;&apos;"><Field Name="n"><Value>&#128;&#x20ac;&amp;lt;&lt;&gt;</Value></Field></Row>') == [[("a", "\"'"), ("n", "\x80€&lt;<>")]]


def test_rendered_numbers(spark):
    """Shortest plain decimals, in the JVM and in Python."""
    from rowloom.functions import plain, rendered

    r = random.Random(2)
    values = [0.0, -0.0, 42.0, 0.1, 123456789.125, 1e15, 1e21, 1e-5, 5e-324, 1.7976931348623157e308, -2.5e-7, 2e23, 1e23, 2.0**-44, 9007199254740993.0, float("nan"), float("inf"), float("-inf"), 1 / 3, 100.0, 0.001, 12345678.9]
    values += [r.uniform(-1, 1) * 10 ** r.randrange(-20, 20) for _ in range(300)] + [float(f"{r.randrange(1, 10**6)}e{r.randrange(-9, 9)}") for _ in range(300)]
    d = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = [x[0] for x in d.select(rendered(d["v"], d.schema["v"].dataType)).collect()]
    assert got == [*map(plain, values), None]
    assert got[:9] == ["0", "-0", "42", "0.1", "123456789.125", "1" + 15 * "0", "1" + 21 * "0", "0.00001", "0." + 323 * "0" + "5"] and got[15:18] == ["NaN", "inf", "-inf"]
    f = spark.sql("SELECT EXPLODE(ARRAY(CAST(0.1 AS FLOAT), CAST(1e10 AS FLOAT), CAST(-1.5e-5 AS FLOAT))) AS v")
    assert [x[0] for x in f.select(rendered(f["v"], f.schema["v"].dataType)).collect()] == ["0.1", "10000000000", "-0.000015"]


def report_file(tmp_path, rows=700):
    path = tmp_path / "r.xml"
    path.write_text("<Report>" + "".join(f'<Row><Field Name="a"><Value>{k}</Value></Field><Field Name="b"><Value>v{k % 3}</Value></Field><Field Name="c"><Value>{k % 7}</Value></Field></Row>' for k in range(rows)) + "</Report>")
    return path


def test_dictionaries_through_stages(spark, tmp_path):
    path = report_file(tmp_path)
    is_dict = lambda p: {f.name: pa.types.is_dictionary(f.type) for f in p.to_arrow().schema}
    assert is_dict(ReportSource(path, auto_dict=True, spark=spark) | RenameFields({"b": "kind"}) | DropFields(["c"])) == {"a": False, "kind": True}
    assert is_dict(ReportSource(path, dictionary_columns=["b"], spark=spark) | RenameFields({"b": "kind"})) == {"a": False, "kind": True, "c": False}
    assert is_dict(ReportSource(path, spark=spark) | CastTypes({"c": "dictionary"})) == {"a": False, "b": False, "c": True}
    assert is_dict(ReportSource(path, auto_dict=True, spark=spark)) == {"a": False, "b": True, "c": True}


def test_dropped_columns_are_not_read(spark, tmp_path):
    src = ReportSource(report_file(tmp_path, 20), spark=spark)
    plan = lambda p: p.df._jdf.queryExecution().optimizedPlan().toString()
    p = src | RenameFields({"c": "z"}) | DropFields(["b", "z"])
    assert p.df.columns == ["a"] and "c#" not in plan(p) and "b#" not in plan(p)
    p = src | FilterRows(field="b", op="==", value="v1") | DropFields(["b", "c"])
    assert [r["a"] for r in p] == [str(k) for k in range(1, 20, 3)] and "c#" not in plan(p)
    p = src | RenameFields({"b": "a"}) | DropFields(["c"])
    assert [r["a"] for r in p][:2] == ["v0", "v1"]


def test_parallel_keeps_order(spark, tmp_path):
    src = ReportSource(report_file(tmp_path, 100), spark=spark, partitions=3)
    p = (src | FilterRows(field="b", op="!=", value="v1")).parallel(workers=4)
    assert [int(r["a"]) for r in p] == [k for k in range(100) if k % 3 != 1] and p.df.rdd.getNumPartitions() == 4


def test_batches(spark, tmp_path):
    src = ReportSource(report_file(tmp_path, 100), spark=spark, partitions=3, batch_size=40)
    assert [len(b) for b in src.batches()] == [40, 40, 20] and [len(b) for b in src.batches(33)] == [33, 33, 33, 1]
    assert [x for b in src.batches(7) for x in b["a"].to_pylist()] == [str(k) for k in range(100)]
    assert [r["a"] for r in src.next_batch(3) + src.next_batch(2)] == list("01234") and len(src.next_batch(1000)) == 95 and src.next_batch() == []
    assert to_dataframe(src, chunksize=30)["a"].tolist() == [str(k) for k in range(100)]
    assert src.schema() == ["a", "b", "c"] and list((src | FilterRows(field="a", op="==", value="x")).batches(5)) == []
    assert len(to_dataframe(src | FilterRows(field="a", op="==", value="x"), chunksize=5)) == 0


def test_format_plans_its_own_ranges(spark, tmp_path, monkeypatch):
    from rowloom.sources import register, report

    path = tmp_path / "r.xml"
    path.write_text("<Report>" + "".join(f"<!-- <Row a='x'/> --><Row a='{k}'/>\n" for k in range(500)) + "</Report>")
    reader = report.ReportReader({"path": str(path)}, spark.createDataFrame([], "a string").schema)
    monkeypatch.setattr(report, "RANGE", 2000)
    parts = reader.partitions()
    assert len(parts) > 5 and [x for p in parts for b in reader.read(p) for x in b["a"].to_pylist()] == [str(k) for k in range(500)]
    register(spark)
    assert spark.read.format("report_xml").load(str(path)).count() == 500


def test_collect_and_polars(spark, tmp_path):
    src = ReportSource(report_file(tmp_path, 4), spark=spark)
    assert collect(src)[3] == {"a": "3", "b": "v0", "c": "3"} == list(src)[3]
    src.persist()
    assert src.df.is_cached and src.df.count() == 4
    src.clear_cache()
    assert not src.df.is_cached
    pytest.importorskip("polars")
    assert src.to_polars()["a"].to_list() == list("0123")


def random_report(seed: int, rows: int = 60) -> bytes:
    r, out = random.Random(seed), ["<?xml version='1.0'?><Report>"]
    for _ in range(rows):
        if r.random() < 0.1:
            out.append("<!-- <Row><Field Name='x'/></Row> -->")
        level = f' Level="{r.randrange(3)}"' if r.random() < 0.7 else ""
        fields = "".join(f'<Field Name="{n}"><Value>{r.choice(["", "a", "&lt;b&gt;", "é", "日本", "1.5", " x "])}</Value></Field>' for n in ("a", "b", "c", "d") if r.random() < 0.65)
        out.append(f"<Group><Row{level}>{fields}</Row></Group>")
    return "\n".join([*out, "</Report>"]).encode()


def by_tree(data: bytes) -> list:
    return [[*e.attrib.items(), *((f.get("Name"), f.find("Value").text or "") for f in e)] for e in ET.fromstring(data).iter("Row")]


@pytest.mark.parametrize("seed", range(4))
def test_against_a_tree_in_any_ranges(seed, tmp_path):
    data = random_report(seed)
    assert flatten(data) == flatten(data, shapes=False) == by_tree(data)
    path = tmp_path / "r.xml"
    path.write_bytes(data)
    for count in (1, 2, 5, 40):
        parts = ranges(str(path), len(data), count)
        states = chained([transfer(data[a:b]) for a, b in parts])
        got = [row for (a, b), s in zip(parts, states, strict=True) for _, row in rows_of(str(path), a, b, len(data), s, RowReader("Row"))]
        assert got == by_tree(data)


def mixed_report(seed: int, rows: int = 120) -> bytes:
    """Many shapes, both kinds of quotes, entities, comments, CDATA, repeated names, texts that no value takes."""
    r, out = random.Random(seed), ["<?xml version='1.0'?><Report>"]
    values = ["", "a", "&lt;b&gt;", "é", "日本", " x ", '"q"', "long " * 40]
    for _ in range(rows):
        out.append(r.choices(["", "<!-- <Row><Field Name='x'/></Row> -->", "<![CDATA[ <Row/> ]]>"], [94, 3, 3])[0])
        quote = r.choice("\"\"\"'")
        attrs = r.choice(["", f" Level={quote}{r.randrange(3)}{quote}", ' B="a&lt;Row x>"', ' C=""'])
        body = "".join(f'<Field Name="{n}"><FormattedValue>{r.choice(["", "q"])}</FormattedValue><Value>{r.choice(values)}</Value></Field>\n' for n in "abcd" if r.random() < 0.65)
        more = ['<Section SectionNumber="7"/><Other>some text</Other><Text Name="t"><TextValue>v</TextValue></Text>', '<Field Name="a"><!-- c --><Value>z</Value></Field>', '<Field Name="a"><Value>dup</Value></Field>']
        out.append(f"<Group><Row{attrs}>{body}{r.choices(['', *more], [85, 5, 5, 5])[0]}</Row></Group>" if r.random() < 0.95 else '<Row a="1"/><RowItem/>')
    return "\n".join([*out, "</Report>"]).encode()


@pytest.mark.parametrize("seed", range(6))
def test_blocks_read_what_tokens_read(seed, tmp_path, monkeypatch):
    data, names = mixed_report(seed), [*"abcdtBC", "Level", "Section", "Other", "Field"]
    path = str(tmp_path / "r.xml")
    (tmp_path / "r.xml").write_bytes(data)
    want = [tuple(dict(row).get(n) for n in names) for row in flatten(data, shapes=False)]
    assert [tuple(dict(row).get(n) for n in names) for row in flatten(data)] == want
    for block, tail in ((1 << 21, 1 << 16), (3000, 500), (200, 3)):
        monkeypatch.setattr(blocks, "BLOCK", block)
        monkeypatch.setattr(blocks, "TAIL", tail)
        for count in (1, 3, 11):
            parts = ranges(path, len(data), count)
            states = chained([transfer(data[a:b]) for a, b in parts])
            got = [tuple(x.values()) for (a, b), s in zip(parts, states, strict=True) for t in blocks.BlockReader("Row", names).read(path, a, b, len(data), s) for x in t.to_pylist()]
            assert got == want


def test_states():
    assert [leads_to(b"<a><!-- x", s) for s in range(4)] == [1, 1, 2, 3]
    assert leads_to(b"x --> <![CDATA[ ]]> <?p", 1) == 3


def test_source(spark, tmp_path):
    data = random_report(9)
    path = tmp_path / "r.xml"
    path.write_bytes(data)
    whole = collect(ReportSource(path, spark=spark), drop_missing=True)
    assert whole == [dict(r) for r in by_tree(data)]
    many = ReportSource(path, spark=spark, partitions=6)
    assert collect(many, drop_missing=True) == whole and many.df.rdd.getNumPartitions() > 1
    assert "Exchange" not in many.df._jdf.queryExecution().executedPlan().toString()
    assert [r["a"] for r in ReportSource(path, spark=spark, drop_fields=["b"])] == [r.get("a") for r in whole]
    with pytest.raises(FileNotFoundError):
        ReportSource(tmp_path / "none")
    with pytest.raises(ValueError):
        ReportSource(path, filter={"op": ">", "field": "a", "value": "1"})
    with pytest.raises(PlanError):
        ReportSource(path, field_types={"a": "date"})


def test_empty_reports(spark, tmp_path):
    for text in ("", "<Report></Report>"):
        path = tmp_path / "e.xml"
        path.write_text(text)
        assert collect(ReportSource(path, spark=spark)) == [] and ReportSource(path, spark=spark).schema() == []


def test_types_and_dictionary(spark, tmp_path):
    path = tmp_path / "t.xml"
    path.write_text('<R><Row><Field Name="n"><Value>42</Value></Field><Field Name="t"><Value>x</Value></Field></Row><Row><Field Name="n"><Value>N/A</Value></Field></Row></R>')
    src = ReportSource(path, spark=spark, field_types={"n": "int64", "t": "dictionary"})
    t = src.to_arrow()
    assert t["n"].to_pylist() == [42, None] and pa.types.is_dictionary(t.schema.field("t").type)
    assert collect(src | FilterRows(field="n", op="==", value="42") | DropFields(["t"])) == [{"n": 42}]


def test_memory():
    assert [memory_bytes(x) for x in (None, 5, "1KB", "2", "1.5mb")] == [None, 5, 1024, 2 << 30, 3 << 19]
    with pytest.raises(ValueError):
        memory_bytes("many")


PEOPLE = [{"name": "A", "age": "30", "city": "X"}, {"name": "B", "age": "5", "city": "Y"}, {"name": "C", "age": "41", "city": None}]
CHAINS = [
    [RenameFields({"name": "n"})], [RenameFields({"name": "city", "city": "name"})], [DropFields(["age", "none"])], [CastTypes({"age": int})],
    [FilterRows(field="city", op="!=", value="X")], [FilterRows(field="city", op="==", value="X")], [FilterRows(field_a="age", op=">", field_b="age")],
    [FilterRows(field="age", op="!=", value="5"), FilterRows(field="name", op="!=", value="A"), RenameFields({"age": "years"})],
    [CastTypes({"age": int}), FilterRows(lambda r: r["age"] > 10), DropFields(["city"])], [OrderFields(["city", "age"])],
]


@pytest.mark.parametrize("chain", CHAINS)
def test_plans_match_plain_dicts(spark, chain):
    p, plain = Pipeline(PEOPLE, spark=spark), list(PEOPLE)
    for s in chain:
        p, plain = p | s, list(s(plain))
    assert collect(p) == plain


def test_stage_errors(spark):
    with pytest.raises(TypeError):
        DropFields("age")
    with pytest.raises(ValueError):
        FilterRows(field="a", op=">", value="1")
    with pytest.raises(PySparkException, match="age"):
        collect(Pipeline([{"age": "x"}], spark=spark) | CastTypes({"age": int}))
    assert collect(Pipeline([{"age": "x"}], spark=spark) | CastTypes({"age": int}, errors="coerce")) == [{"age": None}]
    with pytest.raises(PlanError):
        (Pipeline([{"a": "x", "b": 1}], spark=spark) | FilterRows(field_a="a", op="<", field_b="b")).df
    assert len(collect(Pipeline(PEOPLE, spark=spark) | DropFields(["name", "age", "city"]))) == 3
    assert collect(Pipeline(iter([]), spark=spark)) == []
    with pytest.raises(TypeError):
        (Pipeline(PEOPLE, spark=spark) | _Locked()).parallel()


class _Locked:
    def __init__(self):
        import threading

        self.lock = threading.Lock()

    def apply(self, r):
        return r


@pytest.mark.parametrize("text, value", [("+1", 1), (" 1", None), ("1.0", None), ("", None), ("99999999999999999999", None), ("-7", -7)])
def test_int_grammar(spark, text, value):
    assert collect(Pipeline([{"x": text}], spark=spark) | CastTypes({"x": int}, errors="coerce")) == [{"x": value}]


@pytest.mark.parametrize("text, value", [("1.", 1.0), (".5", 0.5), ("1e3", 1000.0), ("3.0f", None), ("inf", float("inf")), ("x", None)])
def test_float_grammar(spark, text, value):
    assert collect(Pipeline([{"x": text}], spark=spark) | CastTypes({"x": float}, errors="coerce")) == [{"x": value}]


def test_sinks(spark, tmp_path):
    p = Pipeline(PEOPLE, spark=spark)
    assert to_dataframe(p).shape == to_dataframe(p, chunksize=1).shape == (3, 3)
    to_csv(p, tmp_path / "p.csv")
    assert (tmp_path / "p.csv").read_bytes() == b"name,age,city\r\nA,30,X\r\nB,5,Y\r\nC,41,\r\n"
    with pytest.warns(UserWarning, match="'c'"):
        to_csv([{"a": 1, "b": 2}, {"a": 3, "c": 4}], tmp_path / "q.csv")
    to_csv([], tmp_path / "e.csv")
    assert (tmp_path / "e.csv").read_bytes() == b""
    p.to_parquet(tmp_path / "p.parquet")
    assert spark.read.parquet(str(tmp_path / "p.parquet")).count() == 3


def test_branches_and_parallel(spark):
    base = Pipeline(PEOPLE, spark=spark)
    a, b = base | FilterRows(field="name", op="==", value="A"), base | FilterRows(field="name", op="!=", value="A")
    assert (len(collect(a)), len(collect(b)), len(collect(base))) == (1, 2, 3)
    assert sorted(r["name"] for r in collect(b.parallel(2))) == ["B", "C"]


def test_unstable_keys(spark):
    class Late:
        def apply(self, r):
            return r | {"late": 1} if r["k"] == 1999 else r

    with pytest.raises(PySparkException, match="stable key set"):
        collect(Pipeline([{"k": k} for k in range(2000)], spark=spark) | Late())
