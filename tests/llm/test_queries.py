"""Registered queries on the smallest tables: against DuckDB, or for their contract's laws."""

import collections
import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from rowloom.llm import registry
from tests_tables import SF, TABLES, bag

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.QUERIES[name](spark, SF)
    got = con.execute(registry.SQL[name])
    names = [d[0] for d in got.description]
    assert bag([tuple(r) for r in df.collect()], df.columns) == bag(got.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_covers_all_documents(spark, name):
    docs = collections.Counter(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert {r["doc_id"] for r in registry.QUERIES[name](spark, SF).collect()} == set(docs)


def rows_of(spark, name):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    return docs, registry.QUERIES[name](spark, SF).collect()


def test_laws_of_packing(spark):
    docs, rows = rows_of(spark, "op2_pack_windows")
    used, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    for spans, end in [*((s, None) for s in used.values()), *(([p[:2] for p in d], d[0][2]) for d in by_doc.values())]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == end if end else at <= 2048
    assert sum(r["length"] for r in rows) > 0.97 * 2048 * len(used)


@pytest.mark.parametrize("name", ["op4_language_id", "op10_toxicity"])
def test_laws_of_held_out(spark, name):
    docs, rows = rows_of(spark, name)
    assert len(rows) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    if name == "op4_language_id":
        learned = {d["lang"] for d in docs.values()}
        assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, docs[r["doc_id"]]["text"] or ""))) and r["lang_pred"] in learned | {"und"} for r in rows)
    else:
        assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_laws_of_sharding(spark):
    docs, rows = rows_of(spark, "op7_kd_shards")
    text = {k: (d["text"] or "").encode() for k, d in docs.items()}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    sizes = collections.Counter()
    for shard in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
        sizes[shard] = sum(r["size"] for r in rows if r["shard"] == shard)
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 8 + 2 * max(map(len, text.values()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, columns = docs.count(), docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < 4:
            assert docs.columns == columns
        if k < 3:
            assert 0.5 * rows < docs.count() <= rows
    assert corpus_pipeline.run(spark, SF).count() == docs.count() > 0
