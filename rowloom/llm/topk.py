"""Exact top-k inner-product search over norm-sorted vectors.

All candidates are sorted into bands by descending length. Bands are searched in waves, the longest vectors first, and
every query carries its k-th score so far: by Cauchy-Schwarz it meets only bands whose greatest length can still reach
that score, and a band is sent only to the query blocks that ask for it. Vectors are rotated by the right singular
vectors of all candidates (from their Gram matrix, summed over every row), so that leading partial sums carry most of
a product: within a block only pairs whose partial sum plus the product of their residual lengths can reach the k-th
score are computed. Scores are exact integers; those beyond 64 bits are held at the ends of the range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm.common import parts, table, written

#: Rows of a query block and, at most, of a candidate block; candidates looked at in one step; bands, and rows that make
#: one, about (more go to blocks within it).
QUERY_ROWS, BLOCK_ROWS, STEP, BANDS, BAND_ROWS = 2048, 16384, 2048, 64, 1024
#: Integer products below EXACT are exact in doubles, below WIDE in 64 bits.
EXACT, WIDE = float(1 << 52), float(1 << 62)
LARGEST = 1.7976931348623157e308


def integers(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component, as doubles (held at the largest double). Rows with a null id, a
    null vector, or a null or non-finite component take no part; an empty vector does, with every product 0. Other
    columns are left out."""
    d = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    d = d.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", fine))
    held = lambda y: F.greatest(F.least(y, F.lit(LARGEST)), F.lit(-LARGEST))
    floored = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(held(y))  # noqa: E731  beyond, doubles are whole
    return d.select("vec_id", F.transform("x", lambda x: floored(x * scale)).alias("v"))


def _matrix(column: pd.Series | list, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


#: Ends of the scores' range; NONE, below it, is no score, and its negative is a number too.
NONE = -np.iinfo(np.int64).max
LOW, HIGH = NONE + 1, np.iinfo(np.int64).max


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, as int64."""
    top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if top >= WIDE:
        x, y = ([[int(v) for v in row] for row in m] for m in (a, b))
        rows = [[min(max(sum(p * q for p, q in zip(s, t, strict=True)), LOW), HIGH) for t in y] for s in x]
        return np.array(rows, dtype=np.int64).reshape(len(a), len(b))
    if top >= EXACT:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a @ b.T).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of every row, ties to smaller ids; ids: one row for all, or one for each."""
    ids = np.broadcast_to(ids, scores.shape)
    if scores.shape[1] > 4 * k:
        # All above the k-th score and, of those equal to it, as many smallest ids as are missing.
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
        above, level = scores > kth, scores == kth
        missing = k - above.sum(axis=1, keepdims=True)
        if (level.sum(axis=1, keepdims=True) > missing).any():
            order = np.argsort(ids, axis=1, kind="stable")
            sorted_level = np.take_along_axis(level, order, axis=1)
            keep = sorted_level & (np.cumsum(sorted_level, axis=1) <= missing)
            level = np.zeros_like(level)
            np.put_along_axis(level, order, keep, axis=1)
        place = np.nonzero(above | level)[1].reshape(len(scores), k)
        scores, ids = np.take_along_axis(scores, place, axis=1), np.take_along_axis(ids, place, axis=1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def search_block(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, c_ids: np.ndarray, c: np.ndarray, rotation: np.ndarray, k: int, lead: int, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of every query's k best of this block (NONE where there are fewer). floors: a score that is already
    reached k times elsewhere (NONE: none is); what stays below it may be left out. seen: gets the numbers of pairs."""
    with np.errstate(over="ignore", invalid="ignore"):
        order = np.argsort(-np.einsum("ij,ij->i", c, c), kind="stable")
    c_ids, c = c_ids[order], c[order]
    scores, ids = np.full((len(q), k), NONE), np.full((len(q), k), NONE)
    huge = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(c.shape[1], 1) >= WIDE  # no bounds in doubles
    if not huge:
        lengths, q_lengths = np.linalg.norm(c, axis=1), np.linalg.norm(q, axis=1)
        turned, q_turned = c @ rotation, q @ rotation
        rest, q_rest = np.linalg.norm(turned[:, lead:], axis=1), np.linalg.norm(q_turned[:, lead:], axis=1)
    live = np.arange(len(q))
    for a in range(0, len(c), STEP):
        block, block_ids = c[a : a + STEP], c_ids[a : a + STEP]
        can = np.ones((len(live), len(block)), dtype=bool)
        if not huge:
            kth = np.maximum(scores[live, k - 1], floors[live]).astype(np.float64)
            slack = 1e-9 * q_lengths[live] * lengths[a] + 1e-6
            reach = (kth == float(NONE)) | (q_lengths[live] * lengths[a] + slack >= kth)
            live, kth, slack = live[reach], kth[reach], slack[reach]
            if not len(live):
                break
            bound = q_turned[live, :lead] @ turned[a : a + STEP, :lead].T + np.outer(q_rest[live], rest[a : a + STEP])
            can = bound + slack[:, None] >= kth[:, None]
        some = can.any(axis=0)
        if seen is not None:
            seen["pairs"] = seen.get("pairs", 0) + int(can.sum())
        if not some.any():
            continue
        found = _dot(q[live], block[some])
        found[~can[:, some] | (q_ids[live][:, None] == block_ids[some][None, :])] = NONE
        s = np.concatenate([scores[live], found], axis=1)
        i = np.concatenate([ids[live], np.broadcast_to(block_ids[some], found.shape)], axis=1)
        scores[live], ids[live] = _best(s, i, k)
    return scores, ids


def _rotation(rows: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """The right singular vectors of all rows, strongest first, and how many of them carry most of the products. Any
    rotation is right, so components are limited for it to what can be squared and summed."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros((width, width)), TaskContext.get().partitionId() % 64
        for b in batches:
            x = _matrix(b["v"].to_pylist(), width).clip(-1e100, 1e100)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([part] * width, pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "part", "row"])

    def added(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b) for b in t["row"].to_pylist()], axis=0)
        return pa.table({"i": t["i"][:1], "part": t["part"][:1], "row": pa.array([total.tobytes()], pa.binary())})

    schema, square = "i int, part int, row binary", np.zeros((width, width))
    summed = rows.select("v").mapInArrow(sums, schema).groupBy("i", "part").applyInArrow(added, schema).groupBy("i").applyInArrow(added, schema)
    for r in summed.collect():  # width rows of width numbers
        square[r["i"]] = np.frombuffer(bytes(r["row"]))
    power, rotation = np.linalg.eigh((square + square.T) / max(2 * np.abs(square).max(initial=0), 1e-300))
    power, rotation = np.maximum(power[::-1], 0), rotation[:, ::-1]
    share = np.cumsum(power) / max(power.sum(), 1e-300)
    return rotation.copy(), int(min(width, np.searchsorted(share, 0.7) + 1))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, band_rows: int = BAND_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of queries (vec_id, v) the k highest inner products among rows
    (vec_id, v); rows with the query's own vec_id are left out, ties go to smaller ids, repeated rows count each.

    Shorter vectors are filled with zeros. Queries that repeat a vec_id are asked once (the first by its vector).
    Scores beyond 64 bits count as the range's ends. No candidates or no queries: no rows.
    """
    spark = rows.sparkSession
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    rows = written(rows.select("vec_id", "v", length.alias("length")), "vectors")
    queries = written(queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("length", length), "queries")
    (n, width), m = rows.agg(F.count("*"), F.max(F.size("v"))).first(), queries.count()
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, queries.agg(F.max(F.size("v"))).first()[0], 1)
    rotation, lead = _rotation(rows, width)
    turn = spark.sparkContext.broadcast(rotation)

    # Bands by descending length, at most BANDS; equal lengths share one. Their sizes and greatest lengths: a row each.
    count = min(BANDS, parts(n, band_rows))
    cuts = sorted(set(rows.approxQuantile("length", [j / count for j in range(1, count)], 0.1 / count))) if count > 1 else []
    band = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x > F.col("length"))) if cuts else F.lit(0)
    rows = rows.withColumn("band", band.cast("int"))
    sizes = sorted((r["band"], r["n"], r["top"]) for r in rows.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("top")).collect())
    blocks = F.create_map(*(F.lit(x) for b, size, _ in sizes for x in (b, parts(size, BLOCK_ROWS))))
    tops = [(b, top) for b, _, top in sizes]
    deal = lambda count: F.pmod(F.xxhash64(F.lit(3), "vec_id", F.monotonically_increasing_id()), count).cast("int")
    candidates = rows.withColumn("b", deal(blocks[F.col("band")]))
    queries = queries.withColumn("qb", deal(F.lit(parts(m, QUERY_ROWS))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        q_ids, c_ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        if not len(q_ids) or not len(c_ids):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        s, i = search_block(q_ids, _matrix(left["v"], width), left["floor"].to_numpy(), c_ids, _matrix(right["v"], width), turn.value, k, lead)
        out = pd.DataFrame({"query_id": np.repeat(q_ids, k), "vec_id": i.ravel(), "score": s.ravel()})
        return out[(out["score"] != NONE) & (out["score"] >= np.repeat(left["floor"].to_numpy(), k))]

    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, done, wave = None, 0, 1
    while done < len(tops):
        now, done, wave = tops[done : done + wave], done + wave, 4 * wave
        asked = queries.withColumn("floor", F.lit(NONE))
        if best is not None:
            floors = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
            asked = queries.join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE)))
        reach = lambda top: (F.col("floor") == NONE) | (F.col("length") * top * (1 + 1e-9) + 1e-6 >= F.col("floor")) | F.lit(top * top >= WIDE) | (F.col("length") >= WIDE**0.5)
        meets = F.array(*(F.when(reach(top), F.lit(b)) for b, top in now))
        asked = asked.select("qb", "vec_id", "v", "floor", F.explode(F.array_compact(meets)).alias("band"))
        pairs = written(asked.select("band", "qb").distinct(), "pairs")  # bands x query blocks
        c = candidates.where(F.col("band").isin([b for b, _ in now])).join(pairs, "band").select("band", "b", "qb", "vec_id", "v")
        q = asked.withColumn("b", F.explode(F.sequence(F.lit(0), blocks[F.col("band")] - 1))).select("band", "b", "qb", "vec_id", "v", "floor")
        keys = ["band", "b", "qb"]
        met = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score long")
        met = met if best is None else met.unionByName(best)
        best = written(met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "vec_id", "score"), "best")
    return best.withColumn("rank", F.row_number().over(by)).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where("vec_id % 20 = 0"), 20)


OP6_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
