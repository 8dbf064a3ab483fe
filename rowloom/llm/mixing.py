"""Mixing sources to target weights.

Rows get hash-random keys; within each source they are dealt to key ranges, sums of whole ranges are added up
first and sums within a range second (a distributed prefix sum), and the mix is cut at each source's budget;
whole epochs come before the cut one. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm.common import fresh_names, parts, table, words, written

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (3, 1, 2)
#: Rows in a key range, about.
RANGE_ROWS = 4096


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target. Targets share `share` of all sizes by weight; none is above `most` times its
    source's size, and what that leaves is shared again by weight. The level all uncapped sources reach is found
    in one pass over the sources in order of cap / weight. Rows are sources, not documents."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_cap = Window.orderBy("ratio", "place")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("place", F.row_number().over(by_name)).withColumn("weight", w.cast("double"))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", share * F.sum("source_size").over(Window.partitionBy()))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("left", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
    # The first source whose level stays below its ratio sets the level of all that follow.
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(Window.partitionBy())
    s = s.withColumn("level", first["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", target.alias("target"))


def _key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _ranged(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows: doc_id, source, size, key, th, range. Ranges of each source: words of the ranges before, the source's size,
    target, whole epochs, and rest: what the cut epoch takes."""
    light = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), _key(seed).alias("key"), F.xxhash64("text").alias("th"))
    light = written(light, "sizes")
    n = parts(light.count(), RANGE_ROWS)
    # A range is the key's leading 28 bits, scaled: even, whatever share of the rows one source holds.
    rank = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
    light = light.withColumn("range", F.floor(rank * n / F.lit(1 << 28)).cast("long"))
    ranges = light.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    totals = targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    budget, size = F.floor("target").cast("long"), F.col("source_size")
    totals = totals.withColumn("epochs", F.when(size > 0, F.floor(budget / size).cast("long")).otherwise(F.lit(0).cast("long"))).withColumn("rest", budget - F.col("epochs") * size)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    r, t = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0))).alias("r"), totals.alias("t")
    both = r.join(t, F.col("r.source").eqNullSafe(F.col("t.source")))
    return light, both.select("r.source", "range", "range_size", "before", "source_size", "target", "epochs", "rest")


def _running() -> Column:
    """Words of a range up to a row and with it; equal rows in any order."""
    return F.sum("size").over(Window.partitionBy("source", "range").orderBy("key", "size", "th").rowsBetween(Window.unboundedPreceding, 0))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0, extra: dict[str, str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (and source, if asked for as extra={"name": "source"}), a row per row of
    docs; docs' other columns are left out.

    size: words of the whole text (0 for null or empty). taken: size in every whole epoch, and in the last one what the
    budget (target, rounded down) still allows, in order of a hash of the seed and doc_id; equal ones by size and text
    hash, rows that repeat one after another. A null source is a source. A source without words takes nothing. Empty
    table: no rows.
    """
    light, ranges = _ranged(docs, weights, share, most, seed)
    light, o = light.withColumn("upto", _running()).alias("l"), ranges.alias("o")
    out = light.join(o, F.col("l.source").eqNullSafe(F.col("o.source")) & (F.col("l.range") == F.col("o.range")))
    left = F.col("rest") - (F.col("before") + F.col("upto") - F.col("size"))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return out.select("l.doc_id", "l.size", "source_size", "target", taken.alias("taken"), *(F.col(f"l.{c}").alias(k) for k, c in (extra or {}).items()))


def _cuts(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int) -> DataFrame:
    """source, epochs, and where the cut epoch ends: the row (key, size, th) that holds its last word and how many words
    each row like it gives; no such row where whole epochs are all. A row per source; only ranges with a cut are sorted."""
    light, ranges = _ranged(docs, weights, share, most, seed)
    ranges = written(ranges, "ranges")
    cut = ranges.where("rest > 0 AND before < rest AND rest <= before + range_size").alias("c")
    there = light.alias("l").join(cut, F.col("l.source").eqNullSafe(F.col("c.source")) & (F.col("l.range") == F.col("c.range")))
    there = there.select("l.source", "l.range", "l.key", "l.size", "l.th", "before", "rest").withColumn("upto", F.col("before") + _running())
    alike = there.groupBy("source", "key", "size", "th").agg(F.count("*").alias("rows"), F.max("upto").alias("upto"), F.first("rest").alias("rest"))
    first = F.col("upto") - F.col("rows") * F.col("size")
    last = alike.where((first < F.col("rest")) & (F.col("rest") <= F.col("upto"))).select("source", "key", "size", "th", F.expr("(rest - (upto - rows * size)) DIV rows").alias("words")).alias("l")
    sources = ranges.groupBy("source").agg(F.first("epochs").alias("epochs")).alias("s")
    return sources.join(last, F.col("s.source").eqNullSafe(F.col("l.source")), "left").select("s.source", "epochs", "key", "size", "th", "words")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """The mix itself, with docs' columns: a document as often as it is taken whole, and the one at the cut as far as the
    budget goes. Rows that repeat are taken alike: at the cut they share what is left of the budget. Null, empty and
    wordless texts are never taken. Documents are not moved: each is compared with its source's cut. Empty table: no rows.
    """
    cuts = written(_cuts(docs, weights, share, most, seed), "cuts")
    source, epochs, key, size, th, some, own, n, part = fresh_names(docs, "source", "epochs", "key", "size", "th", "some", "own", "n", "part")
    d = docs.where(docs["text"].rlike(r"[^\x20\x09-\x0D]")).withColumn(own, _key(seed))
    d = d.join(cuts.toDF(source, epochs, key, size, th, some), F.col("source").eqNullSafe(F.col(source)))
    # Words are counted only of rows that have the cut row's own key.
    mine, its = F.struct(F.size(words(F.col("text"))).cast("long"), F.xxhash64("text")), F.struct(size, th)
    last = F.when(F.col(key).isNull() | (F.col(own) > F.col(key)), F.lit(0).cast("long")).when(F.col(own) < F.col(key), F.lit(-1).cast("long"))
    last = last.when(mine < its, F.lit(-1).cast("long")).when(mine > its, F.lit(0).cast("long")).when(F.col(some) == F.col(size), F.lit(-1).cast("long")).otherwise(F.col(some))
    d = d.withColumn(n, last)  # words of the cut epoch: none, so many, or -1 for all
    copies = F.concat(F.expr(f"array_repeat(-1L, CAST({epochs} AS INT))"), F.when(F.col(n) == 0, F.array().cast("array<long>")).otherwise(F.array(n)))
    d = d.withColumn(part, F.explode(copies))
    cut = F.expr(f"array_join(slice(regexp_extract_all(text, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0), 1, CAST({part} AS INT)), '')")
    text = F.when(F.col(part) >= 0, cut).otherwise(F.col("text"))
    chars = lambda c: F.when(F.col(part) >= 0, F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return d.select(*(text.alias(c) if c == "text" else chars(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS place FROM s),
w AS (SELECT *, CAST(CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM p),
l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
m AS (SELECT arg_min(level, (cap / weight, place)) AS level FROM l WHERE level <= cap / weight),
t AS (SELECT source, source_size, least(cap, coalesce(m.level * weight, cap)) AS target FROM l, m),
x AS (SELECT doc_id, source, size, key, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM d),
e AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t)
SELECT doc_id, size, source_size, target,
  epochs * size + greatest(0, least(size, budget - epochs * source_size - (upto - size))) AS taken
FROM x JOIN e ON x.source IS NOT DISTINCT FROM e.source
"""
