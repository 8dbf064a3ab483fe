"""Quality rules with host verdicts.

Rules count on every whole text; failures are summed by host, each host's failure rate is shrunk towards the
rate of all hosts by a beta prior fitted to the hosts (moments), and hosts above a limit are joined back to
their documents. DataFrame functions only. Per document no row leaves its task; the narrow table of counts is
written once, so texts are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import SPACES, table, words, written

SYMBOLS = "#*$%&|<>"


def counts(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source") -> DataFrame:
    """doc_id, host and the counts of every text. Null text has no words. Repeated rows each get their counts.

    n_repeat_words finds equal 3-word windows by a 64-bit hash inside one text."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("w", words(F.col("text")))
    d = d.select("doc_id", "host", "text", "w", F.size("w").alias("n"))
    d = d.withColumn("g", F.expr("IF(n < 3, CAST(array() AS array<bigint>), transform(slice(w, 1, n - 2), (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))))"))
    d = d.withColumn("s", F.sort_array("g"))
    # Most texts repeat no window; for these the places are never looked at.
    repeats = F.exists(F.zip_with(F.expr("slice(s, 1, greatest(size(s) - 1, 0))"), F.expr("slice(s, 2, greatest(size(s) - 1, 0))"), lambda a, b: a == b), lambda x: x)
    d = d.withColumn("again", repeats)
    d = d.withColumn("at", F.expr("IF(again, sort_array(transform(g, (x, i) -> struct(x AS h, i AS p))), CAST(array() AS array<struct<h: bigint, p: int>>))"))
    twice = F.expr("filter(at, (x, i) -> (i > 0 AND get(at, i - 1).h = x.h) OR (i + 1 < size(at) AND get(at, i + 1).h = x.h))")
    places = F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    d = d.withColumn("lines", lines)
    kept_chars = lambda drop: F.length(F.translate(F.col("text"), drop, "")).cast("long")
    return d.select(
        "doc_id", "host", F.col("n").cast("long").alias("n_words"), kept_chars(SPACES).alias("word_chars"),
        (F.length("text").cast("long") - kept_chars(SYMBOLS)).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), F.size(F.array_distinct(places))).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def host_rules(docs: DataFrame, max_rate: float = 0.5, min_words: int = 50, max_repeat: int = 50, **names) -> DataFrame:
    """counts() with base_failed, host_rate (shrunk share of failures of the host) and kept.

    A document is kept if it passes the base rules and its host's shrunk rate is at most max_rate. A null host
    counts as one host. With one host, or hosts that all agree, the prior has the weight of one document; an
    empty table gives no rows.
    """
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    seen = written(counts(docs, **names).withColumn("base_failed", base), "counts")
    hosts = seen.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("bad"))
    rate = F.col("bad") / F.col("n")
    mean, var = hosts.agg(F.avg(rate), F.var_pop(rate)).first()  # two numbers
    mean, var = mean or 0.0, var or 0.0
    weight = min(max(mean * (1 - mean) / var - 1, 1.0), 1e6) if var > 0 else 1.0
    shrunk = (F.col("bad") + mean * weight) / (F.col("n") + weight)
    judged = hosts.select(F.col("host").alias("h"), shrunk.alias("host_rate"))
    out = seen.join(judged, seen["host"].eqNullSafe(judged["h"]), "left").drop("h")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (
  SELECT d.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep ON d.r = rep.r LEFT JOIN l ON d.r = l.r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS BIGINT)) AS bad FROM f GROUP BY source),
p AS (SELECT avg(bad / n) AS mean, var_pop(bad / n) AS var FROM h),
k AS (SELECT mean, CASE WHEN var > 0 THEN least(greatest(mean * (1 - mean) / var - 1, 1), 1e6) ELSE 1 END AS weight FROM p),
v AS (SELECT source, (bad + mean * weight) / (n + weight) <= 0.5 AS good FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
