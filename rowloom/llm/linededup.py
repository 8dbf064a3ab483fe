"""Line dedup by a deletion-neighbourhood join.

Later copies of a line go, and lines within max_edits word edits (insert, delete, replace) of an earlier line. Equal
lines are first reduced to one representative. A representative emits, for every place of an edit in it, a hashed key
of what the edit leaves alone: two lines are within the bound exactly if they share such a key. So each key points its
lines to its earliest line, a group makes as many rows as it has lines, never its pairs, and the edit distance is
verified on the words. DataFrame functions only.

Before that, for one edit, a lossless check by halves: one edit leaves the first or the last half of the words alone,
so a line whose halves no other line has emits nothing. Lines are split and hashed once; later steps read the table of
their hashes, and the texts again only where a line must emit or goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import bitmap, flagged, fresh_names, let_through, line_words, table, written

#: Words that a line needs for each edit allowed to be a near copy: one edit in four words leaves a similarity under
#: 0.8. Exact copies go whatever their length.
MIN_WORDS = 5
HALVES = ("a0", "a1", "a2", "a3")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text")


def _lines(texts: DataFrame) -> DataFrame:
    """id, th, line_no, line, w, n: every line of every text and its words. The words pass through a generator, so that
    what is computed from them does not split the line again."""
    d = texts.select("id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    d = d.select("id", "th", "line_no", "line", F.explode(F.array(line_words(F.col("line")))).alias("w"))
    return d.withColumn("n", F.size("w"))


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2")]


def _place() -> Column:
    """Orders lines: by doc_id (null last), then text, then line number."""
    return F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("line_no").alias("line_no"))


def _half_keys() -> list[Column]:
    """Hashes of the first and last half of w, under the even word numbers that n shares with n - 1 and n + 1."""
    low, m = "n - n % 2", "CAST((n - n % 2) / 2 AS INT)"
    keys = [f"xxhash64({low}, 0, slice(w, 1, {m}))", f"xxhash64({low}, 1, slice(w, n - {m} + 1, {m}))"]
    keys += [f"IF(n % 2 = 1, xxhash64(n + 1, {k}, slice(w, {at}, {m} + 1)), NULL)" for k, at in ((0, "1"), (1, f"n - {m}"))]
    return [F.expr(k) for k in keys]


def _prefixes(w: str) -> str:
    """Hashes of the first 0, 1, ... n words of w, order and length included. Chained from eight words to eight
    words, so each takes at most seven words more."""
    chain = "aggregate(sequence(0, shiftright(n, 3)), CAST(array() AS ARRAY<BIGINT>), (a, k) -> concat(a, array(IF(k = 0, 0L, xxhash64(get(a, k - 1), slice(x, 8 * k - 7, 8))))))"
    each = "transform(sequence(0, n), i -> xxhash64(get(c, shiftright(i, 3)), slice(x, i - i % 8 + 1, i % 8)))"
    return f"transform(array({w}), x -> transform(array({chain}), c -> {each})[0])[0]"


def _variants(max_edits: int) -> Column:
    """Keys of w. One edit: its place, the hash of the words before it and of those after it, for every word left out
    and every gap. Two: both places, and the hashes of the words before, between and after them, for every two of
    words left out and gaps. Lines that share a key are within the bound, but for a chance equality of 64-bit hashes."""
    one = [
        "transform(sequence(0, n - 1), i -> xxhash64(get(before, i), get(after, n - 1 - i), i))",
        "transform(sequence(0, n), i -> xxhash64(get(before, i), get(after, n - i), i))",
    ]
    if max_edits == 1:
        return F.expr(f"concat({', '.join(one)})")
    two = []
    for x in (0, 1):
        for y in (0, 1):
            inner = f"transform(sequence(i + {x}, n - {y}), j -> xxhash64(get(before, i), slice(w, i + {x} + 1, j - i - {x}), get(after, n - {y} - j), i, j - i - {x}))"
            two.append(f"flatten(transform(sequence(0, n - {x} - {y}), i -> {inner}))")
    return F.array_distinct(F.expr(f"concat({', '.join(two)})"))


def _let(name: str, value: str, body: str) -> str:
    """body with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _same_start(a: str, b: str) -> str:
    """Number of leading words that two arrays share."""
    k = f"least(size({a}), size({b}))"
    return _let("k", k, f"CAST(coalesce(nullif(array_position(zip_with(slice({a}, 1, k), slice({b}, 1, k), (p, q) -> p = q), false), 0) - 1, k) AS INT)")


def _within(a: str, b: str, edits: int) -> str:
    """Whether two arrays of words are within one or two edits: what both start with is never edited at the least cost."""
    if edits == 1:
        ends = f"{_same_start(a, b)} + {_same_start(f'reverse({a})', f'reverse({b})')} >= greatest(size({a}), size({b})) - 1"
        return f"(abs(size({a}) - size({b})) <= 1 AND {ends})"
    rest = lambda x, skip: f"slice({x}, s + 1 + {skip}, size({x}))"
    ways = [_let("x", rest(a, p), _let("y", rest(b, q), _within("x", "y", 1))) for p, q in ((1, 1), (1, 0), (0, 1))]
    return f"({a} = {b} OR {_let('s', _same_start(a, b), '(' + ' OR '.join(ways) + ')')})"


def dropped_lines(docs: DataFrame, max_edits: int = 1, min_words: int | None = None) -> DataFrame:
    """id, th, drop: for every text (by doc_id and text hash) that loses lines, their numbers from 0.

    A line that is not blank goes if an equal line comes earlier; one of at least min_words words (by default MIN_WORDS
    for each edit) also if one within max_edits (0, 1 or 2) word edits does - whether or not that one stays. Rows
    repeating doc_id and text count as one text, null doc_ids come last, equal doc_ids by text hash. Null and empty
    texts lose nothing; no documents, no rows. A line's variants grow with its
    length, for two edits with its square: two edits are for lines of some hundred words, not for texts in one line.
    """
    if max_edits not in (0, 1, 2):
        raise ValueError("max_edits must be 0, 1 or 2")
    least = MIN_WORDS * max_edits if min_words is None else min_words
    texts = _texts(docs)
    halves = [F.when(F.col("n") >= least, k if max_edits == 1 else F.lit(None).cast("long")).alias(a) for a, k in zip(HALVES, _half_keys(), strict=True)]
    lines = written(_lines(texts).where("n > 0").select("id", "th", "line_no", "n", *_hashes(), *halves), "lines")
    classes = lines.groupBy("h", "h2").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"), F.first("n").alias("n"), *(F.first(a).alias(a) for a in HALVES))
    classes = written(classes, "classes")
    again = classes.where(F.col("first") != F.col("last")).select("h", "h2", "first", F.lit(False).alias("near"))
    if max_edits:
        again = again.unionByName(_near(texts, classes.where(F.col("n") >= least), max_edits))
        again = again.groupBy("h", "h2", "first").agg(F.max("near").alias("near"))
    again = written(again, "again")
    there = let_through(lines.select("id", "th", "line_no", "h", "h2"), bitmap(again.select("h")), F.col("h"))
    hit = there.join(again, ["h", "h2"]).where(F.col("near") | (_place() != F.col("first")))
    return hit.groupBy("id", "th").agg(F.sort_array(F.collect_set("line_no")).alias("drop"))


def _near(texts: DataFrame, classes: DataFrame, max_edits: int) -> DataFrame:
    """h, h2, first, near: the classes that have an earlier line within the bound."""
    live = classes.select("h", "h2", "first")
    if max_edits == 1:
        halves = classes.select("h", "h2", F.explode(F.array_compact(F.array(*HALVES))).alias("key"))
        both = halves.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("key")
        live = live.join(halves.join(both, "key").select("h", "h2").distinct(), ["h", "h2"])
    live = written(live, "live")
    docs = let_through(texts, bitmap(live.select(F.xxhash64("first.id", "first.th").alias("x"))), F.xxhash64("id", "th"))
    held = _lines(docs).select("w", "n", *_hashes(), _place().alias("first"))
    held = let_through(held, bitmap(live.select(F.xxhash64("h", "first.line_no").alias("x"))), F.xxhash64("h", "first.line_no"))
    held = written(held.join(live, ["h", "h2", "first"]).dropDuplicates(["h", "h2", "first"]), "held")
    ends = held.withColumn("before", F.expr(_prefixes("w"))).withColumn("after", F.expr(_prefixes("reverse(w)")))
    keys = written(ends.select("h", "h2", "first", _variants(max_edits).alias("keys")), "keys").select("h", "h2", "first", F.explode("keys").alias("key"))
    groups = written(keys.groupBy("key").agg(F.min("first").alias("hub"), F.count("*").alias("c")).where("c > 1").select("key", "hub"), "groups")
    pairs = let_through(keys, bitmap(groups.select("key")), F.col("key")).join(groups, "key").where(F.col("hub") < F.col("first")).select("h", "h2", "first", "hub").distinct()
    text = held.select(F.col("first").alias("hub"), F.col("w").alias("v"))
    pairs = pairs.join(held.select("h", "h2", "first", "w"), ["h", "h2", "first"]).join(text, "hub").where(_within("w", "v", max_edits))
    return pairs.select("h", "h2", "first", F.lit(True).alias("near")).distinct()


def dedup_lines(docs: DataFrame, max_edits: int = 1, min_words: int | None = None) -> DataFrame:
    """docs, all columns, with texts that have lost the lines of dropped_lines() (n_chars follows, if there is one).

    The remaining lines keep their order and are joined by line feeds; a text of which nothing remains is empty.
    Null texts and blank lines stay. Rows that repeat stay, cut alike. Texts that lose nothing are not moved between
    tasks. Columns named rowloom_* are of docs alone if there are any: those made here have names that docs lacks.
    """
    drops = written(dropped_lines(docs, max_edits, min_words), "drops")
    mark = bitmap(drops.select(F.xxhash64("id", "th")))
    th, touched, id_, t, drop, gone = fresh_names(docs, "th", "touched", "id", "t", "drop", "gone")
    d = flagged(docs.withColumn(th, F.xxhash64("text")), mark, F.xxhash64("doc_id", th), touched)
    x = drops.select(F.col("id").alias(id_), F.col("th").alias(t), F.col("drop").alias(drop))
    cut = d.where(touched).join(x, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(th) == F.col(t)), "left")
    # The numbers to drop are sorted; a map finds each in place of a search along the array.
    rest = F.expr(f"array_join(filter(zip_with(split(text, '\n'), {gone}, (x, g) -> IF(g, NULL, x)), x -> x IS NOT NULL), '\n')")
    cut = cut.withColumn(gone, F.expr(f"transform(array_repeat(0, size(split(text, '\n'))), (x, i) -> array_contains({drop}, i))"))
    whole = F.col(drop).isNull()
    cut = cut.withColumn("text", F.when(whole, F.col("text")).otherwise(rest))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return d.where(f"NOT {touched}").select(*names).unionByName(cut.select(*names))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the remaining text's number of lines and the hash of the remaining text."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.sha2("text", 256).alias("text_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, ls[i] AS line, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
e AS (SELECT line, any_value(w) AS w, min(doc_id * 1000000 + line_no) AS first FROM l WHERE len(w) > 0 GROUP BY line),
v AS (
  SELECT first, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS key, i AS gap FROM (SELECT first, w, unnest(range(1, len(w) + 1)) AS i FROM e WHERE len(w) >= 5)
  UNION ALL
  SELECT first, array_to_string(w, ' '), gap FROM (SELECT first, w, unnest(range(1, len(w) + 2)) AS gap FROM e WHERE len(w) >= 5)),
near AS (SELECT DISTINCT first FROM (SELECT first, min(first) OVER (PARTITION BY key, gap) AS hub FROM v) WHERE hub < first),
kept AS (
  SELECT l.doc_id, l.line_no, l.line FROM l LEFT JOIN e ON l.line = e.line LEFT JOIN near ON e.first = near.first
  WHERE e.line IS NULL OR (near.first IS NULL AND e.first = l.doc_id * 1000000 + l.line_no)),
t AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY line_no) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 1) AS BIGINT) AS n_lines, sha256(coalesce(t.text, '')) AS text_sha256
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""
