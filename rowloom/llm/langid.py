"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1; an n-gram's vector binds (multiplies) its letters' vectors, each
permuted by its place; a text's vector bundles (adds) those of its n-grams; a language's prototype bundles texts.
A text gets the language whose prototype has the largest cosine with it. Texts are read where they lie: nothing
is exchanged but prototypes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import table, written

#: Dimensions; seed of the letters' vectors; texts that train a language, about; prototypes that a driver and a task
#: hold (4 KB each): more values of lang than that are no languages, and an error.
DIMENSIONS, SEED, TRAIN_TEXTS, HELD = 1024, 20, 5000, 20_000
#: A letter is its code point; this one stands for whatever is no letter.
GAP = 32
#: Code points below this have a table of their pairs, which only spares work; bits of a code point in a trigram.
TABLE, BITS = 256, 21


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@functools.lru_cache(maxsize=2)
def _vectors(dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Bound vectors of the table's letter pairs (first letter permuted twice, second once), and of the last letter."""
    base = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), (TABLE, dimensions))
    pairs = np.roll(base, 2, axis=1)[:, None, :] * np.roll(base, 1, axis=1)[None, :, :]
    return pairs.reshape(TABLE * TABLE, dimensions), base


@functools.lru_cache(maxsize=1 << 14)
def _letter(point: int, dimensions: int, seed: int) -> np.ndarray:
    """A letter's own vector, drawn from its whole code point."""
    if point < TABLE:
        return _vectors(dimensions, seed)[1][point]
    return np.random.default_rng([seed, point]).choice(np.array([-1, 1], dtype=np.int8), dimensions)


def _bound(grams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """The vectors of trigrams, a row each."""
    mask = (1 << BITS) - 1
    a, b, c = grams >> 2 * BITS, (grams >> BITS) & mask, grams & mask
    if max(a.max(), b.max(), c.max()) < TABLE:
        pairs, last = _vectors(dimensions, seed)
        return pairs[a * TABLE + b] * last[c]
    points, at = np.unique(np.concatenate([a, b, c]), return_inverse=True)
    base = np.stack([_letter(int(p), dimensions, seed) for p in points])
    i, j, k = at.reshape(3, -1)
    return np.roll(base, 2, axis=1)[i] * np.roll(base, 1, axis=1)[j] * base[k]


def trigrams(text: str) -> np.ndarray:
    """Codes of a text's letter trigrams, words set off by one gap; none if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    codes = np.concatenate(([GAP], np.where(letter, points.astype(np.int64), GAP), [GAP]))
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP)
    c = codes[keep]
    return (c[:-2] << 2 * BITS) | (c[1:-1] << BITS) | c[2:]


def vector(text: str | None, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray | None:
    """A text's unit vector, None if it has no letter."""
    grams = trigrams(text) if text else ()
    if not len(grams):
        return None
    kinds, times = np.unique(grams, return_counts=True)
    out = np.zeros(dimensions, dtype=np.float32)
    for k in range(0, len(kinds), 4096):
        out += times[k : k + 4096].astype(np.float32) @ _bound(kinds[k : k + 4096], dimensions, seed).astype(np.float32)
    norm = float(np.sqrt(out @ out))
    return out / norm if norm else out


def train(labelled: DataFrame, dimensions: int = DIMENSIONS, texts: int = TRAIN_TEXTS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from rows with text and lang; every language that has a text with a
    letter. Of a language with more than about `texts` different texts, a sample by a hash of the text is taken; texts
    that repeat under one language count once, texts of any length whole. Rows without a letter or language teach
    nothing; other columns are left out. Over HELD languages are a ValueError."""
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    sizes = written(labelled.groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("n")), "languages")
    if (found := sizes.count()) > HELD:
        raise ValueError(f"{found} values of lang: more than {HELD} are no languages")
    share = F.least(F.lit(1.0), texts / F.col("n")) * (1 << 20)
    sample = labelled.join(F.broadcast(sizes), "lang")  # HELD rows at most
    sample = sample.where(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 20)) < share).select("lang", "text").distinct()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if (v := vector(text, dimensions, seed)) is not None:
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "v"])

    def total(t: pa.Table) -> pa.Table:
        v = np.sum([np.frombuffer(b) for b in sorted(t["v"].to_pylist())], axis=0)
        return pa.table({"lang": pa.array([t["lang"][0].as_py()], pa.string()), "v": pa.array([v.tobytes()], pa.binary())})

    got = sample.select("lang", "text").mapInArrow(partial, "lang string, v binary").groupBy("lang").applyInArrow(total, "lang string, v binary").collect()
    got = sorted((r["lang"], np.frombuffer(bytes(r["v"]))) for r in got)  # HELD rows at most
    if not got:
        return [], np.zeros((0, dimensions), dtype=np.float32)
    profiles = np.array([v / max(np.linalg.norm(v), 1e-12) for _, v in got])
    if len(got) > 1:
        profiles = profiles - profiles.mean(axis=0)  # what all languages share tells them apart no better
    norms = np.linalg.norm(profiles, axis=1, keepdims=True)
    return [lang for lang, _ in got], (profiles / np.maximum(norms, 1e-12)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], profiles: np.ndarray, seed: int = SEED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, lang_pred and score (the cosine, 0 at least). `und` and 0 where the text is null or has no
    letter, or no language was learned. Ties: the language first by name. Texts of any length count whole, rows that
    repeat each get their row; no rows, no rows."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((langs, profiles))  # HELD x DIMENSIONS numbers at most
    kept = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table_ = model.value
        for batch in batches:
            preds, scores = [], []
            for text in batch["text"].to_pylist():
                v = vector(text, table_.shape[1], seed) if names else None
                if v is None:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                cosines = table_ @ v
                best = int(np.argmax(cosines))
                preds.append(names[best])
                scores.append(float(min(max(cosines[best], 0.0), 1.0)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out() -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; rows without doc_id count as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, profiles = train(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text", held_out().alias("held_out")), langs, profiles, keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score")
