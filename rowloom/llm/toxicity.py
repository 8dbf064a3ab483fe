"""Toxicity by weak supervision.

Many voters - families of a lexicon, how often its words come, and patterns - fire or abstain on a text. A generative label model estimates by
EM how often each fires on toxic and on other texts, and how strongly voters depend on each other given the
label; dependent voters share one voice. A linear classifier is trained on its posterior labels and scores texts.
The lexicon is a short general one plus words that labelled training texts show to be telling. Fitting takes a
bounded sample of labelled rows; scoring reads every whole text where it lies and exchanges nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import parts, table, written
from rowloom.llm.langid import held_out

#: Labelled rows that a fit takes, about.
SAMPLE_ROWS = 20_000
#: Lengths of stems.
STEMS = range(4, 9)
#: Lexicon families, each a voter: what a person is called, what is said of them, profanity, and whole words and stems
#: that labelled texts show to be telling.
FAMILIES = ("person", "quality", "profane", "word", "stem")
#: A general lexicon of insults.
GENERAL = {
    "person": "idiot idiots moron morons loser losers trash scum clown clowns garbage filth vermin imbecile jerk".split(),
    "quality": "stupid dumb pathetic worthless disgusting retard retarded".split(),
    "profane": "bastard bitch asshole crap shit fuck fucking whore slut".split(),
}
WORD = re.compile(r"[^\W\d_]+")
#: What PATTERNS[1] ends in; a text without any of them cannot match it.
INSULTS = "idiot moron loser clown stupid pathetic worthless disgusting scum trash".split()
PATTERNS = (
    re.compile(r"\b(?:shut up|kill yourself|go to hell|drop dead|hate you|piss off|screw you)\b"),
    re.compile(r"\byou(?:'re| are)? (?:an? |all |such an? |nothing but )?(?:\w+ )?(?:" + "|".join(INSULTS) + ")"),
    re.compile(r"\b[a-z]{1,3}[*#@$%]{2,}[a-z]{0,3}\b"),
)


@dataclass
class Model:
    """Lexicon (the family of words, and of stems that end in *), what the label model has estimated, weights of the
    linear classifier."""

    lexicon: dict[str, int]
    fires: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.1
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def lexicon_of(words: list[str] = (), stems: list[str] = ()) -> dict[str, int]:
    """The general lexicon and what was learned; a word's general family holds."""
    learned = dict.fromkeys(words, FAMILIES.index("word")) | dict.fromkeys(stems, FAMILIES.index("stem"))
    return learned | {w: FAMILIES.index(f) for f, some in GENERAL.items() for w in some}


class Families(dict):
    """The lexicon family of every word met so far, -1 for words that are not in it; emptied when it has grown large."""

    def __init__(self, lexicon: dict[str, int]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        hit = next((x for x in (word, *(f"{word[:k]}*" for k in STEMS)) if x in self.lexicon), None)
        self[word] = out = -1 if hit is None else self.lexicon[hit]
        return out


def signals(text: str | None, known: Families) -> list[float]:
    """Numbers that voters and classifier read: words, hits, different hits, hits by family, pattern hits."""
    low = text.lower() if text else ""
    found = WORD.findall(low)
    of = list(map(known.__getitem__, found))
    by_family = [0.0] * len(FAMILIES)
    kinds = set()
    for w, k in zip(found, of, strict=True) if max(of, default=-1) >= 0 else ():
        if k >= 0:
            by_family[k] += 1
            kinds.add(w)
    insult = any(x in low for x in INSULTS)
    return [float(len(found)), sum(by_family), float(len(kinds)), *by_family, *(float(len(p.findall(low))) if insult or k != 1 else 0.0 for k, p in enumerate(PATTERNS))]


def votes(s: np.ndarray) -> np.ndarray:
    """Which voters fire: families of the lexicon, patterns, any two hits, two different ones (unless they
    lie over three hundred words apart on the mean, as chance hits in long texts do), a hit in a hundred words."""
    n, hits, kinds = s[:, 0], s[:, 1], s[:, 2]
    dense = hits * 300 >= n
    return np.column_stack([s[:, 3:] > 0, (hits >= 2) & dense, (kinds >= 2) & dense, hits * 100 >= np.maximum(n, 1)]).astype(float)


def features(s: np.ndarray) -> np.ndarray:
    n, hits, kinds = s[:, 0], s[:, 1], s[:, 2]
    rate = hits / np.maximum(n, 1)
    return np.column_stack([np.ones(len(s)), hits > 0, np.log1p(hits), np.log1p(kinds), np.minimum(rate * 50, 2), np.log1p(s[:, 3:])])


def label_model(v: np.ndarray, start: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """EM over votes v (texts x voters). Returns how often voters fire by label, their shares, the prior and posteriors.

    A voter's share is 1 / (1 + sum of its positive correlations with other voters given the label), so a group of
    voters that always fire together weighs like one."""
    q = start.clip(0.02, 0.98)
    share = np.ones(v.shape[1])
    for _ in range(rounds):
        weight = np.stack([1 - q, q])
        fires = (weight @ v + np.array([[0.02], [0.5]])) / (weight.sum(axis=1, keepdims=True) + 1)
        prior = float(np.clip(q.mean(), 1e-3, 0.5))
        corr = np.zeros((v.shape[1], v.shape[1]))
        for y in (0, 1):
            d = v - fires[y]
            cov = (d * weight[y][:, None]).T @ d / max(weight[y].sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr += 0.5 * np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(corr, 0)
        share = 1 / (1 + corr.sum(axis=1))
        new = posterior(v, fires, share, prior)
        if np.abs(new - q).max() < 1e-6:
            q = new
            break
        q = new
    return fires, share, prior, q


def posterior(v: np.ndarray, fires: np.ndarray, share: np.ndarray, prior: float) -> np.ndarray:
    odds = math.log(prior / (1 - prior)) + (v * np.log(fires[1] / fires[0]) + (1 - v) * np.log((1 - fires[1]) / (1 - fires[0]))) @ share
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def linear(x: np.ndarray, q: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - q) / len(x) + ridge * 0.01 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * 0.01 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    return w


def _words(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems (of three words or more) that tell toxic texts: five toxic contexts or more, and the lower bound
    (Wilson) of their share of toxic contexts over a half, for stems over 0.8. A context is the words on both sides, and
    counts once: near copies of one text do not make its words telling. All that pass, which the sample bounds."""
    tokens = F.expr(r"regexp_extract_all(lower(text), '(?U)[^\\W\\d_]+', 0)")
    t = sample.select("toxic", tokens.alias("w")).where(F.size("w") > 0)
    near = F.expr("transform(w, (x, i) -> struct(x AS word, xxhash64(get(w, i - 1), get(w, i + 1)) AS at))")
    t = t.select("toxic", F.explode(near).alias("x")).select("x.word", "x.at", "toxic")
    seen = t.groupBy("word", "at").agg(F.max("toxic").alias("toxic"))
    sums = written(seen.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")), "words")
    z, share = 2.2, F.col("k") / F.col("n")
    lower = (share + z * z / (2 * F.col("n")) - z * F.sqrt(share * (1 - share) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    told = lambda d, name, least: sorted(r[name] for r in d.where("k >= 5").where(lower > least).select(name).collect())
    words = told(sums.where("length(word) >= 3"), "word", 0.5)
    stems = F.explode(F.transform(F.array(*map(F.lit, STEMS)), lambda k: F.when(F.length("word") >= k, F.col("word").substr(F.lit(1), k))))
    by_stem = sums.select(stems.alias("stem"), "n", "k").where("stem IS NOT NULL").groupBy("stem").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    return words, [f"{x}*" for x in told(by_stem.where("c >= 3"), "stem", 0.8)]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic (0 or 1; others and nulls are skipped; of several for one doc_id the
    largest holds). About `rows` labelled rows, chosen by a hash of doc_id, are fitted; equal texts count once, with
    their largest label. Null texts and doc_ids teach nothing; other columns are left alone; texts are read whole,
    however long. Reruns give the same model. Without labelled rows the general lexicon alone decides."""
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = labels.count()
    some = labels.where(F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(1 << 20)) < min(1.0, rows / max(count, 1)) * (1 << 20))
    # The sample's ids: about `rows` of them, whatever the input.
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where("text IS NOT NULL")
    sample = sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").cast("int").alias("toxic"))
    sample = written(sample.repartition(parts(rows, 500)), "sample")
    lexicon = lexicon_of(*_words(sample))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Families(lexicon)
        for batch in batches:
            numbers = [signals(t, known) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.string()), batch["toxic"], pa.array(numbers, pa.list_(pa.float64()))], names=["doc_id", "toxic", "s"])

    got = sample.mapInArrow(read, "doc_id string, toxic int, s array<double>").toPandas()  # about `rows` rows of a few numbers
    model = Model(lexicon)
    if got.empty:
        got = pd.DataFrame({"doc_id": ["a", "b"], "toxic": [1, 0], "s": [signals("stupid idiot moron", Families(lexicon)), signals("", Families(lexicon))]})
    got = got.sort_values("doc_id", kind="stable")
    s = np.array(got["s"].tolist())
    v = votes(s)
    start = (v.sum(axis=1) >= 2).astype(float) * 0.9
    model.fires, model.share, model.prior, q = label_model(v, start, 0.1)
    model.weights = linear(features(s), q)
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, score (0 to 1) and predicted. Null and empty texts are scored as having no words, texts of any
    length as a whole; equal texts get equal scores, rows that repeat one each, and docs' other columns are left out.
    Empty table: no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, F.col("text").alias("rowloom_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        known = Families(m.lexicon)
        for batch in batches:
            if len(batch):
                x = features(np.array([signals(t, known) for t in batch["rowloom_text"].to_pylist()]))
                p = 1 / (1 + np.exp(-np.clip(x @ m.weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "rowloom_text")
    return kept.mapInArrow(run, f"{fields}, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, less those predicted toxic. Rows that repeat go or stay together; no rows, no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        known = Families(m.lexicon)
        for text in texts:
            s = np.array([signals(t, known) for t in text]).reshape(len(text), len(FAMILIES) + len(PATTERNS) + 3)
            yield pd.Series(features(s) @ m.weights < 0)

    return docs.where(clean(F.col("text")))


def training(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, training(table(spark, sf_dir, "labels")))
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), model, ("doc_id", "held_out")).select("doc_id", "held_out", "score", "predicted")
