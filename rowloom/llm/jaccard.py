"""N-gram Jaccard join with several global token orders.

A document's tokens are hashes of its distinct 5-word shingles. Two similar sets share a token in their prefixes under
every global order, and as many as their prefixes are longer than they must be.

First a document filter: under the order of the hashes themselves, a set whose lengthened prefix shares too few tokens
with other sets has no candidate, which settles most. Frequencies of tokens are counted over the sets that are left, and
further orders put frequent tokens last, ties by different hashes; a set must share prefix tokens under each of them.

Then pairs: of tokens that few sets share, all pairs are candidates under the first order; they are intersected with
the other orders' filters, and what passes all is verified on the whole sets. A frequent token's sets are not paired
with each other. All of them meet its hub, the set that shares most tokens. If they then still lie in several
components, those near the hub are compared in tiles of bounded size, where again pairs must pass every order's filter
before they are verified, and which return a spanning forest of the links, not the pairs; those far from it stay,
under the token and one of the next order. (Jaccard distance is a metric: no set far from a hub is similar to one
close to it.) So every link between different sets is verified, or joins what other links join already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import bitmap, flagged, fresh_names, let_through, removed, table, written
from rowloom.llm.components import components

#: Words of a shingle; least similarity in hundredths; token orders behind the document filter; hundredths of a set's
#: tokens by which the filter lengthens its prefix; sets of a token that are paired directly.
WORDS, PERCENT, ORDERS, MORE, SMALL = 5, 80, 3, 10, 8
#: A set closer to a hub than NEAR may be similar to one closer than FAR; what is further than FAR meets another hub.
#: Similar sets of distance d(x, y) <= 0.2 keep d(x, hub) <= d(y, hub) + 0.2, so 0.5 and 0.3 leave no gap. Sets of half a
#: tile, and bytes of their tokens.
FAR, NEAR, TILE_SETS, TILE_BYTES = 50, 30, 1024, 16 << 20
#: Rows of a group above which its rows are dealt over SALTS tasks where they meet the group's smallest doc_id.
LARGE, SALTS = 1024, 256
#: Tokens that the orders put last, at most.
FREQUENT = 1 << 18
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words met before; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, known: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles (A-Z lower-cased); a shorter text is one shingle."""
    found = text.encode("utf-8", "surrogatepass").translate(_UPPER).split() if text else ()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = _mixed(out * _ODD + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def _set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, percent: int) -> int:
    """Tokens of which two similar sets must share one, whatever the order."""
    return n - -(-percent * n // 100) + 1


def _sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """A row per document: id, th, n, sid, and its tokens in order: head (the lengthened prefix), rest (bytes)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, len(b), 1000)):
            sets = [shingle_hashes(t, known, words) for t in batch["text"].to_pylist()]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            lead = [prefix_length(len(s), percent) + len(s) * MORE // 100 if len(s) else 0 for s in sets]
            heads = np.concatenate([*(s[:k] for s, k in zip(sets, lead, strict=True)), np.zeros(0, np.uint64)]).astype(np.int64)
            head = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lead)]), pa.int32()), pa.array(heads))
            rest = pa.array([s[k:].astype("<u8").tobytes() for s, k in zip(sets, lead, strict=True)], pa.binary())
            sids = pa.array([_set_id(s) if len(s) else 0 for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["th"], pa.array(n), sids, head, rest], names=["id", "th", "n", "sid", "head", "rest"])

    d = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text")
    return d.mapInArrow(read, f"id {docs.schema['doc_id'].dataType.simpleString()}, th long, n long, sid long, head array<long>, rest binary")


def _survivors(sets: DataFrame, of_set: DataFrame, percent: int) -> DataFrame:
    """sid, n, id, th (a document that has the set) and lone (share of the prefix that no other set has) of the sets whose
    prefix shares enough. The prefix has 1 + n * MORE / 100 tokens more than all but the least overlap, so of each two
    similar sets' prefixes as many are shared as the smaller set's has more."""
    rows = sets.select("sid", F.explode("head").alias("tok"))
    common = rows.groupBy("tok").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi").select("tok")
    common = written(common, "common")
    hits = let_through(rows, bitmap(common), F.col("tok")).join(common, "tok").groupBy("sid").agg(F.count("*").alias("hits"))
    least = 1 + F.floor(F.ceil(percent * F.col("n") / 100) * MORE / 100)
    shared = F.col("hits") / F.col("copies")  # every copy of a set has the same prefix
    return of_set.join(hits, "sid").where(shared >= least).select("sid", "n", "rep.id", "rep.th", (1 - shared / F.col("n")).alias("lone"))


def _token_table(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """sid, n, tokens (bytes) of the sets in reps."""
    there = let_through(sets, bitmap(reps.select(F.xxhash64("id", "th"))), F.xxhash64("id", "th")).select("sid", "head", "rest")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [np.asarray(h.values).astype("<i8").tobytes() + r.as_py() for h, r in zip(b["head"], b["rest"], strict=True)]
            yield pa.RecordBatch.from_arrays([b["sid"], pa.array(tokens, pa.binary())], names=["sid", "tokens"])

    return there.mapInArrow(joined, "sid long, tokens binary").join(reps.select("sid", "n"), "sid").dropDuplicates(["sid"])


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens of the sets, sorted, and how frequent (quarters of a power of two). They are counted over all
    sets; as many classes as make up to FREQUENT tokens, from the top, are told apart, which leaves the order one order."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch["tokens"]:
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.int64(), len(x.as_buffer()) // 8, [None, x.as_buffer()])], names=["tok"])

    counts = sets.select("tokens").mapInArrow(tokens, "tok long").groupBy("tok").agg(F.count("*").alias("c")).where("c >= 8")
    counts = written(counts.select("tok", F.floor(4 * F.log2("c")).cast("int").alias("k")), "frequent")
    total, least = 0, 1 << 30
    for r in counts.groupBy("k").count().orderBy(F.desc("k")).collect():  # a row per class
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["k"]
    got = counts.where(F.col("k") >= least).toArrow()  # FREQUENT rows at most
    tok, k = got["tok"].to_numpy().astype(np.uint64), got["k"].to_numpy()
    order = np.argsort(tok)
    return tok[order], np.minimum(k[order], 255).astype(np.uint64)


def _order(tokens: np.ndarray, which: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Places of tokens under an order: frequent ones last, the most frequent at the end, else by a hash."""
    h = _mixed(tokens ^ np.uint64(int(_ODD) * (2 * which + 1) % (1 << 64)))
    tok, k = frequent
    out = h >> np.uint64(1)
    if len(tok):
        at = np.minimum(np.searchsorted(tok, tokens), len(tok) - 1)
        hit = tok[at] == tokens
        out = np.where(hit, np.uint64(1 << 63) | (k[at] << np.uint64(55)) | (h >> np.uint64(9)), out)
    return out


def _prefixes(sets: DataFrame, percent: int, orders: list[int], frequent) -> DataFrame:  # noqa: ANN001
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, n, tokens in zip(batch["sid"].to_pylist(), batch["n"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
                t = np.frombuffer(tokens, "<u8")
                p = prefix_length(n, percent)
                for o in orders:
                    first = np.sort(_order(t, o, frequent.value))[:p].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), o, np.int32)), pa.array(first), pa.array(np.full(len(first), sid)), pa.array(np.full(len(first), n))], names=["o", "tok", "sid", "n"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in emit(batches):
            held.append(b)
            if len(held) == 2000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return sets.mapInArrow(gathered, "o int, tok long, sid long, n long")


def _prefix(tokens: np.ndarray, which: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.sort(_order(tokens, which, frequent))[: prefix_length(len(tokens), percent)]


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, frequent, counts: dict) -> DataFrame:  # noqa: ANN001
    """a, b, their sizes and the number of tokens they share. Of a pair with quick set, which has met under the first
    order, that is 0 unless the prefixes meet under every other order too: then only whether the two are similar is
    asked."""
    a = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("x"))
    b = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y, quick in zip(batch["x"], batch["y"], batch["quick"].to_pylist(), strict=True):
                s, t = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                order = 1
                while quick and order < ORDERS and len(np.intersect1d(_prefix(s, order, percent, frequent.value), _prefix(t, order, percent, frequent.value), assume_unique=True)):
                    order += 1
                for o in range(order if quick else 0):
                    counts[o + 1].add(1)
                meet = not quick or order == ORDERS
                out.append((len(s), len(t), len(np.intersect1d(s, t, assume_unique=True)) if meet else 0))
                counts["hub"].add(int(not quick))
            na, nb, both = (pa.array([o[k] for o in out], pa.int64()) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], na, nb, both], names=["a", "b", "na", "nb", "shared"])

    found = pairs.select("a", "b", "quick").join(a, "a").join(b, "b").select("a", "b", "quick", "x", "y")
    return found.mapInArrow(check, "a long, b long, na long, nb long, shared long")


def _reach(hundredths: int) -> str:
    return f"100 * shared >= {hundredths} * (na + nb - shared)"


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Number of tokens that each two of the sets share."""
    m = len(sets)
    token, doc = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(token, kind="stable")
    token, doc = token[order], doc[order]
    starts = np.nonzero(np.concatenate([[True], token[1:] != token[:-1]]))[0]
    sizes = np.diff(np.append(starts, len(token)))
    out = np.zeros((m, m), dtype=np.float32)
    often = starts[sizes >= 32], sizes[sizes >= 32]
    for k in range(0, len(often[0]), 2048):  # tokens of many sets: a matrix product
        some = np.zeros((m, len(often[0][k : k + 2048])), dtype=np.float32)
        for j, (at, n) in enumerate(zip(often[0][k : k + 2048], often[1][k : k + 2048], strict=True)):
            some[doc[at : at + n], j] = 1
        out += some @ some.T
    for n in range(2, 32):  # tokens of few sets: their pairs
        at = starts[sizes == n]
        if len(at):
            members = doc[at[:, None] + np.arange(n)]
            pairs = (members[:, :, None] * m + members[:, None, :]).ravel()
            out += np.bincount(pairs, minlength=m * m).reshape(m, m)
    return out


NONE = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _forest(sids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], percent: int, frequent: tuple[np.ndarray, np.ndarray] = NONE, seen: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join sets of different roots, one for each set and turn of joining, out of all links of a tile. Pairs
    whose prefixes do not meet under every order are not verified. seen: gets the pairs left after each order."""
    label, out = np.unique(roots, return_inverse=True)[1], []
    linked = label[:, None] > label[None, :]
    for o in range(ORDERS):
        linked &= _overlaps([_prefix(s, o, percent, frequent) for s in sets]) > 0
        if seen is not None:
            seen.append(int(linked.sum()))
        if not linked.any():
            return out
    n = np.array([len(s) for s in sets], dtype=np.float64)
    rows, to = np.nonzero(linked)
    if len(rows) < 4 * len(sets):
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(rows, to, strict=True)])
    else:
        both = _overlaps(sets)[rows, to]
    linked[rows, to] = 100 * both >= percent * (n[rows] + n[to] - both)
    linked |= linked.T
    while True:
        apart = linked & (label[:, None] > label[None, :])
        rows = np.nonzero(apart.any(axis=1))[0]
        if not len(rows):
            return out
        to = apart[rows].argmax(axis=1)
        out += list(zip(sids[rows].tolist(), sids[to].tolist(), strict=True))
        up = np.arange(label.max() + 1)
        np.minimum.at(up, label[rows], label[to])
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def _tiles(near: DataFrame, sets: DataFrame, percent: int, frequent, counts: dict) -> DataFrame:  # noqa: ANN001
    """near: hub, sid, root. Links between sets of one hub in different components, hub by hub and tile by tile. Chunks of
    the hub's largest component meet those of the others, not each other."""
    near = near.join(sets.select("sid", F.octet_length("tokens").cast("long").alias("size")), "sid")
    by_root = near.groupBy("hub", "root").agg(F.count("*").alias("c"), F.sum("size").alias("size"))
    chunks = lambda major: F.greatest(*(F.ceil(F.sum(F.when(major, F.col(c)).otherwise(0)) / most) for c, most in (("c", TILE_SETS), ("size", TILE_BYTES)))).cast("int")
    main = by_root.groupBy("hub").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("hub", F.col("m.root").alias("main"))
    sizes = by_root.join(main, "hub").groupBy("hub", "main").agg(chunks(F.col("root") == F.col("main")).alias("majors"), chunks(F.col("root") != F.col("main")).alias("minors"))
    d = near.join(sizes, "hub").withColumn("major", F.col("root") == F.col("main"))
    d = d.withColumn("c", F.pmod(F.xxhash64("sid"), F.when(F.col("major"), F.col("majors")).otherwise(F.col("minors"))).cast("int"))
    to = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    tile = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    with_main = to("majors", lambda o: tile(0, o, F.col("c")))
    others = to("minors", lambda o: tile(1, F.least("c", o), F.greatest("c", o)))
    d = d.withColumn("t", F.explode(F.when(F.col("major"), to("minors", lambda o: tile(0, F.col("c"), o))).otherwise(F.concat(with_main, others))))
    d = d.select("hub", "t.kind", "t.i", "t.j", "sid", "root").join(sets.select("sid", "tokens"), "sid")

    def compare(t: pa.Table) -> pa.Table:
        seen: list[int] = []
        pairs = _forest(t["sid"].to_numpy(), t["root"].to_numpy(), [np.frombuffer(x, "<u8") for x in t["tokens"].to_pylist()], percent, frequent.value, seen)
        counts["tile"].add(len(t) * (len(t) - 1) // 2)
        for k, c in enumerate(seen):
            counts[k + 1].add(c)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return d.select("hub", "kind", "i", "j", "sid", "root", "tokens").groupBy("hub", "kind", "i", "j").applyInArrow(compare, "a long, b long")


def _apart(df: DataFrame, roots: DataFrame, *cols: str) -> DataFrame:
    """df with the roots of the sets in cols (themselves, if nothing links them)."""
    for c in cols:
        df = df.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    return df


def _linked(sets: DataFrame, reps: DataFrame, percent: int, counts: dict) -> DataFrame | None:
    """Roots of the sets that links join; None if there are no links."""
    frequent = sets.sparkSession.sparkContext.broadcast(_frequent(sets))  # FREQUENT rows at most
    prefixes = written(_prefixes(sets, percent, list(range(ORDERS)), frequent).select("o", "tok", "sid"), "prefixes")
    common = prefixes.groupBy("o", "tok").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi").select("o", "tok")
    rows = written(prefixes.join(common, ["o", "tok"]), "shared")
    removed(prefixes)
    every = rows.groupBy("sid").agg(F.bit_or(F.expr("shiftleft(1, o)")).alias("met")).where(f"met = {(1 << ORDERS) - 1}").select("sid")
    rows = rows.join(every, "sid")
    active = rows.where("o = 0").join(reps.select("sid", "lone"), "sid").select("tok", "sid", "lone")
    links, roots, turn = None, None, 0

    def add(new: DataFrame) -> None:
        nonlocal links, roots
        new = written(rooted(new.select("a", "b"), "a", "b").where("ra <> rb").select("a", "b"), "linked")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            roots = written(components(links), "roots")

    def rooted(df: DataFrame, *cols: str) -> DataFrame:
        return _apart(df, roots, *cols) if roots is not None else df.withColumns({f"r{c}": F.col(c) for c in cols})

    def paired(d: DataFrame) -> DataFrame:
        """Pairs of the sets of each token of d (tok, sid) in different components."""
        x, y = (rooted(d.select("tok", "sid"), "sid").select("tok", F.col("sid").alias(c), F.col("rsid").alias(f"r{c}")) for c in "ab")
        return x.join(y, "tok").where("a < b AND ra <> rb").select("a", "b", F.lit(True).alias("quick")).distinct()

    compared = lambda pairs: _compared(pairs, sets, percent, frequent, counts)
    while True:
        active = written(active, "active")
        sizes = written(active.groupBy("tok").agg(F.count("*").alias("c"), F.min(F.struct("lone", "sid")).alias("h")), "sizes")
        hubs, size = sizes.where(F.col("c") > SMALL).select("tok", F.col("h.sid").alias("hub")), active.count()
        met = active.join(hubs, "tok").where("sid <> hub")
        met = met.select(F.col("sid").alias("a"), F.col("hub").alias("b"), F.lit(False).alias("quick")).distinct()
        met = written(compared(met), "met")
        few = compared(paired(active.join(sizes.where(f"c <= {SMALL}").select("tok"), "tok")))
        add(met.unionByName(few).where(_reach(percent)))
        near = met.where(_reach(NEAR)).select(F.col("b").alias("hub"), F.col("a").alias("sid"))
        near = near.unionByName(near.select("hub", F.col("hub").alias("sid")).distinct())
        add(_tiles(rooted(near, "sid").withColumnRenamed("rsid", "root"), sets, percent, frequent, counts))
        far = met.where(f"NOT ({_reach(FAR)})").select(F.col("a").alias("sid"), F.col("b").alias("hub"))
        rest = rooted(active.join(hubs, "tok").join(far, ["sid", "hub"]).select("tok", "sid", "lone"), "sid")
        still = rest.groupBy("tok").agg(F.min("rsid").alias("lo"), F.max("rsid").alias("hi")).where("lo < hi").select("tok")
        rest = written(rest.join(still, "tok").select("tok", "sid", "lone", "rsid"), "rest")
        by_root = rest.groupBy("tok", "rsid").agg(F.count("*").alias("c"))
        left = by_root.groupBy("tok").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("p")).agg(F.sum("p")).first()[0] or 0
        if left <= size:  # no more pairs than there were prefix tokens
            if left:
                add(compared(paired(rest)).where(_reach(percent)))
            return roots
        turn += 1
        active = rest.select("tok", "sid", "lone")
        if turn < ORDERS:
            following = rows.where(F.col("o") == turn).select("sid", F.col("tok").alias("more"))
            active = active.join(following, "sid").select(F.xxhash64("tok", "more").alias("tok"), "sid", "lone")


def _grouped(docs: DataFrame, percent: int, words: int, counts: dict | None = None) -> DataFrame:
    """id, th, n of every row of docs, and root: the least set id that links reach, null for an empty set."""
    tally = {k: docs.sparkSession.sparkContext.accumulator(0) for k in (*range(1, ORDERS + 1), "hub", "tile")}
    every = written(_sets(docs, words, percent), "sets")
    light = written(every.select("id", "th", "n", "sid"), "light")
    of_set = light.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.min(F.struct("id", "th")).alias("rep"), F.count("*").alias("copies"))
    reps = written(_survivors(every, of_set, percent), "reps")
    sets = written(_token_table(every, reps), "tokens")
    removed(every)  # what follows reads light, reps and sets
    roots = _linked(sets, reps, percent, tally)
    if counts is not None:
        counts |= {"sets": reps.count(), "hub pairs": tally["hub"].value, "pairs in tiles": tally["tile"].value} | {f"candidates after {o} orders": tally[o].value for o in range(1, ORDERS + 1)}
    sid = F.when(F.col("n") > 0, F.col("sid"))
    if roots is None:
        return light.select("id", "th", "n", sid.alias("root"))
    return light.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("id", "th", "n", F.when(F.col("n") > 0, F.coalesce("root", "sid")).alias("root"))


def _beside(g: DataFrame, groups: DataFrame) -> DataFrame:
    """g's rows with what groups (root, size, ...) says of their root, nulls without a root. The rows of a large group are
    dealt over SALTS tasks, and its row of groups goes to each of them: LARGE rows stand behind SALTS, so no more rows are
    added than a quarter of g's. What a full bitmap marks beside them is dealt in the same way."""
    groups = written(groups, "of_root")
    large = bitmap(groups.where(F.col("size") > LARGE).select("root"))
    every = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: k.cast("long"))
    x = flagged(groups.drop("size"), large, F.col("root"), "large")
    x = x.withColumn("salt", F.explode(F.when(F.col("large"), every).otherwise(F.array(F.lit(0).cast("long"))))).drop("large")
    d = flagged(g, large, F.col("root"), "large")
    d = d.withColumn("salt", F.when(F.col("large"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("long"))
    return d.drop("large").join(x, ["root", "salt"], "left").drop("salt")


def near_groups(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, counts: dict | None = None) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (smallest doc_id that links reach, itself included).

    A null or wordless text has no shingles and is linked with nothing. Nulls among doc_ids count last: a group
    of nothing else has a null id. Repeated rows are copies like others; docs' other columns are left out; texts count
    whole, however long. Empty table: no rows. Tokens are 64-bit hashes. counts: gets the sets that pass the document
    filter, the pairs met by hubs and tiles, and the candidates left after each order.
    """
    g = written(_grouped(docs, percent, words, counts), "groups")
    least = g.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("size"))
    out = _beside(g, least)
    return out.select(F.col("id").alias("doc_id"), F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """docs, all columns: of each group one row stays, the one with the smallest doc_id (null last), of equal ones by text
    hash, any one of rows that repeat. Rows linked with nothing stay, texts without words too. Rows that nothing else
    in their group could replace are not moved between tasks. Empty table: no rows."""
    g = written(_grouped(docs, percent, words).where("root IS NOT NULL"), "groups")
    place = F.struct(F.col("id").isNull().alias("z"), "id", "th")
    rows = written(g.groupBy("root", "id", "th").agg(F.count("*").alias("c")), "rows")
    first = rows.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("size"))
    lost = _beside(rows, first).withColumn("lost", place != F.col("first")).where("lost OR c > 1").groupBy("id", "th").agg(F.max("lost").alias("lost"))
    lost = written(lost, "lost")
    th, flag, id_, t, gone = fresh_names(docs, "th", "flag", "id", "t", "gone")
    d = flagged(docs.withColumn(th, F.xxhash64("text")), bitmap(lost.select(F.xxhash64("id", "th"))), F.xxhash64("doc_id", th), flag)
    x = lost.select(F.col("id").alias(id_), F.col("th").alias(t), F.col("lost").alias(gone))
    seen = d.where(flag).join(x, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(th) == F.col(t)), "left")
    names = [F.col(f"`{c}`") for c in docs.columns]
    alone, repeated = seen.where(F.col(gone).isNull()), seen.where(f"NOT {gone}").dropDuplicates([id_, t])
    return d.where(f"NOT {flag}").select(*names).unionByName(alone.select(*names)).unionByName(repeated.select(*names))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a WHERE r.root < e.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(root) FROM r WHERE node = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
