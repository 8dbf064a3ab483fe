"""Every operator against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty
tables, clashing column names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowloom.llm import chat, jaccard, langid, linededup, mixing, packing, quality, sharding, topk, toxicity
from rowloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h string"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Random texts, near and exact copies, shared lines, and hard rows."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    line = lambda: " ".join(r.choices(vocabulary, k=r.randrange(1, 14)))
    texts = ["\n".join(line() for _ in range(r.randrange(1, 6))) for _ in range(n)]
    for k in range(0, n, 4):
        w = r.choice(texts).split(" ")
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    base = [f"b{k}" for k in range(80)]
    texts += [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(0, 40, 3)]
    texts += [None, "", " \n\t", "one", "one two three four", "Alpha beta gamma delta EPSILON zeta", "alpha beta gamma delta epsilon zeta", "\n\n", " ".join(r.choices(vocabulary, k=5000))]
    rows = [(k, t, r.choice(["en", "de", None]), r.choice(["a", "a", "b", None]), None if t is None else len(t), k, "h") for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "no id at all here friend", "en", None, 3, 1, "h")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return WORD.findall(t or "")


# --- chat


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|turn|>x<|end|>", "<\\|end|>", "<<SYS>> <s>", "<", "|", "", None, "a\nb", "\\[INST]", "日本 <|"]
    rows = [(1, k, ("user", "assistant", None)[k % 3], t) for k, t in enumerate(hard)] + [(2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (None, 5, "system", "x")]
    e = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string").selectExpr("*", "uuid() msg_id", "'message' kind", "1 AS turns")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(e)).collect()}
    for conv in (1, 2, None):
        turns = [(a or "", t or "") for c, _, a, t in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        flat, loss = "".join(f"{a}\n{t}\n" for a, t in turns), "".join(t for a, t in turns if a == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(flat.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_events(spark):
    log = [(1, 1, "m1", "message", "user", "hi"), (1, 2, "m2", "delta", "assistant", "wro"), (1, 3, "m2", "delta", None, "ng"), (1, 4, "m2", "regenerate", None, None), (1, 5, "m2", "delta", None, "good"), (1, 7, "m2", "delta", None, "!"), (1, 6, "m1", "edit", None, "hello"), (1, 8, None, "message", "user", "bye"), (2, 1, "m", "delta", "user", None)]
    m = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, msg_id string, kind string, role string, text string"))
    assert sorted((r["conv_id"], r["seq"], r["role"], r["text"]) for r in m.collect()) == [(1, 1, "user", "hello"), (1, 2, "assistant", "good!"), (1, 8, "user", "bye"), (2, 1, "user", "")]
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, seq long, msg_id string, kind string, role string, text string")).count() == 0


def test_chat_random_logs(spark):
    """The fold against one event after another, and a log made of rows against the rows."""
    r = random.Random(8)
    log = [(r.choice([1, 2, 3, None]), k // 2, r.choice(["a", "b", "c", None]), r.choice(["message", "delta", "delta", "edit", "regenerate", None]), r.choice(["user", "assistant", None]), r.choice(["", None, "x", f"t{k}", "日本" * 3])) for k in range(400)]
    schema = "conv_id long, seq long, msg_id string, kind string, role string, text string"
    want: dict = {}
    for conv, seq, msg, kind, role, text in sorted(log, key=lambda e: (e[1], e[3] or "message", e[4] is not None, e[4] or "", e[5] or "")):
        m = want.setdefault((conv, msg), [seq, None, ""])
        m[1] = role if role is not None else m[1]
        if kind == "delta":
            m[2] += text or ""
        else:
            m[2] = "" if kind == "regenerate" else text or ""
    got = {(m["conv_id"], m["msg_id"]): [m["seq"], m["role"], m["text"]] for m in chat.fold(spark.createDataFrame(log, schema)).collect()}
    assert got == want
    rows = [(r.choice([1, 2]), r.randrange(4), r.choice(["user", "assistant", None]), r.choice(["", None, "x", "</s>[INST] <|end|>" * r.randrange(9), "y" * 40])) for _ in range(60)]
    events = chat.events_of(spark.createDataFrame([*rows, rows[0]], "conv_id long, turn long, role string, text string"))
    assert {e["kind"] for e in events.collect()} == {"message", "delta", "edit", "regenerate"} and events.where("msg_id IS NULL").count() == 0
    assert Counter((m["conv_id"], m["seq"], m["role"], m["text"]) for m in chat.fold(events).collect()) == Counter((c, 4 * t, role, text or "") for c, t, role, text in [*rows, rows[0]])
    assert chat.read_back(chat.render(chat.fold(events.limit(0)))).count() == 0


# --- packing


def test_packing(docs, none):
    rows = packing.pack(docs, window=64, group_docs=20, with_ids=True).collect()
    path, ranks = packing.vocabulary(), packing.vocabulary("byte_bpe_50k.tiktoken")
    assert Counter(zlib.crc32(np.frombuffer(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows) == {True: len(rows)}
    want = Counter()
    for d in docs.collect():
        ids = [*packing.token_ids(d["text"], path, ranks).tolist(), 1]
        want.update((d["doc_id"], k, tuple(ids[k : k + 64]), len(ids)) for k in range(0, len(ids), 64))
    assert want == Counter((r["doc_id"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["doc_tokens"]) for r in rows)
    for _, pieces in group(rows, "sequence_id").items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 64
    assert packing.pack(none).count() == 0


def group(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def test_tokens_of_both_libraries():
    path, ranks = packing.vocabulary(), packing.vocabulary("byte_bpe_50k.tiktoken")
    for t in ("", "plain text", "<|endoftext|> in text", "naïve 日本語 🙂\u0000￾", "  \n\t  spaces   ", "a" * 3000, "don't I'LL 12345", "  x"):
        assert packing.token_ids(t, path, ranks).tolist() == packing.token_ids(t, path, None).tolist()


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing(seed):
    r = random.Random(seed)
    lengths = [r.randrange(1, 33) for _ in range(200)]
    which, offset = packing.best_fit_decreasing(np.array(lengths), 32)
    left: list[int] = []
    for k in sorted(range(200), key=lambda k: -lengths[k]):
        fits = [c for c in left if c >= lengths[k]]
        if fits and lengths[k] < 32:
            left.remove(min(fits))
            left.append(min(fits) - lengths[k])
        else:
            left.append(32 - lengths[k])
    used = Counter()
    for w, n in zip(which, lengths, strict=True):
        used[w] += n
    assert sorted(32 - v for v in used.values()) == sorted(left)


# --- line dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for k, y in enumerate(b):
            new.append(min(new[-1] + 1, row[k + 1] + 1, row[k] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("bound", [0, 1, 2])
def test_line_dedup(docs, none, bound):
    docs = docs if bound < 2 else docs.where("n_chars < 2000 OR n_chars IS NULL")  # a line's variants at two edits: its length squared
    rows = sorted({(d["doc_id"] is None, d["doc_id"] or 0, d["text"]) for d in docs.collect() if d["text"] is not None})
    seen, want = [], {}
    for z, i, text in rows:
        kept = []
        for line in text.split("\n"):
            w = words(line)
            near = bound and len(w) >= 5 * bound
            if w and any(line == other or (near and len(v) >= 5 * bound and abs(len(w) - len(v)) <= bound and edits(w, v) <= bound) for other, v in seen):
                seen.append((line, w))
                continue
            if w:
                seen.append((line, w))
            kept.append(line)
        want[None if z else i] = "\n".join(kept)
    got = linededup.dedup_lines(docs, bound).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: r["text"] for r in got if r["text"] is not None} == want
    assert linededup.dedup_lines(none).columns == none.columns and linededup.dedup_lines(none).count() == 0


def test_line_dedup_leaves_clashing_names_alone(spark):
    d = spark.createDataFrame([(1, "one two\none two", 5, "x"), (2, None, 6, "y")], "doc_id long, text string, rowloom_th long, ROWLOOM_drop string")
    got = linededup.dedup_lines(d)
    assert got.columns == d.columns and sorted(map(tuple, got.collect())) == [(1, "one two", 5, "x"), (2, None, 6, "y")]


@pytest.mark.parametrize("bound", [1, 2])
def test_line_dedup_of_permuted_cells(spark, bound):
    """Lines of few different words: permuted pairs, pairs that cancel, words said over and over."""
    r = random.Random(11)
    cells = ["3", "5", "7", "9"]
    rows = ["| 3 | 5 | 7 |", "| 5 | 3 | 7 |", "| 5 | 3 | 9 |", "a b a c a d", "a b a q r s", "a c a b a d", "a c a b a d e", "k l m n o p", "k l m n o p q", "la la la la la", "la la la la la la", "| | | | |", "| | | | | | |"]
    rows += ["| " + " | ".join(r.choices(cells, k=r.randrange(3, 12))) + " |" for _ in range(150)]
    rows += [" ".join(r.choices("abc", k=r.randrange(4, 14))) for _ in range(400)] + [" ".join(r.choices("ab", k=r.randrange(5, 18))) for _ in range(200)]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "doc_id long, text string")
    w, least = [words(x) for x in rows], 5 * bound
    near = lambda a, b: min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= bound and edits(a, b) <= bound
    want = {k: "" if any(rows[j] == x or near(w[k], w[j]) for j in range(k)) else x for k, x in enumerate(rows)}
    assert bound == 2 or (want[1] and not want[2] and not want[6] and not want[8])
    assert {x["doc_id"]: x["text"] for x in linededup.dedup_lines(d, bound).collect()} == want


def test_copies_of_short_lines_go(spark):
    texts = ["All rights reserved.\n\n日本語の行です", "one two three four\n\nAll rights reserved.", "日本語の行です\none two three five\n \nAll rights reserved.", " \n"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [texts[0], "one two three four\n", "one two three five\n ", " \n"]
    assert [r["text"] for r in linededup.dedup_lines(d).orderBy("doc_id").collect()] == want


# --- language


def test_language(spark, none):
    r = random.Random(3)
    texts = {"xx": "abcde", "yy": "klmno"}
    rows = [(k, "".join(r.choices(texts[x] + " ", k=80)), x) for k, x in enumerate(["xx", "yy"] * 40)]
    d = spark.createDataFrame([*rows, (900, None, "xx"), (901, "12 34", "yy"), (902, "abc", None)], "doc_id long, text string, lang string")
    langs, profiles = langid.train(d)
    out = {x["doc_id"]: x for x in langid.predict(d, langs, profiles).collect()}
    assert langs == ["xx", "yy"] and all(out[k]["lang_pred"] == x for k, _, x in rows)
    assert out[900]["lang_pred"] == out[901]["lang_pred"] == "und" and out[902]["lang_pred"] == "xx"
    assert langid.predict(d, *langid.train(none)).where("lang_pred <> 'und'").count() == 0


def test_language_by_loops(spark):
    """Prototypes and predictions, one letter at a time; texts that repeat count once, a rare language is learned."""
    r = random.Random(5)
    kinds = {"xx": "abcde ", "yy": "cdefg ", "zz": "àêçdé "}
    rows = [(k, "".join(r.choices(kinds[x], k=r.randrange(1, 60))), x) for k, x in enumerate(["xx", "yy"] * 30 + ["zz"])]
    rows += [(k, t, x) for k, (_, t, x) in enumerate(rows[:5] * 3, 100)] + [(200, "12", "xx"), (201, None, "yy"), (202, "edcba", None)]
    letter = lambda c: langid._letter(ord(c), langid.DIMENSIONS, langid.SEED).astype(float)

    def vector(text):
        s = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip(" ") + " "
        return sum(np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in zip(s, s[1:], s[2:], strict=False))

    has = lambda t: t is not None and any(c.isalpha() for c in t)
    unit = lambda v: v / np.linalg.norm(v)
    profiles = {x: unit(sum(unit(vector(t)) for t in {t for _, t, y in rows if y == x and has(t)})) for x in kinds}
    mean = sum(profiles.values()) / 3
    profiles = {x: unit(v - mean) for x, v in profiles.items()}
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, got = langid.train(d)
    assert langs == sorted(kinds) and np.allclose(got, [profiles[x] for x in langs], atol=1e-4)
    for x in langid.predict(d, langs, got).collect():
        text = rows[[k for k, _, _ in rows].index(x["doc_id"])][1]
        if not has(text):
            assert (x["lang_pred"], x["score"]) == ("und", 0.0)
            continue
        cosines = {y: float(unit(vector(text)) @ v) for y, v in profiles.items()}
        assert abs(cosines[x["lang_pred"]] - max(cosines.values())) < 1e-4 and abs(x["score"] - max(0.0, max(cosines.values()))) < 1e-4


def test_bundle_is_the_sum_of_bound_letters():
    base = np.random.default_rng(langid.SEED).choice(np.array([-1, 1], dtype=np.int8), (256, 64)).astype(int)
    codes = [32, *map(ord, "abca"), 32]
    want = sum(np.roll(base[a], 2) * np.roll(base[b], 1) * base[c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
    assert np.allclose(langid.vector("ABca!", 64), want / np.linalg.norm(want))


def test_scripts_are_told_apart(spark):
    """Scripts whose code points share their low bytes, and letters inside and outside the table side by side."""
    r = random.Random(4)
    starts = {"hi": 0x0915, "pa": 0x0A15, "te": 0x0C15}
    shapes = [[r.choice((0, 1, 2, 5, 6, 7, 0x13, 0x19)) for _ in range(60)] for _ in range(20)]
    rows = [(3 * k + j, "".join(chr(at + x) for x in shape), lang) for k, shape in enumerate(shapes) for j, (lang, at) in enumerate(starts.items())]
    assert all(t.isalpha() for _, t, _ in rows)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(x["doc_id"], x["lang_pred"]) for x in langid.predict(d, *langid.train(d)).collect()} == {(k, x) for k, _, x in rows}
    vec = lambda c: langid._letter(ord(c), 64, langid.SEED).astype(int)
    codes = " aध漢b "
    want = sum(np.roll(vec(a), 2) * np.roll(vec(b), 1) * vec(c) for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
    assert np.allclose(langid.vector("aध漢b", 64), want / np.linalg.norm(want))


# --- quality


def test_quality(docs, none):
    out = quality.host_rules(docs).collect()
    assert len(out) == docs.count() and quality.host_rules(none).count() == 0
    want = Counter()
    for d in docs.collect():
        t, w = d["text"] or "", words(d["text"])
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times = Counter(grams)
        covered = {p for k, g in enumerate(grams) if times[g] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[d["doc_id"], len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 2 * len(covered) > len(w)] += 1
    assert want == Counter(tuple(r[k] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in out)


def test_bad_host(spark):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(k, good if k % 10 else "short", "fine") for k in range(100)] + [(100 + k, "short" if k % 10 else good, "bad") for k in range(100)]
    out = quality.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {(r["host"], r["kept"]) for r in out.where("NOT base_failed").collect()} == {("fine", True), ("bad", False)}


# --- search


@pytest.mark.parametrize("seed", range(3))
def test_top_k(spark, seed):
    r = np.random.default_rng(seed)
    v = r.normal(size=(300, 6)).round(1)
    v[50:120] = v[50]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(300, [1.0, 2.0]), (301, None), (302, [1.0, None]), (303, [float("nan")] * 6), (304, []), (20, v[20].tolist())]
    d = topk.integers(spark.createDataFrame([(*x, 1.0, 0) for x in rows], "vec_id long, embedding array<double>, length double, band int"))
    got = [(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.top_k(d, d.where("vec_id % 20 = 0"), 5, band_rows=40).collect()]
    ints = [(k, np.pad(np.floor(64 * np.array(x)), (0, 6 - len(x)))) for k, x in rows if x is not None and None not in x and np.isfinite(x).all()]
    want = []
    for k, q in {k: x for k, x in ints if k % 20 == 0}.items():
        best = sorted((-int(q @ x), i) for i, x in ints if i != k)[:5]
        want += [(k, place + 1, i, -s) for place, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(d.limit(0), d, 5).count() == 0


def test_top_k_large_numbers(spark):
    d = spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, 1.0]), (2, [3.0, 1e9])], "vec_id long, v array<double>")
    assert [tuple(r) for r in topk.top_k(d, d.where("vec_id = 0"), 2).orderBy("rank").collect()] == [(0, 1, 2, 10**18 + 3 * 10**9), (0, 2, 1, 10**18 + 10**9)]


def test_top_k_beyond_64_bits(spark):
    x = [[1e200, -3.0], [1e200, 5.0], [-1e200, 1.0], [2.0, 1e17], [1e308, 1e308], [0.5, 0.25], [2e18, 1.0]]
    d = topk.integers(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>"))
    ints = [[int(min(max(np.floor(64 * c) if abs(64 * c) < 2**52 else 64 * c, -topk.LARGEST), topk.LARGEST)) for c in v] for v in x]
    want = []
    for q in range(7):
        scores = sorted((-min(max(sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), topk.LOW), topk.HIGH), c) for c in range(7) if c != q)
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores[:3])]
    with np.errstate(over="ignore"):
        assert sorted(map(tuple, topk.top_k(d, d, 3, band_rows=2).collect())) == want


def test_bounds_spare_pairs():
    """What norm order, a carried score and residual bounds leave to compute."""
    r = np.random.default_rng(1)
    c = np.floor(64 * r.normal(size=(6000, 16)) * np.exp(r.normal(size=(6000, 1))) * np.geomspace(4, 0.1, 16))
    rotation = np.linalg.svd(c, full_matrices=False)[2].T
    ids, q = np.arange(6000), np.arange(0, 6000, 100)
    all_, carried = {}, {}
    s, i = topk.search_block(q, c[q], np.full(60, topk.NONE), ids, c, rotation, 5, 4, all_)
    again, _ = topk.search_block(q, c[q], s[:, 4], ids, c, rotation, 5, 4, carried)
    assert carried["pairs"] < all_["pairs"] < 0.6 * 60 * 6000 and (s == again).all()
    want = c[q] @ c.T
    want[np.arange(60), q] = topk.NONE
    assert (s == -np.sort(-want, axis=1)[:, :5]).all()


# --- sharding


def test_shards(docs, none, spark):
    out = sharding.kd_shards(docs, shards=4).collect()
    assert sorted(r["size"] for r in out) == sorted(len((d["text"] or "").encode()) + 1 for d in docs.collect())
    for rows in group(out, "shard").values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert sharding.kd_shards(none, shards=4).count() == 0
    same = spark.range(4000).selectExpr("id AS doc_id", "IF(id < 1500, 'one text for many', concat('t', repeat(sha(CAST(id AS STRING)), CAST(1 + id % 3 AS INT)))) AS text")
    sums = sharding.kd_shards(same, shards=8).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()["s"]
    assert len(sums) == 8 and sums.max() / sums.mean() < 1.06
    assert sharding.kd_shards(spark.range(10).selectExpr("id AS doc_id", "'x' AS text"), target_bytes=5).select("shard").distinct().count() == 4


def kd_tree(rows, keys, shards, slack, name=0):
    """The same tree over sorted lists: rid -> leaf."""
    if shards == 1 or not rows:
        return {r["rid"]: name for r in rows}
    left = (shards + 1) // 2
    goal = sum(r["size"] for r in rows) * left / shards
    width = {d: max(r[d] >> sharding.HASH_BITS for r in rows) - min(r[d] >> sharding.HASH_BITS for r in rows) for d in keys}
    order, best, torn = sorted(keys, key=lambda d: (-width[d], d)), None, None
    for rank, d in enumerate(order):
        sums = Counter()
        for r in rows:
            sums[r[d]] += r["size"]
        before = 0
        for key in sorted(sums):
            if before + sums[key] >= goal or key == max(sums):
                break
            before += sums[key]
        torn = torn or (d, key, before)
        miss, cut = min((abs(before - goal), key), (abs(before + sums[key] - goal), key + 1))
        choice = (miss > slack, miss if miss > slack else 0, rank, d, cut)
        best = min(best or choice, choice)
    over, _, _, d, cut = best
    rid = -1
    if over:
        d, cut, before = torn
        for r in sorted((r for r in rows if r[d] == cut), key=lambda r: r["rid"]):
            if before + r["size"] >= goal:
                rid = r["rid"] + (goal - before > r["size"] / 2)
                break
            before += r["size"]
    right = [r for r in rows if r[d] > cut or (r[d] == cut and r["rid"] >= rid)]
    there = {r["rid"] for r in right}
    return kd_tree([r for r in rows if r["rid"] not in there], keys, left, slack, name) | kd_tree(right, keys, shards - left, slack, name + left)


@pytest.mark.parametrize("shards", [5, 8])
def test_shards_are_the_tree(docs, spark, shards):
    same = spark.range(300).selectExpr("id AS doc_id", "IF(id < 120, 'one text for many', concat('t', repeat(sha(CAST(id AS STRING)), CAST(1 + id % 5 AS INT)))) AS text", "1 AS node", "2 AS shard")
    for d in (docs, same):
        light, keys = sharding.keyed(d)
        light = light.cache()
        rows = [r.asDict() for r in light.collect()]
        slack = 0.01 * sum(r["size"] for r in rows) / shards
        assert {r["rid"]: r["node"] for r in sharding.leaves(light, keys, shards, slack).collect()} == kd_tree(rows, keys, shards, slack)


# --- Jaccard join


def test_jaccard(docs, none):
    sets = []
    for d in docs.collect():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(d["text"])]
        sets.append((d["doc_id"], {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(1, len(w))))}))
    group_of = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and group_of[i] != group_of[j]:
                old = group_of[i]
                group_of = [group_of[j] if g == old else g for g in group_of]
    want = Counter()
    for k, (i, s) in enumerate(sets):
        ids = [sets[m][0] for m in range(len(sets)) if group_of[m] == group_of[k] and sets[m][0] is not None]
        want[i, len(s), (min(ids) if ids else None) if s else i] += 1
    assert want == Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(docs).collect())
    assert max(Counter(group_of).values()) >= 10
    assert jaccard.near_groups(none).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len([i for i in ids if i == 3]) <= 1 and {i for i, _, c in want if i == c} == set(ids)


def test_one_of_each_without_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text, 1), (None, text, 2), (None, text + " x", 3), (7, text + " y", 4), (7, text + " z", 5), (8, "", 6), (8, "", 6), (None, None, 7), (None, "other words alone here now", 8)]
    d = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, rowloom_id long, rowloom_flag long")
    got = jaccard.one_of_each(d)
    assert got.columns == d.columns and sorted(r["rowloom_id"] for r in got.collect()) in ([4, 6, 6, 7, 8], [5, 6, 6, 7, 8])
    d = d.where("doc_id IS NULL AND text IS NOT NULL")
    assert sorted(r["rowloom_id"] for r in jaccard.one_of_each(d).collect())[1:] == [8]


@pytest.mark.parametrize("large", [3, 10**6])
def test_large_groups_are_dealt(spark, monkeypatch, large):
    """Groups of more and of fewer rows than LARGE, of one text and of two, with and without ids: one row for each row."""
    monkeypatch.setattr(jaccard, "LARGE", large)
    texts = [" ".join(f"{g}w{k}" for k in range(60)) for g in "abc"]
    rows = [(k, texts[0]) for k in range(100, 140)] + [(99, texts[0] + " x"), (None, texts[0])] + [(5, texts[1]), (6, texts[1] + " y"), (7, texts[2]), (8, ""), (None, None)]
    rows += [(None, "no number here at all")] * 5
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard.near_groups(d).collect())
    assert got == Counter([(i, 99 if t and t[0] == "a" else 5 if t and t[0] == "b" else i) for i, t in rows])
    assert Counter(r["doc_id"] for r in jaccard.one_of_each(d).collect()) == Counter([99, 5, 7, 8, None, None])


@pytest.mark.parametrize("small, tile", [(2, 1024), (8, 5), (10**6, 1024)])
def test_jaccard_of_clouds(spark, monkeypatch, small, tile):
    """Many sets around one text, some similar to each other and some not, sets far from any hub, and shared passages:
    by hubs and tiles, and by pairs of all."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "TILE_SETS", tile)
    r = random.Random(small + tile)
    base, other = [f"b{k}" for k in range(60)], [[f"p{j}x{k}" for k in range(12)] for j in range(8)]
    texts = [" ".join(w if r.random() > share else f"n{r.randrange(9)}" for w in base) for share in (0.0, 0.01, 0.03, 0.06) for _ in range(30)]
    texts += [" ".join(sum(r.sample(other, 4), [])) for _ in range(60)] + [" ".join(base[:40] + [f"u{k}x{j}" for j in range(12)]) for k in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    group_of = list(range(len(sets)))
    for i, j in links:
        old, new = max(group_of[i], group_of[j]), min(group_of[i], group_of[j])
        group_of = [new if g == old else g for g in group_of]
    counts: dict = {}
    assert {x["doc_id"]: x["component_id"] for x in jaccard.near_groups(d, counts=counts).collect()} == dict(enumerate(group_of))
    after = [counts[f"candidates after {o} orders"] for o in (1, 2, 3)]
    assert after == sorted(after, reverse=True) and len(links) > 100 and (small < 10**6 or counts["hub pairs"] == 0)


def test_forest_joins_what_links_join():
    r = random.Random(5)
    sets = [np.array(sorted(r.sample(range(30), 20)), dtype=np.uint64) for _ in range(40)] + [np.arange(k, k + 60, dtype=np.uint64) + np.uint64(1000) for k in range(40)]
    sids = np.arange(80)
    linked = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    for roots in (sids, sids // 7):
        pairs = jaccard._forest(sids, roots, sets, 80)
        assert all(linked(a, b) for a, b in pairs)
        up = {k: int(roots[k]) for k in range(80)}
        for a, b in [*pairs, *((i, j) for i in range(80) for j in range(i) if linked(i, j))][: len(pairs)]:
            old = up[a]
            up = {k: up[b] if v == old else v for k, v in up.items()}
        assert all(up[i] == up[j] for i in range(80) for j in range(i) if linked(i, j))


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 8), (20, 21)] + [(100, k) for k in range(101, 130)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20} | {k: 100 for k in range(100, 130)}


# --- mixing


def test_mixing(spark, docs, none):
    rows = mixing.mix(docs, extra={"from": "source"}).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r["from"]] += r["size"]
        taken[r["from"]] += r["taken"]
        target[r["from"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            want[s] = 2 * sizes[s] if full else level * weight[s]
            left -= want[s] if full else 0
        open_ = open_ - full if full else set()
    assert target == pytest.approx(want) and all(taken[s] == int(target[s]) for s in names)
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    per = Counter()
    for r in mixed.collect():
        per[r["source"]] += len(words(r["text"]))
    assert all(taken[s] - 60 <= per[s] <= taken[s] for s in names)
    clash = spark.createDataFrame([(k, f"w{k} x y", "a", k, "z") for k in range(9)] + [(9, None, None, 9, "z"), (10, "one two", None, 10, "z")], "doc_id long, text string, source string, rowloom_key long, ROWLOOM_part string")
    got, plan = mixing.mixed_documents(clash), Counter()
    assert got.columns == clash.columns and mixing.mixed_documents(clash.limit(0)).count() == 0
    for r in mixing.mix(clash).collect():
        plan[r["doc_id"]] = r["taken"]
    words_of = Counter()
    for r in got.collect():
        words_of[r["doc_id"]] += len(words(r["text"]))
    assert words_of == +plan
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


# --- toxicity


def test_toxicity(spark):
    r = random.Random(7)
    rows = []
    for k in range(600):
        w = [f"w{r.randrange(300)}" for _ in range(40)]
        bad = k % 10 == 0
        for _ in range(3 * bad):
            w[r.randrange(40)] = r.choice(["idiot", "scum", "grobnak", "grobnaks", "grobnaki"])
        rows.append((k, " ".join(re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], x) for x in w), int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(d, toxicity.training(d))
    out = {x["doc_id"]: x for x in toxicity.score(d, model).collect()}
    assert np.mean([out[k]["predicted"] == y for k, _, y in rows]) > 0.98
    hard = spark.createDataFrame([(1, None), (2, ""), (3, "you idiot scum idiot"), (3, "you idiot scum idiot"), (None, "fine words")], "doc_id long, text string")
    assert [x["predicted"] for x in toxicity.score(hard, model).orderBy("doc_id").collect()] == [0, 0, 0, 1, 1]
    assert toxicity.without_toxic(hard, model).count() == 3
    empty = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [x["predicted"] for x in toxicity.score(hard, empty).orderBy("doc_id").collect()] == [0, 0, 0, 1, 1]


def test_every_pattern_reads_every_text():
    known = toxicity.Families(toxicity.lexicon_of())
    for text in ("You scumbag", "you are such a moronic person", "you're an utterly trashy", "no insult at all, shut up", "an idiot", "clownfish you", "", None, "s**t you losers"):
        low = (text or "").lower()
        assert toxicity.signals(text, known)[-len(toxicity.PATTERNS) :] == [len(p.findall(low)) for p in toxicity.PATTERNS]


def test_label_model_shares_the_voice_of_copies():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.2
    v = np.where(y[:, None], r.random((4000, 4)) < 0.8, r.random((4000, 4)) < 0.05).astype(float)
    v = np.column_stack([v, v[:, 0], v[:, 0]])
    fires, share, prior, q = toxicity.label_model(v, (v.sum(axis=1) >= 2) * 0.9, 0.1)
    assert share[0] < 0.6 < share[1] and abs(prior - 0.2) < 0.05 and ((q > 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("seed", range(3))
def test_label_model_by_loops(seed):
    """The same estimates, one text and one voter at a time."""
    r = np.random.default_rng(seed)
    v = (r.random((60, 4)) < 0.3).astype(float)
    start, n, m = (v.sum(axis=1) >= 2) * 0.9, 60, 4
    q = [min(max(x, 0.02), 0.98) for x in start]
    for _ in range(5):
        weight = [[1 - x for x in q], q]
        fires = [[(sum(weight[y][i] * v[i, j] for i in range(n)) + (0.02, 0.5)[y]) / (sum(weight[y]) + 1) for j in range(m)] for y in (0, 1)]
        prior = min(max(sum(q) / n, 1e-3), 0.5)
        share = []
        for j in range(m):
            tied = 0.0
            for k in range(m):
                for y in (0, 1):
                    cov = lambda a, b, y=y: sum(weight[y][i] * (v[i, a] - fires[y][a]) * (v[i, b] - fires[y][b]) for i in range(n)) / sum(weight[y])
                    tied += 0.5 * min(max(cov(j, k) / np.sqrt(max(cov(j, j), 1e-9) * max(cov(k, k), 1e-9)), 0), 1) * (j != k)
            share.append(1 / (1 + tied))
        q = []
        for i in range(n):
            odds = np.log(prior / (1 - prior)) + sum(share[j] * np.log((fires[1][j] / fires[0][j]) if v[i, j] else (1 - fires[1][j]) / (1 - fires[0][j])) for j in range(m))
            q.append(1 / (1 + np.exp(-odds)))
    got = toxicity.label_model(v, start, 0.1, rounds=5)
    for a, b in zip(got, (fires, share, prior, q), strict=True):
        assert np.allclose(a, b)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "idiot scum " * 3, 1.0), (2, "idiot scum " * 3, 2.0), (3, "fine words here", None), (None, None, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, None), (None, 1), (9, 7)], "doc_id long, toxic int")
    first, second = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(3), labels.repartition(2))
    assert np.allclose(first.weights, second.weights) and first.lexicon == second.lexicon
    out = toxicity.score(docs, first)
    assert out.columns == ["doc_id", "score", "predicted"] and [r["predicted"] for r in out.orderBy("doc_id").collect()] == [0, 1, 1, 0]
    assert toxicity.score(docs.limit(0), first).count() == 0 and toxicity.without_toxic(docs, first).columns == docs.columns
