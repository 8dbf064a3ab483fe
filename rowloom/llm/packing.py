"""Packing documents into token windows, best fit decreasing.

Documents are tokenized where they lie; overlong ones are first cut into full windows. Only the pieces'
numbers (and ids, if asked for) are dealt to groups of bounded size; in each group pieces go, longest first, to
the tightest open window, which a segment tree over remaining capacities finds.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rowloom.llm.common import parts, table

#: Tokens of a window; the id that ends a document; documents in a packing group, about.
WINDOW, END_ID, GROUP_DOCS = 2048, 1, 2000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def _exact(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _ranked(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


def token_ids(text: str | None, path: str, ranks: str | None) -> np.ndarray:
    """Ids of a text. Where the vocabulary also exists as ranks, the faster of two libraries that give the same
    ids is used; a text it cannot take goes to the other."""
    if not text:
        return np.zeros(0, dtype="<u4")
    if ranks:
        try:
            return np.asarray(_ranked(ranks).encode_to_numpy(text, allowed_special="all"), dtype="<u4")
        except BaseException as e:  # the library's panics are no Exceptions; their type cannot be imported
            if type(e).__name__ != "PanicException":
                raise
    return np.array(_exact(path).encode(text, add_special_tokens=False).ids, dtype="<u4")


class Fits:
    """Open windows by remaining capacity; a segment tree answers: the least capacity of at least n."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, which: int) -> None:
        self.open[capacity].append(which)
        i = self.size + capacity
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """Remove the tightest open window that has n left; its capacity and number."""
        i = self.size + n
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i + (not self.tree[2 * i])
        capacity = i - self.size
        while i:
            self.tree[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every piece its window's number and its offset there. Ties: in the order given."""
    which, offset = np.zeros(len(lengths), dtype="i8"), np.zeros(len(lengths), dtype="i8")
    fits, opened = Fits(window), 0
    for k in np.argsort(-lengths, kind="stable"):
        n = int(lengths[k])
        found = fits.take(n) if n < window else None
        if found is None:
            found, opened = (window, opened), opened + 1
        left, w = found
        which[k], offset[k] = w, window - left
        if left > n:
            fits.add(left - n, w)
    return which, offset


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None, ranks: str | None = None, with_ids: bool = False, group_docs: int = GROUP_DOCS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Null text: empty, so the document is its end id alone; texts of any length; docs' other columns are left out. Pieces
    of one length go in order of their checksum, document's tokens, start and doc_id. Repeated rows are packed each. Pieces are dealt to
    groups in turn, not by a key, so equal documents spread. Empty table: no rows. path: the vocabulary
    for tokenizers; ranks: the same vocabulary as ranks, if there is such a file (both default to the public 50k one).
    """
    if path is None:
        path, ranks = vocabulary(), vocabulary("byte_bpe_50k.tiktoken")
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    groups = parts(docs.count(), group_docs)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = None
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.append(token_ids(text, path, ranks), np.uint32(end_id)).astype("<u4")
                if turn is None:
                    turn = zlib.crc32(ids.tobytes(), len(ids)) % groups  # tasks start at different groups
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    values = [doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), turn] + [piece.tobytes()] * with_ids
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                    turn = (turn + 1) % groups
            types = [batch.schema.field("doc_id").type, *[pa.int64()] * 5] + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", "doc_tokens", "start", "doc_id"], ascending=False, kind="stable")
        which, offset = best_fit_decreasing(pdf["length"].to_numpy(), window)
        if not pd.api.types.is_numeric_dtype(pdf["doc_id"]):
            pdf["doc_id"] = pdf["doc_id"].astype(object)  # strings in several chunks do not convert back
        return pdf.assign(sequence_id=(pdf["part"].to_numpy() << 32) + which, offset=offset).drop(columns="part")

    kinds = f"doc_id {doc_type}, start long, length long, ids_crc32 long, doc_tokens long"
    ids = ", ids binary" * with_ids
    pieces = docs.select("doc_id", "text").mapInArrow(cut, f"{kinds}, part long{ids}")
    return pieces.groupBy("part").applyInPandas(fit, f"{kinds}{ids}, sequence_id long, offset long")


def op2_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
