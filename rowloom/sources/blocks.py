"""Report rows read block by block into Arrow columns.

In a block without comments, CDATA or instructions, tags lie where `<` does. Rows of the known shapes are found and
checked for the whole block at once: each mark of a shape is compared, byte for byte, with what every row has at the
mark's place. Rows that hold entities or match no shape are read one by one, and so is a block whose rows overlap or
that has more than plain tags. All of these give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from rowloom.errors import XmlError
from rowloom.sources.flatten import CLOSES, RowReader, Shape, after, check_tail
from rowloom.sources.splits import read_range

#: Bytes of a block; bytes behind it that its last row may take without being read by itself; mean bytes of values
#: that are still gathered byte by byte.
BLOCK, TAIL, SHORT = 1 << 21, 1 << 16, 64
LT, QUOTE, AMP = b'<"&'
#: What may follow a tag's name.
ENDS = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c>/"))


def _windows(arr: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """arr[p : p + n] for every p; p + n must not pass the end."""
    return np.lib.stride_tricks.as_strided(arr, (len(arr) - n + 1, n), (1, 1))[at]


class Spans:
    """Values of rows as spans of a buffer: row numbers, starts and lengths by column, and values that lie elsewhere."""

    def __init__(self, source: np.ndarray, count: int, width: int):
        self.source = source
        self.start = np.full((width, count), -1, dtype=np.int64)
        self.size = np.zeros((width, count), dtype=np.int64)
        self.extra = bytearray()

    def put(self, column: int, row: int, value: bytes) -> None:
        self.start[column, row], self.size[column, row] = self.keep(value), len(value)

    def keep(self, value: bytes) -> int:
        self.extra += value
        return len(self.source) + len(self.extra) - len(value)

    def batch(self, names: list[str]) -> pa.RecordBatch:
        source = np.concatenate([self.source, np.frombuffer(bytes(self.extra), dtype=np.uint8)])
        return pa.RecordBatch.from_arrays([self._array(source, self.start[k], self.size[k]) for k in range(len(names))], names=names)

    @staticmethod
    def _array(source: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
        count, ends = len(start), np.concatenate([[0], np.cumsum(size)])
        total = int(ends[-1])
        if total > SHORT * count:
            view = memoryview(source)
            held = np.frombuffer(b"".join([view[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True) if n]), dtype=np.uint8)
        else:
            held = source[np.repeat(start - ends[:-1], size) + np.arange(total)]
        valid = np.packbits(start >= 0, bitorder="little")
        try:
            out = pa.Array.from_buffers(pa.large_binary(), count, [pa.py_buffer(valid), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(held)])
            return out.cast(pa.string())
        except pa.ArrowInvalid as e:
            raise XmlError(f"invalid UTF-8: {e}") from e


class BlockReader:
    def __init__(self, row_tag: str, names: list[str]):
        self.reader = RowReader(row_tag)
        self.names, self.place = names, {n: k for k, n in enumerate(names)}

    def read(self, path: str, start: int, end: int, size: int, state: int) -> Iterator[pa.RecordBatch]:
        """The rows that open in a range; what follows it is read as far as the last row needs."""
        more = 1 << 20
        data, base = read_range(path, start, min(end + more, size)), start
        pos = after(data, CLOSES[state], 0) if state else 0
        while True:
            cut = None
            while pos < end - base and cut is None:
                batch, pos, cut = self._block(data, pos, end - base)
                if batch is not None:
                    yield batch
            if cut is None:
                return
            if base + len(data) >= size:
                return check_tail(data[cut:])
            more *= 4
            base, pos = base + cut, 0
            data = read_range(path, base, min(max(end, base) + more, size))

    def _block(self, data: bytes, pos: int, end: int) -> tuple[pa.RecordBatch | None, int, int | None]:
        """Rows that open in the block at pos; where the next one begins; where a row begins that the buffer cuts off."""
        stop = min(pos + BLOCK, end)
        got = self._at_once(data, pos, stop) if self.reader.shapes else None
        if got is None:
            return self._one_by_one(data, pos, min(pos + BLOCK // 8, end))
        return got

    def _one_by_one(self, data: bytes, pos: int, stop: int) -> tuple[pa.RecordBatch | None, int, int | None]:
        rows, cut, last = [], None, stop
        for at, shape, got in self.reader.records(data, pos, stop):
            if got is None:
                cut = at
                break
            rows.append(shape.row(data, got) if shape else got)
        else:
            last = max(stop, self.reader.reached)
        return self._batch(Spans(np.zeros(0, dtype=np.uint8), len(rows), len(self.names)), dict(enumerate(rows))), last, cut

    def _batch(self, spans: Spans, rows: dict[int, list[tuple[str, str]]]) -> pa.RecordBatch | None:
        for k, row in rows.items():
            for name, value in row:
                if (c := self.place.get(name)) is not None:
                    spans.put(c, k, value.encode())
        count = spans.start.shape[1]
        if not count:
            return None
        if not self.names:
            return pa.RecordBatch.from_struct_array(pa.array([{}] * count, pa.struct([])))
        return spans.batch(self.names)

    def _at_once(self, data: bytes, pos: int, stop: int) -> tuple[pa.RecordBatch | None, int, int | None] | None:
        """None if this block must be read row by row."""
        stop = min(stop, len(data)) - pos
        arr = np.frombuffer(data, dtype=np.uint8, offset=pos, count=min(stop + TAIL, len(data) - pos))
        tags = np.flatnonzero(arr == LT)
        inner, n = tags[tags < stop], len(self.reader.tag) + 2
        if len(inner) and inner[-1] + n > len(arr):
            return None
        after_ = arr[inner + 1]
        if ((after_ == 33) | (after_ == 63)).any():  # <! or <?
            return None
        first = inner[after_ == self.reader.tag[0]]
        if len(first):
            w = _windows(arr, first, n)
            first = first[(w[:, 1:-1] == np.frombuffer(self.reader.tag, dtype=np.uint8)).all(axis=1) & ENDS[w[:, -1]]]
        if not len(first):
            return None, pos + stop, None
        spans, ends = Spans(arr, len(first), len(self.names)), np.full(len(first), -1, dtype=np.int64)
        at, quotes = np.searchsorted(tags, first), np.flatnonzero(arr == QUOTE)
        amps = np.flatnonzero(arr == AMP) if data.find(b"&", pos, pos + len(arr)) >= 0 else np.zeros(0, dtype=np.int64)
        for shape in list(self.reader.shapes):
            open_ = np.flatnonzero(ends < 0)
            if not len(open_):
                break
            self._match(shape, arr, open_, first, at, tags, quotes, amps, spans, ends)
        rows = {}
        for k in np.flatnonzero(ends < 0).tolist():
            if k and first[k] < ends[k - 1]:
                return None
            _, shape, got = next(self.reader.records(data, pos + int(first[k]), pos + int(first[k]) + 1))
            if got is None:
                return None  # the row-by-row path says where the row begins
            rows[k], ends[k] = shape.row(data, got) if shape else got, self.reader.reached - pos
        if (first[1:] < ends[:-1]).any():
            return None
        return self._batch(spans, rows), pos + max(stop, int(ends[-1])), None

    def _match(self, shape: Shape, arr: np.ndarray, rows: np.ndarray, first: np.ndarray, at: np.ndarray, tags: np.ndarray, quotes: np.ndarray, amps: np.ndarray, spans: Spans, ends: np.ndarray) -> None:
        if any(mark[:1] not in (b"<", b'"') for _, mark, _ in shape.marks):
            return
        rows = rows[at[rows] + sum(mark.count(b"<") for _, mark, _ in shape.marks) <= len(tags)]
        quote = np.searchsorted(quotes, first[rows])
        passed, tag, seen = [], 0, 0
        upto = first[rows]
        for opens, mark, n in shape.marks:
            if opens == b"<":
                here = tags[at[rows] + tag]
            else:
                fine = quote + seen < len(quotes)
                rows, quote, upto, passed = rows[fine], quote[fine], upto[fine], [(a[fine], z[fine]) for a, z in passed]
                here = quotes[quote + seen]
            fine = (here >= upto) & (here + n <= len(arr))
            fine[fine] = (_windows(arr, here[fine], n) == np.frombuffer(mark, dtype=np.uint8)).all(axis=1) if fine.any() else False
            passed.append((upto, here))
            if not fine.all():
                rows, quote, here, passed = rows[fine], quote[fine], here[fine], [(a[fine], z[fine]) for a, z in passed]
            if not len(rows):
                return
            upto = here + n
            tag, seen = tag + mark.count(b"<"), seen + mark.count(b'"')
        plain = np.searchsorted(amps, first[rows]) == np.searchsorted(amps, upto)  # no entity in the row
        if not plain.all():
            rows, upto, passed = rows[plain], upto[plain], [(a[plain], z[plain]) for a, z in passed]
        ends[rows] = upto
        for name, places in shape.plan.items():
            c = self.place.get(name)
            if c is None:
                continue
            if isinstance(places, bytes):
                spans.start[c, rows], spans.size[c, rows] = spans.keep(places), len(places)
                continue
            start, size = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
            for p in places:
                a, z = passed[p + 1]
                start, size = np.where(z > a, a, start), np.where(z > a, z - a, size)
            spans.start[c, rows], spans.size[c, rows] = start, size
