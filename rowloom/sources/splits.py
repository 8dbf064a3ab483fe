"""Byte ranges of a report file.

A range begins at a `<`, so no mark is cut in two. Whether it begins inside a comment, CDATA or a processing
instruction follows from the ranges before it: each range is summed up as where it leads from any of the four states,
ranges are summed up in parallel, and the sums are chained.
"""

from __future__ import annotations

import contextlib
import os
from typing import BinaryIO

from rowloom.sources.flatten import CLOSES, check_tail

OPENS = ((b"<!--", 1), (b"<![CDATA[", 2), (b"<?", 3))
#: Files under this size are one range.
SMALL = 8 << 20


@contextlib.contextmanager
def opened(path: str):
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path)
        with where.open_input_file(name) as f:
            yield f
    else:
        with open(path.removeprefix("file://"), "rb") as f:
            yield f


def size_of(path: str) -> int:
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path)
        return where.get_file_info(name).size
    return os.stat(path.removeprefix("file://")).st_size


def ranges(path: str, size: int, count: int) -> list[tuple[int, int]]:
    """At most `count` ranges of about one size that cover the file, each from a `<` on."""
    cuts = [0]
    with opened(path) as f:
        for k in range(1, count):
            at = _next_tag(f, max(size * k // count, cuts[-1] + 1), size)
            if at < size and at > cuts[-1]:
                cuts.append(at)
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], size], strict=True) if b > a]


def _next_tag(f: BinaryIO, at: int, size: int) -> int:
    while at < size:
        f.seek(at)
        block = f.read(1 << 16)
        if not block:
            break
        found = block.find(b"<")
        if found >= 0:
            return at + found
        at += len(block)
    return size


def leads_to(data: bytes, state: int) -> int:
    """The state at the end of data that begins in `state`."""
    pos, size = 0, len(data)
    ahead = [-1] * len(OPENS)  # where each mark comes next; looked for again only once it lies behind
    while True:
        if state:
            found = data.find(CLOSES[state], pos)
            if found < 0:
                return state
            pos, state = found + len(CLOSES[state]), 0
        for k, (mark, _) in enumerate(OPENS):
            if ahead[k] < pos:
                found = data.find(mark, pos)
                ahead[k] = size if found < 0 else found
        at = min(ahead)
        if at == size:
            return 0
        mark, state = OPENS[ahead.index(at)]
        pos = at + len(mark)


def transfer(data: bytes) -> list[int]:
    return [leads_to(data, s) for s in range(4)]


def chained(transfers: list[list[int]]) -> list[int]:
    """The state that each range begins in."""
    out, state = [], 0
    for t in transfers:
        out.append(state)
        state = t[state]
    return out


def read_range(path: str, start: int, end: int) -> bytes:
    with opened(path) as f:
        f.seek(start)
        return f.read(end - start)


def records_of(path: str, start: int, end: int, size: int, state: int, reader):  # noqa: ANN001, ANN201
    """What reader.records() finds in a range, with the buffer that it lies in and the buffer's place; what follows the
    range is read as far as its last row needs."""
    more = 1 << 20
    data, base = read_range(path, start, min(end + more, size)), start
    while True:
        cut = None
        for at, shape, got in reader.records(data, 0, end - base, state):
            if got is None:
                cut = at
            else:
                yield base + at, data, shape, got
        if cut is None:
            return
        if base + len(data) >= size:
            return check_tail(data[cut:])
        more *= 4
        base, state = base + cut, 0
        data = read_range(path, base, min(max(end, base) + more, size))


def rows_of(path: str, start: int, end: int, size: int, state: int, reader):  # noqa: ANN001, ANN201
    """Rows that open in a range, with their places."""
    for at, data, shape, got in records_of(path, start, end, size, state, reader):
        yield at, shape.row(data, got) if shape else got
