"""From report XML to flat rows.

A row is every element of the row tag, at any depth. Its attributes come first, then whatever start tags stand before
its end tag, nesting ignored: a Field under its Name or FieldName attribute (the first of them), with the text of the
last Value or FormattedValue that begins with text; a Text under its Name with its TextValue; a Section with its
SectionNumber; anything else under its tag, empty. Empty is not missing. A name met twice keeps its first place and
its last value. A row that the file's end cuts off is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from rowloom.errors import XmlError

TOKEN = re.compile(
    rb"<(?:!--(?P<comment>.*?)-->|!\[CDATA\[(?P<cdata>.*?)\]\]>|\?(?P<pi>.*?)\?>|!(?P<decl>[^>]*)>|/(?P<end>[^\s>]*)\s*>"
    rb"|(?P<start>[^\s/>!?<][^\s/>]*)(?P<attrs>(?:[^>\"'<]|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>)|(?P<text>[^<]+)",
    re.S,
)
ATTR = re.compile(rb"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)
VALUES = {b"Field": (b"FormattedValue", b"Value"), b"Text": (b"TextValue",)}
KEYS = {b"Field": (b"FieldName", b"Name"), b"Text": (b"Name",)}
#: Row shapes that a reader remembers.
SHAPES = 32

ENTITY = re.compile(r"&(?:#(?:x([0-9A-Fa-f]+)|([0-9]+))|(\w+))?(;?)")
#: The entities of XML (fixed values); there are no others without a document type.
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}

Row = list[tuple[str, str]]


def unescape(text: str) -> str:
    """Entities and numeric references replaced; XmlError for any other ampersand."""

    def one(m: re.Match) -> str:
        code = int(m[1], 16) if m[1] else int(m[2]) if m[2] else None
        if not m[4] or (code is None and m[3] not in ENTITIES):
            raise XmlError(f"unknown or unended entity {m[0]!r}")
        if code is None:
            return ENTITIES[m[3]]
        if not 0 < code < 0x110000 or 0xD800 <= code < 0xE000:
            raise XmlError(f"no character has the number of {m[0]!r}")
        return chr(code)

    return ENTITY.sub(one, text)


def decoded(raw: bytes) -> str:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise XmlError(f"invalid UTF-8: {e}") from e
    return unescape(text) if "&" in text else text


def _attrs(raw: bytes) -> list[tuple[bytes, bytes]]:
    return [(m[1], m[2] if m[2] is not None else m[3]) for m in ATTR.finditer(raw)]


def _key(tag: bytes, attrs: bytes) -> str:
    return next((decoded(v) for k, v in _attrs(attrs) if k in KEYS[tag]), tag.decode())


class Shape:
    """A row shape met before: the markup around its values, the names in order, and for each name the numbers of
    the values that may hold it (the last one with text does), or a fixed value."""

    __slots__ = ("marks", "plan")

    def __init__(self, marks: list[bytes], plan: list[tuple[str, list[int] | bytes]]):
        self.marks = [(m[:1], m, len(m)) for m in marks]
        self.plan = dict(plan)  # of a name met twice the first place and the last value

    def match(self, buf: bytes, at: int) -> list[int] | None:
        """Where the values of a row of this shape start and end, by turns, after the row's own end; None if the row
        has another shape. A value ends at the first byte of the mark behind it: a `<`, or its closing quote."""
        find, starts = buf.find, buf.startswith
        _, mark, n = self.marks[0]
        if not starts(mark, at):
            return None
        pos, cuts = at + n, [0]
        for first, mark, n in self.marks[1:]:
            i = find(first, pos)
            if i < 0 or not starts(mark, i):
                return None
            cuts += (pos, i)
            pos = i + n
        cuts[0] = pos
        return cuts

    def row(self, buf: bytes, cuts: list[int]) -> Row:
        return [(k, decoded(cut_out(buf, cuts, p))) for k, p in self.plan.items()]


def cut_out(buf: bytes, cuts: list[int], places: list[int] | bytes) -> bytes:
    """A value of a row that a shape has matched."""
    if isinstance(places, bytes):
        return places
    for p in reversed(places):
        a, z = cuts[2 * p + 1], cuts[2 * p + 2]
        if z > a:
            return buf[a:z]
    return b""


class RowReader:
    """Reads rows out of a buffer. Rows of a shape met before are matched mark by mark; a row of a new shape, or with
    comments or CDATA, is read token by token. Both give the same rows."""

    def __init__(self, row_tag: str, shapes: bool = True):
        self.tag = row_tag.encode()
        self.skips = re.compile(b"<!--|<!\\[CDATA\\[|<\\?|<" + re.escape(self.tag) + rb"(?=[\s>/])")
        self.shapes: list[Shape] | None = [] if shapes else None
        self.reached = 0  # the end of the last row, comment, CDATA or instruction

    def records(self, buf: bytes, start: int, end: int, state: int = 0) -> Iterator[tuple[int, Shape | None, list[int] | Row | None]]:
        """What opens in buf[start:end], with its place: a known shape and its cuts, or no shape and the row. state:
        the one of CLOSES that start lies in. The last row may reach beyond end; if the buffer ends before it does, it
        comes as None."""
        pos = start
        if state:
            pos = after(buf, CLOSES[state], start)
        while pos < end:
            self.reached = pos
            m = self.skips.search(buf, pos)
            if not m or m.start() >= end:
                return
            at, what = m.start(), m[0]
            if what == b"<!--":
                pos = after(buf, b"-->", m.end())
            elif what == b"<![CDATA[":
                pos = after(buf, b"]]>", m.end())
            elif what == b"<?":
                pos = after(buf, b"?>", m.end())
            else:
                for k, shape in enumerate(self.shapes or ()):
                    cuts = shape.match(buf, at)
                    if cuts:
                        if k:
                            self.shapes.insert(0, self.shapes.pop(k))
                        self.reached = pos = cuts[0]
                        yield at, shape, cuts
                        break
                else:
                    got = self._read(buf, at)
                    if got is None:
                        yield at, None, None
                        return
                    pos, row = got
                    self.reached = pos
                    yield at, None, row
        self.reached = pos

    def rows(self, buf: bytes, start: int, end: int, state: int = 0) -> Iterator[tuple[int, Row | None]]:
        """records(), all of them as rows."""
        for at, shape, got in self.records(buf, start, end, state):
            yield at, shape.row(buf, got) if shape else got

    def _read(self, buf: bytes, at: int) -> tuple[int, Row] | None:
        row: dict[str, str] = {}
        shape: list[bytes] | None = [b""]  # marks around values, None if the row must not be remembered
        plan: list[tuple[str, list[int] | bytes]] = []  # names, and the groups with their values or a fixed one
        groups = 0
        pos, first, inside, key, value, places = at, True, b"", "", "", []
        fresh = False  # whether the last tag opened a value
        wanted: tuple[bytes, ...] = ()
        while True:
            m = TOKEN.match(buf, pos)
            if not m:
                if pos >= len(buf) or buf.find(b">", pos) < 0 or _unclosed(buf, pos):
                    return None  # cut off by the end of the buffer
                raise XmlError(f"malformed markup at byte {pos}")
            pos, kind = m.end(), m.lastgroup if m.lastgroup != "empty" else "start"
            raw = m[0]
            if kind == "text":
                if fresh:
                    value = decoded(raw)
                    places.append(groups)
                if shape is not None and (fresh or raw.strip()):  # a value, or text that no value takes
                    shape.append(b"")
                    groups += 1
                elif shape is not None:
                    shape[-1] += raw
                fresh = False
                continue
            if fresh and shape is not None:  # an empty value
                shape.append(b"")
                places.append(groups)
                groups += 1
            fresh = False
            if kind in ("comment", "cdata", "pi", "decl"):
                shape = None
                continue
            if kind == "end":
                if shape is not None:
                    shape[-1] += raw
                if inside and m["end"] == inside:
                    row[key] = value
                    plan.append((key, places))
                    inside = b""
                elif not inside and m["end"] == self.tag:
                    return self._done(pos, row, shape, plan)
                continue
            tag, attrs, empty = m["start"], m["attrs"], bool(m["empty"])
            if first:
                first = False
                rest = raw[1 + len(tag) :]
                last = 0
                if shape is not None:
                    shape[-1] += b"<" + tag
                for a in ATTR.finditer(rest):
                    name = decoded(a[1])
                    row[name] = decoded(a[2] if a[2] is not None else a[3])
                    g = 2 if a[2] is not None else 3
                    if shape is not None:
                        shape[-1] += rest[last : a.start(g)]
                        shape.append(b"")
                    last = a.end(g)
                    plan.append((name, [groups]))
                    groups += 1
                if shape is not None:
                    shape[-1] += rest[last:]
                if empty:
                    return self._done(pos, row, shape, plan)
                continue
            if shape is not None:
                shape[-1] += raw
            if inside:
                fresh = tag in wanted and not empty
                continue
            if tag in VALUES:
                key, value, places, wanted = _key(tag, attrs), "", [], VALUES[tag]
                if empty:
                    row[key] = ""
                    plan.append((key, []))
                else:
                    inside = tag
            elif tag == b"Section":
                number = next((v for k, v in _attrs(attrs) if k == b"SectionNumber"), b"")
                row["Section"] = decoded(number)
                plan.append(("Section", number))  # the tag is part of the pattern, so its number is fixed
            else:
                row[tag.decode()] = ""
                plan.append((tag.decode(), []))

    def _done(self, pos: int, row: dict[str, str], shape: list[bytes] | None, plan: list) -> tuple[int, Row]:
        if self.shapes is not None and shape is not None and not any(isinstance(p, bytes) and b"&" in p for _, p in plan):
            self.shapes.insert(0, Shape(shape, plan))
            del self.shapes[SHAPES:]
        return pos, list(row.items())


#: What ends the region that a split may begin in: nothing, a comment, CDATA, a processing instruction.
CLOSES = (b"", b"-->", b"]]>", b"?>")


def after(buf: bytes, mark: bytes, pos: int) -> int:
    found = buf.find(mark, pos)
    return len(buf) if found < 0 else found + len(mark)


def _unclosed(buf: bytes, pos: int) -> bool:
    """Whether the markup at pos has no end in the buffer: a comment, CDATA or instruction, or an open quote."""
    for mark, end in ((b"<!--", b"-->"), (b"<![CDATA[", b"]]>"), (b"<?", b"?>")):
        if buf.startswith(mark, pos):
            return buf.find(end, pos) < 0
    return re.compile(rb"<[^>\"'<]*(?:(?:\"[^\"]*\"|'[^']*')[^>\"'<]*)*(?:\"[^\"]*|'[^']*)?\Z").match(buf, pos) is not None


def check_tail(data: bytes) -> None:
    """A file may end within a row (which is dropped), but not within a tag."""
    if data.find(b">", max(data.rfind(b"<"), 0)) < 0:
        raise XmlError("the file ends within a tag")


def flatten(data: bytes, row_tag: str = "Row", shapes: bool = True) -> list[Row]:
    out = []
    for at, row in RowReader(row_tag, shapes).rows(data, 0, len(data)):
        if row is None:
            check_tail(data[at:])
        else:
            out.append(row)
    return out
