"""Files in pieces of whole records, so that many tasks read one file in bounded memory.

A piece is a range of bytes; its ends move on to where the next record begins.  Such a place is told by
the bytes around it: after a terminator in ISO 2709, before an ``=LDR`` line in breaker text, between
two values that only a line end parts in JSON, between ``</record>`` and ``<record`` in XML.  Files
without such places, packed ones and those of other formats are one piece.
"""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator

import numpy as np

from ..codecs import breaker, iso2709, marcjson, marcxml
from ..codecs.errors import RecordError
from .datasource import _files, _store
from .readers import TEXT_FORMATS, _number, _wanted

#: Small, as Spark hands 100 pieces at a time to Python and all that comes of them back.
PIECE = 1 << 17
_LOOK = 1 << 12
_CUTS = {
    "marc": re.compile(rb"\x1d"),
    "mrk": re.compile(rb"\n(?==LDR)"),
    # Within an array or object a comma or colon would stand there, and strings hold no line end.
    "marcjson": re.compile(rb"[}\]][ \t\r]*\n\s*(?=[{\[])"),
    "marcxml": re.compile(rb"</(?:[\w.-]+:)?record\s*>\s*(?=<(?:[\w.-]+:)?record[\s/>])"),
}


class _Bytes:
    def __init__(self, path: str):
        store, inner, _ = _store(path)
        self.file, self.size = store.open_input_file(inner), store.get_file_info(inner).size

    def __enter__(self) -> _Bytes:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def read(self, start: int, stop: int) -> bytes:
        self.file.seek(start)
        return self.file.read(stop - start)

    def cut(self, fmt: str, at: int) -> int:
        """The first place from ``at`` on where a record begins; the end if there is none."""
        if at <= 0 or at >= self.size:
            return max(0, min(at, self.size))
        low, reach = max(0, at - 64), _LOOK
        while True:
            data = self.read(low, low + reach)
            for m in _CUTS[fmt].finditer(data):
                if low + m.end() >= at:
                    return low + m.end()
            if low + len(data) >= self.size:
                return self.size
            reach *= 4

    def piece(self, fmt: str, start: int, stop: int) -> bytes:
        return self.read(self.cut(fmt, start), self.cut(fmt, stop))


def pieces(fmt: str, path: str, size: int = PIECE) -> Iterator[tuple[str, int, int, int]]:
    """(file, start, stop, pieces of the file)."""
    for file in _files(path):
        with _Bytes(file) as held:
            n = -(-held.size // size) if fmt in _CUTS and not file.endswith(".gz") else 1
            if n <= 1 or held.cut(fmt, size) == held.size:
                yield file, 0, held.size, 1
                continue
            for k in range(n):
                yield file, k * size, min((k + 1) * size, held.size), n


def count(fmt: str, file: str, start: int, stop: int, parts: int) -> tuple[int, bool]:
    """Records of a piece, and whether its file must be read whole: XML with comments or CDATA, which
    may hold what looks like records."""
    if parts == 1:
        return 0, False
    with _Bytes(file) as held:
        raw = held.piece(fmt, start, stop)
    if fmt == "marc":
        return sum(1 for p in raw.split(iso2709.RT) if p.lstrip(b"\n\r ")), False
    if fmt == "marcxml":
        return marcxml.count(raw), b"<!--" in raw or b"<![CDATA[" in raw
    if fmt == "marcjson" and (text := _lines_of_objects(raw)) is not None:
        return text.count("\n"), False
    text = raw.decode("utf-8", "replace")
    return (breaker.count(text) if fmt == "mrk" else marcjson.count(text) if text.strip() else 0), False


def records(fmt: str, file: str, start: int, stop: int, parts: int, before: int, encoding: str = "auto", lenient: bool = False) -> Iterator[tuple[int, dict]]:
    """(number, record) of a piece that ``before`` records precede."""
    with _Bytes(file) as held:
        raw = held.read(0, held.size) if parts == 1 else held.piece(fmt, start, stop)
    if parts == 1 and file.endswith(".gz"):
        raw = gzip.decompress(raw)
    if fmt != "marc":
        text = raw.decode("utf-8", "replace")
        if parts == 1 or text.strip():
            yield from enumerate(TEXT_FORMATS[fmt](text), before + 1)
        return
    own = (p.lstrip(b"\n\r ") for p in raw.split(iso2709.RT))
    for n, piece in enumerate((p for p in own if p), before + 1):
        try:
            yield n, iso2709.parse(piece, encoding)
        except RecordError as e:
            if not lenient:
                raise RecordError(f"{file} record {n}: {e}") from None


_ASCII = bytes(range(32, 127))
#: Formats whose plain pieces go to the JVM whole.
PLAIN = ("marc", "mrk", "marcjson")


def plain(fmt: str, raw: bytes, encoding: str = "auto") -> str | None:
    """The bytes as a text that ``as_json`` takes apart as ``records`` does, with nothing after the last
    record; None if that is not certain."""
    if fmt == "mrk":
        ok = raw.startswith(b"=LDR") and not raw.translate(None, _ASCII + b"\n") and not re.search(rb"(?m)^(?!=.{5}|\ *$)", raw)
        return raw.decode("ascii") if ok else None
    if fmt != "marc" or encoding not in ("auto", "utf8") or not raw.endswith(iso2709.FT + iso2709.RT) or raw.translate(None, _ASCII + b"\x1d\x1e\x1f"):
        return None
    return raw[:-1].decode("ascii") if _in_order(np.frombuffer(raw, np.uint8), encoding == "utf8") else None


def _in_order(a: np.ndarray, utf8: bool) -> bool:
    """Whether each record's directory tells of its fields one after another, as their terminators do."""
    ends, marks = np.flatnonzero(a == 0x1D), np.flatnonzero(a == 0x1E)
    starts = np.concatenate(([0], ends[:-1] + 1))
    if (ends - starts < 25).any() or (a[ends - 1] != 0x1E).any() or (a[starts] == 32).any() or not (utf8 or (a[starts + 9] == ord("a")).all()):
        return False
    k = np.searchsorted(marks, starts)
    first, n = marks[k], np.searchsorted(marks, ends) - k - 1
    if (first - starts != 24 + 12 * n).any():
        return False
    record = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n)
    entry = a[(starts[record] + 24 + 12 * j)[:, None] + np.arange(12)].astype(np.int64)
    numbers = entry[:, 3:] - 48
    if (numbers < 0).any() or (numbers > 9).any():
        return False
    begin, end = marks[k[record] + j] + 1, marks[k[record] + j + 1]
    control = entry[:, :3] @ [1 << 16, 1 << 8, 1] < int.from_bytes(b"010")
    return bool(
        (numbers[:, :4] @ [1000, 100, 10, 1] == end - begin + 1).all()
        and (numbers[:, 4:] @ [10000, 1000, 100, 10, 1] == begin - first[record] - 1).all()
        and (control | (end - begin >= 2)).all()
    )


#: Quotes and backslashes stand as characters that plain texts don't have until the JSON is made; they
#: are on the same side of the digits.
_HELD = bytes.maketrans(b'"\\', b"\x01\x7f")
_OPEN = '"},{"code":"'
_STRING = r'"[^"]*+"'
_PART = rf"\{{{_STRING}:{_STRING}\}}"
_PARTS = rf"(?:{_PART}(?:,{_PART})*+)?+"
_CONTROL_JSON = rf"\{{{_STRING}:{_STRING}\}}"
_FIELD_JSON = rf'(?:{_CONTROL_JSON}|\{{{_STRING}:\{{"ind1":{_STRING},"ind2":{_STRING},"subfields":\[{_PARTS}\]\}}\}})'
_LINES_JSON = re.compile(rf'(?:\{{"leader":{_STRING},"fields":\[(?:{_FIELD_JSON}(?:,{_FIELD_JSON})*+)?+\]\}}\n)++')
_EACH_JSON = re.compile(rf'\{{"leader":{_STRING}|\{{"([^"]*)":("[^"]*")\}}|\{{"([^"]*)":\{{"ind1":"([^"]*)","ind2":"([^"]*)","subfields":\[({_PARTS})\]\}}\}}')
_CODE_JSON = re.compile(r'\{("[^"]*"):("[^"]*"\})')


class _Odd(Exception):
    pass


def as_json(fmt: str, raw: bytes, encoding: str = "auto") -> str | None:
    """The records of a piece as a JSON array of (leader, fields), which the JVM parses faster than its
    expressions take the text apart; None if it is not plain and regular."""
    try:
        if fmt == "marcjson":
            return _json_of_lines(raw)
        text = plain(fmt, raw, encoding)
        if text is None:
            return None
        records = (_json_of_marc if fmt == "marc" else _json_of_mrk)(text.encode().translate(_HELD).decode())
        return "[" + ",".join(records).replace("\x01", '\\"').replace("\x7f", "\\\\") + "]"
    except _Odd:
        return None


def _json_field(tag: str, body: str, inds: str) -> str:
    """A field whose subfields begin with ``_OPEN`` where they had their marks."""
    if tag < "010":
        if '"' in body:
            raise _Odd
        return f'{{"tag":"{tag}","value":"{body}"}}'
    if '"' in inds:
        raise _Odd
    at = body.find(_OPEN)
    parts = "" if at < 0 else body[at + 3 :] + '"}'
    return f'{{"tag":"{tag}","ind1":"{inds[0]}","ind2":"{inds[1]}","subfields":[{parts}]}}'


def _json_of_marc(text: str) -> Iterator[str]:
    text = re.sub("\x1f([ -~\x01\x7f])", r'"},{"code":"\1","value":"', text)
    if "\x1f" in text:
        raise _Odd
    for record in text.split("\x1d"):
        head, *bodies, _ = record.split("\x1e")
        if len(head) != 24 + 12 * len(bodies) or '"' in head:
            raise _Odd
        tags = (head[k : k + 3] for k in range(24, len(head), 12))
        yield f'{{"leader":"{head[:24]}","fields":[{",".join([_json_field(t, b, b[:2]) if t < "010" else _json_field(t, b[2:], b[:2]) for t, b in zip(tags, bodies, strict=True)])}]}}'


def _json_of_mrk(text: str) -> Iterator[str]:
    text = re.sub("[$]([^$\n])", r'"},{"code":"\1","value":"', text)
    if "$" in text:
        raise _Odd
    for record in re.split("\n(?==LDR)", text.replace("{dollar}", "$")):
        first, *lines = [x for x in record.split("\n") if x.strip(" ")]
        if '"' in first:
            raise _Odd
        fields = [_json_field(x[1:4], x[6:].replace("\x7f", " "), "") if x[1:4] < "010" else _json_field(x[1:4], x[8:], f"{x[6:8]:<2}".replace("\x7f", " ")) for x in lines]
        yield f'{{"leader":"{f"{first[6:]:<24}"[:24].replace(chr(0x7F), " ")}","fields":[{",".join(fields)}]}}'


def _lines_of_objects(raw: bytes) -> str | None:
    """The text, if it is lines of objects as the writer has them.  No string of it holds a quote, so
    those tell where strings end."""
    if b"\\" in raw or raw.translate(None, _ASCII + b"\n"):
        return None
    text = raw.decode("ascii")
    text = text if text.endswith("\n") else text + "\n"
    return text if _LINES_JSON.fullmatch(text) else None


def _json_of_lines(raw: bytes) -> str | None:
    text = _lines_of_objects(raw)
    if text is None:
        return None
    return "[" + _EACH_JSON.sub(_json_of_match, text).rstrip("\n").replace("\n", ",") + "]"


def _json_of_match(m: re.Match) -> str:
    tag, value, other, ind1, ind2, parts = m.groups()
    if tag is not None and tag < "010":
        return f'{{"tag":"{tag}","value":{value}}}'
    if other is None and tag is None:
        return m[0]
    if tag is not None or other < "010":
        raise _Odd
    return f'{{"tag":"{other}","ind1":"{ind1 or " "}","ind2":"{ind2 or " "}","subfields":[{_CODE_JSON.sub(r'{"code":\1,"value":\2', parts)}]}}'


class Pieces:
    def eval(self, fmt: str, path: str):
        yield from pieces(fmt, path)


class Both:
    """The pieces of two paths, each once, and of which path they are."""

    def eval(self, fmt: str, one: str, other: str):
        first, second = (dict.fromkeys(pieces(fmt, path)) for path in (one, other))
        for piece in first | second:
            yield *piece, piece in first, piece in second


class Count:
    def eval(self, fmt: str, file: str, start: int, stop: int, parts: int):
        yield count(fmt, file, start, stop, parts)


class Read:
    """A plain piece goes to the JVM whole, as JSON (``raw``; ``record_no`` is the number before).  Of
    others each record goes there, with its fields as JSON, which it parses faster than Python hands over
    nested rows."""

    def eval(self, fmt: str, file: str, start: int, stop: int, parts: int, before: int, encoding: str, tags: str, ignore_errors: bool):
        wanted = _wanted(tags)
        if wanted is None and fmt in PLAIN and not (parts == 1 and (file.endswith(".gz") or stop > 4 * PIECE)):
            with _Bytes(file) as held:
                raw = held.read(0, held.size) if parts == 1 else held.piece(fmt, start, stop)
            text = as_json(fmt, raw, encoding or "auto")
            if text is not None:
                yield before, None, None, None, text
                return
        for n, record in records(fmt, file, start, stop, parts, before, encoding or "auto", bool(ignore_errors)):
            fields = record["fields"]
            kept = fields if wanted is None else [f for f in fields if f["tag"] in wanted]
            yield n, _number(fields), record["leader"], json.dumps(kept, separators=(",", ":")), None
