"""ISO 2709 records: parsing and writing."""

from __future__ import annotations

import unicodedata

from ..types import DEFAULT_LEADER, clean_fields, control, data, is_control
from . import marc8
from .errors import RecordError

FT, RT, US = b"\x1e", b"\x1d", b"\x1f"


def text_of(raw: bytes, utf8: bool, table: str = "") -> str:
    return unicodedata.normalize("NFC", raw.decode("utf-8", "replace")) if utf8 else marc8.decode(raw, table)


def parse(raw: bytes, encoding: str = "auto", tags: frozenset[str] | None = None) -> dict:
    """One record with or without its terminator.  The directory, not the leader, tells where the
    fields begin; with ``tags`` only those fields are decoded.  ``encoding`` may end in
    ``;codetable=`` and the file of the East Asian code table for MARC-8."""
    encoding, _, table = encoding.partition(";codetable=")
    if encoding not in ("auto", "utf8", "marc8"):
        raise ValueError(f"encoding must be auto, utf8 or marc8, not {encoding}")
    if len(raw) < 24:
        raise RecordError("record shorter than leader")
    leader = raw[:24].decode("latin-1")
    utf8 = encoding == "utf8" or (encoding == "auto" and leader[9] == "a")
    end = raw.find(FT, 24)
    if end < 0:
        raise RecordError("no directory terminator")
    if (end - 24) % 12:
        raise RecordError(f"directory length {end - 24} not multiple of 12")
    fields, base = [], end + 1
    for at in range(24, end, 12):
        tag = raw[at : at + 3].decode("latin-1")
        numbers = raw[at + 3 : at + 12]
        if not numbers.isdigit():
            raise RecordError(f"non-numeric directory entry for tag {tag}")
        size, start = int(numbers[:4]), int(numbers[4:])
        if base + start + size > len(raw):
            raise RecordError(f"field {tag} extends past end of record")
        if tags is not None and tag not in tags:
            continue
        body = raw[base + start : base + start + size].rstrip(RT).removesuffix(FT)
        if tag < "010":
            fields.append(control(tag, text_of(body, utf8, table)))
            continue
        if len(body) < 2:
            raise RecordError(f"data field {tag} shorter than indicators")
        parts = [(chr(p[0]), text_of(p[1:], utf8, table)) for p in body[2:].split(US)[1:] if p]
        fields.append(data(tag, chr(body[0]), chr(body[1]), *parts))
    return {"leader": leader, "fields": fields}


def write(leader: str | None, fields: list[dict], encoding: str = "utf8", normalize: str = "nfc") -> bytes:
    """The record's bytes: lengths, base address and Leader/09 are set, other positions kept."""
    encoding, _, table = encoding.partition(";codetable=")
    if encoding not in ("utf8", "marc8") or normalize not in ("nfc", "nfd"):
        raise ValueError("ENCODING must be utf8 or marc8, NORMALIZE nfc or nfd")
    head = leader if leader is not None and len(leader) == 24 and leader.isascii() else DEFAULT_LEADER
    code = (lambda v: marc8.encode(v, table)) if encoding == "marc8" else lambda v: unicodedata.normalize(normalize.upper(), v).encode()
    directory, body = bytearray(), bytearray()
    for f in clean_fields(fields):
        if is_control(f):
            own = code(f["value"])
        else:
            own = (f["ind1"] + f["ind2"]).encode() + b"".join(US + s["code"].encode() + code(s["value"]) for s in f["subfields"])
        own += FT
        if len(own) > 9999:
            raise RecordError(f"field {f['tag']} is {len(own)} bytes, more than 9999")
        directory += f"{f['tag']:>3.3}{len(own):04d}{len(body):05d}".encode("latin-1", "replace")
        body += own
    base = 24 + len(directory) + 1
    total = base + len(body) + 1
    if total > 99999:
        raise RecordError(f"record is {total} bytes, more than 99999")
    head = f"{total:05d}{head[5:9]}{'a' if encoding == 'utf8' else ' '}{head[10:12]}{base:05d}{head[17:]}"
    return head.encode() + bytes(directory) + FT + bytes(body) + RT
