"""MARC-in-JSON: single objects, arrays, lines of objects and the usual envelopes."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

from ..types import clean_fields, control, data, is_control
from .errors import RecordError


def _documents(text: str) -> list:
    decoder, at, found = json.JSONDecoder(), 0, []
    text = text.removeprefix("﻿")
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            break
        try:
            value, at = decoder.raw_decode(text, at)
        except json.JSONDecodeError as e:
            raise RecordError(f"invalid JSON: {e.msg}") from None
        found.append(value)
    if not found:
        raise RecordError("empty JSON input")
    return found


def _objects(value: object) -> Iterator[dict]:
    """The records' objects in the usual envelopes."""
    if isinstance(value, list):
        for x in value:
            yield from _objects(x)
        return
    if not isinstance(value, dict):
        raise RecordError("a record must be a JSON object")
    if "fields" in value:
        yield value
        return
    for key in ("parsedRecord", "content", "sourceRecords", "records"):
        if key in value:
            yield from _objects(value[key])
            return
    raise RecordError("no fields in the JSON object")


def _record(value: dict) -> dict:
    text = lambda v: v if v.isascii() else unicodedata.normalize("NFC", v)
    fields = []
    if not isinstance(value["fields"], list):
        raise RecordError("fields must be an array")
    for entry in value["fields"]:
        if not isinstance(entry, dict) or len(entry) != 1:
            raise RecordError("a field must be an object of one member")
        ((tag, body),) = entry.items()
        if tag < "010":
            if not isinstance(body, str):
                raise RecordError(f"control field {tag} must be a string")
            fields.append(control(tag, text(body)))
            continue
        if not isinstance(body, dict):
            raise RecordError(f"data field {tag} must be an object")
        parts = []
        for s in body.get("subfields", []):
            if not isinstance(s, dict) or len(s) != 1 or not isinstance(next(iter(s.values())), str):
                raise RecordError(f"a subfield of {tag} must be an object of one string")
            parts += [(c, text(v)) for c, v in s.items()]
        fields.append(data(tag, body.get("ind1") or " ", body.get("ind2") or " ", *parts))
    leader = value.get("leader")
    return {"leader": leader if isinstance(leader, str) else " " * 24, "fields": fields}


def parse(text: str) -> list[dict]:
    return [_record(r) for value in _documents(text) for r in _objects(value)]


def count(text: str) -> int:
    """Records that ``parse`` would give."""
    return sum(1 for value in _documents(text) for _ in _objects(value))


def write(leader: str | None, fields: list[dict]) -> str:
    """One object on one line."""
    entries = []
    for f in clean_fields(fields):
        if is_control(f):
            entries.append({f["tag"]: f["value"]})
        else:
            entries.append({f["tag"]: {"ind1": f["ind1"], "ind2": f["ind2"], "subfields": [{s["code"]: s["value"]} for s in f["subfields"]]}})
    return json.dumps({"leader": leader or " " * 24, "fields": entries}, ensure_ascii=False, separators=(",", ":"))
