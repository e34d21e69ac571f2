"""Breaker text (.mrk): one field a line, ``$`` before subfield codes, backslash for a blank."""

from __future__ import annotations

import re
import unicodedata

from ..types import DEFAULT_LEADER, clean_fields, control, data, is_control
from .errors import RecordError


def escape(value: str) -> str:
    return value.replace("$", "{dollar}")


def _plain(value: str) -> str:
    return unicodedata.normalize("NFC", value.replace("{dollar}", "$"))


def field_line(f: dict) -> str:
    if is_control(f):
        return f"={f['tag']}  {escape(f['value'])}"
    inds = "".join("\\" if i == " " else i for i in (f["ind1"], f["ind2"]))
    return f"={f['tag']}  {inds}" + "".join(f"${s['code']}{escape(s['value'])}" for s in f["subfields"])


def parse_field(line: str) -> dict:
    if not line.startswith("=") or len(line) < 6:
        raise RecordError(f'not a breaker line: "{line}"')
    tag, body = line[1:4], line[6:]
    if tag < "010":
        return control(tag, _plain(body.replace("\\", " ")))
    inds = [" " if c == "\\" else c for c in f"{body[:2]:<2}"]
    return data(tag, *inds, *[(p[0], _plain(p[1:])) for p in body[2:].split("$")[1:] if p])


def parse(text: str) -> list[dict]:
    """Records of a text; each =LDR line opens one, and so does a first line of another kind."""
    records: list[dict] = []
    for line in text.replace("\r\n", "\n").split("\n"):
        if not line.strip():
            continue
        if not line.startswith("=") or len(line) < 6:
            raise RecordError(f'not a breaker line: "{line}"')
        if line[1:4] == "LDR":
            records.append({"leader": f"{line[6:].replace(chr(92), ' '):<24}"[:24], "fields": []})
            continue
        if not records:
            records.append({"leader": DEFAULT_LEADER, "fields": []})
        records[-1]["fields"].append(parse_field(line))
    return records


def count(text: str) -> int:
    """Records that ``parse`` would give."""
    first = re.search(r"\S", text)
    opens = len(re.findall(r"(?m)^=LDR", text))
    return opens + bool(first and not text[text.rfind("\n", 0, first.start()) + 1 :].startswith("=LDR"))


def write(leader: str | None, fields: list[dict]) -> str:
    return "\n".join([f"=LDR  {leader or DEFAULT_LEADER}", *map(field_line, clean_fields(fields))]) + "\n"
