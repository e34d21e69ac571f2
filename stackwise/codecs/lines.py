"""Two line formats: Aleph sequential and MicroLIF."""

from __future__ import annotations

import re
import unicodedata

from ..types import DEFAULT_LEADER, control, data
from .errors import RecordError


def parse_aleph(text: str) -> list[dict]:
    """Columns 0-8 number, 10-12 tag, 13-14 indicators, 16 script, from 18 content; consecutive lines
    of one number are a record."""
    records, last = [], None
    for line in text.replace("\r\n", "\n").split("\n"):
        if not line.strip():
            continue
        if len(line) < 18 or not line[:9].isdigit():
            raise RecordError(f'not an Aleph sequential line: "{line[:40]}"')
        if line[:9] != last:
            last = line[:9]
            records.append({"leader": DEFAULT_LEADER, "fields": []})
        tag, body = line[10:13], unicodedata.normalize("NFC", line[18:])
        if tag == "LDR":
            records[-1]["leader"] = f"{body.replace('^', ' '):<24}"[:24]
        elif tag < "010":
            records[-1]["fields"].append(control(tag, body.replace("^", " ")))
        else:
            records[-1]["fields"].append(data(tag, line[13], line[14], *[(p[0], p[1:]) for p in body.split("$$")[1:] if p]))
    return records


def parse_microlif(text: str) -> list[dict]:
    """One field a line, ``_x`` before subfields, a backtick at a record's end."""
    records, current, first = [], None, True
    for line in text.replace("\r\n", "\n").split("\n"):
        ends = line.endswith("`")
        body = line.rstrip("`")
        if body.strip() and not re.match(r"HEADR|HDR", body):
            m = re.match(r"LDR(.*)|([0-9A-Za-z]{3})(.*)", body, re.DOTALL)
            if not m or not (m[1] is not None or re.match(r"[0-9]{3}", body)):
                if not first:
                    raise RecordError(f'not a MicroLIF line: "{body[:40]}"')
            else:
                current = current or {"leader": DEFAULT_LEADER, "fields": []}
                if m[1] is not None:
                    current["leader"] = f"{m[1]:<24}"[:24]
                else:
                    current["fields"].append(_microlif_field(m[2], unicodedata.normalize("NFC", m[3])))
            first = False
        if ends and current is not None:
            records.append(current)
            current = None
    return records + ([current] if current else [])


def _microlif_field(tag: str, body: str) -> dict:
    if tag < "010":
        return control(tag, body)
    lead, *parts = re.split(r"_(?=[a-z0-9])", body[2:])
    implied = [("a", lead)] if lead else []
    return data(tag, f"{body:<2}"[0], f"{body:<2}"[1], *implied, *[(p[0], p[1:]) for p in parts])
