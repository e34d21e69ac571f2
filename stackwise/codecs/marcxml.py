"""MARCXML: a tolerant reader of records in any envelope, and a writer."""

from __future__ import annotations

import re
import unicodedata

from ..types import DEFAULT_LEADER, clean_fields, control, data, is_control
from .errors import RecordError

_MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)(?:[\w.-]+:)?([\w.-]+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:[\w.-]+:)?([\w.-]+)\s*=\s*(\"[^\"]*\"|'[^']*')")
_PARTS = re.compile(rb"<(/?)(?:[\w.-]+:)?(record|leader|controlfield|datafield)(?=[\s/>])")
_ENTITY = re.compile(r"&(?:#x([0-9A-Fa-f]+)|#([0-9]+)|(amp|lt|gt|quot|apos));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[3]:
            return _NAMED[m[3]]
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "�"

    return _ENTITY.sub(one, text) if "&" in text else text


_HEAD = re.compile(r"\s*(?:<\?xml[^<>]*\?>\s*)?(?:<collection(?:\s[^<>]*)?(?<!/)>\s*)?")
_FOOT = re.compile(r"\s*(?:</collection>\s*)?")
_LEADER = re.compile(r"\s*<record>\s*<leader>([^<]*)</leader>")
_FIELD = re.compile(r'\s*<(?:controlfield tag="([^"&<>]*)">([^<]*)</controlfield>|datafield tag="([^"&<>]*)" ind1="([^"&<>]*)" ind2="([^"&<>]*)">((?:\s*<subfield code="[^"&<>]*">[^<]*</subfield>)*)\s*</datafield>)')
_SUBFIELD = re.compile(r'<subfield code="([^"&<>]*)">([^<]*)</subfield>')
_END = re.compile(r"\s*</record>")


def _regular(text: str) -> list[dict] | None:
    """Records of the plain form that ``write`` gives; None of any other."""
    exact = "&" not in text and text.isascii()
    value = (lambda v: v) if exact else (lambda v: unicodedata.normalize("NFC", unescape(v)))
    found, at = [], _HEAD.match(text).end()
    while m := _LEADER.match(text, at):
        fields, at, leader = [], m.end(), value(m[1])
        while m := _FIELD.match(text, at):
            tag, body, own, ind1, ind2, parts = m.groups()
            at = m.end()
            if own is None:
                fields.append(control(tag, value(body)))
            else:
                fields.append({"tag": own, "ind1": ind1 or " ", "ind2": ind2 or " ", "value": None, "subfields": [{"code": c, "value": value(v)} for c, v in _SUBFIELD.findall(parts)]})
        if not (m := _END.match(text, at)):
            return None
        found.append({"leader": f"{leader:<24}"[:24], "fields": fields})
        at = m.end()
    return found if _FOOT.match(text, at).end() == len(text) else None


def parse(text: str) -> list[dict]:
    regular = _regular(text)
    return _any(text) if regular is None else regular


def _any(text: str) -> list[dict]:
    """Records that have a leader or fields; an inner ``record`` starts afresh within an outer one."""
    found, record, field, held, start = [], None, None, None, 0

    def value(end: int) -> str:
        return unicodedata.normalize("NFC", unescape(text[start:end]))

    for m in _MARKUP.finditer(text):
        name = m[2]
        if name not in ("record", "leader", "controlfield", "datafield", "subfield"):
            continue
        closing, empty = bool(m[1]), bool(m[4])
        if name == "record":
            if closing:
                if record and (record["leader"] or record["fields"]):
                    found.append({"leader": record["leader"] or DEFAULT_LEADER, "fields": record["fields"]})
                record = None
            else:
                record = {"leader": None, "fields": []}
            continue
        if record is None:
            continue
        if not closing:
            own = {k: unescape(v[1:-1]) for k, v in _ATTRIBUTE.findall(m[3])}
            needed = {"controlfield": "tag", "datafield": "tag", "subfield": "code"}.get(name)
            if needed and needed not in own:
                raise RecordError(f"{name} without {needed}")
            if name == "datafield":
                field = data(own["tag"], own.get("ind1") or " ", own.get("ind2") or " ")
                record["fields"].append(field)
            else:
                held, start = own, m.end()
            if not empty:
                continue
            if name == "datafield":
                field = None
                continue
        end = m.end() if not closing else m.start()
        body = "" if not closing else value(end)
        if name == "leader":
            record["leader"] = f"{body:<24}"[:24]
        elif name == "controlfield" and held is not None:
            record["fields"].append(control(held["tag"], body))
        elif name == "subfield" and held is not None and field is not None:
            field["subfields"].append({"code": held["code"], "value": body})
        elif name == "datafield":
            field = None
        held = None
    return found


def count(raw: bytes) -> int:
    """Records that ``parse`` would give of bytes without comments and CDATA."""
    found, inside, some = 0, False, False
    for m in _PARTS.finditer(raw):
        if m[2] == b"record":
            found += bool(m[1]) and inside and some
            inside, some = not m[1], False
        elif inside:
            some = True
    return found


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


HEADER = '<?xml version="1.0" encoding="UTF-8"?>\n<collection xmlns="http://www.loc.gov/MARC21/slim">\n'
FOOTER = "</collection>\n"


def write(leader: str | None, fields: list[dict]) -> str:
    lines = ["  <record>", f"    <leader>{escape(leader or DEFAULT_LEADER)}</leader>"]
    for f in clean_fields(fields):
        if is_control(f):
            lines.append(f'    <controlfield tag="{escape(f["tag"])}">{escape(f["value"])}</controlfield>')
            continue
        lines.append(f'    <datafield tag="{escape(f["tag"])}" ind1="{escape(f["ind1"])}" ind2="{escape(f["ind2"])}">')
        lines += [f'      <subfield code="{escape(s["code"])}">{escape(s["value"])}</subfield>' for s in f["subfields"]]
        lines.append("    </datafield>")
    return "\n".join([*lines, "  </record>\n"])
