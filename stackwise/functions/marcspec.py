"""A subset of MARCspec: ``245$a``, ``6..$a[0]``, ``650[1-#]^2``, ``008/35-37``, ``LDR/6``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..types import clean_fields, is_control
from .records import tag_test

_RANGE = r"(?:#|[0-9]+)(?:-(?:#|[0-9]+))?"
_SPEC = re.compile(rf"(LDR|[0-9A-Za-z.]{{3}})(?:\[({_RANGE})\])?(?:/({_RANGE})|\^([12])|((?:\$[0-9a-z](?:\[{_RANGE}\])?)+))?", re.ASCII)


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class Spec:
    tag: str
    fields: tuple | None
    characters: tuple | None
    indicator: int | None
    codes: tuple[tuple[str, tuple | None], ...]


def _range(text: str | None) -> tuple | None:
    if text is None:
        return None
    start, dash, stop = text.partition("-")
    end = lambda x: None if x == "#" else int(x)
    return (end(start), end(stop) if dash else end(start))


def parse(spec: str) -> Spec:
    m = _SPEC.fullmatch(spec)
    if not m or (m[1] == "LDR" and (m[2] or m[4] or m[5])):
        raise SpecError(f'unsupported MARCspec "{spec}"')
    codes = tuple((c, _range(r or None)) for c, r in re.findall(rf"\$([0-9a-z])(?:\[({_RANGE})\])?", m[5] or ""))
    return Spec(m[1], _range(m[2]), _range(m[3]), int(m[4]) if m[4] else None, codes)


def _pick(items: list, span: tuple | None) -> list:
    """Members in a range; ``#`` is the last one when it ends a range, or counts back from it when
    it opens one."""
    if span is None:
        return items
    start, stop = span
    last = len(items) - 1
    if start is None:
        low, high = (last, last) if stop is None else (last - stop, last)
    else:
        low, high = start, last if stop is None else stop
    return [x for i, x in enumerate(items) if max(low, 0) <= i <= high]


def _cut(value: str, span: tuple | None) -> str | None:
    if span is None:
        return value
    raw = value.encode()
    own = bytes(_pick(list(raw), span))
    return own.decode("utf-8", "replace") if own else None


def evaluate(spec: Spec, leader: str | None, fields: list[dict] | None) -> list[str] | None:
    if fields is None:
        return None
    if spec.tag == "LDR":
        own = _cut(leader or "", spec.characters)
        return [own] if own is not None else []
    test, found = tag_test(spec.tag), []
    for f in _pick([f for f in clean_fields(fields) if test(f["tag"])], spec.fields):
        if is_control(f):
            if spec.indicator is None and not spec.codes and (own := _cut(f["value"], spec.characters)) is not None:
                found.append(own)
        elif spec.indicator:
            found.append(f[f"ind{spec.indicator}"])
        elif spec.codes:
            for code, span in spec.codes:
                found += _pick([s["value"] for s in f["subfields"] if s["code"] == code], span)
        elif spec.characters is None:
            found.append(" ".join(s["value"] for s in f["subfields"]))
    return found
