"""Edits with literal patterns as Spark SQL expressions: the JVM side of the editing functions.

Same results as :mod:`stackwise.functions.records`, without leaving whole-stage code for Python.
Patterns, codes and tags are Python strings and are checked when the plan is built; use the SQL
functions where they come from columns.
"""

from __future__ import annotations

import re

from ..types import FIELD_DDL, FIELDS_DDL
from .expr import field_value, in_list, q
from .marcspec import parse
from .records import RDA_WORDS, EditError, is_control_tag, literal_tag, one_character, tag_test

_CONTROL = "f.value IS NOT NULL AND f.subfields IS NULL"


def _matches(pattern: str) -> str:
    tag_test(pattern)
    return f"f.tag = {q(pattern)}" if "." not in pattern else f"f.tag RLIKE {q('^' + pattern.replace('.', '.') + '$')}"


def _field(tag: str = "f.tag", ind1: str = "f.ind1", ind2: str = "f.ind2", value: str = "f.value", subfields: str = "f.subfields") -> str:
    return f"CAST(named_struct('tag', {tag}, 'ind1', {ind1}, 'ind2', {ind2}, 'value', {value}, 'subfields', {subfields}) AS {FIELD_DDL})"


def clean(fields: str) -> str:
    """Without null members; absent indicators and codes blank, absent subfield values empty."""
    blank = lambda x: f"coalesce(nullif({x}, ''), ' ')"
    parts = f"transform(filter(coalesce(f.subfields, array()), s -> s IS NOT NULL), s -> named_struct('code', {blank('s.code')}, 'value', coalesce(s.value, '')))"
    tag = "coalesce(f.tag, '')"
    control = _field(tag, "NULL", "NULL", "f.value", "NULL")
    return f"transform(filter({fields}, f -> f IS NOT NULL), f -> IF({_CONTROL}, {control}, {_field(tag, blank('f.ind1'), blank('f.ind2'), 'NULL', parts)}))"


def _change(fields: str, pattern: str, changed: str) -> str:
    return f"transform({clean(fields)}, f -> IF(f.subfields IS NOT NULL AND {_matches(pattern)}, {changed}, f))"


def remove_fields(fields: str, pattern: str) -> str:
    return f"filter({clean(fields)}, f -> NOT ({_matches(pattern)}))"


def remove_subfield(fields: str, pattern: str, code: str) -> str:
    code = q(one_character(code, "subfield code"))
    emptied = f"f.subfields IS NOT NULL AND {_matches(pattern)} AND size(f.subfields) > 0 AND forall(f.subfields, s -> s.code = {code})"
    return _change(f"filter({clean(fields)}, f -> NOT ({emptied}))", pattern, _field(subfields=f"filter(f.subfields, s -> s.code != {code})"))


def set_subfield(fields: str, pattern: str, code: str, value: str) -> str:
    """``value`` is an expression."""
    code = q(one_character(code, "subfield code"))
    new = f"named_struct('code', {code}, 'value', coalesce({value}, ''))"
    parts = f"concat(transform(f.subfields, s -> IF(s.code = {code}, {new}, s)), IF(exists(f.subfields, s -> s.code = {code}), array(), array({new})))"
    return _change(fields, pattern, _field(subfields=parts))


def set_indicators(fields: str, pattern: str, ind1: str | None = None, ind2: str | None = None) -> str:
    new = [f"f.{n}" if v is None else q(one_character(v, n)) for n, v in (("ind1", ind1), ("ind2", ind2))]
    return _change(fields, pattern, _field(ind1=new[0], ind2=new[1]))


def rename_subfield(fields: str, pattern: str, old: str, new: str) -> str:
    old, new = q(one_character(old, "subfield code")), q(one_character(new, "subfield code"))
    return _change(fields, pattern, _field(subfields=f"transform(f.subfields, s -> IF(s.code = {old}, named_struct('code', {new}, 'value', s.value), s))"))


def replace_values(fields: str, pattern: str, code: str | None, find: str, replace: str) -> str:
    """``$1``, ``$&`` and ``$$`` work in the replacement."""
    try:
        re.compile(find)
    except re.error as e:
        raise EditError(f'invalid regular expression "{find}": {e}') from None
    text = re.sub(r"\\|\$\$|\$&|\$(?![0-9])", lambda m: {"$&": "$0", "$$": "\\$"}.get(m[0], "\\" + m[0]), replace)
    swap = lambda v: f"regexp_replace({v}, {q(find)}, {q(text)})"
    test = "true" if code is None else f"s.code = {q(one_character(code, 'subfield code'))}"
    parts = f"transform(f.subfields, s -> IF({test}, named_struct('code', s.code, 'value', {swap('s.value')}), s))"
    control = _field(value=swap("f.value")) if code is None else "f"
    return f"transform({clean(fields)}, f -> IF({_matches(pattern)}, IF(f.subfields IS NULL, {control}, {_field(subfields=parts)}), f))"


def move_field(fields: str, pattern: str, to_tag: str) -> str:
    side = "NOT" if is_control_tag(literal_tag(to_tag)) else ""
    wrong = f"raise_error(concat('marc edit: cannot turn ', f.tag, ' into {to_tag}: it crosses the control/data field boundary'))"
    return f"transform({clean(fields)}, f -> IF({_matches(pattern)}, IF({side} f.subfields IS NOT NULL, {_field(tag=q(to_tag))}, {wrong}), f))"


def sort_fields(fields: str) -> str:
    """By tag, equal tags in their order."""
    keyed = f"transform({clean(fields)}, (f, i) -> named_struct('t', f.tag, 'i', i, 'f', f))"
    return f"transform(array_sort({keyed}, (a, b) -> CASE WHEN a.t < b.t THEN -1 WHEN a.t > b.t THEN 1 ELSE a.i - b.i END), x -> x.f)"


def add_field(fields: str, field: str) -> str:
    """After the last field whose tag is not greater; ``field`` is an expression, null adds nothing."""
    own, new = clean(fields), f"get({clean(f'array({field})')}, 0)"
    at = f"aggregate(transform({own}, (f, i) -> IF(f.tag <= {field}.tag, i + 1, 0)), 0, (n, x) -> greatest(n, x))"
    return f"IF({field} IS NULL, {own}, concat(slice({own}, 1, {at}), CAST(array({new}) AS {FIELDS_DDL}), slice({own}, {at} + 1, size({own}))))"


# ---- holdings --------------------------------------------------------------------------------


def zip_86x(caption: str, value: str) -> str:
    cap = f"get(transform(filter({caption}.subfields, c -> c.code = s.code), c -> c.value), 0)"
    return f"transform(filter({value}.subfields, s -> s.code BETWEEN 'a' AND 'f'), s -> named_struct('code', s.code, 'cap', {cap}, 'val', s.value))"


def expand_863(caption: str, value: str) -> str:
    pairs = zip_86x(caption, value)
    opens = "coalesce(p.cap LIKE '(%', false)"
    numbers = f"array_join(transform(filter({pairs}, p -> NOT {opens}), p -> concat(coalesce(p.cap, ''), p.val)), ':')"
    dates = f"array_join(transform(filter({pairs}, p -> {opens}), p -> p.val), ':')"
    return f"concat(coalesce({numbers}, ''), IF(exists({pairs}, p -> {opens}), concat('(', {dates}, ')'), ''))"


def holdings_pairs(fields: str) -> str:
    link = f"split_part({field_value('v', '8')}, '.', 1)"
    caption = f"get(filter({fields}, c -> c.tag = CASE v.tag WHEN '863' THEN '853' WHEN '864' THEN '854' ELSE '855' END AND {field_value('c', '8')} = {link}), 0)"
    return f"transform(filter({fields}, v -> {in_list('v.tag', ('863', '864', '865'))} AND v.subfields IS NOT NULL), v -> named_struct('link', {link}, 'caption_field', {caption}, 'value_field', v))"


# ---- RDA and specs ---------------------------------------------------------------------------


def rda_expand(fields: str) -> str:
    """Abbreviations of 250$a and of all 300 subfields spelt out, longest first."""

    def spelt(value: str) -> str:
        for short, full in RDA_WORDS.items():
            value = f"regexp_replace({value}, {q('(?<![A-Za-z0-9])' + re.escape(short) + '(?![A-Za-z0-9])')}, {q(full)})"
        return value

    parts = f"transform(f.subfields, s -> IF(f.tag = '300' OR s.code = 'a', named_struct('code', s.code, 'value', {spelt('s.value')}), s))"
    return f"transform({clean(fields)}, f -> IF(f.subfields IS NOT NULL AND f.tag IN ('250', '300'), {_field(subfields=parts)}, f))"


def _pick(items: str, span: tuple | None) -> str:
    if span is None:
        return items
    start, stop = span
    if start is None:
        back = stop or 0
        return f"slice({items}, greatest(size({items}) - {back}, 1), {back + 1})"
    return f"slice({items}, {start + 1}, {f'size({items})' if stop is None else max(stop - start + 1, 0)})"


def _characters(value: str, span: tuple | None) -> str:
    """Bytes of a value as an array of one string, or of none."""
    if span is None:
        return f"array({value})"
    start, stop = span
    raw = f"CAST({value} AS binary)"
    size = f"octet_length({value})"
    low = f"greatest({size} - {stop or 0}, 1)" if start is None else str(start + 1)
    length = str((stop or 0) + 1) if start is None else size if stop is None else str(max(stop - start + 1, 0))
    cut = f"make_valid_utf8(CAST(substring({raw}, {low}, {length}) AS string))"
    return f"filter(array({cut}), x -> x != '')"


def spec(leader: str, fields: str, text: str) -> str:
    """Values at a literal MARCspec, as an array."""
    s = parse(text)
    if s.tag == "LDR":
        return _characters(leader, s.characters)
    none = "CAST(array() AS array<string>)"
    if s.indicator:
        control, own = none, f"array(f.ind{s.indicator})"
    elif s.codes:
        values = [_pick(f"transform(filter(f.subfields, s -> s.code = {q(c)}), s -> s.value)", span) for c, span in s.codes]
        control, own = none, f"concat({', '.join(values)})"
    else:
        control = _characters("f.value", s.characters)
        own = none if s.characters else "array(array_join(transform(f.subfields, s -> s.value), ' '))"
    some = _pick(f"filter({clean(fields)}, f -> {_matches(s.tag)})", s.fields)
    return f"flatten(transform({some}, f -> IF(f.subfields IS NULL, {control}, {own})))"
