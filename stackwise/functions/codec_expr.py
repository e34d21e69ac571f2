"""The codecs as SQL expressions: records as text within the JVM.

Writers give the texts of :mod:`stackwise.codecs`; ``PLAIN`` tells of a text whether it can differ from
them (letters to normalise, lengths out of bounds, control characters), and such records go through
Python.
"""

from __future__ import annotations

from ..types import DEFAULT_LEADER
from .expr import q

_FT, _RT, _US = (f"'\\u{n:04x}'" for n in (0x1E, 0x1D, 0x1F))
_LEADER = f"IF(coalesce(leader, '') = '', {q(DEFAULT_LEADER)}, leader)"
_CONTROL = "f.value IS NOT NULL AND f.subfields IS NULL"


def _blank(value: str) -> str:
    return f"IF(coalesce({value}, '') = '', ' ', {value})"


def _each(control: str, before: str, part: str, between: str, after: str) -> str:
    """Texts of the fields that are not null: of a control field, and of a data field's head, subfields
    and end."""
    parts = f"array_join(transform(filter(f.subfields, s -> s IS NOT NULL), s -> {part}), {between})"
    return f"transform(filter(fields, f -> f IS NOT NULL), f -> IF({_CONTROL}, {control}, concat({before}, coalesce({parts}, ''), {after})))"


_TAG, _IND1, _IND2, _CODE, _VALUE = "coalesce(f.tag, '')", _blank("f.ind1"), _blank("f.ind2"), _blank("s.code"), "coalesce(s.value, '')"


def _dollar(value: str) -> str:
    return f"replace({value}, '$', '{{dollar}}')"


def _backslash(ind: str) -> str:
    return f"replace({ind}, ' ', '\\\\')"


def _xml(value: str) -> str:
    return f"replace(replace(replace(replace({value}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _json(value: str) -> str:
    return f"""concat('"', replace(replace({value}, '\\\\', '\\\\\\\\'), '"', '\\\\"'), '"')"""


#: Steps of an ISO 2709 record: name -> expression over leader, fields and the steps before.
_MARC = {
    "own": f"transform(filter(fields, f -> f IS NOT NULL), f -> named_struct('t', lpad({_TAG}, 3, ' '), 'b', concat(IF({_CONTROL}, f.value, concat({_IND1}, {_IND2}, coalesce(array_join(transform(filter(f.subfields, s -> s IS NOT NULL), s -> concat({_US}, {_CODE}, {_VALUE})), ''), ''))), {_FT})))",
    "d": "aggregate(own, named_struct('d', '', 'n', 0, 'most', 0), (a, x) -> named_struct('d', concat(a.d, x.t, lpad(CAST(octet_length(x.b) AS STRING), 4, '0'), lpad(CAST(a.n AS STRING), 5, '0')), 'n', a.n + octet_length(x.b), 'most', greatest(a.most, octet_length(x.b))))",
    "h": f"IF(length(leader) = 24 AND octet_length(leader) = 24, leader, {q(DEFAULT_LEADER)})",
    "value": f"concat(lpad(CAST(26 + octet_length(d.d) + d.n AS STRING), 5, '0'), substring(h, 6, 4), 'a', substring(h, 11, 2), lpad(CAST(25 + octet_length(d.d) AS STRING), 5, '0'), substring(h, 18), d.d, {_FT}, array_join(transform(own, x -> x.b), ''))",
}
#: Format -> the steps to a record's line, without the terminator of ISO 2709; NULL for NULL fields.
WRITERS: dict[str, dict[str, str]] = {
    "marc": _MARC,
    "mrk": {"value": f"concat('=LDR  ', {_LEADER}, '\\n', array_join({_each(f"concat('=', {_TAG}, '  ', {_dollar('f.value')}, '\\n')", f"concat('=', {_TAG}, '  ', {_backslash(_IND1)}, {_backslash(_IND2)})", f"concat('$', {_CODE}, {_dollar(_VALUE)})", "''", "'\\n'")}, ''))"},
    "marcxml": {
        "value": f"""concat('  <record>\\n    <leader>', {_xml(_LEADER)}, '</leader>\\n', array_join({
            _each(
                f"concat('    <controlfield tag=\"', {_xml(_TAG)}, '\">', {_xml('f.value')}, '</controlfield>\\n')",
                f"concat('    <datafield tag=\"', {_xml(_TAG)}, '\" ind1=\"', {_xml(_IND1)}, '\" ind2=\"', {_xml(_IND2)}, '\">\\n')",
                f"concat('      <subfield code=\"', {_xml(_CODE)}, '\">', {_xml(_VALUE)}, '</subfield>\\n')",
                "''",
                "'    </datafield>\\n'",
            )
        }, ''), '  </record>')"""
    },
    "marcjson": {
        "value": f"""concat('{{"leader":', {_json(f"IF(coalesce(leader, '') = '', repeat(' ', 24), leader)")}, ',"fields":[', array_join({
            _each(
                f"concat('{{', {_json(_TAG)}, ':', {_json('f.value')}, '}}')",
                f"""concat('{{', {_json(_TAG)}, ':{{"ind1":', {_json(_IND1)}, ',"ind2":', {_json(_IND2)}, ',"subfields":[')""",
                f"concat('{{', {_json(_CODE)}, ':', {_json(_VALUE)}, '}}')",
                "','",
                "']}}'",
            )
        }, ','), ']}}')"""
    },
}
#: Format -> whether the line made in the JVM is the codec's for certain.
PLAIN = {"marc": "length(value) = octet_length(value) AND octet_length(value) < 99999 AND d.most <= 9999", "mrk": "true", "marcxml": "true", "marcjson": "NOT value RLIKE '[\\u0000-\\u001f]'"}
