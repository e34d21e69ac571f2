"""The record model as Spark types.

A record is ``leader`` plus ``fields``.  A control field has ``value`` and nothing else; a data
field has indicators and subfields and no ``value``.  Order of fields and subfields is data.
"""

from __future__ import annotations

SUBFIELDS_DDL = "array<struct<code:string,value:string>>"
FIELD_DDL = f"struct<tag:string,ind1:string,ind2:string,value:string,subfields:{SUBFIELDS_DDL}>"
FIELDS_DDL = f"array<{FIELD_DDL}>"
RECORD_DDL = f"struct<leader:string,fields:{FIELDS_DDL}>"

NESTED_DDL = f"record_no bigint, file string, control_number string, leader string, fields {FIELDS_DDL}"
RAW_DDL = "record_no bigint, file string, control_number string, leader string, raw binary, error string"
SUBFIELD_COLUMNS = ["record_no", "file", "control_number", "leader", "field_no", "tag", "ind1", "ind2", "subfield_no", "code", "value"]

DEFAULT_LEADER = "00000nam a2200000 a 4500"


def control(tag: str, value: str) -> dict:
    return {"tag": tag, "ind1": None, "ind2": None, "value": value, "subfields": None}


def data(tag: str, ind1: str = " ", ind2: str = " ", *subfields: tuple[str, str]) -> dict:
    return {"tag": tag, "ind1": ind1, "ind2": ind2, "value": None, "subfields": [{"code": c, "value": v} for c, v in subfields]}


def is_control(field: dict) -> bool:
    """A field with a value and no subfields is a control field."""
    return field.get("value") is not None and field.get("subfields") is None


def clean_fields(fields: list[dict | None]) -> list[dict]:
    """Fields as edits see them: null members are gone, absent indicators and codes are blank and
    absent subfield values empty."""
    found = []
    for f in fields:
        if f is None:
            continue
        if is_control(f):
            found.append(control(f["tag"] or "", f["value"]))
        else:
            parts = [s for s in f.get("subfields") or [] if s is not None]
            found.append(data(f["tag"] or "", f["ind1"] or " ", f["ind2"] or " ", *[(s["code"] or " ", s["value"] or "") for s in parts]))
    return found
