"""Readers of record files.  Every reader gives the nested shape (record_no, file, control_number,
leader, fields); ``to_subfields`` and ``to_fields`` flatten it without a shuffle.

ISO 2709 files are split on the record terminator by Spark's text reader, so one file is read by
many tasks; a record's ordinal is its place in its block plus the records of the blocks before,
which are counted per block, not sorted.  Text formats are framed by whole files.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..codecs import breaker, iso2709, lines, marcjson, marcxml
from ..codecs.errors import RecordError
from ..types import NESTED_DDL, RAW_DDL, SUBFIELD_COLUMNS

TEXT_FORMATS: dict[str, Callable[[str], list[dict]]] = {
    "marcxml": marcxml.parse,
    "mrk": breaker.parse,
    "marcjson": marcjson.parse,
    "alephseq": lines.parse_aleph,
    "microlif": lines.parse_microlif,
}


def _wanted(tags: str | None) -> frozenset[str] | None:
    return frozenset(t.strip() for t in tags.split(",") if t.strip()) if tags else None


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _number(fields: list[dict]) -> str | None:
    return next((f["value"] for f in fields if f["tag"] == "001"), None)


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, raw) of the record slices; text after the last terminator counts as a slice."""
    text = spark.read.option("lineSep", "\x1d").text(path).filter(r"TRIM(BOTH ' \r\n' FROM value) != ''")
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"))


def _numbered(spark: SparkSession, path, ddl: str, parse: Callable[[bytes, int, str], dict]) -> DataFrame:
    pieces = _pieces(spark, path)
    counts = pieces.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    schema = _arrow_schema(f"block bigint, {ddl}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            rows = []
            for file, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[file, block] = n = seen.get((file, block), 0) + 1
                row = parse(raw.lstrip(b"\n\r "), n, file)
                if row is not None:
                    rows.append({"block": block, "record_no": n, "file": file, **row})
            yield pa.RecordBatch.from_pylist(rows, schema)

    parsed = pieces.mapInArrow(work, f"block bigint, {ddl}")
    joined = parsed.join(offsets, ["file", "block"])
    return joined.withColumn("record_no", F.col("record_no") + F.col("offset")).select(*[c.split()[0] for c in _names(ddl)])


def _names(ddl: str) -> list[str]:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl).names


def read_marc(spark: SparkSession, path: str | list[str], encoding: str = "auto", tags: str | None = None, ignore_errors: bool = False) -> DataFrame:
    """ISO 2709 records.  ``tags`` keeps only those fields (the record stays); bad records raise, or
    are left out with ``ignore_errors``, keeping the ordinals of the others."""
    wanted = _wanted(tags)

    def parse(raw: bytes, n: int, file: str) -> dict | None:
        try:
            record = iso2709.parse(raw, encoding, None if wanted is None else wanted | {"001"})
        except RecordError as e:
            if ignore_errors:
                return None
            raise RecordError(f"read_marc: {file} record {n}: {e}") from None
        number = _number(record["fields"])
        kept = [f for f in record["fields"] if wanted is None or f["tag"] in wanted]
        return {"control_number": number, "leader": record["leader"], "fields": kept}

    return _numbered(spark, path, NESTED_DDL, parse)


def read_marc_raw(spark: SparkSession, path: str | list[str], encoding: str = "auto") -> DataFrame:
    """Every slice with its bytes and what is wrong with it; never fails."""

    def parse(raw: bytes, n: int, file: str) -> dict:
        leader = raw[:24].decode("latin-1") if len(raw) >= 24 else None
        try:
            record, error = iso2709.parse(raw, encoding), None
        except RecordError as e:
            record, error = {"fields": []}, str(e)
        return {"control_number": _number(record["fields"]), "leader": leader, "raw": raw + iso2709.RT, "error": error}

    return _numbered(spark, path, RAW_DDL, parse)


def read_marc_subfields(spark: SparkSession, path, encoding: str = "auto", tags: str | None = None, ignore_errors: bool = False) -> DataFrame:
    return to_subfields(read_marc(spark, path, encoding, None, ignore_errors), tags)


def read_records(spark: SparkSession, path: str | list[str], fmt: str, tags: str | None = None) -> DataFrame:
    """Records of a text format (``TEXT_FORMATS``) in the nested shape; ``.gz`` files are inflated."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return files.mapInArrow(_whole(fmt, _wanted(tags)), NESTED_DDL)


def records_of_text(texts: DataFrame, fmt: str, tags: str | None = None) -> DataFrame:
    """Records of a DataFrame (file, content) of texts, such as answers of a service."""
    return texts.select("file", F.col("content").cast("binary").alias("content")).mapInArrow(_whole(fmt, _wanted(tags)), NESTED_DDL)


def _whole(fmt: str, wanted: frozenset[str] | None):
    parse, schema = TEXT_FORMATS[fmt], _arrow_schema(NESTED_DDL)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = (gzip.decompress(content) if file.endswith(".gz") else content or b"").decode("utf-8", "replace")
                rows = []
                for n, record in enumerate(parse(text), 1):
                    kept = [f for f in record["fields"] if wanted is None or f["tag"] in wanted]
                    rows.append({"record_no": n, "file": file, "control_number": _number(record["fields"]), "leader": record["leader"], "fields": kept})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return work


def to_fields(records: DataFrame) -> DataFrame:
    """One row a field: (…, field_no, tag, ind1, ind2, control_value, subfields)."""
    each = records.select("record_no", "file", "control_number", "leader", F.posexplode("fields").alias("field_no", "f"))
    return each.select("record_no", "file", "control_number", "leader", (F.col("field_no") + 1).alias("field_no"), "f.tag", "f.ind1", "f.ind2", F.col("f.value").alias("control_value"), "f.subfields")


def to_subfields(records: DataFrame, tags: str | None = None) -> DataFrame:
    """One row a subfield, one for a control field; data fields without subfields give none."""
    one = "array(named_struct('code', CAST(NULL AS string), 'value', control_value))"
    fields = to_fields(records)
    if tags:
        fields = fields.filter(F.col("tag").isin(*_wanted(tags)))
    parts = F.expr(f"CASE WHEN subfields IS NULL THEN {one} ELSE subfields END")
    each = fields.select("record_no", "file", "control_number", "leader", "field_no", "tag", "ind1", "ind2", F.posexplode(parts).alias("k", "s"))
    return each.select("record_no", "file", "control_number", "leader", "field_no", "tag", "ind1", "ind2", (F.col("k") + 1).alias("subfield_no"), "s.code", "s.value").select(*SUBFIELD_COLUMNS)


def read_kbart(spark: SparkSession, path: str) -> DataFrame:
    """KBART: tab-separated, with a header, all text, names untouched."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False)
