"""Structured Streaming over landing directories of ISO 2709 files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import iso2709
from ..codecs.errors import RecordError
from ..functions import udfs
from ..sources.readers import _arrow_schema, _number
from ..types import FIELDS_DDL

_DDL = f"file string, arrived timestamp, control_number string, leader string, fields {FIELDS_DDL}, error string"


def stream_records(spark: SparkSession, path: str, encoding: str = "auto", max_files: int | None = None) -> DataFrame:
    """(file, arrived, control_number, leader, fields, error) of new files as they land; ``arrived``
    is the file's modification time.  Bad records carry an error and no fields."""
    reader = spark.readStream.option("lineSep", "\x1d").option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    text = reader.text(path).filter(r"TRIM(BOTH ' \r\n' FROM value) != ''")
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("arrived"), F.col("value").cast("binary").alias("raw"))
    schema = _arrow_schema(_DDL)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, arrived, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = {"file": file, "arrived": arrived, "control_number": None, "leader": None, "fields": None, "error": None}
                try:
                    record = iso2709.parse(raw.lstrip(b"\n\r "), encoding)
                    row |= {"control_number": _number(record["fields"]), **record}
                except RecordError as e:
                    row["error"] = str(e)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    return pieces.mapInArrow(work, _DDL)


def first_of_key(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Records whose match key has not come within ``delay``; state is dropped behind the watermark."""
    keyed = records.filter("error IS NULL").withColumn("matchkey", udfs.call("marc_matchkey", "fields"))
    return keyed.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["matchkey"])
