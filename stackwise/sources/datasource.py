"""Record formats as Spark data sources: ``spark.read.format("marc")`` and ``df.write.format("marc")``.

The sources read and write with Arrow's file systems, one task a file: local paths, or addresses of
any store that Arrow knows (``s3://``, ``gs://``, ``hdfs://``, ...) and all executors reach.
:mod:`stackwise.sources.readers` and ``writers`` go through Spark's own and split large files.
"""

from __future__ import annotations

import gzip
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as stores
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..codecs import breaker, iso2709, marcjson, marcxml
from ..codecs.errors import RecordError
from ..types import FIELDS_DDL, NESTED_DDL
from .readers import TEXT_FORMATS, _number, _wanted


def _store(path: str) -> tuple[stores.FileSystem, str, str]:
    """(file system, path in it, what precedes that path in addresses)."""
    if "://" in path and not path.startswith("file:"):
        plain = re.split(r"[*?\[]", path)[0].rsplit("/", 1)[0]  # patterns aren't part of addresses
        store, inner = stores.FileSystem.from_uri(plain)
        return store, inner + path[len(plain) :], plain.removesuffix(inner)
    return stores.LocalFileSystem(), os.path.abspath(path.removeprefix("file://").removeprefix("file:")), ""


def _matching(pattern: str) -> re.Pattern:
    """A path pattern with ``*``, ``?`` and ``[...]`` within a folder, ``**`` across folders."""
    parts = re.split(r"(\*\*|\*|\?|\[[^\]]*\])", pattern)
    known = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return re.compile("".join(known.get(x) or (x.replace("[!", "[^") if x.startswith("[") else re.escape(x)) for x in parts))


def _files(path: str) -> list[str]:
    """The files of a path, folder or pattern; hidden ones of a folder are left out."""
    store, inner, before = _store(path)
    if re.search(r"[*?\[]", inner):
        top, own = re.split(r"[*?\[]", inner)[0].rsplit("/", 1)[0] or "/", _matching(inner)
        found = [f for f in store.get_file_info(stores.FileSelector(top, recursive=True, allow_not_found=True)) if own.fullmatch(f.path)]
    else:
        found = [f for f in [store.get_file_info(inner)] if f.type != stores.FileType.NotFound]
    each = []
    for f in found:
        inside = store.get_file_info(stores.FileSelector(f.path)) if f.type == stores.FileType.Directory else [f]
        each += [x.path for x in inside if x.type == stores.FileType.File and (x is f or x.base_name[0] not in "._")]
    return [before + x for x in sorted(set(each))]


def read_bytes(path: str) -> bytes:
    store, inner, _ = _store(path)
    with store.open_input_file(inner) as file:
        return file.read()


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, fmt: str, options: dict):
        self.fmt, self.path = fmt, options["path"]
        self.tags, self.encoding = _wanted(options.get("tags")), options.get("encoding", "auto")
        self.lenient = options.get("ignore_errors", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        raw = read_bytes(partition.path)
        if partition.path.endswith(".gz"):
            raw = gzip.decompress(raw)
        for n, record in enumerate(self._records(raw, partition.path), 1):
            if record is not None:
                kept = [f for f in record["fields"] if self.tags is None or f["tag"] in self.tags]
                rows = [(f["tag"], f["ind1"], f["ind2"], f["value"], None if f["subfields"] is None else [(s["code"], s["value"]) for s in f["subfields"]]) for f in kept]
                yield n, partition.path, _number(record["fields"]), record["leader"], rows

    def _records(self, raw: bytes, path: str) -> Iterator[dict | None]:
        if self.fmt != "marc":
            yield from TEXT_FORMATS[self.fmt](raw.decode("utf-8", "replace"))
            return
        pieces = [p.lstrip(b"\n\r ") for p in raw.split(iso2709.RT)]
        for n, piece in enumerate((p for p in pieces if p), 1):
            try:
                yield iso2709.parse(piece, self.encoding)
            except RecordError as e:
                if not self.lenient:
                    raise RecordError(f"{path} record {n}: {e}") from None
                yield None


@dataclass
class _Part(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    """Tasks write hidden parts; the commit shows them and only then drops what they replace."""

    def __init__(self, fmt: str, names: list[str], options: dict, overwrite: bool):
        self.fmt, self.names, self.options, self.path, self.overwrite = fmt, names, options, options["path"], overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, folder, _ = _store(self.path)
        store.create_dir(folder, recursive=True)
        part = f"{folder}/_part-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            if self.fmt == "marcxml":
                out.write(marcxml.HEADER.encode())
            for row in rows:
                values = row.asDict(recursive=True)
                leader, fields = values.get("leader"), values["fields"]
                if fields is not None:
                    out.write(self._bytes(leader, fields))
            if self.fmt == "marcxml":
                out.write(marcxml.FOOTER.encode())
        return _Part(part)

    def _bytes(self, leader: str | None, fields: list[dict]) -> bytes:
        if self.fmt == "marc":
            return iso2709.write(leader, fields, self.options.get("encoding", "utf8"), self.options.get("normalize", "nfc"))
        text = {"marcxml": marcxml.write, "mrk": breaker.write, "marcjson": marcjson.write}[self.fmt](leader, fields)
        return (text if text.endswith("\n") and self.fmt == "marcxml" else text + "\n").encode()

    def commit(self, messages: list) -> None:
        store, folder, _ = _store(self.path)
        old = [f.path for f in store.get_file_info(stores.FileSelector(folder, allow_not_found=True)) if f.base_name.startswith("part-")]
        for m in messages:
            if m is not None:
                head, name = m.path.rsplit("/", 1)
                store.move(m.path, f"{head}/{name.removeprefix('_')}")
        for path in old if self.overwrite else []:
            store.delete_file(path)

    def abort(self, messages: list) -> None:
        store = _store(self.path)[0]
        for m in messages:
            if m is not None and store.get_file_info(m.path).type != stores.FileType.NotFound:
                store.delete_file(m.path)


def _source(fmt: str, writable: bool) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return fmt

        def schema(self) -> str:
            return NESTED_DDL

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fmt, dict(self.options))

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            if not writable:
                raise ValueError(f"{fmt} can't be written")
            if "fields" not in schema.names:
                raise ValueError(f"a column fields of {FIELDS_DDL} is needed")
            return _Writer(fmt, schema.names, dict(self.options), overwrite)

    Source.__name__ = Source.__qualname__ = f"{fmt}_source"
    return Source


def register_sources(spark: SparkSession) -> None:
    """Registers marc, marcxml, mrk, marcjson (read and write), alephseq and microlif (read)."""
    for fmt in ("marc", *TEXT_FORMATS):
        spark.dataSource.register(_source(fmt, fmt in ("marc", "marcxml", "mrk", "marcjson")))
