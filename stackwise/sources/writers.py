"""Writers of record files.  Each takes the columns ``leader`` (optional) and ``fields``; others are
ignored.  Every task writes a file of its own; with ``single_file`` these are strung together, with
``order_by`` in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..codecs import breaker, marcjson, marcxml
from ..functions import udfs
from ..functions.codec_expr import PLAIN, WRITERS

FORMATS = ("marc", "marcxml", "mrk", "marcjson")


def write_records(df: DataFrame, path: str, fmt: str = "marc", encoding: str = "utf8", normalize: str = "nfc", mode: str = "errorifexists", order_by: list | None = None, single_file: bool = False) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    if "fields" not in df.columns:
        raise ValueError("a column fields is needed")
    df = df.withColumn("leader", F.lit(None).cast("string")) if "leader" not in df.columns else df
    if order_by:
        df = df.orderBy(*order_by)
    df = df.select("leader", "fields")
    if single_file:
        _write_one(df, path, fmt, encoding, normalize, mode)
    else:
        _write_parts(df, path, fmt, encoding, normalize, mode)


def _write_parts(df: DataFrame, path: str, fmt: str, encoding: str, normalize: str, mode: str, framed: bool = True) -> None:
    if fmt == "marc":
        # The writer's line separator is the record terminator, which the bytes then must not have.
        _lines(df, fmt, encoding, normalize).write.mode(mode).option("lineSep", "\x1d").text(path)
    elif fmt == "marcxml" and framed:
        df.mapInArrow(_texts(fmt, framed), "value string").write.mode(mode).text(path)
    else:
        _lines(df.filter("fields IS NOT NULL"), fmt, encoding, normalize).write.mode(mode).text(path)


def _made(df: DataFrame, fmt: str) -> DataFrame:
    """``df`` with the records' texts, made in the JVM."""
    for name, step in WRITERS[fmt].items():
        df = df.withColumn(name, F.expr(step))
    return df


def _in_jvm(fmt: str, encoding: str, normalize: str) -> bool:
    return fmt != "marc" or (encoding == "utf8" and normalize in ("nfc", "nfd"))


def _lines(df: DataFrame, fmt: str, encoding: str, normalize: str) -> DataFrame:
    """The records' texts, made in the JVM; those that it can't write for certain go through Python,
    which gets NULL for the others."""
    python = {"marc": "marc_to_iso2709", "marcjson": "marc_to_json"}.get(fmt)
    plain = "false"
    if _in_jvm(fmt, encoding, normalize):
        df = _made(df, fmt)
        plain = f"coalesce({PLAIN[fmt]}, false)"
    else:
        df = df.withColumn("value", F.lit(None).cast("string"))
    if python is None:
        return df.select("value")
    df = df.select(F.expr(f"IF({plain}, value, NULL)").alias("value"), *[F.expr(f"IF({plain}, NULL, {c})").alias(c) for c in ("leader", "fields")])
    odd = udfs.call(python, "leader", "fields", *([F.lit(encoding), F.lit(normalize)] if fmt == "marc" else []))
    if fmt == "marc":
        df = df.withColumn("odd", odd).withColumn("odd", F.expr("CAST(substring(odd, 1, length(odd) - 1) AS string)"))
    else:
        df = df.withColumn("odd", odd)
    return df.select(F.coalesce("value", "odd").alias("value"))


def _write_plain(df: DataFrame, path: str, fmt: str, encoding: str, normalize: str) -> bool:
    """Writes parts in the JVM alone; false if some record needs Python, and the parts are of no use."""
    if fmt not in ("marc", "marcjson") or not _in_jvm(fmt, encoding, normalize):
        return False
    seen = Observation()
    made = _made(df if fmt == "marc" else df.filter("fields IS NOT NULL"), fmt).withColumn("odd", F.expr(f"NOT coalesce({PLAIN[fmt]}, false)")).select("value", "odd")
    made = made.observe(seen, F.count_if("odd").alias("odd")).select("value")
    made.write.option("lineSep", "\x1d" if fmt == "marc" else "\n").text(path)
    return seen.get["odd"] == 0


def _write_one(df: DataFrame, path: str, fmt: str, encoding: str, normalize: str, mode: str) -> None:
    """One file of the tasks' parts, which are written beside the path and copied one after another."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    folder, parts = hadoop(path), hadoop(f"{path.rstrip('/')}-{uuid.uuid4().hex}")
    store = folder.getFileSystem(conf)
    if store.exists(folder) and mode not in ("append", "overwrite"):
        _write_parts(df.limit(0), path, fmt, encoding, normalize, mode)  # Spark tells what the mode means
        return
    try:
        if not _write_plain(df, parts.toString(), fmt, encoding, normalize):
            _write_parts(df, parts.toString(), fmt, encoding, normalize, "overwrite", framed=False)
        held = [s.getPath() for s in store.listStatus(parts) if s.getLen() and s.getPath().getName().startswith("part-")]
        name = f"part-00000-{uuid.uuid4().hex}.txt"
        out = store.create(hadoop(parts, f"_{name}"))
        try:
            if held and fmt == "marcxml":
                out.write(bytearray(marcxml.HEADER.encode()))
            for part in sorted(held, key=lambda p: int(p.getName().split("-")[1])):
                own = store.open(part)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, out, 1 << 20, False)
                own.close()
            if held and fmt == "marcxml":
                out.write(bytearray(marcxml.FOOTER.encode()))
        finally:
            out.close()
        if mode == "overwrite":
            store.delete(folder, True)
        store.mkdirs(folder)
        store.rename(hadoop(parts, f"_{name}"), hadoop(folder, name))
    finally:
        store.delete(parts, True)


def _texts(fmt: str, framed: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = {"marcxml": marcxml.write, "mrk": breaker.write, "marcjson": marcjson.write}[fmt]
        some = False
        for batch in batches:
            leaders, fields = map(udfs.rows_of, batch.columns)
            texts = [write(leader, own).removesuffix("\n") for leader, own in zip(leaders, fields, strict=True) if own is not None]
            if fmt == "mrk":
                texts = [t + "\n" for t in texts]
            if fmt == "marcxml" and framed and not some:
                texts.insert(0, marcxml.HEADER.removesuffix("\n"))
            some = True
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])
        if some and framed and fmt == "marcxml":
            yield pa.RecordBatch.from_arrays([pa.array([marcxml.FOOTER.removesuffix("\n")])], names=["value"])

    return work
