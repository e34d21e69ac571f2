"""Shared plumbing of the corpus operators: scratch tables, documents, column clashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: A file of this size or less is read by one task.
ONE_TASK = 128 << 20
_OPEN: list[list[str]] = []  # scratch folders made in each open ``scope``


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is read from fewer files than there are and none is large
    enough to be read by several tasks; else as it is."""
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    size = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return df.repartition(cores) if 0 < files < cores and size <= files * ONE_TASK else df


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; it goes when
    the application ends.  Only a local session (tests) may do without that setting."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.gettempdir()}/stackwise-scratch"
    own = f"{top.rstrip('/')}/stackwise/{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        store.mkdirs(path)
        store.deleteOnExit(path)
    folder = f"{own}/{uuid.uuid4().hex}"
    for made in _OPEN[-1:]:
        made.append(folder)
    return folder


def remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope() -> Iterator[list[str]]:
    """The list of the scratch folders made inside, for the caller to ``remove``; a scope around this
    one lists them too."""
    _OPEN.append([])
    try:
        yield _OPEN[-1]
    finally:
        made = _OPEN.pop()
        for outer in _OPEN[-1:]:
            outer.extend(made)


def stored_bytes(spark: SparkSession, folder: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared scratch folder and reads it back: lineage is cut, and a lost
    executor costs nothing that was written."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Writes ``df`` once, dealt out by ``key`` into as many buckets as there are shuffle
    partitions, and reads it as a bucketed table: later joins on ``key`` don't move it again."""
    spark, n = df.sparkSession, partitions(df.sparkSession)
    name = f"stackwise_{uuid.uuid4().hex}"
    writer = df.repartition(n, F.col(key)).write.option("compression", "zstd").option("path", scratch_dir(spark))
    writer.bucketBy(n, key).format("parquet").saveAsTable(name)
    release(spark)
    table = spark.table(name)
    table.schema  # resolved: the plan keeps files and buckets, so that the catalogue can forget the name
    spark.sql(f"DROP TABLE {quoted(name)}")  # an external table: its files stay
    return table


def cleanup(spark: SparkSession) -> None:
    """Removes the scratch tables of this application before it ends; results that still read them
    must be written before."""
    remove(spark, [scratch_dir(spark).rsplit("/", 1)[0]])


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs, which wait for the driver's
    garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names (in any case) an operator's results need."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def sheltered(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all columns but those ``needed`` under names that no operator uses, and a
    function that gives a result's columns their names and order back (and appends others)."""
    own = {c: c if c in needed else f"c{i}" for i, c in enumerate(docs.columns)}

    def back(found: DataFrame, *added: str) -> DataFrame:
        return found.select(*[F.col(quoted(i)).alias(c) for c, i in own.items()], *added)

    return docs.toDF(*own.values()), back


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
