"""Shared plumbing: shared-folder tables, bounded Arrow batches, word rules."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A-Z to a-z and nothing else, for str.translate and F.translate.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: A word is a run of anything but space and the controls \t to \r.
WORD = re.compile("[^\x20\x09-\x0d]+")


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, since texts may be long; a tighter setting of the caller's stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 500), ("spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20)):
        try:
            now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        except Exception as e:  # the setting is unknown to this version
            if "SQL_CONF_NOT_FOUND" not in str(e):
                raise
            continue
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for cut lineage, ``spark.checkpoint.dir``. Where none is named a local session (tests) sets one of its own; on a cluster that is an error, since executors would write to their own disks."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_OPEN: list[list[tuple[str, str]]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, note all tables and folders that operators write to the shared folder, and remove them at its end: for results that are written before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for kind, name in _OPEN.pop():
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            else:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(kind: str, name: str) -> None:
    """Note a ``table`` or ``folder`` for the scratch scopes that are open."""
    for names in _OPEN[-1:]:
        names.append((kind, name))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return it reread: lineage ends there, so a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/helixframe/{name}-{uuid.uuid4().hex}"
    written("folder", path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` as a table in the shared folder bucketed by ``key``, reread: joins on the key move the other side only."""
    spark = df.sparkSession
    table = f"helixframe_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/helixframe/{table}"
    written("table", table)
    written("folder", path)
    df.write.bucketBy(partitions(spark), key).option("path", path).saveAsTable(table, format="parquet")
    return spark.table(table)


def release() -> None:
    """Give memory that a batch has freed back to the system: Python workers serve many stages, and what one leaves behind counts against the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a whole text (null counts as empty)."""
    return F.unhex(F.substring(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256), 1, 32))
