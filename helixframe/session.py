"""SparkSession factory with the settings the library is tuned for."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "helixframe", **conf: str) -> SparkSession:
    """Return a session: AQE on, UTC, Arrow on; on ``local`` masters shuffle partitions follow the cores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        settings["spark.sql.shuffle.partitions"] = str(os.cpu_count() or 8)
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_OPEN: list[list[tuple[str, str]]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, note all tables and folders that operators write to the shared folder, and remove them at its end: for results that are written or collected before."""
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


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_folder(spark)}/helixframe/{name}-{uuid.uuid4().hex}"
    for names in _OPEN[-1:]:
        names.append(("folder", path))
    return path


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` as a table in the shared folder, reread: its lineage ends there, and a lost executor costs a reread."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, buckets: int, name: str = "rows") -> DataFrame:
    """``df`` stored in buckets of a key: what groups by the key (and more) afterwards moves no rows."""
    spark = df.sparkSession
    table, path = f"helixframe_{name}_{uuid.uuid4().hex}", new_path(spark, name)
    for names in _OPEN[-1:]:
        names.append(("table", table))
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table, format="parquet")
    return spark.table(table)
