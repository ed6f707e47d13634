"""Session settings and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, tuple] = {}


def get_session(app: str = "telarium", **conf: str) -> SparkSession:
    """A session with adaptive execution on; an existing one is returned as it is."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only where the setting is absent (local tests) a temporary folder of this machine is set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        sc = spark.sparkContext
        where = sc.getCheckpointDir()
        if not where:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="telarium-")
            sc.setCheckpointDir(where)
    return where.rstrip("/")


def _clean(app: str) -> None:
    spark, path = _FOLDERS.pop(app, (None, None))
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended
        if path and path.startswith("file://"):
            import shutil

            shutil.rmtree(path[7:], ignore_errors=True)


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = (spark, f"{shared_folder(spark)}/telarium-{app}")
        atexit.register(_clean, app)
    return f"{_FOLDERS[app][1]}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Cuts the lineage: writes df to a parquet table of the shared folder and reads it back.

    The table survives the loss of executors and, unlike a cache, keeps column pruning.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # a table without rows has no files to tell its schema


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a materialised table that no later step reads."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folders = {os.path.dirname(f) for f in df.inputFiles()}
    for folder in folders:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        if "/telarium-" in folder:
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def short_plans(spark: SparkSession, length: int = 100_000) -> Iterator[None]:
    """Keeps descriptions of plans short while they hold large constants: the driver retains them, and each is as long as
    all its constants before it is cut, so they are also made once an operator and not twice."""
    wanted = {"spark.sql.maxPlanStringLength": str(length), "spark.sql.ui.explainMode": "simple"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
