"""Session, shared folder and staging helpers used by every operator."""

from __future__ import annotations

import atexit
import os
import pathlib
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}
_SHIPPED: set[str] = set()
_STAGED: dict[str, list[str]] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "knotwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (AQE, UTC, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a local session that does not name one gets a folder of its own, which goes away
    with the process; on a cluster a missing setting is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN_DIR[app] = "file://" + folder
        spark.sparkContext.setCheckpointDir(_OWN_DIR[app])
    return _OWN_DIR[app]


def staged(df: DataFrame, name: str, lean: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage; the table survives the loss of any executor and later reads
    prune its columns. The schema is given to the reader, so no inference job runs.
    ``lean`` saves disk: zstd instead of snappy, and the shuffle files of the write go
    as soon as it is done, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write = df.write.mode("overwrite")
    if lean:
        before = spark.conf.get(_CLEANUP, "false")
        spark.conf.set(_CLEANUP, "true")
        try:
            write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before)
    else:
        write.parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove a table that ``staged`` returned; nothing that is still to be computed may read it."""
    spark = df.sparkSession
    _remove(spark, [df._staged_at])
    _STAGED[spark.sparkContext.applicationId].remove(df._staged_at)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def release(spark: SparkSession) -> int:
    """Remove all staged tables of this session and give their number; results that still read them must be written before."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    _remove(spark, paths)
    return len(paths)


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = pathlib.Path(__file__).resolve().parent
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    if not os.path.isdir(folder):  # a shared folder that is no file system path: Spark's file server takes over
        folder = tempfile.mkdtemp(prefix="spark-")
    path = f"{folder}/knotwork-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"knotwork/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
