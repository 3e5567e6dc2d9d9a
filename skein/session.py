"""Session settings shared by the entry points, the benchmark and the tests."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "skein", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; an explicit master or partition count wins over the caller's environment."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SKEIN_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str):
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out if it has fewer partitions than the session has cores: a small table in one file would keep them idle. Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Where the session names none, a master on one machine gets a temporary one, which goes when the program ends; on a cluster that would be the driver's own
    disk, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="skein-shared-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for a table that a query stores while it runs; sweep deletes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    spark.__dict__.setdefault("_skein_folders", []).append(path)
    return path


def sweep(spark: SparkSession) -> int:
    """Deletes what queries of this session have stored, once their results are written or no longer wanted; how many folders went."""
    held = spark.__dict__.pop("_skein_folders", [])
    spark.__dict__.pop("_skein_indexes", None)
    sc = spark.sparkContext
    for path in held:
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    return len(held)


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers of a session, once, for sessions whose workers don't find it by themselves."""
    sc = spark.sparkContext
    if getattr(sc, "_skein_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="skein-package-")) / "skein-package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in [*sorted((top / "skein").rglob("*.py")), *sorted(top.glob("*.py"))]:
            z.write(p, p.relative_to(top))
    sc.addPyFile(str(target))
    sc._skein_shipped = True
