"""Session factory and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "callweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results depend on (UTC) and those that plans profit from (AQE)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return ship(b.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Hands this package to the Python workers, once a context, so that executors need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_callweave_shipped", False):
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    part = tempfile.mkdtemp(prefix="callweave-py-")
    atexit.register(shutil.rmtree, part, True)
    path = os.path.join(part, "callweave.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(here)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)  # the driver serves it to the executors
    sc._callweave_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where that is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="callweave-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir("file://" + own)
    return "file://" + own


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/callweave-{label}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and a lost executor
    costs no recomputation of what came before. The table goes when the driver ends."""
    path = shared_path(df.sparkSession, label)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    local = path.removeprefix("file://")
    if os.path.isabs(local) and os.path.isdir(local):
        atexit.register(shutil.rmtree, local, True)
    else:
        sc = df.sparkSession.sparkContext
        there = sc._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(there)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, per_slot: int = 3, narrow: float = 2) -> DataFrame:
    """Enough partitions for work that is heavy per row. A scan that already has at least ``narrow`` partitions
    a slot is left alone (no shuffle), so this only acts where the input is small."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= narrow * slots else df.repartition(per_slot * slots)
