"""Helpers around the active Spark session."""

from __future__ import annotations

import logging
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_LOG = logging.getLogger("permeate")


def log(message: str) -> None:
    """A line with the time on standard output, unless the caller has set up the logger ``permeate``."""
    if not _LOG.handlers and not logging.getLogger().handlers:
        handler = logging.StreamHandler(sys.stdout)
        handler.setFormatter(logging.Formatter("%(asctime)s, %(message)s", "%Y-%m-%d %H:%M:%S"))
        _LOG.addHandler(handler)
        _LOG.setLevel(logging.INFO)
    _LOG.info(message)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over at least as many partitions as there are cores.

    Small inputs come as one file split; work that is heavy per row would run on one core. Inputs that already have
    as many partitions pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and everything runs on one machine (local tests) a temporary folder is set; on a
    cluster that is an error, because executors could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="permeate-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder and the lineage ends there."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    conf = spark.sparkContext._jsc.sc().conf()
    if not conf.contains(_CLEAN):  # the files go when the last frame that reads them is collected
        conf.set(_CLEAN, "true")
    return df.checkpoint(eager=True)


_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


_KEPT: dict[str, object] = {}


def kept_by_worker(token: str, build):
    """What ``build`` gives, made once per Python worker for each token and kept for its next tasks (the last four)."""
    if token not in _KEPT:
        while len(_KEPT) >= 4:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[token] = build()
    return _KEPT[token]


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_permeate_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="permeate-")) / "permeate.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._permeate_shipped = True
