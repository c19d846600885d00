"""Session helpers: shipping the package to workers and finding a shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    The sources go through Spark's own file server, so executors need no copy on their disks.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="reprise-src-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "reprise_src.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """The cluster's shared folder, `spark.checkpoint.dir`; a local one only where that is unset and everything runs on this machine, as in tests."""
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_:
        return set_
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix=f"reprise-{purpose}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def materialise(df: DataFrame, freed: bool = False) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint in the cluster's shared folder.

    The files go when nothing refers to the checkpoint any more. `freed`: shuffle files that led to it
    go at once, instead of when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
        sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if not freed:
        return df.checkpoint(eager=True)
    before = spark.conf.get(_FREE)
    spark.conf.set(_FREE, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting holds for plans made under it
    finally:
        spark.conf.set(_FREE, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
