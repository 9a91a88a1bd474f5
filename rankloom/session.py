"""Session set-up and the one way this library cuts lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "rankloom", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench. On a cluster use the session you are given, and ``ship`` the package."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RANKLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local session may fall back to a temporary folder, which goes when the program ends: other executors could
    not read it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        folder = sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("start the session with spark.checkpoint.dir set to a folder that all executors share, or call spark.sparkContext.setCheckpointDir")
        folder = tempfile.mkdtemp(prefix="rankloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="rankloom-")
    with zipfile.ZipFile(f"{folder}/rankloom.zip", "w") as archive:
        for f in sorted(package.rglob("*.py")):
            archive.write(f, f.relative_to(package.parent))
    sc.addPyFile(f"{folder}/rankloom.zip")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder for one written table, below one folder per application that can be removed with it."""
    run = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/rankloom-{run}/{label}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there from now on.

    Used where two later branches must see the very same rows (slice numbers after a range
    partitioning), and where several branches or a retry would recompute a long lineage. A written
    table is columnar, so later reads are pruned, and its true size decides how it is joined.
    """
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
