"""Session helpers shared by the queries and by the command line."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def build_session(app: str = "strandline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine relies on (UTC, AQE); `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application: they need not share the driver's disk."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="strandline-ship-"), "strandline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent).as_posix())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; the path may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder for files, on a file system that driver and executors mount: below spark.checkpoint.dir; without that setting a temporary
    one, which only a local master may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="strandline-files-")
    elif "://" in base.replace("file://", "", 1):
        raise ValueError("array files are written through a mounted file system")
    path = f"{base.removeprefix('file://').rstrip('/')}/files-{uuid.uuid4().hex}"
    os.makedirs(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"file://{path}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path
