"""Session settings the operators rely on: UTC clock, adaptive execution, no fixed shuffle width."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Set when the session is built here; a session made elsewhere keeps its own values.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "gridloom", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session with DEFAULTS, overridden by ``conf`` (dots written as ``__``)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application (they may not share the driver's path)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root, folder = Path(__file__).resolve().parent, tempfile.mkdtemp()  # tasks fetch it while the application runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / "gridloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)
