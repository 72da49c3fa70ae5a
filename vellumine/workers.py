"""Python workers import this package by reference, so they must find it wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Rows of documents sent to a worker together: some ten megabytes of text.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 4096
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Workers of local mode get this package's folder on their path; those of a cluster, once an
    application, the package itself as an archive that Spark hands to every executor."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH) == "10000":  # Spark's default; any other value is the user's own
        spark.conf.set(BATCH, str(ROWS))
    sc.environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")  # gives memory back
    env, root = sc.environment, str(PACKAGE.parent)
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = root + (os.pathsep + have if have else "")
    if sc.master == "local" or sc.master.startswith("local[") or sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    archive = Path(tempfile.mkdtemp()) / "vellumine.zip"  # on the driver, which serves it
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(archive))


def reachable(df: DataFrame) -> DataFrame:
    ship(df.sparkSession)
    return df
