"""Puts this package on the executors, and bounds what they hand to Python at once."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once a Spark application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="fathomgrid-")) / "fathomgrid.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def bounded(spark: SparkSession, most: str = "2m") -> None:
    """Rows go to the Python workers in batches of about `most` bytes, where the session sets no size.

    By default 10,000 rows go at once, so that a batch of texts takes memory in proportion to their lengths, in the JVM
    and in Python. A longer row is a batch of its own. The setting stays in the session, as results are lazy.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, most)
