"""Sends this package to the executors, whose Python workers import it by name."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows that a Python worker gets at a time, at most: its memory is then the same for any table.
BATCH = 2000


def ship(spark: SparkSession) -> None:
    """Once for each Spark context; larger Arrow batches of the session are cut to ``BATCH`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, BATCH)
    sc = spark.sparkContext
    if not getattr(sc, "_inkveil_shipped", False):
        root = Path(__file__).resolve().parents[2]
        name = Path(tempfile.mkdtemp(prefix="inkveil-zip-")) / "inkveil.zip"
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted((root / "inkveil").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(str(name))
        sc._inkveil_shipped = True
