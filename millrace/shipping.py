"""Python tasks import this package: send it to executors that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application once."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(HERE):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("millrace", os.path.relpath(full, HERE)))
    sc.addPyFile(path)
    sc._millrace_shipped = True
