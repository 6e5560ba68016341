"""Give the package to executors that can't import it from where the driver does."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each Spark context; harmless where the package is installed."""
    sc = spark.sparkContext
    if getattr(sc, "_gridloom_package", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="gridloom-"), "gridloom_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(n for n in names if n.endswith(".py")):
                z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(top)))
    sc.addPyFile(out)
    sc._gridloom_package = True
