"""Send this package's code to the executors of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per Spark context; harmless where the package is installed on the executors too."""
    context = spark.sparkContext
    if getattr(context, "_quarry_sent", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="quarry-code-"), "quarry_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    z.write(at, os.path.join("quarry", os.path.relpath(at, package)))
    context.addPyFile(target)
    context._quarry_sent = True
