"""Send this package to the executors, where they don't have it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the session once; driver and executors then run the same code."""
    sc = spark.sparkContext
    if getattr(sc, "_quillgraph_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    # The archive lies on the driver only; Spark serves it to the executors.
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='quill-')}/{package.name}", "zip", package.parent, package.name)
    sc.addPyFile(archive)
    sc._quillgraph_shipped = True
