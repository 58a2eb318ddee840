"""Makes the package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the executors, once per application; Spark hands it to executors that join later as well."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(SparkFiles.getRootDirectory()) / f"{package.name}-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
