"""Sending this package to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to where tasks run Python, once for each application."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _SHIPPED or not package.is_dir():  # in an archive already: it was shipped as one
        return
    # Executors fetch it from the driver, at any time until the driver ends.
    folder = tempfile.mkdtemp(prefix="gridmill-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{package.name}-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
