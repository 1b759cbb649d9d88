"""Make the packages importable in the Python workers, as ``--py-files`` would."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_packages(spark: SparkSession) -> None:
    """Send ``echoloom`` and ``workload`` to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="echoloom-pkg-")) / "echoloom_packages.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for package in ("echoloom", "workload"):
            for source in sorted((root / package).rglob("*.py")):
                target.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
