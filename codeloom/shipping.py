"""Make this package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="codeloom-ship-")) / "codeloom_package.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, f"{root.name}/{path.relative_to(root)}")
        spark.sparkContext.addPyFile(str(target))
    return spark
