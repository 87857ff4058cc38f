"""What every query needs of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's modules to the session's Python workers, once."""
    context = spark.sparkContext
    if "pagestrata.zip" not in context._python_includes:
        root = Path(__file__).resolve().parent
        packed = Path(tempfile.mkdtemp()) / "pagestrata.zip"
        with zipfile.ZipFile(packed, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(packed))
    return spark
