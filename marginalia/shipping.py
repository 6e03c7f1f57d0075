"""Makes this package importable in Spark's Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to all executors, once for each application; Spark fetches them from the driver."""
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    _DONE.add(context.applicationId)
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="marginalia-")) / "marginalia-src.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(path))
