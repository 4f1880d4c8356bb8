"""Makes the package importable in Python workers, wherever the driver imported it from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as --py-files would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).parent
    out = Path(tempfile.mkdtemp()) / f"{here.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for source in sorted(here.rglob("*.py")):
            z.write(source, source.relative_to(here.parent))
    context.addPyFile(str(out))
    _shipped.add(context.applicationId)
