"""Python workers get this package from the driver, so that executors need no installed copy."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import tallybridge

_shipped: set[str] = set()

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Both ends of the pipe hold a batch twice while it grows, so tasks are handed small ones, unless the session says how large.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application, once, and bound what a Python worker is handed at a time."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(tallybridge.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="tallybridge-")) / "tallybridge.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
