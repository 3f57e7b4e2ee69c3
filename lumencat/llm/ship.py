"""Make this package importable on the executors, as ``--py-files`` would."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
# What a Python worker is handed at once; rows alone would let long texts make a batch of any size.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, and bound the batches of Python workers.

    The archive is the driver's own.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp()}/{package.name}", "zip", str(package.parent), package.name,
        )
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
