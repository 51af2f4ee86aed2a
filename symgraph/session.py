"""The package on the executors."""

from __future__ import annotations

import functools
import io
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for each application.

    Functions that run in Python workers are unpickled by module name, so workers must be
    able to import the package wherever they start.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="symgraph-package-")
    target = os.path.join(folder, f"symgraph-{context.applicationId}.zip")
    Path(target).write_bytes(packed.getvalue())
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def with_package(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query(spark, ...)`` after the package is on the executors.

    Rows here are whole texts, so batches sent to Python have fewer rows than Spark's
    default, unless the session says otherwise.
    """

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship_package(spark)
        if spark.conf.get(_BATCH_ROWS) == "10000":
            spark.conf.set(_BATCH_ROWS, "1000")
        return query(spark, *args)

    return run
