"""The package on the executors, and the size of what they hand to Python."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of one Arrow batch. Rows may be whole documents, so Spark's own 10,000 would be a large batch.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS, SPARKS_OWN = "1000", "10000"


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the session's Python workers, once a Spark application; an installed copy is not needed there.

    Arrow batches get ROWS rows unless the session has a number of its own.
    """
    if spark.conf.get(BATCH_ROWS) == SPARKS_OWN:
        spark.conf.set(BATCH_ROWS, ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(), "meander.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(here)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
