"""Makes this package importable on workers that do not have it installed, and bounds what they are given at once."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Bytes of rows that a Python worker is given at once, and rows that a Parquet reader decodes at once: rows may be long.
BATCH_BYTES, READER_ROWS = 2 << 20, 256
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's code to the application's executors, once; call it before a job that runs Python functions.

    The session keeps bounds of its own on what a worker and a reader hold at once, or gets these.
    """
    own = spark.conf.getAll
    for bound, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)):
        if bound not in own:
            spark.conf.set(bound, value)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="foliospark-package-"), "foliospark_package.zip")  # Spark's file server sends it on
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
