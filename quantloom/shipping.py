"""Makes this package importable in Python workers, and bounds what one Arrow batch holds."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: bytes of an Arrow batch; Spark's own limit, 64 MB, costs an executor several times that for each core
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: bytes of a method up to which the JVM compiles it
METHOD_BYTES = 8_000
_METHOD = "spark.sql.codegen.hugeMethodLimit"


def compiled_methods(spark: SparkSession) -> None:
    """Lets a session evaluate a wide projection in several methods where one would be too long for the JVM to compile,
    unless another limit than Spark's own is set: such a method is interpreted, several times slower."""
    if spark.conf.get(_METHOD) == "65535":
        spark.conf.set(_METHOD, str(METHOD_BYTES))


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each application, and lowers
    a session's limit on Arrow batches to ``BATCH_BYTES``, unless another than Spark's own is set."""
    if spark.conf.get(_LIMIT) == "67108864b":
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="package-")
    path = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
