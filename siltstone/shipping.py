"""Makes this package importable on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_PREFIX = "siltstone_package_"


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python workers, once for each Spark context."""
    context, top = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if any(name.startswith(_PREFIX) for name in context._python_includes):
        return
    folder = tempfile.mkdtemp(prefix="siltstone-")  # the driver serves the file from here; executors never read this folder
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{_PREFIX}{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for where, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    out.write(f"{where}/{name}", f"siltstone/{os.path.relpath(f'{where}/{name}', top)}")
    context.addPyFile(path)
