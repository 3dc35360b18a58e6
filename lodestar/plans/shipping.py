"""Makes this package importable in the executors' Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Hands the package's sources to the session's executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(root)))
    # the driver serves the file to the executors; nobody else reads this copy
    _shipped[app] = os.path.join(tempfile.mkdtemp(prefix="lodestar-"), "lodestar.zip")
    with open(_shipped[app], "wb") as f:
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(_shipped[app])
