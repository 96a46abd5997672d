"""Make the package importable in Python workers wherever the session runs."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application.

    A job submitted with --py-files, or with the package installed on all
    machines, doesn't need it; a second copy does no harm.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    fd, path = tempfile.mkstemp(prefix=root.name, suffix=".zip")
    with os.fdopen(fd, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
