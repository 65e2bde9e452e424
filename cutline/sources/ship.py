"""Sends this package to the executors, so that no worker needs it installed."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's files, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).resolve().parent.parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    at = Path(tempfile.mkdtemp(prefix="cutline-")) / f"{root.name}.zip"
    at.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(at))
    _SENT.add(app)
