"""What a session needs before Python functions of this package run on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once an application."""
    sc = spark.sparkContext
    if getattr(sc, "_chronoloom_sent", False):
        return
    top = Path(__file__).resolve().parent
    name = Path(tempfile.mkdtemp(prefix="chronoloom-")) / "chronoloom.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(name))
    sc._chronoloom_sent = True
