"""Sending this package to the executors, where it isn't installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the session's application, once."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="codelode-")  # code only, and the driver serves it to the executors
    atexit.register(shutil.rmtree, folder, True)
    target = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".grammar"):
                z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _sent.add(app)
