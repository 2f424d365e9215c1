"""Makes the package importable on executors that don't have it installed."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import SparkSession

from .staging import run_dir

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: add the package as a zip to the Python path of all executors."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = run_dir(spark).removeprefix("file://")
    if "://" in folder:
        return  # a remote store: the package has to be installed on the executors
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/lexispark-{app}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
