"""The package's own code for Python workers: added once a session, so that executors need no copy of the repository."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> SparkSession:
    """Let the executors of ``spark`` import this package."""
    sc = spark.sparkContext
    if getattr(sc, "_skyloom_shipped", False) or not os.path.isdir(_ROOT):
        return spark
    folder = tempfile.mkdtemp(prefix="skyloom-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "skyloom_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for top, _, names in os.walk(_ROOT):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(top, name), os.path.join("skyloom", os.path.relpath(os.path.join(top, name), _ROOT)))
    sc.addPyFile(target)
    sc._skyloom_shipped = True
    return spark
