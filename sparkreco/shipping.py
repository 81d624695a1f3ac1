"""Makes the package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package as a zip file, unless the workers' path has it already."""
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _DONE or any(p and os.path.isdir(p) and os.path.samefile(p, _ROOT) for p in known):
        return
    _DONE.add(app)
    path = os.path.join(tempfile.mkdtemp(), "sparkreco.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(os.path.join(_ROOT, "sparkreco")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), _ROOT))
    spark.sparkContext.addPyFile(path)
