"""Give the executors this package when it isn't installed on them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str | None:
    """Send the package as a zip file, once a session; local sessions share the driver's path."""
    sc = spark.sparkContext
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        return None
    sent = getattr(sc, "_lexspark_zip", None)
    if sent is None:
        package = Path(__file__).resolve().parent
        sent = str(Path(tempfile.mkdtemp()) / "lexspark.zip")  # read by the driver's file server only
        with zipfile.ZipFile(sent, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(sent)
        sc._lexspark_zip = sent
    return sent
