"""Making this package importable where tasks run Python."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import keysift.llm
from keysift.llm.files import new_file
from keysift.plans.durable import scratch_dir


def ship(spark: SparkSession) -> None:
    """Hand the package to the session's Python workers, once per Spark context.

    Workers find it on their own only where it is installed or the driver was started in
    its folder.  It travels as Spark's own package files do, by way of the shared folder.
    """
    context = spark.sparkContext
    if getattr(context, "_keysift_shipped", False):
        return
    root, data = Path(keysift.llm.__file__).parent.parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, f"keysift/{path.relative_to(root)}")
    uri, out = new_file(scratch_dir(spark, "package"), ".zip")
    out.write(data.getvalue())
    out.close()
    context.addPyFile(uri)
    context._keysift_shipped = True
