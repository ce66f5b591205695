"""Send this package to the executors' Python workers, cut lineage, and keep growing tables off the driver."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once per application.

    Executors fetch it from the driver, so a cluster needs no installed copy and no shared folder.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    _SENT.add(sc.applicationId)
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "clonospark_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(target))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder of the session and read from there; a local session without one gets its own."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
    return df.checkpoint()


def apart(df: DataFrame) -> DataFrame:
    """``df`` as a side that is joined by key over many tasks, whatever its estimated size.

    Spark broadcasts a side by an estimate from the sizes of compressed files, in which what explode adds doesn't count, so at its
    default settings a side that grows with the input goes through the driver.
    """
    return df.hint("merge")
