"""What plans need of a session: the package on executors, and checkpoints."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, unless their path has it."""
    package = Path(__file__).resolve().parent
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(package.parent) in on_path:
        return
    to = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    before = list(sys.path)
    spark.sparkContext.addPyFile(str(to))
    sys.path[:] = before  # the driver keeps importing from the checkout
    _SHIPPED.add(app)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's own folder in spark.checkpoint.dir, which all executors share.

    The cluster names that folder; only a local session that names none gets a temporary
    one, for elsewhere executors wouldn't see it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint, one that outlives executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
