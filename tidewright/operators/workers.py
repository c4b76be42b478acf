"""What functions that run in Python workers need."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; on a cluster it is installed or sent along."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where they come from fewer files than there are: a small file of one row group would be one task. Larger tables stay as they are read."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if 0 < len(rows.inputFiles()) < n else rows
