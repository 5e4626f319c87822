"""Cutting lineage through the shared folder of the cluster."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that ``spark.checkpoint.dir`` names.

    One is made only where it is unset and everything runs in one process; on a cluster that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {sc.master} share")
        sc.setCheckpointDir(named or Path(tempfile.gettempdir(), f"vigil-shared-{os.getpid()}").as_uri())
    return df.checkpoint(eager=True)
