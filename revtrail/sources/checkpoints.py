"""Results that are used several times, held where no lost executor takes them along."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder; lineage ends there.  Only a local master may do
    without ``spark.checkpoint.dir``: elsewhere a folder of one machine would be lost with it."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="revtrail-"))
    return df.checkpoint(eager=True)
