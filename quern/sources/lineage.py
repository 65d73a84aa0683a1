"""Cutting a plan's lineage in the folder the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is chosen on a local master only; on a
    cluster other machines would not see it, so that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="quern-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
