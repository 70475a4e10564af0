"""Results that are kept between the steps of a computation."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder of checkpoints, which driver and executors share.

    The folder is that of ``spark.checkpoint.dir``. Only where a local session
    has none a temporary one is made; on a cluster it must be set.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='cyclarium-')}"
        context.setCheckpointDir(folder)
    return df.checkpoint()
