"""Tables that must be computed once only, because a second computation could deal their rows out differently."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """`df` as written to the cluster's checkpoint folder. Only a session on one machine (tests) that names none gets a folder of this machine."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = f"file://{tempfile.mkdtemp(prefix='fathomline-')}"
            atexit.register(shutil.rmtree, named.removeprefix("file://"), True)
        context.setCheckpointDir(named)
    return df.checkpoint()
