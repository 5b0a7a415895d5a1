"""Session factory: UTC clock, ANSI arithmetic and adaptive execution on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "loomline", conf: dict[str, str] | None = None) -> SparkSession:
    """A session with DEFAULTS; entries of conf win."""
    return SparkSession.builder.appName(app).config(map=DEFAULTS | (conf or {})).getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder of spark.checkpoint.dir, without its lineage.

    Where none is set, a temporary folder serves a local session, whose executors are this very process; on a cluster
    that is an error, as its executors could not see such a folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.match(r"local(\[.*\])?\Z", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="loomline-checkpoint-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
