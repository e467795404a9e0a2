"""Session factory with the settings the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder the cluster names; where there is none, set a temporary one in local mode only."""
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir") and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rillgraph-"))


def session(app: str = "rillgraph", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; keyword settings use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
