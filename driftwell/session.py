"""Session helpers: nothing here changes a setting that the cluster already made."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that operators rely on for results (not for speed).
RESULT_CONF = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}


def build(master: str = "local[*]", app: str = "driftwell", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    b = SparkSession.builder.master(master).appName(app)
    defaults = {
        **RESULT_CONF,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share.

    Only where none is set and driver and executors are one process (tests) is a folder of this machine taken;
    on a cluster that would be another disk on each node, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "driftwell-checkpoint")


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into shared_folder(), or into the folder that the session set itself."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
