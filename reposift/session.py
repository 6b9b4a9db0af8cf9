"""A session with the settings the jobs expect. A caller's own session is never changed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "reposift", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


def tidy(spark: SparkSession, **conf: str) -> SparkSession:
    """A session of a job's own with the caller's settings and those of conf, whose queries delete their shuffle files when they end.

    Else these stay until the driver happens to collect its garbage. Of a DataFrame that is run twice the
    shuffles are made twice, so what a caller gets should belong to the caller's session.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.get(key, None) != value:
            own.conf.set(key, value)
    for key, value in ({"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | conf).items():
        own.conf.set(key, value)
    return own


def workspace(spark: SparkSession) -> str:
    """A new folder name for tables that a job keeps for itself, below the session's spark.checkpoint.dir.

    Where that is unset, a session of one process, as in tests, gets a temporary
    folder; a cluster, whose executors would not share it, is an error.
    """
    context = spark.sparkContext
    shared = context._jsc.sc().getCheckpointDir()
    folder = shared.get() if shared.isDefined() else context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{folder or tempfile.mkdtemp(prefix='spark-')}/work-{uuid.uuid4()}"
