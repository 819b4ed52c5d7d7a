"""Session settings and the shared folder that written tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs count on; all of them may be overridden."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{name.replace("__", "."): str(value) for name, value in conf.items()},
    }
    builder = SparkSession.builder.appName("stockloom")
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is the cluster's ``spark.checkpoint.dir``. A machine-local folder is used only by a
    local master without that setting, as in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="stockloom-")
    return _local_dirs[app]


def clear_scratch(spark: SparkSession) -> None:
    """Remove everything this application has written to ``scratch_path``; tables read from there are gone then."""
    from stockloom.sources import files

    files.remove(spark, f"{shared_dir(spark)}/stockloom/{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody wrote to before, in the shared folder."""
    return f"{shared_dir(spark)}/stockloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
