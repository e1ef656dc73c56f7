"""Spark session settings and the shared working folder."""

from __future__ import annotations

import logging
import tempfile
import uuid

from pyspark.sql import SparkSession


log = logging.getLogger(__name__)

#: Folders made by this process that were not removed yet.
_folders: list[str] = []


def build_session(
    app_name: str = "tidemark",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings the queries were planned for.

    On a cluster leave ``master`` to spark-submit and give ``shuffle_partitions``
    generously (a few per core of the whole cluster): AQE merges the small ones
    after each shuffle, but it cannot split them again.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in (settings or {}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def working_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder below the one the cluster names in ``spark.checkpoint.dir``.

    Every executor must be able to reach it, so that written intermediate tables
    outlive the executor that wrote them. A machine-local folder is used only where
    the setting is absent and Spark itself is local, as in tests, and the log says so.
    ``remove_working_folders`` removes all of them once their results have been read.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if not parent:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        parent = tempfile.mkdtemp(prefix="tidemark-")
        log.warning("spark.checkpoint.dir is not set: intermediate tables go to %s", parent)
        _folders.append(parent)
    folder = f"{parent.rstrip('/')}/tidemark/{purpose}-{uuid.uuid4().hex}"
    _folders.append(folder)
    return folder


def remove_working_folders(spark: SparkSession) -> None:
    """Remove the folders that this process has made, with what is in them.

    Results that are still to be read from them, and streams that are to be continued, are lost.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folders.pop())
        path.getFileSystem(conf).delete(path, True)
