"""Starting streams and reading what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

# For streams, unless the caller's session sets them.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session for streams with the settings of ``spark``, which it leaves alone.

    State is kept in RocksDB, on the executors' disks with a changelog in the checkpoint,
    because one key per user outgrows the memory of the default store. Sessions are
    merged before the shuffle, so a user with very many events sends few rows. Event
    times have no time zone and are taken as UTC.

    ``state_partitions`` is the number of stores the state is spread over, if it is not
    to be the session's number of shuffle partitions. Each is opened and saved in every
    micro-batch, so a few per core are enough. A stream keeps the number it began with.
    """
    session = spark.newSession()
    for name, value in {**STREAM_SETTINGS, **spark.conf.getAll}.items():
        if session.conf.isModifiable(name):
            session.conf.set(name, value)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    if state_partitions is not None:
        session.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    return session


def start_available(stream: DataFrame, location: str) -> StreamingQuery:
    """Start processing what has arrived, appending the finished rows to a parquet table.

    Starting it again with the same ``location`` continues where the last run stopped,
    with the state it had; the table below ``location`` holds each row once even if a
    run was broken off.
    """
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output_folder(location))
        .option("checkpointLocation", f"{location}/progress")
        .trigger(availableNow=True)
        .start()
    )


def run_available(stream: DataFrame, location: str) -> StreamingQuery:
    query = start_available(stream, location)
    query.awaitTermination()
    return query


def output_folder(location: str) -> str:
    return f"{location}/table"


def read_output(spark: SparkSession, stream: DataFrame, location: str) -> DataFrame:
    return spark.read.schema(stream.schema).parquet(output_folder(location))
