"""A table of the newest row per key, kept up by a stream batch by batch."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

MERGE = 8
KEEP_VERSIONS = 4


def newest_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each key the row with the largest ``order`` columns; between rows equal in these, the other columns decide.

    Nulls are the smallest, and a null in the key is a value like others. Formed in each task before the
    shuffle, so a key sends one row per task. Columns must be ones that can be compared (no maps).
    """
    names = [*order, *(c for c in rows.columns if c not in order)]
    keys = [F.col(k).alias(f"_key{i}") for i, k in enumerate(key)]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(*names)).alias("_newest"))
    return newest.select(*(F.col("_newest")[c].alias(c) for c in rows.columns))


@dataclass(frozen=True)
class UpsertTable:
    """The newest row per ``key`` of everything a stream has brought, below ``location``.

    Newest by the ``order`` columns, not by arrival: a row that comes late changes nothing. A row whose boolean
    column ``deleted`` is true takes its key out until a newer row brings it back.

    Each batch writes its newest rows to a folder of their own and then publishes a version: one small file, named
    after the batch and moved into place in one step, that lists the folders that make up the table. A reader takes
    the latest version and sees all of a batch or nothing. A batch that is published already is not written
    again, and what a broken-off one left behind is listed nowhere. ``merge`` folders of a level are
    merged into one of the next, so a version lists few folders and a row is rewritten once per level, not once per
    batch. The last ``KEEP_VERSIONS`` versions and their folders stay for readers that began earlier.

    One stream writes a table. The file system must move files in one step, as for Spark's own checkpoints.
    """

    location: str
    key: list[str]
    order: list[str]
    deleted: str | None = None
    merge: int = MERGE

    def run_available(self, stream: DataFrame) -> StreamingQuery:
        """Take in what has arrived; run again with the same table to continue."""
        query = (
            stream.writeStream.foreachBatch(self.take)
            .option("checkpointLocation", f"{self.location}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return query

    def take(self, rows: DataFrame, batch: int) -> None:
        """Bring one batch into the table, unless it is there already."""
        spark = rows.sparkSession
        versions = self._versions(spark)
        if versions and batch <= versions[-1]:
            return
        folders = self._folders(spark, versions[-1]) if versions else []
        folders.append({"name": self._write(rows, batch), "level": 0})
        level = 0
        while len(full := [f for f in folders if f["level"] == level]) >= self.merge:
            together = self._parts(spark, rows.schema, full)
            folders = [f for f in folders if f["level"] != level]
            level += 1
            folders.append({"name": self._write(together, batch), "level": level})
        self._publish(spark, batch, folders)
        self._forget(spark, [*versions, batch])

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The table as of the latest version; empty before the first."""
        versions = self._versions(spark)
        if not versions:
            return spark.createDataFrame([], schema)
        newest = newest_rows(self._parts(spark, schema, self._folders(spark, versions[-1])), self.key, self.order)
        return newest if self.deleted is None else newest.filter(~F.coalesce(self.deleted, F.lit(False)))

    def _write(self, rows: DataFrame, batch: int) -> str:
        # A deleted key is written too: an older row of it may be in another folder or still to come.
        name = f"{batch}-{uuid.uuid4().hex}"
        newest_rows(rows, self.key, self.order).write.parquet(f"{self.location}/parts/{name}")
        return name

    def _parts(self, spark: SparkSession, schema: StructType, folders: list[dict]) -> DataFrame:
        return spark.read.schema(schema).parquet(*(f"{self.location}/parts/{f['name']}" for f in folders))

    def _publish(self, spark: SparkSession, batch: int, folders: list[dict]) -> None:
        files, path = self._files(spark)
        staged = path(f"{self.location}/staged/{batch}-{uuid.uuid4().hex}")
        out = files.create(staged)
        try:
            out.write(bytearray(json.dumps(folders).encode()))
        finally:
            out.close()
        files.mkdirs(path(f"{self.location}/versions"))
        if not files.rename(staged, path(f"{self.location}/versions/{batch}")):
            raise OSError(f"version {batch} of {self.location} could not be moved into place")

    def _versions(self, spark: SparkSession) -> list[int]:
        return sorted(int(name) for name in self._names(spark, "versions"))

    def _folders(self, spark: SparkSession, version: int) -> list[dict]:
        files, path = self._files(spark)
        source = files.open(path(f"{self.location}/versions/{version}"))
        try:
            return json.loads(bytes(source.readAllBytes()))
        finally:
            source.close()

    def _forget(self, spark: SparkSession, versions: list[int]) -> None:
        """Remove old versions, and folders of earlier batches that no version lists any more."""
        files, path = self._files(spark)
        for version in versions[:-KEEP_VERSIONS]:
            files.delete(path(f"{self.location}/versions/{version}"), False)
        listed = {f["name"] for version in versions[-KEEP_VERSIONS:] for f in self._folders(spark, version)}
        for name in self._names(spark, "parts"):
            if name not in listed and int(name.split("-")[0]) <= versions[-1]:
                files.delete(path(f"{self.location}/parts/{name}"), True)

    def _names(self, spark: SparkSession, folder: str) -> list[str]:
        files, path = self._files(spark)
        below = path(f"{self.location}/{folder}")
        return [s.getPath().getName() for s in files.listStatus(below)] if files.exists(below) else []

    def _files(self, spark: SparkSession):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.location).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
