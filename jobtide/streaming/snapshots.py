"""A chain of snapshots of one table, committed one micro-batch at a time.

``path/data/<batch>-<attempt>`` has a version's files, ``path/commits/<batch>@<folder>`` is
an empty file that makes it current. A writer that dies before its commit leaves files
that nothing reads; the batch is then replayed onto the last committed version. A batch
that is committed already is not merged again. Versions beyond the newest ``keep``, and
files of dead writers, are removed after each commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import files

PLACES = 12


class Chain:
    def __init__(self, path: str, schema: str, keep: int = 2, partitions: int = 64, key: str = "id"):
        self.path, self.schema, self.keep, self.partitions, self.key = path.rstrip("/"), schema, max(1, keep), partitions, key

    def commits(self, spark: SparkSession) -> dict[int, str]:
        """Committed batches and their folders, oldest first; few, as older ones are removed."""
        found = (name.split("@", 1) for name in files.names(spark, f"{self.path}/commits"))
        return {int(batch): folder for batch, folder in sorted(found)}

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The newest version, or the newest of a batch before the given one; an empty table where there is none."""
        kept = [folder for batch, folder in self.commits(spark).items() if before is None or batch < before]
        return spark.read.schema(self.schema).parquet(f"{self.path}/data/{kept[-1]}") if kept else spark.createDataFrame([], self.schema)

    def write(self, table: DataFrame, batch: int) -> str:
        """Write a version without committing it: its folder."""
        folder = f"{batch:0{PLACES}d}-{uuid.uuid4().hex}"
        table.repartition(self.partitions, self.key).write.parquet(f"{self.path}/data/{folder}")
        return folder

    def commit(self, spark: SparkSession, batch: int, folder: str) -> bool:
        """Make a written version current; false where the batch has been committed meanwhile."""
        if batch in self.commits(spark):
            return False
        return files.make(spark, f"{self.path}/commits/{batch:0{PLACES}d}@{folder}")

    def clean(self, spark: SparkSession) -> list[str]:
        """Remove old versions and files of dead writers: the folders that went."""
        commits = self.commits(spark)
        current = list(commits.items())[-self.keep :]
        newest = max(commits, default=-1)
        stay = {folder for _, folder in current}
        for batch, folder in commits.items():
            if folder not in stay:
                files.delete(spark, f"{self.path}/commits/{batch:0{PLACES}d}@{folder}")
        # a writer of a later batch may be at work
        gone = [f for f in files.names(spark, f"{self.path}/data") if f not in stay and int(f.split("-", 1)[0]) <= newest]
        for folder in gone:
            files.delete(spark, f"{self.path}/data/{folder}")
        return gone

    def step(self, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """What ``foreachBatch`` calls: the next version is ``merge(version before, batch)``."""

        def run(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            if number not in self.commits(spark):
                folder = self.write(merge(self.read(spark, number), batch), number)
                self.commit(spark, number, folder)
            self.clean(spark)

        return run
