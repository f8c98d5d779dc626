"""A table that grows by batches, of which the last one with an id has its row.

    path/batches/<name>/     rows of one batch, one per id, or of a compaction
         replaced/<name>/    (id, batch): rows of earlier batches that this one replaces
         current/<name>      empty; which batches count

Appending a batch writes its rows and the ids that it replaces, found from ids
alone, and rewrites nothing. Reading leaves out the replaced rows by an anti-join
with a table of ids. A compaction writes what is left as one batch, behind which earlier
ones no longer count. A batch counts from the creation of its empty file on, so a
writer that dies changes nothing. One writer at a time.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import delete, names, touch

FULL = "full"


class MergeStore:
    """The merged rows under ``path``, identified by ``id_column``."""

    def __init__(self, spark: SparkSession, path: str, id_column: str):
        self.spark, self.path, self.id_column = spark, path, id_column

    def _at(self, *parts: str) -> str:
        return posixpath.join(self.path, *parts)

    def batches(self) -> list[str]:
        """Names of the batches that count, in order: the last compaction and what came after it."""
        found = names(self.spark, self._at("current"))
        full = [k for k, name in enumerate(found) if name.endswith(FULL)]
        return found[full[-1] :] if full else found

    def _read(self, folder: str, batches: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[self._at(folder, b) for b in batches])

    def _live(self, batches: list[str], *columns: str) -> DataFrame:
        """Rows that no later batch replaces."""
        rows = self._read("batches", batches)
        rows = rows.select(*columns) if columns else rows
        return rows.join(self._read("replaced", batches), [self.id_column, "batch"], "left_anti")

    def append(self, rows: DataFrame) -> int:
        """Add a batch and return its number. Of several rows with an id the largest is taken; rows without one are left out."""
        every = names(self.spark, self._at("current"))
        number = int(every[-1].split("-")[0]) + 1 if every else 0
        name = f"{number:012}-{uuid.uuid4().hex}"
        others = [c for c in rows.columns if c != self.id_column]
        one = rows.filter(F.col(self.id_column).isNotNull()).groupBy(self.id_column).agg(F.max(F.struct(*others)).alias("row"))
        self._write(name, one.select(self.id_column, "row.*", F.lit(number).cast("long").alias("batch")), self.batches())
        return number

    def _write(self, name: str, rows: DataFrame, before: list[str]) -> None:
        rows.write.parquet(self._at("batches", name))
        new = self._read("batches", [name]).select(self.id_column)
        if before:
            replaced = self._live(before, self.id_column, "batch").join(new, self.id_column, "left_semi")
        else:
            replaced = new.withColumn("batch", F.lit(0).cast("long")).limit(0)
        replaced.select(self.id_column, "batch").write.parquet(self._at("replaced", name))
        touch(self.spark, self._at("current", name))

    def read(self) -> DataFrame:
        """The merged rows, with the number of the ``batch`` each came from."""
        batches = self.batches()
        if not batches:
            raise FileNotFoundError(f"no batches under {self.path}")
        return self._live(batches)

    def compact(self) -> None:
        """Write the merged rows as one batch; rows keep their numbers. Earlier batches are deleted."""
        every, batches = names(self.spark, self._at("current")), self.batches()
        if len(batches) < 2:
            return
        number = int(batches[-1].split("-")[0])
        # The name sorts behind the batches it holds and before the next one.
        self._write(f"{number:012}-~{uuid.uuid4().hex}-{FULL}", self._live(batches), [])
        for old in every:
            for folder in ("current", "batches", "replaced"):
                delete(self.spark, self._at(folder, old))
