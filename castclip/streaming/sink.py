"""A table of the newest row of each key, kept by a stream and read by others, on any file system that Spark writes to.

Batches are folders of level 0. When ``fan`` folders of a level are there, they become one of the next, by key and newest batch, so there are at most
fan - 1 folders of each level and a row is written again once a level. Which folders count is said by a numbered list, of which the newest is valid; a list
is written whole under another name and then renamed, which fails if the number is taken. A batch that a list names already (one replayed after a restart) changes nothing.
Folders and lists that neither of the two newest lists needs are deleted; readers of a list before those should read again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LiveTable:
    """key: columns whose newest row counts; of a batch's rows with one key any may stay, so a batch should hold each key once."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], fan: int = 8):
        self.spark, self.path, self.key, self.fan = spark, path.rstrip("/"), list(key), fan
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _lists(self) -> list[int]:
        if not self.fs.exists(self._at("lists")):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self._at("lists"))]
        return sorted(int(n) for n in names if n.isdigit())

    def state(self, number: int | None = None) -> dict:
        """number of the list, last batch, and parts: name and level of each folder, oldest batch first."""
        lists = self._lists()
        if not lists and number is None:
            return {"number": 0, "last": -1, "parts": []}
        rows = self.spark.read.text(f"{self.path}/lists/{number or lists[-1]}").collect()  # one line
        return json.loads(rows[0]["value"])

    def _commit(self, state: dict) -> None:
        draft = f"drafts/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/{draft}")
        self.fs.mkdirs(self._at("lists"))
        to = self._at(f"lists/{state['number']}")
        if self.fs.exists(to) or not self.fs.rename(self._at(draft), to):
            self.fs.delete(self._at(draft), True)
            raise RuntimeError(f"{self.path} has another writer: list {state['number']} is there already")

    def _clean(self) -> None:
        lists = self._lists()
        used = {name for n in lists[-2:] for name, _ in self.state(n)["parts"]}
        for n in lists[:-2]:
            self.fs.delete(self._at(f"lists/{n}"), True)
        for f in self.fs.listStatus(self._at("parts")):
            if f.getPath().getName() not in used:
                self.fs.delete(f.getPath(), True)

    def _part(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/parts/{n}" for n in names])

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.key]
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "_batch").alias("_v")).select(*self.key, "_v.*")

    def write(self, batch: DataFrame, n: int) -> None:
        state = self.state()
        if n <= state["last"]:
            batch.write.format("noop").mode("overwrite").save()  # a stream's own state is only kept if its batch is read
            return
        name = uuid.uuid4().hex
        batch.withColumn("_batch", F.lit(n).cast("long")).write.parquet(f"{self.path}/parts/{name}")
        parts = [*state["parts"], [name, 0]]
        level = 0
        while len(own := [p for p, x in parts if x == level]) >= self.fan:
            name = uuid.uuid4().hex
            self._newest(self._part(own)).write.parquet(f"{self.path}/parts/{name}")
            parts = [[p, x] for p, x in parts if x > level] + [[name, level + 1]]
            level += 1
        self._commit({"number": state["number"] + 1, "last": n, "parts": parts})
        self._clean()

    def read(self) -> DataFrame:
        """The newest row of each key."""
        names = [p for p, _ in self.state()["parts"]]
        if not names:
            raise ValueError(f"{self.path}: no batch has been written")
        return self._newest(self._part(names)).drop("_batch")


def upsert(path: str, key: list[str], fan: int = 8) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that puts the changed rows of each batch into a LiveTable."""
    return lambda batch, n: LiveTable(batch.sparkSession, path, key, fan).write(batch, n)


def latest(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    return LiveTable(spark, path, key).read()
