"""Results that grow by parts: a part of recordings is computed, written, and only then entered in a ledger.

A run does what the ledger lacks, so a second one writes nothing, and one that broke goes on after its last finished part. What a broken run left
without an entry is never read, and is written over when its part is done again."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = ["subject_id", "visit_id"]


class Ledger:
    """``folder``/ledger, one row a finished recording and method with its part; ``folder``/<table>, the parts."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _there(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def done(self) -> DataFrame:
        """method, subject_id, visit_id, part."""
        schema = "method string, subject_id string, visit_id string, part string"
        path = f"{self.folder}/ledger"
        return self.spark.read.schema(schema).parquet(path) if self._there(path) else self.spark.createDataFrame([], schema)

    def open(self, recordings: DataFrame, method: str) -> DataFrame:
        """The recordings that the method has not done yet."""
        return recordings.select(*UNIT).distinct().join(self.done().where(F.col("method") == method), UNIT, "left_anti")

    def advance(self, recordings: DataFrame, method: str, work: Callable[[str], dict[str, DataFrame]], parts: int = 8) -> int:
        """Does what is open, in ``parts`` parts by hash; ``work`` gets the path of a part's list of recordings and gives its tables. Returns
        the number of parts that were done."""
        todo = self.open(recordings, method).withColumn("n", F.pmod(F.xxhash64(*UNIT), F.lit(parts)).cast("int"))
        run = uuid.uuid4().hex[:12]
        lists = f"{self.folder}/lists/{method}-{run}"
        todo.write.partitionBy("n").parquet(lists)
        numbers = sorted(r[0] for r in self.spark.read.schema("subject_id string, visit_id string, n int").parquet(lists).select("n").distinct().collect())
        for n in numbers:
            chosen = f"{lists}/n={n}"
            part = f"{method}-{run}-{n}"
            for name, table in work(chosen).items():
                table.write.mode("overwrite").parquet(f"{self.folder}/{name}/part={part}")
            mine = self.spark.read.schema("subject_id string, visit_id string").parquet(chosen)
            mine.select(F.lit(method).alias("method"), *UNIT, F.lit(part).alias("part")).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")
        return len(numbers)

    def table(self, name: str) -> DataFrame | None:
        """The finished parts of a table together; None before there is one."""
        parts = [r[0] for r in self.done().select("part").distinct().collect()]  # parts x runs names
        found = [self.spark.read.parquet(f"{self.folder}/{name}/part={p}") for p in sorted(parts) if self._there(f"{self.folder}/{name}/part={p}")]
        return reduce(DataFrame.unionByName, found) if found else None
