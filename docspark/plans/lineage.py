"""Cutting lineage of iterative jobs in storage that every executor can reach.

A cut is a parquet table in the folder of `spark.checkpoint.dir`. It survives the loss of executors, keeps its columns
prunable, and can be dropped as soon as the next round stands.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A local session without one gets a temporary folder; a cluster
    without one is an error, as each executor would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[\w*, ]+\])?", spark.sparkContext.master) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not (there := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docspark-"))
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
    return there.get()


class Cuts:
    """Written rounds of one iterative job; `drop` removes those that nothing reads any longer. What results still read goes when the
    session's file system is closed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_folder(spark)}/docspark-{uuid.uuid4().hex}"
        self.live: list[tuple[DataFrame, str]] = []

    def _at(self, path: str) -> tuple:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{uuid.uuid4().hex}"
        if not self.live:
            self._at(self.base)[0].deleteOnExit(self._at(self.base)[1])
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.live.append((out, path))
        return out

    def keep_only(self, before: list, *frames: DataFrame) -> None:
        """Drops what was cut since `before` (an earlier copy of `live`) but for `frames`."""
        self.drop(*[df for df, _ in self.live if not any(df is x for x, _ in before) and not any(df is x for x in frames)])

    def drop(self, *frames: DataFrame) -> None:
        keep = []
        for df, path in self.live:
            if any(df is x for x in frames):
                system, where = self._at(path)
                system.delete(where, True)
            else:
                keep.append((df, path))
        self.live = keep
