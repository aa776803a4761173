"""Named parquet tables under one folder, read by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` under `folder`, as one scan that later projections and filters prune."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan in at least as many partitions as there are cores, for steps that compute much on each row.

    A scan of few small files has few partitions, each of a split at most, so that what is shuffled here is bounded by a split for each
    core; larger tables have more partitions than cores and stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def earliest(df: DataFrame, key: str, columns: list[str], at: str = "recorded_at") -> DataFrame:
    """One row for each `key`: the values of `columns` in the row with the earliest `at`.

    Rows that share the earliest `at` are told apart by the remaining columns in the order given, so the result doesn't
    depend on the order of the input. Rows without a key are left out; a row without `at` counts as the latest. The
    aggregation combines on the map side, so a key that holds many rows sends few of them. Columns of the input that are
    not named are ignored.
    """
    rest = [c for c in columns if c != at]
    if any("map<" in df.schema[c].dataType.simpleString() or "variant" in df.schema[c].dataType.simpleString() for c in rest):
        order = F.struct(F.col(at).isNull(), F.col(at), *[F.to_json(F.struct(c)) for c in rest])
        first = F.min_by(F.struct(at, *rest), order).alias("_r")
    else:
        first = F.min(F.struct(F.col(at).isNull().alias("_n"), F.col(at), *rest)).alias("_r")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])
