"""References to keys that are missing, deleted or recorded later.

References and parent keys are hashed to the same partitions, sorted by key and merged once (a sort-merge join). The parent
side is aggregated first, on the map side, to one row per key with the bounds of its validity, so it never holds a hot key;
a key that very many references name is hot on the reference side only, where the join may split it (AQE) or, with
`salts` > 1, where it is spread over that many copies of the narrow parent row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validity(parents: DataFrame, key: str, recorded: str = "recorded_at", deleted: str = "deleted_at") -> DataFrame:
    """(key, first_recorded, first_deleted): since when a key exists and from when on it is deleted."""
    own = parents.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
    return own.agg(F.min(recorded).alias("first_recorded"), F.min(deleted).alias("first_deleted"))


def orphans(references: DataFrame, valid: DataFrame, key: str, at: str, salts: int = 1) -> DataFrame:
    """The rows of `references` whose `key` isn't valid at the time `at`, with a column `reason`.

    `missing`: no parent has the key; else `deleted`: its first deletion isn't after the reference; else `late`: it was first
    recorded after the reference. Null and empty keys are no references. A reference without a time is an orphan only if its
    key is missing. Rows are neither merged nor dropped; other columns pass through, also ones named like those of `valid`.
    """
    names = references.columns
    left = references.where(F.col(key).isNotNull() & (F.col(key) != "")).select(F.struct(*names).alias("_ref"), F.col(key).alias("key"), F.col(at).alias("_at"))
    on = ["key"]
    if salts > 1:
        on = ["key", "_salt"]
        left = left.withColumn("_salt", F.pmod(F.xxhash64("_ref"), F.lit(salts)))
        valid = valid.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    found = left.hint("merge").join(valid.withColumn("_known", F.lit(True)), on, "left")
    reason = F.when(F.col("_known").isNull(), "missing").when(F.col("first_deleted") <= F.col("_at"), "deleted").when(F.col("first_recorded") > F.col("_at"), "late")
    return found.withColumn("reason", reason).where("reason is not null").select(*[F.col("_ref")[c].alias(c) for c in names], "reason")
