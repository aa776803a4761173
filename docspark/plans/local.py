"""Row-local Python functions over Arrow batches: no shuffle, other columns pass through untouched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.types import arrow, fields

#: Rows turned into Python objects at a time.
SLICE = 256


def with_local(df: DataFrame, name: str, ddl: str, function: Callable, *inputs: str, keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with the column `name` of type `ddl`: function(*inputs) of each row."""
    keep = [c for c in (df.columns if keep is None else keep) if c != name]
    extra = [c for c in inputs if c not in keep]  # a column that is kept is read where it stands
    at = [keep.index(c) if c in keep else len(keep) + extra.index(c) for c in inputs]
    width, kind = len(keep), arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                values = [function(*x) for x in zip(*(part.column(i).to_pylist() for i in at), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(values, kind)], [*keep, name])

    read = df.select(*keep, *[F.col(c).alias(f"_in{i}") for i, c in enumerate(extra)])
    return read.mapInArrow(run, ", ".join(x for x in (fields(df.schema, keep), f"`{name}` {ddl}") if x))
