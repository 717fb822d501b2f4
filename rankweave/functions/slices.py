"""Functions of single rows that run on a few rows of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: So many rows are Python objects at a time; a batch of Spark's has 10,000 rows, whatever their size.
ROWS = 128


def map_rows(df: DataFrame, run: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that run makes of df's, narrow; a worker holds a batch as Arrow and only a slice of it, and what that gives, as objects."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = list(run(zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True)))
                columns = zip(*rows, strict=True) if rows else [()] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return df.mapInArrow(sliced, schema)
