"""How rows are dealt to tasks, and Python functions over rows whose results are much larger than a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: rows whose arguments and results are Python objects at once; an Arrow batch has 10,000 by default
SLICE = 128
#: and the bytes of their arguments, unless one row alone has more
SLICE_BYTES = 1 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by keys over all cores.  A compact file of many short rows is a split or two, too few tasks for work that is done row by row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _slices(cols: tuple[pa.Array, ...]) -> Iterator[list[pa.Array]]:
    at = 0
    while at < len(cols[0]):
        n = min(SLICE, len(cols[0]) - at)
        while n > 1 and sum(c.slice(at, n).nbytes for c in cols) > SLICE_BYTES:
            n //= 2
        yield [c.slice(at, n) for c in cols]
        at += n


def _sliced(batches, f: Callable, kind: pa.DataType):
    for batch in batches:
        for cols in _slices(batch if isinstance(batch, tuple) else (batch,)):
            yield pa.array([f(*r) for r in zip(*(c.to_pylist() for c in cols), strict=True)], kind)


def per_row(f: Callable, returns: str, *cols: Column) -> Column:
    """f of each row's values; what a task holds as Python objects grows neither with the batch nor with its rows' length, but for a single row's."""
    kind = to_arrow_type(DataType.fromDDL(returns))
    if len(cols) == 1:

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return _sliced(batches, f, kind)
    elif len(cols) == 2:

        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            return _sliced(batches, f, kind)
    else:
        raise ValueError("one or two columns")
    return F.arrow_udf(run, returns)(*cols)
