"""Python functions over columns that hold a few rows as objects at a time, however many a task or an Arrow batch has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Rows, or bytes and characters of what they hold, whose results are handed on at once.
ROWS, SIZE = 64, 4 << 20


def by_row(f: Callable, kind: str):
    """A column function of f, which takes a row's values and gives one of this kind (maps as lists of pairs). It runs once a row: no plan repeats it in filters of its own."""
    shape = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            out, held = [], 0
            for values in zip(*columns, strict=True):
                row = [v.as_py() for v in values]
                out.append(f(*row))
                held += sum(len(x) for x in row if x is not None)
                if len(out) == ROWS or held >= SIZE:
                    yield pa.array(out, shape)
                    out, held = [], 0
            if out:
                yield pa.array(out, shape)

    return run.asNondeterministic()
