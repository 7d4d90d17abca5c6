"""Python on Arrow batches in small steps, so that a worker holds one batch of input and few results whatever the table's size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that are Python objects at once.
STEP = 64
_KINDS = {"string": pa.string(), "array<string>": pa.list_(pa.string())}


def each(fn: Callable[[str], object], kind: str) -> Callable[[Column], Column]:
    """``fn`` of every text that is not null, as a Column function."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for at in range(0, len(texts), STEP):
                yield pa.array([None if t is None else fn(t) for t in texts.slice(at, STEP).to_pylist()], _KINDS[kind])

    return run
