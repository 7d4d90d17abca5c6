"""A pipeline of named steps, each a function from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pii import deidentify

Step = Callable[[DataFrame], DataFrame]


class Pipeline:
    """Steps in order; ``fit_transform`` and ``transform`` are the same, as no step keeps state."""

    def __init__(self, steps: Sequence[tuple[str, Step]]):
        names = [n for n, _ in steps]
        if len(set(names)) != len(names):
            raise ValueError(f"names repeat: {names}")
        self.steps = list(steps)

    def transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = df.transform(step)
        return df

    fit_transform = transform


class Deidentifier(Transformer, HasInputCol, HasOutputCol):
    """The masks as a stage of a Spark ML pipeline."""

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "text", options: dict | None = None):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.options = options or {}

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), deidentify(F.col(self.getInputCol()), **self.options))


def over_text_columns(df: DataFrame, fn: Callable[[Column], Column], columns: Sequence[str] | None = None) -> DataFrame:
    """A column function over several text columns, all of them if none is named."""
    names = list(columns) if columns is not None else [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.withColumns({c: fn(F.col(c)) for c in names})
