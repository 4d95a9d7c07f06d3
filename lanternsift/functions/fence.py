"""A fence against inlining.

An array that a lambda refers to must be a column by itself. When a filter, one on a generator's array included, sinks
below that column's step, the optimizer puts the column's expression into the lambda, and it is computed per element.
A filter can't pass a step with a column that isn't deterministic, so such a column is made there and referred to
above, without anything depending on its value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns and _fence, which is always true. Streams don't take such a column and have a plain one."""
    mark = F.lit(True) if df.isStreaming else F.monotonically_increasing_id() >= 0
    return df.withColumns({**columns, "_fence": mark})


def behind(value: Column) -> Column:
    """A value that refers to the fence."""
    return F.when(F.col("_fence"), value)
