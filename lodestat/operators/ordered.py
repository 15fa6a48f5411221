"""Neighbours in an order, without one task for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous_row(df: DataFrame, *, by: str, order: list[str], carry: list[str], slice_of: Column) -> DataFrame:
    """``df`` with ``prev``, the struct of ``carry`` of the row before it within ``by``.

    ``order`` must be total and begin with the column that ``slice_of`` (a monotone function of it, a
    month say) is made from.  Rows are ordered within (``by``, slice); the last row of each slice
    is handed to the first of the next one.  So a key that holds a third of all rows is sorted in
    as many tasks as it has slices, and only one row for each slice meets in one task.

    A null in ``order`` sorts first, as its own slice.  A null ``by`` is a key of its own.  The first row
    of each key has a null ``prev``.
    """
    sliced = df.withColumn("__slice", slice_of)
    inner = Window.partitionBy(by, "__slice").orderBy(*order)
    packed = F.struct(*carry)
    rows = sliced.withColumn("__prev", F.lag(packed).over(inner)).withColumn("__first", F.row_number().over(inner) == 1)
    lasts = (
        sliced.groupBy(by, "__slice")
        .agg(F.max_by(packed, F.struct(*order)).alias("__last"))
        .withColumn("__before", F.lag("__last").over(Window.partitionBy(by).orderBy("__slice")))
        .select(F.col(by).alias("__by"), F.col("__slice").alias("__s"), "__before")
    )
    joined = rows.join(lasts, F.col(by).eqNullSafe(F.col("__by")) & F.col("__slice").eqNullSafe(F.col("__s")), "left")
    prev = F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__prev"))
    return joined.select(*df.columns, prev.alias("prev"))
