"""Nested stock grid -> one row per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stock_grid_source(grid: DataFrame, row_col: str = "row", x_col: str | None = "x") -> DataFrame:
    """Grid rows (``x``, ``array<struct<color, reserved, order_id>>`` by y;
    a null element = empty cell) -> ``x, y, filled, color, reserved,
    order_id``. With ``x_col=None`` the row position gives x
    (``posexplode_outer`` twice over an ``array<array<...>>``)."""
    if x_col is None:
        g = grid.select(F.posexplode_outer(row_col).alias("x", "_row"))
        row_col, x_col = "_row", "x"
    else:
        g = grid
    c = g.select(F.col(x_col).cast("long").alias("x"), F.posexplode_outer(row_col).alias("y", "cell"))
    return c.select("x", F.col("y").cast("long").alias("y"), F.col("cell").isNotNull().alias("filled"),
                    F.col("cell.color").alias("color"), F.col("cell.reserved").alias("reserved"),
                    F.col("cell.order_id").alias("order_id"))
