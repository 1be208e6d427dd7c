"""Item and robot geometry projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockyard import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def block_count(item) -> Column:
    """Blocks needed per item type; invalid item -> null."""
    i = _c(item)
    expr = None
    for name, n in K.BLOCK_COUNT.items():
        expr = F.when(i == name, F.lit(n)) if expr is None else expr.when(i == name, F.lit(n))
    return expr


def assembly_plan(item) -> Column:
    """Item type -> ordered ``array<struct<x,y,z>>`` of assembly positions."""
    i = _c(item)
    expr = None
    for name, plan in K.ASSEMBLY_PLAN.items():
        arr = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"))
                        for x, y, z in plan])
        expr = F.when(i == name, arr) if expr is None else expr.when(i == name, arr)
    return expr


def stock_to_robot_offset(x, y) -> Column:
    """Stock cell -> robot offset ``struct(dx, dy, z)`` from the grid origin."""
    return F.struct((_c(x) * K.INVENTORY_X_STEP).alias("dx"),
                    (_c(y) * K.INVENTORY_Y_STEP).alias("dy"),
                    F.lit(K.INVENTORY_Z_PICKUP).alias("z"))


def assembly_offset(x, z) -> Column:
    """Assembly position -> relative move ``struct(dx, dz)``."""
    return F.struct((_c(x) * K.ASSEMBLY_CUBE_SIZE).alias("dx"),
                    (-K.ASSEMBLY_Z_INITIAL + _c(z) * K.ASSEMBLY_CUBE_SIZE).alias("dz"))
