"""Vector tables: rows replaced by id, deleted by metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``new`` take the place of those of ``old`` with the same id."""
    return old.join(new.select(id_col).distinct(), id_col, "left_anti").select(*new.columns).unionByName(new)


def matches(where: dict):
    """All entries equal, null matching only null."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in where.items()], F.lit(True))


def delete_where(rows: DataFrame, where: dict) -> DataFrame:
    """Rows that do not meet all entries of ``where``; an empty condition is refused, as it would delete everything."""
    if not where:
        raise ValueError("a condition is needed")
    return rows.where(~matches(where))
