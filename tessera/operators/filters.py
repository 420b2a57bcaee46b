"""Metadata filters: conditions on fields, all compared as strings, that only narrow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("eq", "ne", "in", "nin", "gt", "gte", "lt", "lte", "between")


def condition(df: DataFrame, field: str, op: str, value) -> Column:
    """One condition; a missing field never matches, a null value counts as ''."""
    if op not in OPS:
        raise ValueError(f"unknown operator {op}")
    if op in ("in", "nin") and not isinstance(value, (list, tuple)) or op == "between" and (not isinstance(value, (list, tuple)) or len(value) != 2):
        raise ValueError(f"{op} needs a list")
    if field not in df.columns:
        return F.lit(False)
    c = F.coalesce(F.col(field).cast("string"), F.lit(""))
    v = [str(x) for x in value] if isinstance(value, (list, tuple)) else str(value)
    return {
        "eq": lambda: c == v,
        "ne": lambda: c != v,
        "in": lambda: c.isin(v),
        "nin": lambda: ~c.isin(v),
        "gt": lambda: c > v,
        "gte": lambda: c >= v,
        "lt": lambda: c < v,
        "lte": lambda: c <= v,
        "between": lambda: (c >= v[0]) & (c <= v[1]),
    }[op]()


def apply(df: DataFrame, conditions: list[tuple], combine: str = "and") -> DataFrame:
    """Rows that meet all (and) or any (or) conditions; no conditions keep all rows."""
    if combine not in ("and", "or"):
        raise ValueError("combine is 'and' or 'or'")
    if not conditions:
        return df
    cols = [condition(df, *c) for c in conditions]
    return df.where(reduce(lambda a, b: a & b if combine == "and" else a | b, cols))


def visible(c: Column) -> Column:
    """Facts that may be shown: approved ones and those approved by rule, which tables spell ``auto_approved`` or ``auto``."""
    return c.isin("auto_approved", "auto", "approved")


def not_restricted(c: Column) -> Column:
    """What may leave an exit."""
    return F.upper(F.coalesce(c, F.lit(""))) != "RESTRICTED"
