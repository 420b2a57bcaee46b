"""Periods: FY, HY and QUARTER from text, relative words and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relative words and their offset.
YEAR_WORDS = {"今年": 0, "本年": 0, "this year": 0, "去年": -1, "上年": -1, "last year": -1, "前年": -2, "year before last": -2}
HALF_WORDS = {"上半年": "H1", "下半年": "H2"}
QUARTER_WORDS = {"本季度": 0, "这个季度": 0, "这季度": 0, "this quarter": 0, "上季度": -1, "上个季度": -1, "last quarter": -1}


def normalize(raw: Column) -> Column:
    """struct(period_type, period) of 2024, FY2024, 2024H1, 2024 Q3; null where it is none of these."""
    s = F.replace(F.upper(F.regexp_replace(raw, r"(?U)\s+", "")), F.lit("FY"), F.lit(""))
    kind = F.when(s.rlike(r"^[0-9]{4}H[12]$"), "HY").when(s.rlike(r"^[0-9]{4}Q[1-4]$"), "QUARTER").when(s.rlike(r"^[0-9]{4}$"), "FY")
    return F.when(kind.isNotNull(), F.struct(kind.alias("period_type"), s.alias("period")))


def relative_year(word: Column, reference: Column) -> Column:
    """The year a word means at a reference date; null for other words."""
    out = F.lit(None).cast("string")
    for w, k in YEAR_WORDS.items():
        out = F.when(word == w, (F.year(reference) + k).cast("string")).otherwise(out)
    return out


def relative_quarter(word: Column, reference: Column) -> Column:
    """The quarter a word means at a reference date, over year ends."""
    out = F.lit(None).cast("string")
    for w, k in QUARTER_WORDS.items():
        t = F.year(reference) * 4 + F.quarter(reference) - 1 + k
        out = F.when(word == w, F.concat(F.floor(t / 4).cast("string"), F.lit("Q"), (F.pmod(t, F.lit(4)) + 1).cast("string"))).otherwise(out)
    return out


def relative_half(word: Column, reference: Column) -> Column:
    """The half year a word means, alone or after a word for a year; null for other words."""
    out = F.lit(None).cast("string")
    for half, code in HALF_WORDS.items():
        head = F.trim(F.regexp_replace(word, half + "$", ""))
        year = F.when(head == "", F.year(reference).cast("string")).otherwise(relative_year(head, reference))
        out = F.when(word.endswith(half), F.concat(year, F.lit(code))).otherwise(out)
    return out


def relative(word: Column, reference: Column) -> Column:
    """struct(period_type, period) of a relative word: half years first, then years, then quarters; null for other words."""
    w = F.lower(F.trim(word))
    half, year, quarter = relative_half(w, reference), relative_year(w, reference), relative_quarter(w, reference)
    any_half = F.lit(False)
    for h in HALF_WORDS:
        any_half = any_half | w.endswith(h)
    year, quarter = F.when(~any_half, year), F.when(~any_half, quarter)
    kind = F.when(half.isNotNull(), "HY").when(year.isNotNull(), "FY").when(quarter.isNotNull(), "QUARTER")
    return F.when(kind.isNotNull(), F.struct(kind.alias("period_type"), F.coalesce(half, year, quarter).alias("period")))


def from_filename(name: Column) -> Column:
    """The one period a file name holds; '' where it holds none or several."""
    found = F.array_distinct(F.regexp_extract_all(F.upper(name), F.lit(r"(?:FY)?((?:19|20)[0-9]{2}(?:[HQ][1-4])?)"), F.lit(1)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise("")


def label(period_type: Column, period: Column) -> Column:
    return F.when(period_type == "FY", F.concat(F.lit("FY"), period)).otherwise(period)
