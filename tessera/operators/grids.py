"""Cells of sheets and pages as tables: facts from grids, colours with their tags, kinds of pages.

Cells come as rows (sheet, row, col, text, rgb); the parsers of binary formats that make them are
outside the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import periods
from tessera.functions.text import clean, number

# Characters of text and share of images from which a page counts as text or as scanned.
TEXT_CHARS, IMAGE_COVER = 50, 0.55


def a1(cell: Column) -> Column:
    """struct(row, col) of a cell reference such as AB12 or R12C28."""
    rc = F.upper(F.trim(cell))
    letters = F.regexp_extract(rc, r"^([A-Z]+)([0-9]+)$", 1)
    col = F.aggregate(F.split(letters, ""), F.lit(0), lambda acc, x: F.when(x == "", acc).otherwise(acc * 26 + F.ascii(x) - 64))
    other = rc.rlike(r"^R[0-9]+C[0-9]+$")
    row = F.when(other, F.regexp_extract(rc, r"^R([0-9]+)C", 1)).otherwise(F.regexp_extract(rc, r"^[A-Z]+([0-9]+)$", 1)).try_cast("int")
    return F.struct(row.alias("row"), F.when(other, F.regexp_extract(rc, r"C([0-9]+)$", 1).try_cast("int")).otherwise(col).alias("col"))


def read_cells(cells: DataFrame, metrics: DataFrame) -> DataFrame:
    """Cells with what they can be: a period, a metric code (by ``metrics`` of (word, metric_code)), a number."""
    words = metrics.select(clean(F.col("word")).alias("key"), "metric_code").dropDuplicates(["key"])
    p = periods.normalize(F.col("text"))
    out = cells.withColumn("key", clean(F.regexp_replace("text", r"[(（].*?[)）]", ""))).withColumn("p", p)
    out = out.withColumn("figure", F.when(F.col("p").isNull(), number(F.col("text"))))
    return out.join(words, "key", "left").select("sheet", "row", "col", "text", F.col("p.period_type").alias("period_type"), F.col("p.period").alias("period"), "metric_code", "figure")


def facts(cells: DataFrame, metrics: DataFrame) -> DataFrame:
    """(sheet, row, col, metric_code, period_type, period, value) of every number with a metric in its row and a period in its column, or the other way round.

    Of several labels the one nearest to the left and of several headers the nearest above
    counts. Numbers without either are left out.
    """
    c = read_cells(cells, metrics)
    nums = c.where("figure is not null").select("sheet", "row", "col", F.col("figure").alias("value"))
    out = None
    for what, how in ((("metric_code",), ("period_type", "period")), (("period_type", "period"), ("metric_code",))):
        side = c.where(F.col(what[-1]).isNotNull()).select("sheet", "row", F.col("col").alias("c2"), F.struct(*what).alias("side"))
        head = c.where(F.col(how[-1]).isNotNull()).select("sheet", F.col("row").alias("r2"), "col", F.struct(*how).alias("head"))
        left = nums.join(side, ["sheet", "row"]).where("c2 < col").groupBy("sheet", "row", "col", "value").agg(F.max_by("side", "c2").alias("side"))
        both = left.join(head, ["sheet", "col"]).where("r2 < row").groupBy("sheet", "row", "col", "value", "side").agg(F.max_by("head", "r2").alias("head"))
        part = both.select("sheet", "row", "col", "side.*", "head.*", "value").select("sheet", "row", "col", "metric_code", "period_type", "period", "value")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def candidates(cells: DataFrame, metrics: DataFrame) -> DataFrame:
    """(sheet, has_data): does a sheet hold a period, a metric and a number at all?"""
    c = read_cells(cells, metrics)
    return c.groupBy("sheet").agg((F.max(F.col("period").isNotNull()) & F.max(F.col("metric_code").isNotNull()) & F.max(F.col("figure").isNotNull())).alias("has_data"))


def clusters(cells: DataFrame) -> DataFrame:
    """(sheet, rgb, n, place): how often each reliable colour occurs, most frequent first, ties by rgb."""
    from pyspark.sql import Window

    n = cells.where("rgb is not null and not coalesce(conditional, false)").groupBy("sheet", "rgb").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("sheet").orderBy(F.desc("n"), "rgb")))


def legend(cells: DataFrame) -> DataFrame:
    """(sheet, rgb, meaning, tag): coloured empty cells with the text of the cell to their right; the tag is what stands right of '='."""
    colour = cells.where("rgb is not null and trim(coalesce(text, '')) = ''").select("sheet", "row", (F.col("col") + 1).alias("col"), "rgb")
    words = cells.where("trim(coalesce(text, '')) <> ''").select("sheet", "row", "col", F.trim("text").alias("meaning"))
    tag = F.when(F.contains(F.col("meaning"), F.lit("=")), F.trim(F.split_part("meaning", F.lit("="), F.lit(2))))
    return colour.join(words, ["sheet", "row", "col"]).select("sheet", "rgb", "meaning", tag.alias("tag")).distinct()


def active_mapping(events: DataFrame) -> DataFrame:
    """(scope, version, mapping): the newest confirmed mapping of each scope from events (scope, version, action, mapping); a later confirmation takes over."""
    ok = events.where("action = 'confirm'").select("scope", "version")
    gone = events.where("action = 'reject'").select("scope", "version")
    drafts = events.where("action = 'register'").select("scope", "version", "mapping")
    return drafts.join(ok, ["scope", "version"], "left_semi").join(gone, ["scope", "version"], "left_anti").groupBy("scope").agg(F.max("version").alias("version"), F.max_by("mapping", "version").alias("mapping"))


def tagged(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cells with the tag of their colour; without an active mapping of their scope there is no tag and a warning."""
    joined = cells.join(mapping, "scope", "left")
    return joined.withColumn("tag", F.try_element_at("mapping", F.col("rgb"))).withColumn("warning", F.col("version").isNull() & F.col("rgb").isNotNull()).drop("mapping", "version")


def page_kind(chars: Column, cover: Column) -> Column:
    """digital, ocr_scan, img_scan or low_text from the characters of a page and the share its images cover."""
    image = F.least(cover, F.lit(1.0)) >= IMAGE_COVER
    return F.when(chars >= TEXT_CHARS, F.when(image, "ocr_scan").otherwise("digital")).otherwise(F.when(image, "img_scan").otherwise("low_text"))


def file_verdict(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_pages, verdict) from pages with ``kind``: nine tenths digital, nine tenths scanned (the larger kind, ties to scanned), else mixed."""
    n = lambda *k: F.sum(F.col("kind").isin(*k).cast("int"))
    total, digital, img, ocr = F.count("*"), n("digital"), n("img_scan"), n("ocr_scan")
    verdict = F.when(digital >= 0.9 * total, "digital").when(img + ocr >= 0.9 * total, F.when(img >= ocr, "scanned").otherwise("ocr_scan")).otherwise("mixed")
    return pages.groupBy(key).agg(total.alias("n_pages"), verdict.alias("verdict"))
