"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[\\x{4E00}-\\x{9FFF}]"


def clean(c: Column) -> Column:
    """Trimmed, lower case, white space folded to single blanks."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def clean_block(c: Column) -> Column:
    """Lines trimmed and folded, empty lines dropped, vertical tabs as line ends."""
    lines = F.split(F.replace(c, F.lit("\v"), F.lit("\n")), "\n")
    folded = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))
    return F.array_join(F.filter(folded, lambda x: x != ""), "\n")


def tokens(c: Column) -> Column:
    """Search tokens: runs of a-z and 0-9, and of each run of ideographs its characters and then its pairs."""
    low = F.lower(F.coalesce(c, F.lit("")))
    latin = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(CJK + "+"), F.lit(0))
    single = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(CJK), F.lit(0))))
    pairs = F.flatten(
        F.transform(runs, lambda r: F.when(F.char_length(r) > 1, F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))
    )
    return F.concat(latin, single, pairs)


def token_set(c: Column) -> Column:
    """Evaluation tokens: words of letters and digits, or one ideograph, lower case, distinct."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+|" + CJK), F.lit(0)))


def number(c: Column) -> Column:
    """The number of a cell without , $ and %; null where it is none."""
    return F.regexp_replace(c, r"[,$%\s]", "").try_cast("double")


def sensitivity(name: Column, text: Column, patterns: list[str], keywords: list[str], default: str = "INTERNAL", hit: str = "RESTRICTED") -> Column:
    """Label by file name pattern first, then by keyword in the text, else the default; case does not matter."""
    low_name, low_text = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for p in patterns:
        found = found | low_name.contains(p.lower())
    for k in keywords:
        found = found | low_text.contains(k.lower())
    return F.when(found, hit).otherwise(default)


def context_header(title: Column, entity: Column, period: Column, heading: Column) -> Column:
    """[文档:… · 实体:… · 期间:… · 章节:…] of the parts that are not empty; '' without any."""
    parts = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{n}:"), c)) for n, c in (("文档", title), ("实体", entity), ("期间", period), ("章节", heading))]
    joined = F.concat_ws(" · ", *parts)
    return F.when(joined != "", F.concat(F.lit("["), joined, F.lit("]"))).otherwise("")


def excerpt(c: Column, limit: int = 240) -> Column:
    """The first sentence, cut at ``limit`` characters."""
    return F.left(F.regexp_extract(F.trim(c), r"^[^.!?。！？\n]*[.!?。！？]?", 0), F.lit(limit))


# Beginnings of lines that frame an answer and state nothing.
FRAMING = ["基于检索到的资料", "未检索到", "归因部分未检索到", "对比结果", "归因分析", "资料来源", "问题：", "问题:", "检索片段"]


def claims(answer: Column) -> Column:
    """Checkable claims of an answer: framing lines dropped, citations removed, [n] marks made blanks, cut at sentence ends but not at full stops, those without tokens dropped."""
    lines = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), "[\n\r]+"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^(" + "|".join(FRAMING) + ")"))
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, "（(?:资料)?来源[：:][^）]*）", ""), r"\[[0-9]+\]", " "))
    parts = F.flatten(F.transform(bare, lambda x: F.split(x, "[。！？!?；;]+")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.rlike("[A-Za-z0-9]|" + CJK))


def stray_numbers(answer: Column) -> Column:
    """Numbers of an answer that are no part of a period."""
    bare = F.regexp_replace(answer, r"(?:FY)?(?:19|20)[0-9]{2}(?:[HQ][1-4])?", " ")
    return F.regexp_extract_all(bare, F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))


def listwise_order(response: Column, n: Column) -> Column:
    """A full order of 0..n-1 from a judge's text: valid numbers first in its order, the missing ones ascending."""
    said = F.filter(F.transform(F.regexp_extract_all(response, F.lit(r"[0-9]+"), F.lit(0)), lambda x: x.try_cast("int")), lambda x: x.isNotNull() & (x >= 0) & (x < n))
    return F.array_union(F.array_distinct(said), F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))


def slices(c: Column, size: int) -> Column:
    """Slices of fixed width."""
    return F.when(F.char_length(c) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.char_length(c) - 1) / size).cast("int")), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(
        F.array().cast("array<string>")
    )


def json_strings(c: Column) -> Column:
    """The strings of a JSON list; an empty list where it is none."""
    return F.coalesce(F.filter(F.from_json(c, "array<string>"), lambda x: x.isNotNull()), F.array().cast("array<string>"))
