"""Splitting oversized texts at natural boundaries by structure-tree packing (problem 7).

A text is parsed into a tree: sections nested by the level of their headings, lists nested by
indentation, tables, lines, sentence units, words, characters. From the leaves upwards sibling
subtrees are merged as long as they stay within the limit; only a node above the limit is
descended into, so every text is cut at the coarsest boundary that suffices and no piece crosses
the border of a subtree that was cut. A heading goes with what follows it. Consecutive pieces
overlap by whole units of the level they were cut at, up to the allowance.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.sentences import Evidence, evidence_of, split_units, with_evidence

LIMIT = 480
OVERLAP = 80
LEVELS = ["para", "sentence", "word", "char"]
_LIST = regex.compile(r"(\s*)(?:[-*•·–]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+\S")
_RULED = regex.compile(r"\s*(?:(#{1,6})\s+\S|<h([1-6])\b)", regex.I)
_NUMBERED = regex.compile(r"\s*(\d+(?:\.\d+)*)\.?\s+\p{Lu}[^\n]{0,80}$")
_PART = regex.compile(r"\s*(?:(?:chapter|part|kapitel|teil|chapitre|partie|capítulo|parte|глава)\s+\w+|第\s*[\d一二三四五六七八九十百]+\s*[章部编篇])", regex.I)
_ARTICLE = regex.compile(r"\s*(?:(?:section|article|abschnitt|artikel|sección|artículo|раздел)\s+\w+|第\s*[\d一二三四五六七八九十百]+\s*[节條条款])", regex.I)
_STOP = regex.compile(r"[.!?…。！？।:;,，；：、)”»」]\s*$")
#: Level of a heading that only its shape tells: below all that are marked or numbered.
UNMARKED = 9

Span = tuple[int, int]
Part = tuple[int, int, int]


def heading_level(line: str, before: str, after: str) -> int:
    """Level of a heading from 1, or 0: by markup, by number or word, or a short line without a stop that stands alone before text."""
    if m := _RULED.match(line):
        return len(m.group(1)) if m.group(1) else int(m.group(2))
    s = line.strip()
    if not s or _STOP.search(s):
        return 0
    if len(s) <= 80 and _PART.match(s):
        return 1
    if len(s) <= 80 and _ARTICLE.match(s):
        return 2
    if m := _NUMBERED.match(s):
        return 1 + m.group(1).count(".")
    if _LIST.match(line) or len(s) > 60 or before.strip() or not s[0].isalnum() or s[0].islower():
        return 0
    return UNMARKED if len(after.strip()) > len(s) else 0


class Node:
    """A subtree: a section (rank: level), a list or item (rank: indentation), a table, or a line without kids."""

    __slots__ = ("kind", "rank", "kids", "start", "end")

    def __init__(self, kind: str, rank: int, start: int = 0, end: int = 0):
        self.kind, self.rank, self.kids, self.start, self.end = kind, rank, [], start, end


def tree(text: str) -> list[Node]:
    """The nodes of the structure tree, parents before their kids, the root first."""
    root = Node("section", 0)
    nodes, path = [root], [root]
    lines = text.split("\n")
    follow = [""] * len(lines)  # the next line with ink
    ahead = ""
    for i in range(len(lines) - 1, -1, -1):
        follow[i] = ahead
        if lines[i].strip():
            ahead = lines[i]

    def put(node: Node, stay: bool) -> None:
        path[-1].kids.append(node)
        nodes.append(node)
        if stay:
            path.append(node)

    at = 0
    for i, line in enumerate(lines):
        a, b = at, at + len(line)
        at = b + 1
        if not line.strip():
            continue
        level = heading_level(line, lines[i - 1] if i else "", follow[i])
        item = _LIST.match(line)
        indent = len(line) - len(line.lstrip())
        if level:
            while path[-1].kind != "section" or path[-1].rank >= level:
                path.pop()
            put(Node("section", level), True)
            put(Node("head", 0, a, b), False)
        elif item:
            while path[-1].kind == "table" or path[-1].kind in ("list", "item") and path[-1].rank > indent or path[-1].kind == "item" and path[-1].rank == indent:
                path.pop()
            if path[-1].kind != "list" or path[-1].rank < indent:
                put(Node("list", indent), True)
            put(Node("item", indent), True)
            put(Node("line", 0, a, b), False)
        elif line.lstrip().startswith("|"):
            if path[-1].kind != "table":
                put(Node("table", 0), True)
            put(Node("line", 0, a, b), False)
        else:
            while path[-1].kind in ("list", "table") or path[-1].kind == "item" and path[-1].rank >= indent:
                path.pop()
            put(Node("line", 0, a, b), False)
    for node in reversed(nodes):
        if node.kids:
            node.start, node.end = node.kids[0].start, node.kids[-1].end
    return nodes


def _merge(parts: list[tuple[int, int, int]], limit: int) -> list[tuple[int, int, int]]:
    """Neighbouring parts joined from the left while the whole stays within the limit; a part is (start, end, level)."""
    out: list[tuple[int, int, int]] = []
    for a, b, v in parts:
        if out and b - out[-1][0] <= limit:
            out[-1] = (out[-1][0], b, max(out[-1][2], v))
        else:
            out.append((a, b, v))
    return out


def _chars(text: str, a: int, b: int, limit: int) -> list[tuple[int, int, int]]:
    out = []
    while b - a > limit:
        cut = a + limit
        while cut > a + limit // 2 and unicodedata.combining(text[cut]):
            cut -= 1
        out.append((a, cut, 3))
        a = cut
    return [*out, (a, b, 3)]


def _words(text: str, a: int, b: int, limit: int) -> list[tuple[int, int, int]]:
    parts = []
    for m in regex.finditer(r"\S+", text, pos=a, endpos=b):
        x, y = m.span()
        parts += _chars(text, x, y, limit) if y - x > limit else [(x, y, 2)]
    return _merge(parts, limit)


def _line(text: str, a: int, b: int, limit: int, units: list[Span]) -> list[Part]:
    """A line above the limit by its sentence units, those above it by words, those by characters."""
    parts = []
    for x, y in units[bisect_left(units, (a, 0)) : bisect_left(units, (b, 0))]:
        if y <= b:
            parts += _words(text, x, y, limit) if y - x > limit else [(x, y, 1)]
    return _merge(parts, limit)


def _pack_tree(text: str, nodes: list[Node], limit: int, units: list[Span]) -> list[Part]:
    """Pieces of the root, bottom-up; kids come after their parents in ``nodes``, so no recursion is needed."""
    parts: dict[int, list[Part]] = {}
    for node in reversed(nodes):
        if node.end - node.start <= limit:
            continue
        if not node.kids:
            parts[id(node)] = _line(text, node.start, node.end, limit, units)
            continue
        out: list[Part] = []
        room = False  # may the last part still take siblings?
        head = False  # is it a heading alone?
        for kid in node.kids:
            own = parts.pop(id(kid), None)
            if own is None:
                if room and kid.end - out[-1][0] <= limit:
                    out[-1] = (out[-1][0], kid.end, out[-1][2])
                else:
                    out.append((kid.start, kid.end, 0))
                head = kid.kind == "head" and out[-1][0] == kid.start
                room = True
                continue
            if head and own[0][1] - out[-1][0] <= limit:
                own[0] = (out.pop()[0], own[0][1], own[0][2])
            out += own
            room = head = False
        parts[id(node)] = out
    return parts.get(id(nodes[0]), [(nodes[0].start, nodes[0].end, 0)])


def pack(text: str, limit: int = LIMIT, overlap: int = OVERLAP, evidence: Evidence | None = None) -> list[tuple[int, int, int]]:
    """(start, end, level) of the pieces of a text, from 0, end exclusive; level indexes LEVELS.

    A text within the limit is one piece; null and blank texts have none. No piece is longer
    than the limit, overlaps are at most ``overlap`` and every visible character is in a piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if not text or not text.strip():
        return []
    if len(text) <= limit:
        return [(0, len(text), 0)]
    units = split_units(text, evidence) if max(map(len, text.split("\n"))) > limit else []
    cut = _pack_tree(text, tree(text), limit, units)
    out = cut[:1]
    for a, b, v in cut[1:]:
        room = min(overlap, limit - (b - a))
        low = max(out[-1][0] + 1, a - room)
        best = a
        if low < a:
            for m in regex.finditer(r"(?<=[.!?。！？।\n][”»)）」]?)\s*\S|(?<=\s)\S", text, pos=low, endpos=a):
                if m.end() - 1 >= low:
                    best = m.end() - 1
                    break
        out.append((best, b, v))
    return out


def split_oversized(
    df: DataFrame, id_col: str, text_col: str = "text", doc_col: str | None = None, para_col: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP
) -> DataFrame:
    """(id, piece_no, start_pos, end_pos, para_from, para_to, level, piece, cut) of the texts above the limit, positions from 1 and inclusive.

    Texts within the limit give no piece but their words count as evidence for sentence ends.
    para_from and para_to count the non-blank lines of the text from ``para_col`` (1 where that
    is null or missing). Rows with a null id or without text give no piece; repeated rows count once.
    """
    para = F.coalesce(F.col(para_col).cast("long"), F.lit(1)) if para_col else F.lit(1).cast("long")
    doc = F.col(doc_col).cast("string") if doc_col else F.col(id_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), doc.alias("doc"), F.col(text_col).cast("string").alias("text"), para.alias("para")).where("id is not null and text is not null")
    ready = with_evidence(rows.select("doc", "text"), rows.where(F.char_length("text") > limit).distinct())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t, p, facts in zip(pdf.id, pdf.text, pdf.para, pdf.facts):
                lines, at = [], 0
                for line in t.split("\n"):
                    if line.strip():
                        lines.append((at, at + len(line)))
                    at += len(line) + 1
                ends = [y for _, y in lines]
                for k, (a, b, v) in enumerate(pack(t, limit, overlap, evidence_of(facts))):
                    hi = max(0, bisect_left(lines, (b, 0)) - 1)
                    lo = min(hi, max(0, bisect_right(ends, a)))
                    out.append((i, k, a + 1, b, p + lo, p + hi, v, t[a:b]))
            yield pd.DataFrame(out, columns=["id", "piece_no", "start_pos", "end_pos", "para_from", "para_to", "level", "piece"])

    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, piece_no int, start_pos long, end_pos long, para_from long, para_to long, level int, piece string"
    out = ready.select("id", "text", "para", "facts").mapInPandas(run, schema)
    return out.withColumn("cut", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level") + 1))
