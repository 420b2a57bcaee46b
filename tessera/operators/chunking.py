"""Chunking: sections, sentences with windows, greedy packing with overlap, versions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import width

SENTENCE = r"[^.!?。！？;；\n]+[.!?。！？;；]*"


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, para, text): lines that are not blank, counted from 1."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select(F.col(id_col).alias("id"), F.posexplode(lines).alias("p", "text")).select("id", (F.col("p") + 1).alias("para"), "text")


def sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, para, seq, text): simple sentences of every paragraph; pieces of punctuation only are dropped."""
    s = paragraphs(docs, id_col, text_col).select("id", "para", F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).alias("s", "text"))
    s = s.select("id", "para", "s", F.trim("text").alias("text")).where(F.col("text").rlike(r"[^\p{Punct}\s。！？；，、]"))
    return s.withColumn("seq", F.row_number().over(Window.partitionBy("id").orderBy("para", "s")) - 1).select("id", "para", "seq", "text")


def sentence_window(docs: DataFrame, id_col: str, text_col: str, size: int = 3) -> DataFrame:
    """Each sentence with the sentences up to ``size`` before and after it, joined by a blank, or a line end where the paragraph changes."""
    s = sentences(docs, id_col, text_col)
    w = Window.partitionBy("id").orderBy("seq").rowsBetween(-size, size)
    around = s.withColumn("around", F.collect_list(F.struct("para", "text")).over(w))
    joined = F.aggregate(
        F.slice("around", F.lit(2), F.greatest(F.size("around") - 1, F.lit(0))),
        F.struct(F.col("around")[0]["para"].alias("p"), F.col("around")[0]["text"].alias("t")),
        lambda acc, x: F.struct(x["para"].alias("p"), F.concat(acc["t"], F.when(x["para"] == acc["p"], " ").otherwise("\n"), x["text"]).alias("t")),
        lambda acc: acc["t"],
    )
    return around.select("id", "seq", "para", "text", joined.alias("window_text"))


# Forms of headings.
MARKED = r"^#{1,6}\s+\S"
CHAPTER = r"^第[0-9一二三四五六七八九十百千]+[章节篇部回讲]"
CLAUSE = r"^第[0-9一二三四五六七八九十百千]+[条款项]"
NUMBERED = r"^([0-9]+(\.[0-9]+)*|[一二三四五六七八九十百千]+|[IVXLCDMivxlcdm]+)[.、)）]\s*\S"
ASKED = r"^([Qq][:.、)）]|问[：:、])"
SHORT, STOPS = 30, "[。！？；…，、：.!?;,:]"


def heading(c, preset: str = "layout"):
    """Is a trimmed line a heading: marked, a chapter, numbered, or (layout only) short without punctuation; laws add clauses, qa takes questions."""
    by_form = c.rlike(MARKED) | c.rlike(CHAPTER) | c.rlike(NUMBERED)
    if preset == "layout":
        return (c != "") & (by_form | ((F.char_length(c) <= SHORT) & ~c.rlike(STOPS)))
    if preset == "laws":
        return by_form | c.rlike(CLAUSE)
    if preset == "book":
        return by_form
    if preset == "qa":
        return c.rlike(ASKED) | c.rlike("[?？]$")
    raise ValueError("preset is layout, laws, book or qa")


def sections(docs: DataFrame, id_col: str, text_col: str, preset: str = "layout") -> DataFrame:
    """(id, para, section, is_heading, text): a heading starts a section, what stands before the first is section 0."""
    p = paragraphs(docs, id_col, text_col).withColumn("is_heading", heading(F.col("text"), preset))
    w = Window.partitionBy("id").orderBy("para").rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w)).select("id", "para", "section", "is_heading", "text")


def parent_child(docs: DataFrame, id_col: str, text_col: str, preset: str = "layout") -> DataFrame:
    """(id, para, section, text, window_text, parent_locator): every paragraph with the text and the real span of its section.

    A section of any length is put together in one row, as it is what a reader is shown.
    """
    s = sections(docs, id_col, text_col, preset)
    parts = F.array_sort(F.collect_list(F.struct("para", "text")))
    whole = s.groupBy("id", "section").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("window_text"), F.concat(F.lit("#para"), F.min("para"), F.lit("-"), F.max("para")).alias("parent_locator"))
    return s.join(whole, ["id", "section"]).select("id", "para", "section", "text", "window_text", "parent_locator")


def greedy(docs: DataFrame, id_col: str, text_col: str, limit: int = 480) -> DataFrame:
    """(id, seq, text): whole paragraphs packed to the limit without overlap, as a native fold over the paragraphs."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def add(acc, x):
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.char_length(last) + 1 + F.char_length(x) <= limit)
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit("\n"), x)))).otherwise(F.concat(acc, F.array(x)))

    packed = F.aggregate(lines, F.array().cast("array<string>"), add)
    return docs.select(F.col(id_col).alias("id"), F.posexplode(packed).alias("seq", "text"))


def _split_long(p: str, limit: int) -> list[str]:
    import re

    parts = [x for s in re.findall(r"[^.!?。！？;；\n]+[.!?。！？;；]*\s*|[.!?。！？;；]+\s*", p) for x in ([s[i : i + limit] for i in range(0, len(s), limit)] if len(s) > limit else [s])]
    out: list[str] = []
    for s in parts:
        if out and len(out[-1]) + len(s) <= limit:
            out[-1] += s
        else:
            out.append(s)
    return out


def pack_overlap(text: str, limit: int = 480, overlap: int = 80) -> list[tuple[str, int, int]]:
    """(text, first paragraph, last paragraph) of the chunks of one document, trailing paragraphs carried over up to ``overlap`` characters.

    The carry never crosses a paragraph above the limit; if carry and next paragraph do not fit
    together the carry is dropped from its front.
    """
    if limit <= 0 or overlap < 0 or overlap >= limit:
        raise ValueError("limit must be positive and overlap below it")
    paras = [(i, s) for i, s in enumerate((x.strip() for x in (text or "").split("\n")), 1) if s]
    out: list[tuple[str, int, int]] = []
    now: list[tuple[int, str]] = []
    fresh = False
    size = lambda xs: sum(len(s) for _, s in xs) + max(0, len(xs) - 1)
    flush = lambda: out.append(("\n".join(s for _, s in now), now[0][0], now[-1][0]))
    for i, s in paras:
        if len(s) > limit:
            if fresh:
                flush()
            now, fresh = [], False
            out += [(x, i, i) for x in _split_long(s, limit)]
            continue
        if now and size(now) + 1 + len(s) > limit:
            if fresh:
                flush()
            carry: list[tuple[int, str]] = []
            for x in reversed(now):
                if size([x, *carry]) > overlap:
                    break
                carry.insert(0, x)
            while carry and size(carry) + 1 + len(s) > limit:
                carry.pop(0)
            now, fresh = carry, False
        now.append((i, s))
        fresh = True
    if fresh:
        flush()
    return out


def overlapped(docs: DataFrame, id_col: str, text_col: str, limit: int = 480, overlap: int = 80) -> DataFrame:
    """(id, seq, para_start, para_end, text) for every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(width(docs.sparkSession))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(i, k, a, b, t) for i, x in zip(pdf.id, pdf.text) for k, (t, a, b) in enumerate(pack_overlap(x, limit, overlap))]
            yield pd.DataFrame(got, columns=["id", "seq", "para_start", "para_end", "text"])

    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, seq int, para_start int, para_end int, text string")


def semantic_cuts(docs: DataFrame, id_col: str, text_col: str, share: float = 0.9) -> DataFrame:
    """(id, para, segment): a new segment starts where the distance to the paragraph before is in the top tenth of its document and above 0.

    The distance is one minus the cosine of hash-bag vectors of 256 md5 buckets. A document is
    cut where it is read, in numbers of whole batches; nothing is shuffled but an uneven scan.
    """
    import numpy as np
    import pyarrow as pa

    from tessera.operators.search import md5_bucket, rounded, words
    from tessera.session import spread

    rows = spread(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text")))

    def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, paragraph, segment) of every paragraph of some texts."""
        paras = [[y for x in t.split("\n") if (y := x.strip(" "))] for t in texts]
        n = np.fromiter(map(len, paras), np.int64, len(paras))
        doc = np.repeat(np.arange(len(n)), n)
        para = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + 1
        codes = [list(map(md5_bucket, words(y))) for x in paras for y in x]
        size = np.fromiter(map(len, codes), np.int64, len(codes))
        key, tf = np.unique(np.repeat(np.arange(len(codes)), size) * 256 + np.fromiter((c for x in codes for c in x), np.int64, int(size.sum())), return_counts=True)
        at = key // 256
        w = tf / np.sqrt(np.bincount(at, tf * tf, len(codes)))[at]
        before = np.searchsorted(key, key - 256)
        same = (para[at] > 1) & (key[np.minimum(before, len(key) - 1)] == key - 256)
        d = rounded(1 - np.bincount(at[same], w[same] * w[before[same]], len(codes)), 6)
        inner = np.flatnonzero(para > 1)
        order = inner[np.lexsort((d[inner], doc[inner]))]
        many = np.maximum(n - 1, 0)
        start, place = np.cumsum(many) - many, share * np.maximum(many - 1, 0)
        low = np.floor(place).astype(np.int64)
        limit, some = np.full(len(n), np.inf), many > 0
        a, z = d[order][(start + low)[some]], d[order][(start + np.minimum(low + 1, np.maximum(many - 1, 0)))[some]]
        limit[some] = rounded(a + (z - a) * (place - low)[some], 6)
        hit = (para > 1) & (d >= limit[doc]) & (d > 0)
        total = np.cumsum(hit)
        first = np.flatnonzero(para == 1)
        return doc, para, total - np.repeat(total[first], n[n > 0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                doc, para, segment = cut(part.column("text").to_pylist())
                if len(doc):
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc)), pa.array(para, pa.int32()), pa.array(segment, pa.int64())], ["id", "para", "segment"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, para int, segment long")


def newest(chunks: DataFrame, doc_col: str = "doc_id", version_col: str = "version") -> DataFrame:
    """Chunks with ``is_active``: those of the newest version of their document."""
    top = chunks.groupBy(doc_col).agg(F.max(version_col).alias("_top"))
    return chunks.join(top, doc_col).withColumn("is_active", F.col(version_col) == F.col("_top")).drop("_top")
