"""Gates in front of data and caches: scope of a question, persistence, short answers, adaptive routes."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.filters import not_restricted

# Words that ask for the present state, for a comparison, and for the whole.
REALTIME = ["现在", "目前", "实时", "今天", "current", "currently", "right now", "today", "latest", "actuellement", "aktuell", "hoy"]
COMPARISON = ["对比", "比较", "哪个最", "高吗", "vs", "versus", "compare", "which", "höher", "plus élevé"]
GLOBAL = ["overall", "themes", "main topics", "across all", "整体", "总体", "主要主题", "全局"]


def outside(question: Column, aliases: dict[str, str]) -> Column:
    """Display name of the foreign party a question names, or null; longest alias first, blanks inside a name do not hide it."""
    bare = F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"(?U)\s+", "")
    out = F.lit(None).cast("string")
    for alias in sorted(aliases, key=lambda a: (len(a), a)):
        out = F.when(bare.contains(re.sub(r"\s+", "", alias.lower())), F.lit(aliases[alias])).otherwise(out)
    return out


def masked(question: Column, aliases: dict[str, str]) -> Column:
    """The cleaned question with the foreign name, blanks inside it too, put out by blanks of the same length."""
    names = sorted(aliases, key=lambda a: (-len(a), a))
    forms = [re.compile(r"\s*".join(map(re.escape, re.sub(r"\s+", "", a.lower())))) for a in names]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            clean = re.sub(r"\s+", " ", text.strip().lower())
            for form in forms:
                if m := form.search(clean):
                    return clean[: m.start()] + " " * (m.end() - m.start()) + clean[m.end() :]
            return clean

        return s.map(one)

    return run(question)


def screen(question: Column, aliases: dict[str, str]) -> Column:
    """struct(decision, external): refuse where a foreign party is named, whatever a parser made of the question."""
    ext = outside(question, aliases)
    return F.struct(F.when(ext.isNotNull(), "refuse_out_of_scope").otherwise("allow").alias("decision"), ext.alias("external"))


def persistable(rows: DataFrame, write_all: bool = False) -> DataFrame:
    """Rows whose vectors may be written; restricted ones stay out unless everything is asked for."""
    return rows if write_all else rows.where(not_restricted(F.col("sensitivity")))


def surface(c: Column) -> Column:
    """The form under which questions are compared: lower case, blanks folded."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")), " +", " "))


def any_of(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(c).contains(w) for w in words])


def within(reference: Column, start: Column, end: Column) -> Column:
    """Closed interval with open bounds; a bound that is no date is never met."""
    low = start.isNull() | (reference >= start.try_cast("date"))
    high = end.isNull() | (reference <= end.try_cast("date"))
    return F.coalesce(low & high, F.lit(False))


def faq(questions: DataFrame, items: DataFrame) -> DataFrame:
    """(id, item_id, answer) of the questions that an entry answers by equal surface.

    ``questions`` has id, question, reference_date, slots (does the parser find any) and external;
    ``items`` has item_id, question, answer, enabled, valid_from, valid_until, sensitivity. Of
    entries with one surface the last by item_id counts. Foreign parties, slots, words for the
    present, closed validity and restricted entries are misses.
    """
    open_ = items.where("enabled").select("item_id", surface(F.col("question")).alias("key"), "answer", "valid_from", "valid_until", "sensitivity").where("key <> ''")
    last = open_.groupBy("key").agg(F.max_by(F.struct("item_id", "answer", "valid_from", "valid_until", "sensitivity"), "item_id").alias("e"))
    asked = questions.where(F.col("external").isNull() & ~F.col("slots")).withColumn("key", surface(F.col("question"))).where(~any_of(F.col("key"), REALTIME))
    hit = asked.join(last, "key").where(within(F.col("reference_date"), F.col("e.valid_from"), F.col("e.valid_until")) & not_restricted(F.trim("e.sensitivity")))
    return hit.select("id", F.col("e.item_id").alias("item_id"), F.col("e.answer").alias("answer"))


def complexity(n_metrics: Column, n_entities: Column, n_periods: Column, route: Column, question: Column) -> Column:
    """multi where several values stand on one axis or a word compares, simple for one figure, else single."""
    multi = (n_metrics > 1) | (n_entities > 1) | (n_periods > 1) | any_of(question, COMPARISON)
    return F.when(multi, "multi").when((route == "structured") & (n_metrics > 0), "simple").otherwise("single")


def vocabulary_filters(queries: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame, field: str) -> DataFrame:
    """(id, field, op, value): one equality for every code of a controlled vocabulary (term, code) a query names.

    Latin terms must stand as words, others anywhere. The vocabulary must be of dimension size:
    above ``retrieval.BROADCAST_ROWS`` rows the join is refused.
    """
    from tessera.operators.retrieval import BROADCAST_ROWS

    if vocabulary.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError("the vocabulary is not of dimension size")
    v = vocabulary.select(F.lower("term").alias("term"), "code").where("term is not null and term <> ''").distinct()
    q = queries.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("q"))
    latin = F.col("term").rlike("^[\\x00-\\x7f]+$")
    word = F.concat(F.lit("\\b\\Q"), F.col("term"), F.lit("\\E\\b"))
    hit = q.join(F.broadcast(v), F.when(latin, F.regexp_like("q", word)).otherwise(F.contains("q", "term")))
    return hit.select("id", F.lit(field).alias("field"), F.lit("eq").alias("op"), F.col("code").alias("value")).distinct()


def rewrite(query: Column, vocabularies: list[dict[str, str]], most: int = 5) -> Column:
    """The query and its variants: every term found is replaced by its code first, then by the other words of the code; at most ``most`` in all."""

    def place(low: str, term: str) -> tuple[int, int] | None:
        if term.isascii():
            m = re.search(rf"\b{re.escape(term)}\b", low)
            return m.span() if m else None
        at = low.find(term)
        return (at, at + len(term)) if at >= 0 else None

    def variants(text: str) -> list[str]:
        low, out = text.lower(), [text]
        found = [(span, term, code, words) for words in vocabularies for term, code in words.items() if (span := place(low, term.lower()))]
        other = [text[:a] + code + text[b:] for (a, b), _, code, _ in found]
        other += [text[:a] + word + text[b:] for (a, b), term, code, words in found for word, c in words.items() if c == code and word != term]
        for x in other:
            if x not in out and len(out) < most:
                out.append(x)
        return out

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else variants(t))

    return run(query)


def first_passing(queries: DataFrame, stages: list[DataFrame], texts: DataFrame, least: float = 0.5) -> DataFrame:
    """Corrective retrieval for many queries: (query_id, stage, grade, id, rank) of the first stage whose hits cover the query.

    ``queries`` has query_id and words (its words, repeats kept); a stage has query_id, id, rank;
    ``texts`` has id and words. The grade is the share of the query's words, counted with
    repeats, that occur in any of the stage's texts; a query without words has grade 1. Every
    stage is graded on the original query; where none passes the query has no rows.
    """
    tagged = [s.select("query_id", "id", "rank", F.lit(i).alias("stage")) for i, s in enumerate(stages)]
    hits = reduce(lambda a, b: a.unionByName(b), tagged)
    words = queries.select("query_id", F.explode("words").alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("n"))
    total = queries.select("query_id", F.size("words").alias("total"))
    seen = hits.join(texts.select("id", F.explode(F.array_distinct("words")).alias("word")), "id").join(words, ["query_id", "word"]).select("query_id", "stage", "word", "n").distinct()
    covered = seen.groupBy("query_id", "stage").agg(F.sum("n").alias("hit"))
    stage = F.explode(F.sequence(F.lit(0), F.lit(len(stages) - 1))).alias("stage")
    grades = total.select("query_id", "total", stage).join(covered, ["query_id", "stage"], "left")
    grades = grades.withColumn("grade", F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.coalesce("hit", F.lit(0)) / F.col("total"), 6)))
    first = grades.where(F.col("grade") >= least).groupBy("query_id").agg(F.min_by(F.struct("stage", "grade"), "stage").alias("g"))
    best = first.select("query_id", "g.stage", "g.grade")
    return best.join(hits, ["query_id", "stage"], "left").select("query_id", "stage", "grade", "id", "rank")


def fuse_snippets(hits: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, key, fused, rank, text, entity) of snippets found by several variants of a query.

    A snippet is told by its chunk_id, else by doc_id::source_locator, else by its text; text and
    entity come from its first occurrence (variant, then rank).
    """
    from tessera.operators.retrieval import ranked

    key = F.coalesce("chunk_id", F.concat("doc_id", F.lit("::"), "source_locator"), "text")
    keyed = hits.withColumn("id", key)
    out = keyed.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("fused"), F.min_by(F.struct("text", "entity"), F.struct("variant", "rank")).alias("s"))
    return ranked(out, None, "fused").select("query_id", F.col("id").alias("key"), "fused", "rank", "s.text", "s.entity")
