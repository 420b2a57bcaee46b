"""Answers put together from what was found: passages with their sources, several figures with their change, chains of steps."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.facts import lookup
from tessera.operators.filters import not_restricted
from tessera.operators.retrieval import ranked


def chain(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Steps from DataFrames to DataFrames as one; without steps nothing changes."""
    return lambda df: reduce(lambda x, step: step(x), steps, df)


def sources(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, doc_id, place): every source once, in the order of its first hit."""
    first = hits.where("doc_id is not null").groupBy(key, "doc_id").agg(F.min("rank").alias("rank"))
    return ranked(first.withColumnRenamed("doc_id", "id").withColumn("score", -F.col("rank")), None, "score", key).select(key, F.col("id").alias("doc_id"), F.col("rank").alias("place"))


def narrative(queries: DataFrame, hits: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, answer, sources, n_hits) for every query: its visible passages numbered in their order, and their sources once each.

    ``hits`` has key, doc_id, text, rank, sensitivity and is bounded by the top k of a retrieval.
    Restricted passages never leave; a query without any has the answer 'nothing found'.
    """
    open_ = hits.where(not_restricted(F.col("sensitivity")))
    seen = ranked(open_.select(key, F.col("doc_id").alias("id"), "doc_id", "text", (-F.col("rank")).alias("score")), None, "score", key)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: F.concat(F.lit("["), x["rank"], F.lit("] "), F.coalesce(x["text"], F.lit(""))))
    text = seen.groupBy(key).agg(F.array_join(lines, "\n").alias("answer"), F.count("*").alias("n_hits"))
    cited = sources(seen, key).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"]), "; ").alias("sources"))
    out = queries.select(key).distinct().join(text, key, "left").join(cited, key, "left")
    return out.select(key, F.coalesce("answer", F.lit("nothing found")).alias("answer"), F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def several(tasks: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, ordinal, line, delta) of sub-tasks (qid, ordinal, metric_code, entity, period_type, period, channel): one line each, with the change to the line before of the same metric and entity.

    What is hidden or missing is said to be not found and breaks the chain of changes.
    """
    from pyspark.sql import Window

    got = lookup(tasks, facts)
    what = F.concat_ws(" ", "entity", "metric_code", "period")
    shown = (F.col("status") == "found") & F.col("value").isNotNull()
    line = F.when(shown, F.concat(what, F.lit(" = "), F.round("value", 4).cast("string"), F.concat(F.lit(" "), F.coalesce("unit", F.lit(""))))).otherwise(F.concat(what, F.lit(": not found")))
    w = Window.partitionBy("qid", "metric_code", "entity").orderBy("ordinal")
    value = F.when(shown, F.col("value"))
    same = F.lag("unit").over(w).eqNullSafe(F.col("unit"))
    return got.select("qid", "ordinal", line.alias("line"), F.when(same, F.round(value - F.lag(value).over(w), 4)).alias("delta"))
