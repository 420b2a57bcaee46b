"""Quality: recall, reciprocal rank, faithfulness, accuracy, gates, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import claims, token_set


def recall_mrr(results: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, recall, mrr) for every query of (query_id, id) gold; recall 1 without gold is by absence of the query."""
    hit = gold.distinct().join(results.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(
        F.round(F.count_if(F.col("rank") <= k) / F.count("*"), 6).alias("recall"), F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("mrr")
    )


def faithfulness(answer: Column, source: Column, least: float = 0.6) -> Column:
    """Share of the answer's claims whose tokens are covered by the source at least ``least``; 1 without claims."""
    known = token_set(source)

    def backed(c):
        t = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+|[\\x{4E00}-\\x{9FFF}]"), F.lit(0))
        return F.size(F.filter(t, lambda x: F.array_contains(known, x))) >= least * F.size(t)

    c = claims(answer)
    return F.when(F.size(c) == 0, 1.0).otherwise(F.round(F.size(F.filter(c, backed)) / F.size(c), 6))


def accuracy(answer: Column, reference: Column) -> Column:
    """Share of the reference's distinct tokens found in the answer; 1 on an empty reference."""
    r = token_set(reference)
    return F.when(F.size(r) == 0, 1.0).otherwise(F.round(F.size(F.array_intersect(r, token_set(answer))) / F.size(r), 6))


def gates(outcomes: DataFrame, tag: str, passed: str) -> DataFrame:
    """(tag, total, passed, pass_rate) with a row 'ALL'."""
    got = outcomes.groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("total"), F.count_if(F.col(passed)).alias("passed"))
    every = outcomes.agg(F.count("*").alias("total"), F.count_if(F.col(passed)).alias("passed")).select(F.lit("ALL").alias("tag"), "total", "passed")
    return got.unionByName(every).withColumn("pass_rate", F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("passed") / F.col("total"), 6)))


def regressions(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """Metrics (name, value) that fell below their baseline; unknown names are left out."""
    return now.join(baseline.select("name", F.col("value").alias("base")), "name").where("value < base")


def channel_accuracy(pairs: DataFrame, group: str, a: str, b: str, tolerance: float) -> DataFrame:
    """(group, total, correct, accuracy) of values that agree within a tolerance."""
    ok = F.abs(F.col(a) - F.col(b)) <= tolerance
    return pairs.groupBy(group).agg(F.count("*").alias("total"), F.count_if(ok).alias("correct"), F.round(F.count_if(ok) / F.count("*"), 6).alias("accuracy"))


def lead(scores: DataFrame, key: str, bucket: str, score: str, threshold: float, margin: float) -> DataFrame:
    """(key, best, score, runner_up, decided): the best bucket of each key, decided if it has ``threshold`` and leads every other by ``margin``."""
    w = Window.partitionBy(key).orderBy(F.desc(score), bucket)
    two = scores.withColumn("k", F.row_number().over(w)).where("k <= 2")
    first = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    out = two.groupBy(key).agg(first(bucket, 1).alias("best"), first(score, 1).alias("score"), F.coalesce(first(score, 2), F.lit(0.0)).alias("runner_up"))
    return out.withColumn("decided", (F.col("score") >= threshold) & (F.col("score") - F.col("runner_up") >= margin))
