"""Batch retrieval: postings, BM25, vectors, reciprocal-rank fusion.

All functions take many queries at once. Statistics follow the candidates that are passed in,
so a filter is applied before. Scores are rounded before ranking and ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens

K1, B = 1.5, 0.75
#: A query side above this many rows is not broadcast.
BROADCAST_ROWS = 200_000
#: Queries of one matrix product.
QUERY_BLOCK = 1024


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf)."""
    return docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dl); documents without tokens have 0 and count."""
    return docs.select(F.col(id_col).alias("id"), F.size(tokens(F.col(text_col))).alias("dl"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term, qtf)."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(query_id, id, score), positive scores only.

    Words no query asks for leave before the first shuffle, the length travels with the word, and
    document frequencies are pre-aggregated and joined on the term.
    """
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("tk"))
    stats = words.agg(F.count("*").alias("n"), (F.sum(F.size("tk")) / F.count("*")).alias("avgdl"))
    wanted = terms.select("term").distinct()
    hits = words.select("id", F.size("tk").alias("dl"), F.explode("tk").alias("term")).join(wanted, "term", "left_semi").groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = (
        hits.join(df, "term")
        .crossJoin(F.broadcast(stats))
        .withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        .withColumn("w", F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
        .select("id", "term", "w")
    )
    return scored.join(terms, "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("qtf") * F.col("w")), 6).alias("score")).where("score > 0")


def ranked(scores: DataFrame, k: int | None = None, by: str = "score", key: str = "query_id") -> DataFrame:
    """Adds rank from 1 by falling score, ties by id; only the first k are kept if k is given."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), F.asc("id"))))
    return out.where(F.col("rank") <= k) if k else out


def _blocks(docs: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_col: str, query_vec: str, pick) -> tuple[DataFrame, DataFrame]:
    """(q, id, score) that ``pick`` (a function of a matrix of scores) takes from every batch of documents and block of queries, and the label of every q."""
    d = docs.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    q = queries.select(F.col(query_col).alias("query_id"), F.col(query_vec).cast("array<double>").alias("v")).where("query_id is not null and v is not null")
    if q.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} queries; pass them in blocks")
    rows = q.orderBy("query_id").collect()
    names = [r.query_id for r in rows]
    shared = docs.sparkSession.sparkContext.broadcast(np.array([r.v for r in rows], float) if rows else np.zeros((0, 1)))
    unit = lambda m: np.divide(m, (n := np.linalg.norm(m, axis=1, keepdims=True)), out=np.zeros_like(m), where=n > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qs = unit(shared.value)
        for pdf in batches:
            if not len(pdf) or not len(qs):
                continue
            pdf = pdf.sort_values("id", ignore_index=True)
            m = unit(np.array(pdf.v.tolist(), float).reshape(len(pdf), -1))
            for lo in range(0, len(qs), QUERY_BLOCK):
                s = np.round(m @ qs[lo : lo + QUERY_BLOCK].T, 6) + 0.0
                row, col = pick(s)
                yield pd.DataFrame({"q": col + lo, "id": pdf.id.to_numpy()[row], "score": s[row, col]})

    part = d.mapInPandas(run, f"q long, id {dict(d.dtypes)['id']}, score double")
    label = docs.sparkSession.createDataFrame(pd.DataFrame({"q": range(len(names)), "query_id": names}), f"q long, query_id {dict(q.dtypes)['query_id']}")
    return part, label


def vector_topk(docs: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_col: str, query_vec: str, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): the k best cosines of a stated query set against every document, ties by id.

    Query vectors go to the executors in blocks of ``QUERY_BLOCK``. Each batch of documents is one
    matrix product per block and passes on its own k best only, so the shuffle holds k rows a query and batch.
    Vectors of another dimension than the query's are an error; zero vectors have cosine 0.
    """

    def pick(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.argsort(-s, axis=0, kind="stable")[:k]
        return top.ravel(), np.tile(np.arange(s.shape[1]), len(top))

    part, label = _blocks(docs, id_col, vec_col, queries, query_col, query_vec, pick)
    return ranked(part, k, key="q").join(F.broadcast(label), "q").select("query_id", "id", "score", "rank")


def vector_links(docs: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_col: str, query_vec: str, least: float) -> DataFrame:
    """(query_id, id, score): all documents with a cosine of ``least`` or more to a stated query set, by the same matrix products."""
    part, label = _blocks(docs, id_col, vec_col, queries, query_col, query_vec, lambda s: np.nonzero(s >= least))
    return part.join(F.broadcast(label), "q").select("query_id", "id", "score")


def rrf(rankings: list[DataFrame], k: int = 60, key: str = "query_id") -> DataFrame:
    """(query_id, id, fused): the sum of 1 / (k + rank) over rankings with columns query_id, id, rank."""
    every = rankings[0].select(key, "id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select(key, "id", "rank"))
    return every.groupBy(key, "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("fused"))


def fuse(lexical: DataFrame, dense: DataFrame, k: int = 50, c: int = 60) -> DataFrame:
    """Top k by fused rank of two ranked channels with the score of each, 0 where a channel has none; both meet in one aggregate."""
    one = lexical.select("query_id", "id", "rank", F.col("score").alias("bm25"), F.lit(None).cast("double").alias("vector"))
    two = dense.select("query_id", "id", "rank", F.lit(None).cast("double").alias("bm25"), F.col("score").alias("vector"))
    best = lambda n: F.greatest(F.coalesce(F.max(n), F.lit(0.0)), F.lit(0.0)).alias(n)
    out = one.unionByName(two).groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("fused"), best("bm25"), best("vector"))
    return ranked(out, k, "fused")


def library_scores(titles: DataFrame, library_col: str, text_col: str, queries: DataFrame, query_col: str, query_text: str) -> DataFrame:
    """(query_id, library, overlap): libraries whose words (of all their rows) the query shares, by a join on the word; a query without any overlap goes to all."""
    words = titles.select(F.col(library_col).alias("library"), F.explode(tokens(F.col(text_col))).alias("term")).distinct()
    asked = queries.select(F.col(query_col).alias("query_id"), F.explode(tokens(F.col(query_text))).alias("term")).distinct()
    hit = asked.join(words, "term").groupBy("query_id", "library").agg(F.count("*").cast("int").alias("overlap"))
    libraries = titles.select(F.col(library_col).alias("library")).distinct()
    if libraries.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError("too many libraries to send a query to all")
    rest = queries.select(F.col(query_col).alias("query_id")).join(hit.select("query_id").distinct(), "query_id", "left_anti")
    return hit.select("query_id", "library", "overlap").unionByName(rest.crossJoin(F.broadcast(libraries)).select("query_id", "library", F.lit(0).alias("overlap")))
