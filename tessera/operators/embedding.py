"""Deterministic hash-bag embeddings and batch hybrid retrieval with them.

A token falls into one of ``dim`` buckets by its hash; a text is the normalised vector of its
bucket counts. The vectors carry no meaning beyond shared words: they stand in where no model is.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators import retrieval, search

DIM = 256


def bucket(token: Column, dim: int = DIM, algorithm: str = "md5") -> Column:
    """Bucket of a token; md5 (first eight hex digits) is native, blake2b (8 bytes, big-endian) a pandas UDF."""
    if algorithm == "md5":
        return (F.conv(F.left(F.md5(token), F.lit(8)), 16, 10).cast("long") % dim).cast("int")
    if algorithm != "blake2b":
        raise ValueError("algorithm is md5 or blake2b")

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % dim)

    return run(token)


def weights(docs: DataFrame, id_col: str, text_col: str, dim: int = DIM, algorithm: str = "md5") -> DataFrame:
    """(id, bucket, weight) of the buckets that are not empty; weights of an id have norm 1.

    The hash is taken of the different words only; for blake2b that means a join with them.
    """
    words = docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    if algorithm == "md5":
        words = words.withColumn("bucket", bucket(F.col("term"), dim))
    else:
        words = words.join(words.select("term").distinct().withColumn("bucket", bucket(F.col("term"), dim, algorithm)), "term")
    counts = words.groupBy("id", "bucket").agg(F.sum("tf").alias("tf"))
    norms = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return counts.join(norms, "id").select("id", "bucket", (F.col("tf") / F.col("norm")).alias("weight"))


def embed(docs: DataFrame, id_col: str, text_col: str, dim: int = DIM, algorithm: str = "md5") -> DataFrame:
    """(id, v): dense unit vectors; a text without tokens has the zero vector. At most ``dim`` entries are gathered per text."""
    parts = weights(docs, id_col, text_col, dim, algorithm).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    ids = docs.select(F.col(id_col).alias("id")).distinct().join(parts, "id", "left")
    none = F.create_map().cast("map<int,double>")
    return ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(F.coalesce("m", none), i), F.lit(0.0))).alias("v"))


def hybrid(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, query_col: str, query_text: str, k: int = 10, pool: int = 50, dim: int = DIM, algorithm: str = "md5") -> DataFrame:
    """(query_id, id, fused, bm25, vector, rank): BM25 and cosine of hash-bag vectors, each cut to its ``pool`` best before they are fused by reciprocal rank."""
    lexical = search.bm25_top(docs, id_col, text_col, retrieval.query_terms(queries, query_col, query_text), pool)
    dense = search.bag_top(docs, id_col, text_col, queries, query_col, query_text, pool, dim, algorithm)
    return retrieval.fuse(lexical, dense, k)
