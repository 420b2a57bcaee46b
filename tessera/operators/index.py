"""The narrative index: documents in, chunks of a new version and their vectors out; retrieval with a fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import chunking, embedding, filters, gates, retrieval

CHUNK = "doc_id string, chunk_id string, seq int, text string, para_start int, para_end int, sensitivity string, version int, active int"
PRESETS = {"economy": {"vector": False, "rerank": False, "pool": 50}, "balanced": {"vector": True, "rerank": False, "pool": 50}, "quality": {"vector": True, "rerank": True, "pool": 100}}


def preset(name: str) -> dict:
    """What a retrieval does: with or without the vector channel and reranking, and how many hits a channel passes on."""
    if name not in PRESETS:
        raise ValueError(f"preset is one of {', '.join(PRESETS)}")
    return dict(PRESETS[name])


def ingest(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, write_all: bool = False, limit: int = 480, overlap: int = 80) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors) after documents (doc_id, text, sensitivity) were taken in.

    A document that is there already gets the next version and its older chunks go inactive; its
    old vectors are deleted, and vectors of the new chunks are written unless they are
    restricted. Documents without text leave no active chunk. Repeated rows of a document count once.
    """
    one = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max_by("text", F.coalesce("text", F.lit(""))).alias("text"), F.max(F.coalesce("sensitivity", F.lit("INTERNAL"))).alias("sensitivity"))
    last = chunks.groupBy("doc_id").agg(F.max("version").alias("v"))
    cut = chunking.overlapped(one, "doc_id", "text", limit, overlap).withColumnRenamed("id", "doc_id")
    new = cut.join(one.select("doc_id", "sensitivity"), "doc_id").join(last, "doc_id", "left")
    new = new.select("doc_id", F.concat("doc_id", F.lit("#c"), F.col("seq").cast("string")).alias("chunk_id"), "seq", "text", "para_start", "para_end", "sensitivity", (F.coalesce("v", F.lit(0)) + 1).alias("version"), F.lit(1).alias("active"))
    touched = one.select("doc_id", F.lit(True).alias("touched"))
    old = chunks.join(touched, "doc_id", "left").withColumn("active", F.when(F.col("touched"), F.lit(0)).otherwise(F.col("active"))).select(*new.columns)
    kept = vectors.join(one.select("doc_id"), "doc_id", "left_anti")
    v = embedding.embed(gates.persistable(new, write_all), "chunk_id", "text").join(new.select(F.col("chunk_id").alias("id"), "doc_id"), "id")
    return old.unionByName(new), kept.select("id", "doc_id", "v").unionByName(v.select("id", "doc_id", "v"))


def retrieve(chunks: DataFrame, queries: DataFrame, conditions: list[tuple] | None = None, k: int = 10, mode: str = "balanced", fallback: bool = True) -> DataFrame:
    """(query_id, id, score, rank, filtered) of the active chunks for queries (query_id, question); restricted chunks never leave.

    Conditions narrow the candidates first; queries without a hit among them are asked again
    without conditions if ``fallback`` is set, and say so in ``filtered``.
    """
    how = preset(mode)
    live = chunks.where("active = 1")

    def ask(rows: DataFrame, asked: DataFrame) -> DataFrame:
        if how["vector"]:
            return embedding.hybrid(rows, "chunk_id", "text", asked, "query_id", "question", k, how["pool"]).select("query_id", "id", F.col("fused").alias("score"), "rank")
        return retrieval.ranked(retrieval.bm25(rows, "chunk_id", "text", retrieval.query_terms(asked, "query_id", "question")), k)

    first = ask(filters.apply(live, conditions or []), queries).withColumn("filtered", F.lit(bool(conditions)))
    if conditions and fallback:
        rest = queries.join(first.select("query_id").distinct(), "query_id", "left_anti")
        first = first.unionByName(ask(live, rest).withColumn("filtered", F.lit(False)))
    open_ = live.where(filters.not_restricted(F.col("sensitivity"))).select(F.col("chunk_id").alias("id")).distinct()
    return first.join(open_, "id", "left_semi").select("query_id", "id", "score", "rank", "filtered")
