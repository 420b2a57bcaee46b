"""After retrieval: order, diversity, compression, reranking with restricted rows in place."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import token_set
from tessera.session import durable

#: Results up to which the hashes of their ids are sent to the scan of the texts; with more, all texts are shuffled.
FOUND = 2_000_000


def with_texts(results: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds the columns of ``texts`` by id; only the texts that are found leave their scan. Results are written once, as they are read twice."""
    results = durable(results, "found")
    if results.count() <= FOUND:
        found = results.select(F.xxhash64("id").alias("_found")).distinct()
        texts = texts.join(F.broadcast(found), F.xxhash64(texts["id"]) == found["_found"], "left_semi")
    return results.join(texts, "id")


def lost_in_the_middle(results: DataFrame, key: str = "query_id") -> DataFrame:
    """Adds place from 0: best results at both ends, even ranks forward, then odd ranks backward."""
    n = F.count("*").over(Window.partitionBy(key))
    i = F.col("rank") - 1
    order = F.when(i % 2 == 0, i).otherwise(2 * n - i)
    return results.withColumn("_o", order).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_o")) - 1).drop("_o")


def mmr(results: DataFrame, key: str = "query_id", top: int | None = None, weight: float = 0.5) -> DataFrame:
    """(key, id, place): greedy maximal marginal relevance with Jaccard of token sets; results has key, id, rank, text of bounded lists."""
    rows = results.select(key, "id", "rank", token_set(F.col("text")).alias("tok"))
    kinds = dict(rows.dtypes)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        sets = [set(x) for x in pdf.tok]
        n = len(pdf)
        left, done = list(range(n)), []
        while left and (top is None or len(done) < top):
            best, at = -1e9, left[0]
            for i in left:
                near = max((len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] and sets[j] else 0.0 for j in done), default=0.0)
                v = weight * (n - i) / n - (1 - weight) * near
                if v > best + 1e-12:
                    best, at = v, i
            left.remove(at)
            done.append(at)
        return pd.DataFrame({key: pdf[key].iloc[0], "id": [pdf.id[i] for i in done], "place": range(len(done))})

    return rows.groupBy(key).applyInPandas(pick, f"{key} {kinds[key]}, id {kinds['id']}, place int")


def compress(results: DataFrame, query_tokens: str, text_col: str, least: float = 0.3) -> DataFrame:
    """Adds prompt_text: the sentences covered by the query at least ``least``, else the best one, as they stand; a text without sentences stays whole."""
    parts = F.regexp_extract_all(text_col, F.lit(r"[^!?。！？\n]+[!?。！？]*"), F.lit(0))
    scored = F.transform(parts, lambda s: F.struct(s.alias("s"), F.when(F.size(token_set(s)) > 0, F.size(F.array_intersect(token_set(s), F.col(query_tokens))) / F.size(token_set(s))).otherwise(0.0).alias("c")))
    keep = F.filter("scored", lambda x: x["c"] >= least)
    top = F.array_max(F.transform("scored", lambda x: x["c"]))
    best = F.get(F.filter("scored", lambda x: x["c"] == top), F.lit(0))["s"]
    out = results.withColumn("scored", scored)
    return out.withColumn("prompt_text", F.when(F.size(keep) > 0, F.array_join(F.transform(keep, lambda x: x["s"]), "")).otherwise(F.coalesce(best, F.col(text_col)))).drop("scored")


def rerank_slots(results: DataFrame, judged: DataFrame, key: str = "query_id") -> DataFrame:
    """Restricted rows keep their rank, the others are put into the remaining ranks in the judge's order (key, id, pos); unjudged ones follow."""
    open_ = F.upper(F.coalesce("sensitivity", F.lit(""))) != "RESTRICTED"
    marked = results.withColumn("open", open_)
    slots = marked.where("open").withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).select(key, "k", F.col("rank").alias("slot"))
    moved = marked.where("open").join(judged, [key, "id"], "left")
    moved = moved.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("pos", F.lit(2**30)), "rank")))
    put = moved.join(slots, [key, "k"]).select(key, "id", F.col("slot").alias("new_rank"))
    return put.unionByName(marked.where("not open").select(key, "id", F.col("rank").alias("new_rank")))
