"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, languages, normalize, packing, pieces, pii, scans, sentences
from tessera.session import table


def _active(spark: SparkSession, d: str, *suffixes: str) -> DataFrame:
    """Active chunks, of files with one of the suffixes if any are given."""
    rows = table(spark, d, "narrative_chunk").where("active = 1 and chunk_id is not null")
    return rows.where(F.lower(F.element_at(F.split("doc_id", r"\."), -1)).isin(*suffixes)) if suffixes else rows


def _looks(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        _active(spark, d).select(F.lit("narrative_chunk").alias("src"), F.col("chunk_id").alias("key"), "text"),
        table(spark, d, "qa_golden_set").select(F.lit("qa_golden_set").alias("src"), F.col("id").alias("key"), F.col("question").alias("text")),
        table(spark, d, "graph_entity").select(F.lit("graph_entity").alias("src"), F.col("ent_id").cast("string").alias("key"), F.col("name").alias("text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows that look the same but differ in characters."""
    return normalize.lookalikes(_looks(spark, d))


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every text, question and name, and the key of its look."""
    return normalize.normalize(normalize.normalize(_looks(spark, d), "text"), "text", "look", True).drop("text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """End positions of the sentence units of all active chunks of text files."""
    return p5_units(spark, d).select("chunk_id", "end_pos").distinct()


def p5_units(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units with their places."""
    rows = _active(spark, d, "docx", "pptx", "txt")
    out = sentences.units(rows, "chunk_id", doc_col="doc_id")
    return out.withColumnRenamed("id", "chunk_id")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of at most 480 characters of every oversized active chunk of text files."""
    rows = _active(spark, d, "docx", "pptx", "txt")
    start = rows.withColumn("first_para", F.when(F.col("para_end") >= F.col("para_start"), F.col("para_start")).otherwise(F.least("para_start", "para_end")))
    return pieces.split_oversized(start, "chunk_id", doc_col="doc_id", para_col="first_para").withColumnRenamed("id", "chunk_id").drop("level")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The coarsest boundary that suffices: the deepest level the packing had to descend to."""
    out = pieces.split_oversized(_active(spark, d, "docx", "pptx", "txt"), "chunk_id", doc_col="doc_id")
    deepest = out.groupBy(F.col("id").alias("chunk_id")).agg(F.max("level").alias("level"))
    return deepest.select("chunk_id", F.element_at(F.array(*map(F.lit, pieces.LEVELS)), F.col("level") + 1).alias("cut"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    """Container of every text, or of every piece of a text above the capacity."""
    counts = bpe.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.assign(counts).withColumnRenamed("id", "doc_id")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Items, tokens and free space of every container."""
    rows = p9_packed(spark, d).groupBy("container").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    return rows.withColumn("free", packing.CAPACITY - F.col("n_tokens"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of personal data in the documents with its kind and place."""
    out = pii.detect(table(spark, d, "documents"), "doc_id")
    return out.select(F.col("id").alias("doc_id"), "kind", "start_pos", "end_pos")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The documents with placeholders in place of personal data."""
    return pii.redact(table(spark, d, "documents"), "doc_id").withColumnRenamed("id", "doc_id")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    chunks = _active(spark, d).select(F.lit("narrative_chunk").alias("src"), F.col("chunk_id").alias("key"), "text", F.col("language").alias("label"))
    corpus = table(spark, d, "retrieval_ab_corpus").select(F.lit("retrieval_ab_corpus").alias("src"), F.col("doc_id").alias("key"), "text", F.col("language").alias("label"))
    return chunks.unionByName(corpus)


def p1_detected(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every active chunk and corpus row."""
    rows = _labelled(spark, d)
    return languages.detect(rows, languages.fit(languages.labelled_sample(rows)))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every segment."""
    rows = _labelled(spark, d)
    return languages.segments(rows, languages.fit(languages.labelled_sample(rows)))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose language label is missing or wrong, with the right one."""
    return languages.mislabelled(p1_detected(spark, d)).select("src", F.col("key").alias("row_key"), F.col("lang").alias("lang_true"))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Continuous text of the active chunks of scanned files with the noise that was found."""
    rows = _active(spark, d)
    scanned = F.lower(F.element_at(F.split("doc_id", r"\."), -1)).isin("pdf", "tif")
    return scans.repair(rows.where(scanned), rows.where(~scanned))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of noise in the active chunks of scanned files."""
    return scans.noise(p2_repaired(spark, d))


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired, "p1_found": p1_found, "p1_detected": p1_detected, "p1_segments": p1_segments, "p10_found": p10_found, "p10_redacted": p10_redacted, "p9_packed": p9_packed, "p9_containers": p9_containers, "p7_found": p7_found, "p7_pieces": p7_pieces, "p8_ids": p8_ids, "p5_found": p5_found, "p5_units": p5_units, "p4_found": p4_found, "p4_canonical": p4_canonical}
SQL: dict[str, str] = {}
