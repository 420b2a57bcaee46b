"""Files as documents, FAQ lists, golden sets and graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """(source_doc_id, locator, content, file_hash) of all files below a folder; hidden and temporary names are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    out = raw.where(~name.startswith(".") & ~name.startswith("~$"))
    if suffixes:
        out = out.where(F.lower(F.element_at(F.split(name, r"\."), -1)).isin([s.lower().lstrip(".") for s in suffixes]))
    return out.select(name.alias("source_doc_id"), F.col("path").alias("locator"), "content", F.sha2("content", 256).alias("file_hash"))


def text_segments(docs: DataFrame) -> DataFrame:
    """(source_doc_id, locator, text): blocks of text files between blank lines, white space folded."""
    blocks = F.split(F.decode("content", "utf-8"), r"\n\s*\n")
    clean = F.filter(F.transform(blocks, lambda b: F.trim(F.regexp_replace(b, r"(?U)\s+", " "))), lambda b: b != "")
    return docs.select("source_doc_id", F.posexplode(clean).alias("i", "text")).select("source_doc_id", F.concat(F.lit("para"), (F.col("i") + 1).cast("string")).alias("locator"), "text")


def faq(spark: SparkSession, path: str) -> DataFrame:
    """FAQ items of {"items": [...]} or [...]."""
    raw = spark.read.option("multiLine", "true").json(path)
    return raw.select(F.explode("items").alias("i")).select("i.*") if "items" in raw.columns else raw


def golden(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A golden set of JSON lines; any row that does not fit the schema rejects the set."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def graph(entities: DataFrame, relationships: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of graph tables; lineage is the first document of the least text unit, else the row's own id; blank ids are left out."""
    home = units.select(F.col("id").alias("unit"), F.array_min("document_ids").alias("doc"))
    lineage = lambda df: df.withColumn("unit", F.array_min("text_unit_ids")).join(home, "unit", "left").withColumn("source_doc_id", F.coalesce("doc", "id"))
    v = lineage(entities.where("id is not null and trim(id) <> ''")).select("id", "type", F.col("title").alias("label"), "source_doc_id", F.lit("model_derived").alias("origin"))
    e = lineage(relationships.where("id is not null and trim(id) <> ''")).select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit("related").alias("type"), "source_doc_id")
    return v, e


def write_graph(vertices: DataFrame, edges: DataFrame, folder: str) -> None:
    """Both tables as parquet, without restricted vertices and the edges on them."""
    from tessera.operators.graph import induced, open_vertices

    v = open_vertices(vertices)
    v.write.mode("overwrite").parquet(f"{folder}/entities.parquet")
    induced(edges, v).write.mode("overwrite").parquet(f"{folder}/relationships.parquet")


def in_memory(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Documents given as (source_doc_id, locator, content) rows, with the columns of :func:`documents`."""
    df = spark.createDataFrame([(a, b, bytearray(c.encode() if isinstance(c, str) else c)) for a, b, c in rows], "source_doc_id string, locator string, content binary")
    return df.withColumn("file_hash", F.sha2("content", 256))


def unseen(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Documents whose (source_doc_id, file_hash) the registry does not hold; of equal ones the first by locator counts."""
    one = docs.groupBy("source_doc_id", "file_hash").agg(F.min_by(F.struct("locator", "content"), "locator").alias("s")).select("source_doc_id", "s.*", "file_hash")
    return one.join(registry.select("source_doc_id", "file_hash"), ["source_doc_id", "file_hash"], "left_anti")
