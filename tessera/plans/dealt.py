"""Queries of the general data problems: hierarchies (3) and units (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import hierarchy, units
from tessera.session import table


def _active(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "narrative_chunk").where("active = 1")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every active chunk."""
    out = hierarchy.resolve(_active(spark, d), "chunk_id", "parent_id", ["version", "ingested_at"], with_path=False)
    return out.select(F.col("id").alias("chunk_id"), F.col("root").alias("root_id"), "depth")


def p3_tree(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root and number of descendants of every active chunk."""
    out = hierarchy.resolve(_active(spark, d), "chunk_id", "parent_id", ["version", "ingested_at"])
    return out.select(F.col("id").alias("chunk_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", ">").alias("path"), "n_descendants")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every (ancestor, descendant) pair of the active chunks with its distance."""
    return hierarchy.descendants(hierarchy.resolve(_active(spark, d), "chunk_id", "parent_id", ["version", "ingested_at"]))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of facts of one key that state the same figure in different units."""
    return units.agreeing_pairs(p6_converted(spark, d))


def p6_converted(spark: SparkSession, d: str) -> DataFrame:
    """Every fact with its decoded unit and the value in the metric's common unit."""
    return units.convert(table(spark, d, "fact_metric"), table(spark, d, "metric_def"), table(spark, d, "fx_rate"))


_ONE = """one AS (SELECT chunk_id, arg_max(nullif(parent_id, ''), (version, ingested_at, coalesce(parent_id, ''))) AS p0 FROM narrative_chunk
          WHERE active = 1 AND chunk_id IS NOT NULL GROUP BY chunk_id),
     lk AS (SELECT a.chunk_id, b.chunk_id AS parent FROM one a LEFT JOIN one b ON b.chunk_id = a.p0),
     t AS (SELECT chunk_id, chunk_id AS root_id, 0::BIGINT AS depth, chunk_id AS path FROM lk WHERE parent IS NULL
           UNION ALL SELECT k.chunk_id, t.root_id, t.depth + 1, t.path || '>' || k.chunk_id FROM t JOIN lk k ON k.parent = t.chunk_id)"""

QUERIES = {"p3_found": p3_found, "p3_tree": p3_tree, "p3_descendants": p3_descendants, "p6_found": p6_found, "p6_converted": p6_converted}
SQL = {
    "p3_found": f"""WITH RECURSIVE {_ONE}
SELECT lk.chunk_id, coalesce(t.root_id, '') AS root_id, coalesce(t.depth, -1)::BIGINT AS depth FROM lk LEFT JOIN t USING (chunk_id)""",
    "p3_tree": f"""WITH RECURSIVE {_ONE},
     a AS (SELECT u.chunk_id, unnest(string_split(u.path, '>')) AS anc FROM t u),
     n AS (SELECT anc, count(*) - 1 AS n FROM a GROUP BY anc)
SELECT lk.chunk_id, coalesce(t.root_id, '') AS root_id, coalesce(t.depth, -1)::BIGINT AS depth, coalesce(t.path, '') AS path,
       coalesce(n.n, 0)::BIGINT AS n_descendants FROM lk LEFT JOIN t USING (chunk_id) LEFT JOIN n ON n.anc = lk.chunk_id""",
    "p3_descendants": f"""WITH RECURSIVE {_ONE},
     a AS (SELECT chunk_id AS descendant, depth, string_split(path, '>') AS p FROM t),
     x AS (SELECT descendant, depth, unnest(p) AS ancestor, generate_subscripts(p, 1) - 1 AS pos FROM a)
SELECT ancestor, descendant, (depth - pos)::BIGINT AS distance FROM x WHERE ancestor <> descendant""",
}
