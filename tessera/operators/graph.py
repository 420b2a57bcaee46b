"""Typed property graph as vertex and edge DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.filters import not_restricted
from tessera.session import durable


def open_vertices(vertices: DataFrame) -> DataFrame:
    """Vertices that may be read; restricted ones are invisible and no stepping stones."""
    return vertices.where(not_restricted(F.col("sensitivity"))) if "sensitivity" in vertices.columns else vertices


def merge_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """One row per (src, dst, type), the last by ``order``."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "type")]
    return edges.groupBy("src", "dst", "type").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select("src", "dst", "type", "s.*")


def directed(edges: DataFrame, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(src, dst) in the wanted direction."""
    e = edges.where(F.col("type").isin(types)) if types else edges
    out, back = e.select("src", "dst"), e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction not in ("out", "in", "both"):
        raise ValueError("direction is out, in or both")
    return (out if direction == "out" else back if direction == "in" else out.unionByName(back)).distinct()


def neighbors(vertices: DataFrame, edges: DataFrame, starts: DataFrame, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(start, id) of visible neighbours one step away, each once."""
    ok = open_vertices(vertices).select("id")
    step = directed(edges, direction, types)
    s = starts.select(F.col("id").alias("start")).join(ok.withColumnRenamed("id", "start"), "start", "left_semi")
    return s.join(step, s["start"] == step["src"]).select("start", F.col("dst").alias("id")).join(ok, "id", "left_semi").where("id <> start").distinct()


def traverse(vertices: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 3, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(start, id, depth) of vertices within ``depth`` steps with their least depth; the start itself is not returned."""
    if depth < 0:
        raise ValueError("depth must not be negative")
    ok = open_vertices(vertices).select("id")
    step = directed(edges, direction, types).join(ok.withColumnRenamed("id", "dst"), "dst", "left_semi")
    front = starts.select(F.col("id").alias("start"), F.col("id"), F.lit(0).alias("depth")).join(ok, "id", "left_semi").distinct()
    seen = front
    for k in range(1, depth + 1):
        nxt = front.join(step, front["id"] == step["src"]).select("start", F.col("dst").alias("id")).distinct()
        front = durable(nxt.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(k)), "front")
        seen = seen.unionByName(front)
    return seen.where("depth > 0").select("start", "id", "depth")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select("id").distinct()
    return edges.join(n.withColumnRenamed("id", "src"), "src", "left_semi").join(n.withColumnRenamed("id", "dst"), "dst", "left_semi")


def cooccurrence(mentions: DataFrame, group_col: str, item_col: str) -> DataFrame:
    """(a, b, n_groups), a < b: items that occur in the same group, by the number of groups."""
    m = mentions.select(F.col(group_col).alias("g"), F.col(item_col).alias("x")).where("g is not null and x is not null").distinct()
    b = m.select("g", F.col("x").alias("y"))
    return m.join(b, "g").where("x < y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count("*").alias("n_groups"))


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component): the least id reachable when edges go both ways.

    Labels are contracted by alternating large-star and small-star steps, which needs a number
    of rounds logarithmic in the size whatever the diameter; each round is a written table.
    """
    e = edges.select(F.col("src").cast("string").alias("u"), F.col("dst").cast("string").alias("v")).where("u <> v").distinct()
    e = durable(e, "cc")
    # number of edges and a sum of their hashes: two rounds with the same pair have the same edges
    mark = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        new = durable(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        now = mark(new)
        e = new
        if now == before:
            break
        before = now
    root = e.groupBy("u").agg(F.min("v").alias("component"))
    ids = vertices.select(F.col("id").cast("string").alias("id")).distinct()
    return ids.join(root.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def communities(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(community, n_members, n_edges): components of two or more vertices, named by their least member."""
    comp = components(edges, vertices)
    inside = edges.join(comp.select(F.col("id").alias("src"), "component"), "src").groupBy("component").agg(F.count("*").alias("n_edges"))
    size = comp.groupBy("component").agg(F.count("*").alias("n_members")).where("n_members > 1").join(inside, "component", "left")
    return size.select(F.concat(F.lit("c:"), "component").alias("community"), "component", "n_members", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def where(vertices: DataFrame, conditions: dict) -> DataFrame:
    """Vertices that meet every condition on type, label or metadata."""
    from tessera.operators.vectors import matches

    return vertices.where(matches(conditions))


def top_communities(communities: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` communities with most relations, ties by their id as a string; each partition passes on its own first."""
    best = communities.orderBy(F.desc("n_relations"), F.col("community").cast("string")).limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_relations"), F.col("community").cast("string"))))


def community_documents(members: DataFrame, relations: DataFrame) -> DataFrame:
    """(community, source_doc_id), each once, of relations (src, source_doc_id) that start at a member (community, member)."""
    r = relations.where("source_doc_id is not null and source_doc_id <> ''")
    return members.join(r, members["member"] == r["src"]).select("community", "source_doc_id").distinct()
