"""Parent-child rows to full hierarchies by tree contraction.

Every round removes all current leaves (rake) and an independent set of unary chain nodes
(compress), so a forest of n nodes is contracted in O(log n) rounds whatever its depth. Each
removed node remembers the node it hung on and the nodes skipped in between; a leaf hands its
number of descendants to its parent, a skipped node leaves its own on the link. The recorded
contractions are then reversed, last round first, to give roots, depths, paths and numbers of
descendants: a node needs only nodes that outlived it, so what is read and written shrinks and
grows by a factor from round to round both ways, and roots are never read, as a link knows
whether it ends at one. A cycle can be neither raked nor spliced away: it contracts to a node
that is its own parent, which exposes it and everything hanging on it. What is left when at
most ``TAIL`` nodes remain is contracted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import durable

#: Nodes contracted in one task at the end.
TAIL = 20_000


def _priority(c: Column, turn: int) -> Column:
    return F.xxhash64(F.lit(turn), c)


def links(rows: DataFrame, id_col: str, parent_col: str, order_cols: list[str] | None = None) -> DataFrame:
    """One (id, parent) row per id; the parent is null for roots.

    Of repeated ids the row that is last by ``order_cols`` (then the greatest parent) counts.
    A parent that is null, empty or no id makes a root. Rows with a null id are no nodes.
    """
    keyed = rows.select(
        F.col(id_col).cast("string").alias("id"),
        F.nullif(F.col(parent_col).cast("string"), F.lit("")).alias("parent"),
        F.struct(*[F.col(c) for c in order_cols or []], F.coalesce(F.col(parent_col).cast("string"), F.lit(""))).alias("o"),
    ).where(F.col("id").isNotNull())
    one = keyed.groupBy("id").agg(F.max_by("parent", "o").alias("parent"))
    known = one.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    return one.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"))


def _contract(rows: pd.DataFrame) -> pd.DataFrame:
    """Root, depth, path and number of nodes below (itself included) of the rows of a rest, cyclic ones with root ''."""
    kids: dict[str, list[int]] = {}
    for i, (p, top) in enumerate(zip(rows.parent, rows.top)):
        if not top:
            kids.setdefault(p, []).append(i)
    ids, via = rows.id.tolist(), rows.via.tolist()
    root, depth, path = [""] * len(ids), [-1] * len(ids), [[]] * len(ids)
    total = rows.s.tolist()
    order = [i for i, top in enumerate(rows.top) if top]
    for i in order:
        root[i], depth[i], path[i] = rows.parent.iat[i], int(rows.w.iat[i]), [rows.parent.iat[i], *via[i], ids[i]]
    for i in order:  # grows while it is read
        for k in kids.get(ids[i], ()):
            root[k], depth[k], path[k] = root[i], depth[i] + int(rows.w.iat[k]), [*path[i], *via[k], ids[k]]
            order.append(k)
    at = {x: i for i, x in enumerate(ids)}
    for i in reversed(order):
        if not rows.top.iat[i]:
            total[at[rows.parent.iat[i]]] += total[i] + int(rows.x.iat[i])
    return pd.DataFrame({"id": ids, "root": root, "depth": depth, "path": path, "total": total, "gift": [t + x if top else 0 for t, x, top in zip(total, rows.x, rows.top)]})


def resolve(rows: DataFrame, id_col: str, parent_col: str, order_cols: list[str] | None = None, with_path: bool = True, tail: int = TAIL) -> DataFrame:
    """(id, root, depth[, path, n_descendants]) for every id.

    Roots have their own id, depth 0 and the path [id]. A node whose chain of parents never
    ends has root '', depth -1, an empty path and no descendants. An empty input gives an empty
    result. Extra columns of ``rows`` are not read, so clashing names do no harm.
    """
    start = durable(links(rows, id_col, parent_col, order_cols), "tree")
    none = F.array().cast("array<string>")
    long = lambda c: c.cast("long")
    tops = start.where(F.col("parent").isNull()).select(F.col("id").alias("parent"), F.lit(True).alias("top"))
    alive = start.where(F.col("parent").isNotNull()).join(tops, "parent", "left")
    # w: edges to the parent; s: nodes below and itself so far; x: nodes on the link and below them
    alive = durable(alive.select("id", "parent", F.coalesce("top", F.lit(False)).alias("top"), long(F.lit(1)).alias("w"), long(F.lit(1)).alias("s"), long(F.lit(0)).alias("x"), none.alias("via")), "tree")
    left = alive.count()
    removed: list[tuple[DataFrame, DataFrame]] = []
    loops: list[DataFrame] = []
    turn = 0
    while left > tail:
        turn += 1
        kids = alive.where(~F.col("top")).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"), F.min("id").alias("kid"), F.min("x").alias("kx"))
        seen = alive.join(kids, "id", "left").withColumn("loop", F.col("id") == F.col("parent"))
        first = lambda c: _priority(F.col("id"), turn) < _priority(F.col(c), turn)  # noqa: E731, B023
        splice = ~F.col("loop") & (F.col("n") == 1) & (F.col("top") | first("parent")) & first("kid")
        kind = F.when(F.col("loop"), "loop").when(F.col("n").isNull(), "leaf").when(splice, "splice").otherwise("stay")
        step = durable(seen.withColumn("kind", kind).drop("n", "loop"), "tree")
        gone = step.where("kind = 'splice'")
        over = gone.select(F.col("id").alias("parent"), F.col("parent").alias("p2"), F.col("top").alias("t2"), F.col("w").alias("w2"), (F.col("s") + F.col("x")).alias("x2"), F.col("via").alias("via2"))
        skipped = F.col("p2").isNotNull()
        moved = step.where("kind <> 'splice'").join(over, "parent", "left").select(
            "id", F.coalesce("p2", "parent").alias("parent"), F.coalesce("t2", "top").alias("top"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), "s", (F.col("x") + F.coalesce("x2", F.lit(0))).alias("x"),
            (F.when(skipped, F.concat("via2", F.array("parent"), "via")).otherwise(F.col("via")) if with_path else none).alias("via"), "kind",
        )
        moved = durable(moved, "tree")
        leaves = moved.where("kind = 'leaf'").drop("kind")
        removed.append((leaves, gone.drop("kind")))
        loops.append(moved.where("kind = 'loop'").select("id"))
        gain = leaves.where(~F.col("top")).groupBy(F.col("parent").alias("id")).agg(F.sum(F.col("s") + F.col("x")).alias("g"))
        alive = moved.where("kind = 'stay'").drop("kind").join(gain, "id", "left").withColumn("s", F.col("s") + F.coalesce("g", F.lit(0))).drop("g")
        left = moved.where("kind = 'stay'").count()

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [b for b in batches if len(b)]
        if every:
            yield _contract(pd.concat(every, ignore_index=True))

    schema = "id string, root string, depth long, path array<string>, total long, gift long"
    done = alive.repartition(1).mapInPandas(rest, schema)
    for x in loops:
        done = done.unionByName(x.select("id", F.lit("").alias("root"), long(F.lit(-1)).alias("depth"), none.alias("path"), long(F.lit(0)).alias("total"), long(F.lit(0)).alias("gift")))
    done = durable(done, "tree")
    gifts = [done.where("gift > 0").select(F.col("root").alias("id"), "gift")]
    done = done.drop("gift")
    cyclic = F.col("d") < 0
    for leaves, gone in reversed(removed):
        known = done.select(F.col("id").alias("kid"), F.col("total").alias("below")).unionByName(leaves.select(F.col("id").alias("kid"), F.col("s").alias("below")))
        own = leaves.withColumn("total", F.col("s")).unionByName(gone.join(known, "kid", "left").withColumn("total", F.col("s") + F.coalesce("below", F.lit(0)) + F.coalesce("kx", F.lit(0))).drop("below"), allowMissingColumns=True).drop("kid", "kx")
        gifts.append(leaves.where("top").select(F.col("parent").alias("id"), (F.col("s") + F.col("x")).alias("gift")))
        path = F.concat(F.array("parent"), "via", F.array("id")) if with_path else none
        at_root = own.where("top").select("id", F.col("parent").alias("root"), F.col("w").alias("depth"), path.alias("path"), "total")
        up = done.select(F.col("id").alias("parent"), "root", F.col("depth").alias("d"), F.col("path").alias("pp"))
        path = F.when(cyclic, none).otherwise(F.concat("pp", "via", F.array("id"))) if with_path else none
        below = own.where(~F.col("top")).join(up, "parent").select("id", "root", F.when(cyclic, long(F.lit(-1))).otherwise(F.col("d") + F.col("w")).alias("depth"), path.alias("path"), "total")
        done = durable(at_root.unionByName(below).unionByName(done), "tree")
    roots = start.where(F.col("parent").isNull())
    if not with_path:
        return done.select("id", "root", "depth").unionByName(roots.select("id", F.col("id").alias("root"), long(F.lit(0)).alias("depth")))
    given = gifts[0]
    for g in gifts[1:]:
        given = given.unionByName(g)
    given = given.groupBy("id").agg(F.sum("gift").alias("g"))
    out = done.select("id", "root", "depth", "path", F.when(F.col("depth") < 0, long(F.lit(0))).otherwise(F.col("total") - 1).alias("n_descendants"))
    return out.unionByName(roots.join(given, "id", "left").select("id", F.col("id").alias("root"), long(F.lit(0)).alias("depth"), F.array("id").alias("path"), F.coalesce("g", F.lit(0)).alias("n_descendants")))


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every proper ancestor, from the paths of :func:`resolve`."""
    at = resolved.select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("pos", "ancestor"))
    return at.where(F.col("ancestor") != F.col("descendant")).select("ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
