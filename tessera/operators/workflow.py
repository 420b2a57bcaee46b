"""Workflow graphs as plans: order, layers, lint and node semantics as DataFrame functions."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def topological(nodes: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """Stable order, smallest id first; a cycle is an error."""
    into = dict.fromkeys(nodes, 0)
    out: dict[str, list[str]] = defaultdict(list)
    for a, b in dict.fromkeys(edges):
        into[b] += 1
        out[a].append(b)
    heap = [n for n, k in into.items() if not k]
    heapq.heapify(heap)
    order = []
    while heap:
        n = heapq.heappop(heap)
        order.append(n)
        for m in out[n]:
            into[m] -= 1
            if not into[m]:
                heapq.heappush(heap, m)
    if len(order) < len(nodes):
        raise ValueError("the graph has a cycle")
    return order


def layers(nodes: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """Nodes by the length of the longest path to them."""
    level = dict.fromkeys(nodes, 0)
    for n in topological(nodes, edges):
        for a, b in edges:
            if a == n:
                level[b] = max(level[b], level[n] + 1)
    return [sorted(n for n in nodes if level[n] == k) for k in range(max(level.values(), default=-1) + 1)]


def layers_table(nodes: DataFrame, edges: DataFrame, depth: int = 64) -> DataFrame:
    """(id, level) as joins, for graphs kept as tables; more levels than ``depth`` are an error (a cycle)."""
    from tessera.session import durable

    level = nodes.select("id", F.lit(0).alias("level"))
    for k in range(1, depth + 1):
        step = edges.join(level.where(F.col("level") == k - 1).withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        new = durable(level.join(step.withColumn("_n", F.lit(k)), "id", "left").select("id", F.coalesce("_n", "level").alias("level")), "layers")
        if new.where(F.col("level") == k).isEmpty():
            return new
        level = new
    raise ValueError("the graph has a cycle or more levels than allowed")


def lint(nodes: list[dict], edges: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(severity, rule, node), sorted: unreachable nodes, dead ends, branches that could run side by side, repeated equal calls, loops without bound."""
    ids = [n["id"] for n in nodes]
    kind = {n["id"]: n.get("type", "") for n in nodes}
    out: list[tuple[str, str, str]] = []
    heads, tails = {b for _, b in edges}, {a for a, _ in edges}
    for n in ids:
        if n not in heads and kind[n] != "start":
            out.append(("warning", "unreachable", n))
        if n not in tails and kind[n] not in ("end", "answer"):
            out.append(("info", "dead-end", n))
    for row in layers(ids, edges):
        slow = [n for n in row if kind[n] in ("llm", "http", "retrieval")]
        if len(slow) > 1:
            out.append(("info", "parallel", slow[0]))
    seen: dict = {}
    for n in nodes:
        key = (n.get("type"), str(sorted(n.get("data", {}).items())))
        if n.get("data") and key in seen:
            out.append(("info", "cache", n["id"]))
        seen.setdefault(key, n["id"])
        if n.get("type") == "loop" and not 0 < int(n.get("data", {}).get("max", 0)) <= 100:
            out.append(("error", "unbounded-loop", n["id"]))
    return sorted(out)


CONDITIONS: dict[str, Callable[[Column, object], Column]] = {
    "==": lambda c, v: c.eqNullSafe(F.lit(v)), "is": lambda c, v: c.eqNullSafe(F.lit(v)), "!=": lambda c, v: ~c.eqNullSafe(F.lit(v)), "is not": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "<": lambda c, v: c < v, ">": lambda c, v: c > v, "<=": lambda c, v: c <= v, ">=": lambda c, v: c >= v,
    "contains": lambda c, v: c.contains(v), "not contains": lambda c, v: ~c.contains(v), "start with": lambda c, v: c.startswith(v), "end with": lambda c, v: c.endswith(v),
    "empty": lambda c, v: c.isNull() | (c.cast("string") == ""), "not empty": lambda c, v: c.isNotNull() & (c.cast("string") != ""),
}


_SAME = {"is": "==", "equals": "==", "=": "==", "is not": "!=", "≥": ">=", "≤": "<="}


def condition(c: Column, op: str, value=None) -> Column:
    """A branch condition; comparisons of size take both sides as numbers, an unknown operator compares for equality, null is false."""
    op = _SAME.get(op, op)
    if op in (">", "<", ">=", "<="):
        x, y = c.cast("string").try_cast("double"), F.lit(value).cast("string").try_cast("double")
        return F.coalesce({">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[op], F.lit(False))
    return F.coalesce(CONDITIONS.get(op, CONDITIONS["=="])(c, value), F.lit(False))


def branch(df: DataFrame, cases: list[tuple[Column, Callable[[DataFrame], DataFrame]]], otherwise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each row goes through the first branch whose condition holds; every branch sees its own rows only."""
    left = F.lit(True)
    parts = []
    for when, run in cases:
        hit = F.coalesce(when, F.lit(False))
        parts.append(run(df.where(left & hit)))
        left = left & ~hit
    parts.append(otherwise(df.where(left)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def first_produced(*cols: str) -> Column:
    """Variable aggregation: the first value that is not null; '' counts."""
    return F.coalesce(*[F.col(c) for c in cols])


def assign(c: Column, op: str, value: Column | None = None, kind: str | None = None) -> Column:
    """Assigner operations on a variable; ``kind`` is its type (string, double, boolean, array<...>, map<...>), which clearing and adding to null need."""
    number = lambda x: x.cast("string").try_cast("double")
    array = (kind or "").startswith("array")
    empty = F.array() if array or kind is None else F.create_map() if kind.startswith("map") else F.lit({"string": "", "boolean": False}.get(kind, 0))
    empty = empty.cast(kind) if kind else F.lit(None)
    held = F.coalesce(c, empty) if array else c
    ops = {
        "over-write": lambda: value, "set": lambda: value, "clear": lambda: empty, "append": lambda: F.array_append(held, value), "extend": lambda: F.concat(held, value),
        "remove-first": lambda: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), "remove-last": lambda: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))),
        "+=": lambda: number(c) + number(value), "-=": lambda: number(c) - number(value), "*=": lambda: number(c) * number(value), "/=": lambda: F.try_divide(number(c), number(value)),
    }
    if op not in ops:
        raise ValueError(f"unknown operation {op}")
    return ops[op]()


def iterate(items: Column, body: Callable[[Column], Column]) -> Column:
    """The body over every element, in order."""
    return F.transform(items, body)


def loop(start: Column, step: Callable[[Column], Column], done: Callable[[Column], Column], rounds: int = 100) -> Column:
    """The body at most ``rounds`` times; whether to stop is tested after it."""
    if not 0 < rounds <= 100:
        raise ValueError("between 1 and 100 rounds")
    first = F.struct(start.alias("v"), F.lit(False).alias("stop"))
    run = lambda acc, _: F.when(acc["stop"], acc).otherwise(F.struct(step(acc["v"]).alias("v"), F.coalesce(done(step(acc["v"])), F.lit(False)).alias("stop")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, run, lambda acc: acc["v"])


def render(template: str) -> Column:
    """{{name}} placeholders filled from columns, null as ''."""
    import re

    parts = re.split(r"\{\{\s*#?([\w.]+)#?\s*\}\}", template)
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])
