"""Filling containers of fixed capacity with texts (problem 9).

Only the histogram of item sizes, at most one entry per size up to the capacity, reaches the
driver. Few-document patterns that fill a container almost exactly are enumerated, their
repeat counts are fitted to the histogram by non-negative least squares, rounded within what
is there, and the residual histogram is packed by best-fitting patterns, each repeated as often
as its sizes allow. The plan is a list of runs (size, rank range, first container), whose
length depends on the capacity and not on the number of items; items find their container by
their rank among items of equal size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import durable, width

CAPACITY = 2048
GRID = (10, 5, 4)
MOST_PATTERNS = 40_000


def _fit(present: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Largest present size within each room, 0 where none is."""
    at = np.searchsorted(present, room, side="right") - 1
    return np.where(at >= 0, present[np.maximum(at, 0)], 0)


def patterns(hist: np.ndarray, capacity: int = CAPACITY, slack: float = 0.01) -> np.ndarray:
    """Patterns as rows of sizes in falling order, padded with 0, that leave at most ``slack`` of a container free."""
    present = np.flatnonzero(hist)
    if not len(present):
        return np.zeros((0, 5), np.int64)
    share = np.cumsum(hist[present]) / hist.sum()
    grids = [np.unique(present[np.minimum(np.searchsorted(share, (np.arange(g) + 0.5) / g), len(present) - 1)]) for g in GRID]
    found = [np.stack([present] + [np.zeros_like(present)] * 4, axis=1)]

    def close(*parts: np.ndarray) -> None:
        room = capacity - sum(parts)
        rows = np.stack([*parts, _fit(present, room), *[np.zeros_like(room)] * (4 - len(parts))], axis=1)
        found.append(rows[room >= 0])

    close(present)
    a, b = np.meshgrid(present, grids[0], indexing="ij")
    close(a.ravel(), b.ravel())
    a, b, c = np.meshgrid(present, grids[1], grids[1], indexing="ij")
    ok = b.ravel() >= c.ravel()
    close(a.ravel()[ok], b.ravel()[ok], c.ravel()[ok])
    a, b, c, e = np.meshgrid(present, grids[2], grids[2], grids[2], indexing="ij")
    ok = (b.ravel() >= c.ravel()) & (c.ravel() >= e.ravel())
    close(a.ravel()[ok], b.ravel()[ok], c.ravel()[ok], e.ravel()[ok])
    rows = np.unique(-np.sort(-np.concatenate(found), axis=1), axis=0)
    total = rows.sum(axis=1)
    rows = rows[(total <= capacity) & (total >= capacity * (1 - slack))]
    return rows[np.argsort(-rows.sum(axis=1), kind="stable")[:MOST_PATTERNS]]


def nnls(rows: np.ndarray, hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 minimising the squared misfit of the patterns' sizes to the histogram (accelerated projected gradient)."""
    n, k = rows.shape
    if not n:
        return np.zeros(0)
    pat = np.repeat(np.arange(n), k)
    size = rows.ravel()
    keep = size > 0
    pat, size = pat[keep], size[keep]
    use = lambda x: np.bincount(size, weights=x[pat], minlength=len(hist))
    back = lambda r: np.bincount(pat, weights=r[size], minlength=n)
    v = np.ones(n)
    for _ in range(20):
        v = back(use(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1.0 / (norm * 1.05)
    x = y = np.zeros(n)
    t = 1.0
    h = hist.astype(float)
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(use(y) - h))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> pd.DataFrame:
    """Runs (size, lo, hi, container, place): items of ``size`` with rank in [lo, hi) go to containers from ``container`` on.

    hist[s] is the number of items of size s, 0 < s <= capacity. ``place`` is where in the container the item starts.
    """
    left = hist.astype(np.int64).copy()
    used = np.zeros_like(left)
    runs: list[tuple[int, int, int, int, int]] = []
    n = 0

    def apply(sizes: list[int], times: int) -> None:
        nonlocal n
        place = 0
        for s in sizes:
            runs.append((s, int(used[s]), int(used[s] + times), n, place))
            used[s] += times
            left[s] -= times
            place += s
        n += times

    def most(sizes: list[int]) -> int:
        return min(int(left[s]) // sizes.count(s) for s in set(sizes))

    rows = patterns(hist, capacity)
    x = nnls(rows, hist)
    for p in np.argsort(-x, kind="stable"):
        if x[p] < 0.05:
            break
        sizes = [int(s) for s in rows[p] if s]
        times = min(int(np.ceil(x[p] - 1e-6)), most(sizes))
        if times > 0:
            apply(sizes, times)
    while left.any():
        present = np.flatnonzero(left)
        first = int(present[-1])
        sizes, room = [first], capacity - first
        while room > 0:
            can = present[(present <= room) & (left[present] > np.array([sizes.count(int(s)) for s in present]))]
            if not len(can):
                break
            second = _fit(can, room - can)
            second = np.where((second == can) & (left[can] < 2 + np.array([sizes.count(int(s)) for s in can])), 0, second)
            second = np.where((second > 0) & (left[second] <= np.array([sizes.count(int(s)) for s in second])), 0, second)
            both = can + second
            big = int(can[-1])
            if room - big < int(can[0]) or both.max() >= room - capacity // 200:
                i = len(both) - 1 - int(both[::-1].argmax())
                sizes += [int(can[i])] + ([int(second[i])] if second[i] else [])
                room = capacity - sum(sizes)
            else:
                sizes.append(big)
                room -= big
        apply(sizes, max(1, most(sizes)))
    return pd.DataFrame(runs, columns=["size", "lo", "hi", "container", "place"])


def assign(counts: DataFrame, capacity: int = CAPACITY, bucket_rows: int = 50_000) -> DataFrame:
    """(id, piece, first_token, n_tokens, container, place) for every row of (id, n_tokens).

    Items above the capacity are cut into full pieces and a rest, all others stay whole. Items
    without tokens (empty and null texts) lie in container 0 and take no space. Every row gets
    its own pieces, repeated ids included. Ranks are taken in hashed buckets of bounded size
    whose offsets come from counts, so equal sizes, however many, are never gathered in one task.
    """
    spark = counts.sparkSession
    c = capacity
    sized = counts.select("id", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n"), F.monotonically_increasing_id().alias("row"))
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("n") / c) - 1))
    items = sized.select("id", "row", "n", F.explode(cut).alias("piece")).select(
        "id", "row", F.col("piece").cast("int").alias("piece"), (F.col("piece") * c).alias("first_token"), F.least(F.col("n") - F.col("piece") * c, F.lit(c)).alias("size")
    )
    items = durable(items, "items")
    by_size = items.where("size > 0").groupBy("size").count().collect()
    hist = np.zeros(c + 1, np.int64)
    for r in by_size:
        hist[r["size"]] = r["count"]
    runs = plan(hist, c).sort_values(["size", "lo"], ignore_index=True)
    buckets = max(width(spark), int(hist.max()) // bucket_rows + 1)
    placed = items.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)))
    ahead = placed.groupBy("size", "bucket").count()
    ahead = ahead.withColumn("ahead", F.sum("count").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    ahead = ahead.select("size", "bucket", F.coalesce("ahead", F.lit(0)).alias("ahead"))
    ranked = placed.join(ahead, ["size", "bucket"]).withColumn("rank", F.col("ahead") + F.row_number().over(Window.partitionBy("size", "bucket").orderBy("row", "piece")) - 1)
    big = np.int64(1) << 40
    shared = spark.sparkContext.broadcast((runs["size"].to_numpy() * big + runs.lo.to_numpy(), runs.lo.to_numpy(), runs.container.to_numpy(), runs.place.to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, lo, container, place = shared.value
        for pdf in batches:
            at = np.searchsorted(key, pdf["size"].to_numpy() * big + pdf["rank"].to_numpy(), side="right") - 1
            yield pd.DataFrame(
                {
                    "id": pdf.id,
                    "piece": pdf.piece,
                    "first_token": pdf.first_token,
                    "n_tokens": pdf["size"],
                    "container": container[at] + pdf["rank"].to_numpy() - lo[at] if len(at) else [],
                    "place": place[at] if len(at) else [],
                }
            )

    kind = dict(items.dtypes)["id"]
    full = ranked.select("id", "piece", "first_token", "size", "rank").mapInPandas(run, f"id {kind}, piece int, first_token long, n_tokens long, container long, place long")
    zero = F.lit(0).cast("long")
    none = items.where("size <= 0").select("id", "piece", "first_token", zero.alias("n_tokens"), zero.alias("container"), zero.alias("place"))
    return full.unionByName(none)
