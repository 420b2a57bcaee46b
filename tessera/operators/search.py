"""The best rows for many queries by sparse products.

Every task keeps a running list of the k best of each query, so the shuffle holds k rows a query
and task, whatever the number of pairs that share a word. Queries with the same words in the table
are one; those with like words stand in one block, and a block multiplies by its own words only.
Ids are taken to be unique.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import durable, spread, width

K1, B = 1.5, 0.75
LATIN, IDEOGRAPHS = re.compile("[a-z0-9]+"), re.compile("[\u4e00-\u9fff]+")
#: Queries that are sent to the executors at once; more are taken in parts.
QUERIES = 200_000
#: Queries of one matrix product.
BLOCK = 512
#: Rows of the first and of the largest matrix product; each has twice the rows of the one before.
FIRST, MOST = 256, 8192
#: Rows of a result of all pairs that are handed on at once.
PAIRS = 200_000


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Numbers from 0 rounded half up, as SQL does."""
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of every entry of a column of lists, and the entries."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), n), column.flatten()


def _counted(piece: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, tf) of a piece of vectors."""
    row, code = _lists(piece.column("codes"))
    key, tf = np.unique(row.astype(np.int64) * width + code.to_numpy(zero_copy_only=False), return_counts=True)
    return key // width, key % width, tf


def words(low: str) -> list[str]:
    """The tokens of ``functions.text.tokens`` of a text in lower case."""
    out = LATIN.findall(low)
    for run in IDEOGRAPHS.findall(low):
        out += run
        out += map(str.__add__, run, run[1:])
    return out


@functools.lru_cache(1 << 18)
def md5_bucket(token: str, dim: int = 256) -> int:
    """``embedding.bucket`` of a token by md5."""
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim


def coded(docs: DataFrame, id_col: str, text_col: str, codes_of: Callable[[], Callable[[str], int | None]]) -> DataFrame:
    """(id, dl, codes): the number of tokens and the codes, repeats kept, of those that have one by the function that ``codes_of`` makes once in a task."""
    rows = spread(docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codes_of()
        for b in batches:
            n, codes = [], []
            for low in b.column("text").to_pylist():
                w = words(low)
                n.append(len(w))
                codes.append([c for c in map(code, w) if c is not None])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(codes, pa.list_(pa.int32()))], ["id", "dl", "codes"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, dl long, codes array<int>")


def best(vectors: DataFrame, bags: list[tuple], k: int, width: int, weigh: Callable, rate: Callable | None = None) -> DataFrame:
    """(q, id, score): of every task the ``k`` best products of its vectors with each bag ((code, weight), ...), positive ones only, equal ones by id.

    ``weigh`` gives the (row, code, weight) of a piece of ``vectors`` (id, dl, codes; codes below ``width``).
    ``rate`` may put another number in the place of the products, from them, both factors and the numbers q of the block.
    """
    spark = vectors.sparkSession
    n = np.fromiter((len(b) for b in bags), np.int64, len(bags))
    flat = [np.array([x[i] for b in bags for x in b], t) for i, t in ((0, np.int64), (1, float))]
    shared = spark.sparkContext.broadcast((n, *flat))
    rows = vectors.where("id is not null").repartition(spark.sparkContext.defaultParallelism).sortWithinPartitions("id")
    schema = f"q long, id {dict(vectors.dtypes)['id']}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, codes, weights = shared.value
        ends = np.concatenate([[0], np.cumsum(n)])
        blocks = []
        for lo in range(0, len(n), BLOCK):
            hi, (a, z) = min(lo + BLOCK, len(n)), (ends[lo], ends[min(lo + BLOCK, len(n))])
            words, at = np.unique(codes[a:z], return_inverse=True)
            blocks.append((lo, hi, words, at, np.repeat(np.arange(hi - lo), n[lo:hi]), weights[a:z]))
        score, seq, place = np.zeros((len(n), k)), np.full((len(n), k), -1, np.int64), np.full(width, -1)
        ids, seen, size = [], 0, FIRST
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                piece = batch.slice(start, size)
                start, size = start + piece.num_rows, min(MOST, 2 * size)
                ids.append(piece.column("id"))
                row, code, w = weigh(piece)
                for lo, hi, words, at, who, qw in blocks:
                    place[:] = -1
                    place[words] = np.arange(len(words))
                    col = place[code]
                    hit = col >= 0
                    has = np.zeros(piece.num_rows, bool)
                    has[row[hit]] = True
                    used = np.flatnonzero(has)
                    if not len(used):
                        continue
                    d, q = np.zeros((len(used), len(words))), np.zeros((len(words), hi - lo))
                    d[(np.cumsum(has) - 1)[row[hit]], col[hit]] = w[hit]
                    q[at, who] = qw
                    s = d @ q
                    if rate:
                        s = rate(s, d, q, slice(lo, hi))
                    least = score[lo:hi, -1]  # rows come by id, so a later one of equal score is behind
                    i, j = np.divmod(np.flatnonzero((s > least + 4e-7).ravel()), hi - lo)
                    v = rounded(s[i, j], 6)
                    more = v > least[j]
                    i, j, v = i[more], j[more], v[more]
                    if not len(i):
                        continue
                    open_ = np.unique(j)
                    old = seq[lo + open_] >= 0
                    whose = np.concatenate([np.repeat(open_, k)[old.ravel()], j])
                    v = np.concatenate([score[lo + open_][old], v])
                    number = np.concatenate([seq[lo + open_][old], seen + used[i]])
                    o = np.lexsort((number, -v, whose))
                    whose, v, number = whose[o], v[o], number[o]
                    step = np.arange(len(o))
                    first = np.concatenate([[True], whose[1:] != whose[:-1]])
                    rank = step - np.maximum.accumulate(np.where(first, step, 0))
                    kept = rank < k
                    score[lo + open_], seq[lo + open_] = 0, -1
                    score[lo + whose[kept], rank[kept]], seq[lo + whose[kept], rank[kept]] = v[kept], number[kept]
                seen += piece.num_rows
        q, r = np.nonzero(seq >= 0)
        if not len(q):
            return
        names = pa.chunked_array(ids)
        for a in range(0, len(q), 100_000):
            x, y = q[a : a + 100_000], r[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x), names.take(pa.array(seq[x, y])).combine_chunks(), pa.array(score[x, y])], ["q", "id", "score"])

    return rows.mapInArrow(run, schema)


def _bags(table: pa.Table, code: Callable[[list], list], extra: Callable[[int], tuple] = lambda n: ()) -> tuple[list[tuple], list[tuple]]:
    """The different bags ((code, weight), ...) in order, and (q, query_id) for every query of (query_id, term, weight)."""
    of: dict = {}
    terms = table.column("term").to_pylist()
    for who, c, w in zip(table.column("query_id").to_pylist(), code(terms), table.column("w").to_pylist()):
        got = of.setdefault(who, [0, []])
        got[0] += 1
        if c is not None:
            got[1].append((c, w))
    keys = {who: (tuple(sorted(x)), *extra(n)) for who, (n, x) in of.items() if x}
    bags = sorted(set(keys.values()))
    number = {b: i for i, b in enumerate(bags)}
    return bags, [(number[b], who) for who, b in keys.items()]


def _labelled(part: DataFrame, labels: list[tuple], kind: str, k: int) -> DataFrame:
    from tessera.operators.retrieval import ranked

    label = part.sparkSession.createDataFrame(labels, f"q long, query_id {kind}")
    return ranked(part, k, key="q").join(F.broadcast(label), "q").select("query_id", "id", "score", "rank")


def _in_parts(terms: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` of all queries, in parts where there are more than ``QUERIES``."""
    n = terms.select("query_id").distinct().count()
    parts = -(-n // QUERIES)
    if parts <= 1:
        return search(terms)
    bucket = F.pmod(F.xxhash64("query_id"), F.lit(2 * parts))
    out = [search(terms.where(bucket == i)) for i in range(2 * parts)]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


class Index:
    """Texts as codes of the words some query asks for, with the statistics of BM25; written once, as they are read again."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> None:
        wanted = terms.select("term").distinct().toArrow().column("term").to_pylist()
        held = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(wanted)})
        self.rows = durable(coded(docs, id_col, text_col, lambda: held.value.get), "codes")
        total = self.rows.agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).first()
        df = {r.code: r.n for r in self.rows.select(F.explode(F.array_distinct("codes")).alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()}
        # The commonest word has code 0: queries of one wording, sorted by their codes, stand together.
        by = sorted(df, key=lambda c: (-df[c], c))
        self.code = {wanted[c]: i for i, c in enumerate(by)}
        self.width = len(by)
        self.renumber = np.full(len(wanted), 0, np.int64)
        self.renumber[by] = np.arange(len(by))
        counts = np.array([df[c] for c in by], float)
        self.idf = np.log(1 + (total.n - counts + 0.5) / (counts + 0.5))
        self.mean = (total.dl or 0) / max(total.n, 1)

    def weigh(self) -> Callable:
        renumber, idf, mean, wide = self.renumber, self.idf, self.mean, len(self.renumber)

        def run(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            row, code, tf = _counted(piece, max(wide, 1))
            code, dl = renumber[code], piece.column("dl").to_numpy()[row]
            return row, code, idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))

        return run


def bm25_top(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best of ``retrieval.bm25`` for the (query_id, term, qtf) of every query."""

    def searched(asked: DataFrame) -> DataFrame:
        index = Index(docs, id_col, text_col, asked)
        bags, labels = _bags(asked.select("query_id", "term", F.col("qtf").cast("double").alias("w")).toArrow(), lambda t: [index.code.get(x) for x in t])
        part = best(index.rows, [b for b, *_ in bags], k, index.width, index.weigh())
        return _labelled(part, labels, dict(terms.dtypes)["query_id"], k)

    return _in_parts(terms, searched)


def confidence_top(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, k: int, cap: float) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best by 0.62 of the share of a query's different words and 0.38 of the BM25 score against the best one, at most ``cap`` with fewer than two common words."""

    def searched(asked: DataFrame) -> DataFrame:
        index = Index(docs, id_col, text_col, asked)
        bags, labels = _bags(asked.select("query_id", "term", F.col("qtf").cast("double").alias("w")).toArrow(), lambda t: [index.code.get(x) for x in t], lambda n: (n,))
        plain, size = [b for b, _ in bags], np.array([n for _, n in bags], float)
        top = np.ones(len(bags))
        for r in best(index.rows, plain, 1, index.width, index.weigh()).groupBy("q").agg(F.max("score").alias("top")).collect():
            top[r.q] = r.top
        shared = docs.sparkSession.sparkContext.broadcast((size, top))

        def rate(s: np.ndarray, d: np.ndarray, q: np.ndarray, which: slice) -> np.ndarray:
            size, top = (x[which] for x in shared.value)
            s = rounded(s, 6)
            common = (d > 0).astype(float) @ (q > 0).astype(float)
            out = rounded(np.minimum(1.0, 0.62 * common / size + 0.38 * s / top), 4)
            return np.where(s > 0, np.where(common < 2, np.minimum(out, cap), out), 0.0)

        return _labelled(best(index.rows, plain, k, index.width, index.weigh(), rate), labels, dict(terms.dtypes)["query_id"], k)

    return _in_parts(terms, searched)


def bag_top(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, query_col: str, query_text: str, k: int, dim: int = 256, algorithm: str = "md5") -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best cosines above 0 of the hash-bag vectors of ``embedding``."""

    def buckets() -> Callable[[str], int]:
        if algorithm == "md5":
            return lambda t: md5_bucket(t, dim)
        return functools.lru_cache(1 << 18)(lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % dim)

    def weigh(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, code, tf = _counted(piece, dim)
        norm = np.sqrt(np.bincount(row, tf * tf, piece.num_rows))
        return row, code, tf / norm[row]

    if algorithm not in ("md5", "blake2b"):
        raise ValueError("algorithm is md5 or blake2b")
    vectors = coded(docs, id_col, text_col, buckets)

    def searched(asked: DataFrame) -> DataFrame:
        counts = asked.select("query_id", F.explode("codes").alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("double").alias("w"))
        bags, labels = _bags(counts.toArrow(), lambda t: t)
        units = [tuple((c, w / sum(x * x for _, x in b) ** 0.5) for c, w in b) for b, in bags]
        return _labelled(best(vectors, units, k, dim, weigh), labels, dict(asked.dtypes)["query_id"], k)

    asked = coded(queries, query_col, query_text, buckets).where("id is not null").withColumnRenamed("id", "query_id")
    return _in_parts(asked, searched)


def products(docs: DataFrame, id_col: str, text_col: str, asked: Column) -> DataFrame:
    """(query_id, id, score): products of the counts of Latin words and numbers of every text that ``asked`` picks with those of every text that shares one; texts of one id are one.

    The pairs are made where the texts are read: a text adds up the lists of the queries that have its words, and no pair is shuffled.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    low = F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text")
    # No word runs over the end of a line.
    whole = docs.select(F.col(id_col).alias("id"), low).repartition(width(spark), "id").groupBy("id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))

    def searched(part: DataFrame) -> DataFrame:
        table, bags, code = part.toArrow(), {}, {}
        for who, text in zip(table.column("query_id").to_pylist(), table.column("text").to_pylist()):
            bags.setdefault(who, Counter()).update(LATIN.findall(text))
        entries = np.array([(code.setdefault(t, len(code)), i, n) for i, b in enumerate(bags.values()) for t, n in b.items()], np.int64).reshape(-1, 3)
        entries = entries[np.argsort(entries[:, 0], kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(entries[:, 0], minlength=len(code)))])
        shared = spark.sparkContext.broadcast((list(bags), code, ends, entries[:, 1].copy(), entries[:, 2].astype(float)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, code, ends, who, w = shared.value
            names = None if not names else pa.array(names)
            for b in batches:
                found, n = [], 0
                for i, text in enumerate(b.column("text").to_pylist()):
                    bag = Counter(c for c in map(code.get, LATIN.findall(text)) if c is not None)
                    if bag:
                        at = np.concatenate([who[ends[c] : ends[c + 1]] for c in bag])
                        s = np.bincount(at, np.concatenate([w[ends[c] : ends[c + 1]] * tf for c, tf in bag.items()]))
                        q = np.flatnonzero(s)
                        found.append((q, np.full(len(q), i), s[q]))
                        n += len(q)
                    if found and (n >= PAIRS or i == b.num_rows - 1):
                        q, row, s = map(np.concatenate, zip(*found))
                        found, n = [], 0
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), b.column("id").take(pa.array(row)), pa.array(s)], ["query_id", "id", "score"])

        return whole.mapInArrow(run, f"query_id {kind}, id {kind}, score double")

    return _in_parts(docs.where(asked).select(F.col(id_col).alias("query_id"), low).where("query_id is not null"), searched)
