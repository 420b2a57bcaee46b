"""Queries of the stores and the corpus against brute force on small tables."""

import math
import random
from collections import Counter

from tessera.plans import corpus, stores


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_components_span_files(spark, tmp_path):
    rows = [("a#c1", None, 1), ("a#c2", "a#c1", 1), ("b#c1", "a#c2", 1), ("b#c2", "b#c1", 1), ("c#c1", "gone#c1", 1), ("d#c1", "e#c1", 1), ("e#c1", "d#c1", 1), ("f#c1", "f#c0", 1), ("f#c0", "a#c1", 0), ("a#c2", "a#c1", 1), ("g#c1", "", 1)]
    d = written(spark, tmp_path, "narrative_chunk", rows, "chunk_id string, parent_id string, active int")
    ids = {c for c, _, a in rows if a}
    root = {c: c for c in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for c, p, a in rows:
        if a and p in ids:
            x, y = top(c), top(p)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in stores.connected_components_linked(spark, d).collect()}
    assert got == {c: top(c) for c in ids} and got["b#c2"] == "a#c1"


def test_maxsim_reads_whole_vectors_for_all_queries(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(64)]) for i in range(41)]
    rows[1] = (1, rows[0][1][:48] + [-x for x in rows[0][1][48:]])  # differs from 0 in the last slice only
    d = written(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<double>")
    cut = lambda v: [v[k : k + 16] for k in range(0, 64, 16)]
    cos = lambda a, b: sum(map(lambda x, y: x * y, a, b)) / math.hypot(*a) / math.hypot(*b)
    want = {(q, i): sum(max(cos(x, y) for y in cut(v)) for x in cut(rows[q][1])) for q in (0, 20, 40) for i, v in rows}
    got = {(x.query_id, x.vec_id): x.score for x in corpus.maxsim_score_all(spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want) and got[0, 0] > got[0, 1]


def test_sparse_dot_asks_every_twentieth(spark, tmp_path):
    texts = {"c-00.txt": "a b a", "c-01.txt": "b a", "c-20.txt": "b b c", "c-40.txt": "", "x": "c"}
    d = written(spark, tmp_path, "retrieval_ab_corpus", [(k, v, "en", "E", "G") for k, v in texts.items()], "doc_id string, text string, language string, entity string, geography string")
    bags = {k: Counter(v.split()) for k, v in texts.items()}
    dots = {(q, k): float(sum(n * bags[q][w] for w, n in b.items())) for q in ("c-00.txt", "c-20.txt", "c-40.txt") for k, b in bags.items()}
    assert {(x.query_id, x.doc_id): x.score for x in corpus.sparse_dot_score_all(spark, d).collect()} == {k: v for k, v in dots.items() if v}


def test_cooccurrence_of_names(spark, tmp_path):
    rows = [("d1", "hot", "A"), ("d1", "x", "A"), ("d1", "x", "A"), ("d1", "y", "A"), ("d2", "hot", "A"), ("d2", "x", "B"), ("d3", "hot", "A"), (None, "x", "A"), (None, "y", "A"), ("d3", None, "A")]
    d = written(spark, tmp_path, "graph_entity", rows, "doc_id string, name string, entity_type string")
    assert {tuple(r) for r in stores.cooccurrence_names(spark, d).collect()} == {("hot", "x", 2), ("hot", "y", 1), ("x", "y", 1)}


def test_index_ingest_and_retrieve(spark):
    from tessera.operators import index

    chunks, vectors = spark.createDataFrame([], index.CHUNK), spark.createDataFrame([], "id string, doc_id string, v array<double>")
    docs = spark.createDataFrame([("a", "Cash flow rose.", "INTERNAL"), ("b", "Secret cash plan.", "restricted"), ("c", None, None), ("a", "Cash flow rose.", "INTERNAL")], "doc_id string, text string, sensitivity string")
    chunks, vectors = index.ingest(docs, chunks, vectors)
    assert {(r.chunk_id, r.version, r.active) for r in chunks.collect()} == {("a#c0", 1, 1), ("b#c0", 1, 1)}
    assert {r.id for r in vectors.collect()} == {"a#c0"}
    chunks, vectors = index.ingest(spark.createDataFrame([("a", "Weather was fine.", None)], docs.schema), chunks, vectors)
    assert {(r.chunk_id, r.version, r.active) for r in chunks.collect()} == {("a#c0", 1, 0), ("a#c0", 2, 1), ("b#c0", 1, 1)}
    q = spark.createDataFrame([(1, "weather"), (2, "cash")], "query_id int, question string")
    got = {(r.query_id, r.id, r.filtered) for r in index.retrieve(chunks, q, [("doc_id", "eq", "zzz")]).collect()}
    assert got == {(1, "a#c0", False)}  # nothing among the filtered; the restricted chunk never leaves
    assert index.retrieve(chunks, q, None, mode="economy").count() == 1


def test_in_memory_documents(spark):
    from tessera.sources import files

    docs = files.in_memory(spark, [("a", "x", "one"), ("a", "w", "one"), ("b", "y", b"two")])
    seen = docs.where("source_doc_id = 'b'")
    assert [(r.source_doc_id, r.locator) for r in files.unseen(docs, seen).collect()] == [("a", "w")]


def test_composing(spark):
    from tessera.operators import composing

    q = spark.createDataFrame([(1,), (2,), (1,)], "query_id int")
    hits = spark.createDataFrame([(1, "d1", "t1", 1, "x"), (1, "d2", "t2", 2, "Restricted"), (1, "d1", "t3", 3, None), (1, "d0", None, 4, "x")], "query_id int, doc_id string, text string, rank int, sensitivity string")
    got = {r.query_id: (r.answer, r.sources, r.n_hits) for r in composing.narrative(q, hits).collect()}
    assert got == {1: ("[1] t1\n[2] t3\n[3] ", "d1; d0", 3), 2: ("nothing found", "", 0)}
    assert composing.chain()(q) is q
