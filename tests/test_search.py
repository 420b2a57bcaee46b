"""Searches that keep the best rows only: against the scores of all pairs, and without a shuffle of pairs."""

import random

import pytest

from tessera.operators import chunking, post, retrieval, search
from tessera.plans import corpus, more

SMALL = "/root/testdata/sf0.001"
SEARCHES = [
    corpus.multi_library_rrf,
    corpus.bm25_multiquery_topk,
    corpus.hybrid_rrf_topk,
    corpus.recall_and_mrr,
    corpus.template_confidence,
    corpus.rerank_slots_restricted,
    corpus.mmr_select,
    corpus.compress_extractive,
    corpus.lost_in_the_middle,
    corpus.relevance_grade,
    more.snippet_fusion,
    more.narrative_answers,
    more.corrective_retrieval,
    more.postprocessor_chain,
]


def rows(df):
    return sorted((r.query_id, r.id, r.score, r["rank"]) for r in df.collect())


def joins_terms(df):
    """Is a word joined with the queries that ask for it?"""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any("Join" in line and "term#" in line for line in plan.splitlines())


def test_bm25_top_equals_all_pairs(spark):
    pick = random.Random(7)
    some = lambda n: " ".join(pick.choice("alpha beta gamma delta eins zwei 保费收入 承保 x1 x2 x3 x4".split()) for _ in range(n))
    docs = [(f"d{pick.randrange(10**9):09}", some(pick.randrange(0, 9))) for _ in range(2000)]
    docs += [("none", None), (None, "alpha beta")]
    asked = [(i, some(pick.randrange(0, 5)) + (" unknown" if i % 3 else "")) for i in range(700)]
    d = spark.createDataFrame(docs, "id string, text string")
    q = retrieval.query_terms(spark.createDataFrame(asked, "id long, text string"), "id", "text")
    want = retrieval.ranked(retrieval.bm25(d, "id", "text", q).where("id is not null"), 7)
    assert rows(search.bm25_top(d, "id", "text", q, 7)) == rows(want)
    assert search.bm25_top(d.where("false"), "id", "text", q, 7).count() == 0
    assert search.bm25_top(d, "id", "text", q.where("false"), 7).count() == 0


def test_more_queries_than_fit_at_once(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERIES", 2)
    d = spark.createDataFrame([("a", "eins zwei"), ("b", "zwei drei")], "id string, text string")
    q = retrieval.query_terms(spark.createDataFrame([(i, "zwei drei" if i % 2 else "eins") for i in range(7)], "id long, text string"), "id", "text")
    got = {r.query_id: r.id for r in search.bm25_top(d, "id", "text", q, 1).collect()}
    assert got == {i: "b" if i % 2 else "a" for i in range(7)}


@pytest.mark.parametrize("search_query", SEARCHES)
def test_shuffles_no_pairs(spark, search_query):
    assert not joins_terms(search_query(spark, SMALL))


def test_segments_need_no_shuffle_of_words(spark):
    df = corpus.semantic_segments(spark, SMALL)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    d = spark.createDataFrame([(1, "a b\n\n a b \nc d\nc d"), (2, None), (3, "x"), (None, "x\ny")], "id long, text string")
    assert sorted((r.id, r.para, r.segment) for r in chunking.semantic_cuts(d, "id", "text").collect()) == [(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 1), (3, 1, 0)]


def test_products_shuffle_no_pairs(spark, monkeypatch):
    df = corpus.sparse_dot_score_all(spark, SMALL)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(search, "PAIRS", 3)
    d = spark.createDataFrame([("q1", "a B a"), ("q1", "b c"), ("x", "b\n-b"), (None, "a"), (None, "A 7"), ("q2", None), ("q3", "7"), ("z", "保费"), ("q4", "d")], "id string, text string")
    want = {("q1", "q1"): 9.0, ("q1", "x"): 4.0, ("q1", None): 4.0, ("q3", None): 1.0, ("q3", "q3"): 1.0, ("q4", "q4"): 1.0}
    for most in (200_000, 2):
        monkeypatch.setattr(search, "QUERIES", most)
        got = [((r.query_id, r.id), r.score) for r in search.products(d, "id", "text", d["id"].startswith("q")).collect()]
        assert len(got) == len(want) and dict(got) == want
    assert search.products(d, "id", "text", d["id"] == "none").count() == 0


@pytest.mark.parametrize("search_query", [corpus.mmr_select, corpus.compress_extractive, corpus.relevance_grade])
def test_only_found_texts_leave_their_scan(spark, search_query):
    assert "LeftSemi" in search_query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_with_texts_is_a_join_by_id(spark, monkeypatch):
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, None, 2), (3, "gone", 1)], "query_id long, id string, rank long")
    t = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z"), (None, "n"), ("c", "w")], "id string, text string")
    for most in (post.FOUND, 1):
        monkeypatch.setattr(post, "FOUND", most)
        got = sorted((x.query_id, x.id, x["rank"], x.text) for x in post.with_texts(r, t).collect())
        assert got == [(1, "a", 1, "x"), (1, "b", 2, "y"), (1, "b", 2, "z"), (2, "a", 1, "x")]
