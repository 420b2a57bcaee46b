"""Operators against hand values."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import periods, text, vectors
from tessera.operators import chunking, evaluation, facts, filters, graph, ledger, post, retrieval


def one(spark, expr, **cols):
    names = ", ".join(f"{k} {v[1]}" for k, v in cols.items())
    return spark.createDataFrame([tuple(v[0] for v in cols.values())], names).select(expr).first()[0]


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t=("Héllo 营业收入 Q3", "string")) == ["h", "llo", "q3", "营", "业", "收", "入", "营业", "业收", "收入"]
    assert one(spark, text.tokens(F.col("t")), t=(None, "string")) == []
    assert one(spark, text.token_set(F.col("t")), t=("A a 营营", "string")) == ["a", "营"]


def test_bm25_hand_value(spark):
    docs = spark.createDataFrame([("d1", "alpha beta alpha"), ("d2", "gamma delta")], "id string, text string")
    q = retrieval.query_terms(spark.createDataFrame([("q", "alpha")], "id string, text string"), "id", "text")
    got = retrieval.bm25(docs, "id", "text", q).collect()
    idf = math.log(1 + (2 - 1 + 0.5) / 1.5)
    assert [(r.id, r.score) for r in got] == [("d1", round(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2.5)), 6))]


def test_rrf_hand_value(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", "x", 1), ("q", "z", 2), ("q", "y", 3)], "query_id string, id string, rank int")
    got = {r.id: r.fused for r in retrieval.rrf([a, b]).collect()}
    assert got == {"x": round(2 / 61, 9), "y": round(1 / 62 + 1 / 63, 9), "z": round(1 / 62, 9)}


def test_vectors(spark):
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=([1.0, 0.0], "array<double>"), b=([1.0, 1.0], "array<double>")) == pytest.approx(0.70710678)
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=([0.0, 0.0], "array<double>"), b=([1.0, 1.0], "array<double>")) == 0.0


def test_filters(spark):
    df = spark.createDataFrame([("10", "a"), ("9", None)], "p string, t string")
    assert filters.apply(df, [("p", "gt", "5")]).count() == 1  # compared as strings
    assert filters.apply(df, [("t", "eq", "")]).count() == 1
    assert filters.apply(df, [("none", "ne", "x")]).count() == 0
    assert filters.apply(df, []).count() == 2
    for bad in (("p", "like", "x"), ("p", "in", "x"), ("p", "between", ["1"])):
        with pytest.raises(ValueError):
            filters.condition(df, *bad)


def test_chunking(spark):
    assert chunking.pack_overlap("") == [] and chunking.pack_overlap(None) == []
    paras = ["a" * 100, "b" * 60, "c" * 60, "d" * 300]
    got = chunking.pack_overlap("\n".join(paras), 240, 80)
    assert [(x[1], x[2]) for x in got] == [(1, 3), (4, 4), (4, 4)]
    assert chunking.pack_overlap("x" * 10 + "\n" + "y" * 10 + "\n" + "z" * 10, 21, 10) == [("x" * 10 + "\n" + "y" * 10, 1, 2), ("y" * 10 + "\n" + "z" * 10, 2, 3)]
    with pytest.raises(ValueError):
        chunking.pack_overlap("x", 10, 10)
    df = spark.createDataFrame([(1, "a\n\nb"), (2, None)], "id int, text string")
    assert [tuple(r) for r in chunking.greedy(df, "id", "text").collect()] == [(1, 0, "a\nb")]


def test_post(spark):
    r = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 6)], "query_id string, id string, rank int")
    assert [x.id for x in post.lost_in_the_middle(r).orderBy("place").collect()] == ["d1", "d3", "d5", "d4", "d2"]
    s = r.withColumn("sensitivity", F.when(F.col("rank") == 2, "RESTRICTED").otherwise("x"))
    judged = spark.createDataFrame([("q", "d5", 1), ("q", "d1", 2)], "query_id string, id string, pos int")
    assert {x.id: x.new_rank for x in post.rerank_slots(s, judged).collect()} == {"d5": 1, "d2": 2, "d1": 3, "d3": 4, "d4": 5}
    t = r.withColumn("text", F.when(F.col("rank") <= 2, "same words here").otherwise(F.concat(F.lit("other "), "id")))
    assert [x.id for x in post.mmr(t, top=2).orderBy("place").collect()][0] == "d1"


def test_periods(spark):
    p = periods.normalize(F.col("t"))
    assert one(spark, p, t=("fy 2024 h1", "string")) == ("HY", "2024H1")
    assert one(spark, p, t=("2024Q5", "string")) is None
    assert one(spark, periods.from_filename(F.col("t")), t=("a_2020_2021.pdf", "string")) == ""


def test_facts_and_ledger(spark):
    f = spark.createDataFrame([("M", "E", "FY", "2020", "T", 1.0, 1), ("M", "E", "FY", "2020", "T", 2.0, 2)], "metric_code string, entity string, period_type string, period string, channel string, value double, n int")
    assert facts.last_wins(f, ["n"]).first().value == 2.0 and facts.first_wins(f, ["n"]).first().value == 1.0
    e = spark.createDataFrame([(1, 1, "note"), (1, 2, "reject"), (1, 3, "approve"), (2, 4, "note")], "item int, seq int, action string")
    assert {r["item"]: r.status for r in ledger.review_state(e, "item", "seq", "action").collect()} == {1: "rejected", 2: "pending"}
    assert ledger.illegal(e, "item", "seq", "action").count() == 1


def test_graph(spark):
    v = spark.createDataFrame([("a", "x"), ("b", "RESTRICTED"), ("c", "x"), ("d", "x")], "id string, sensitivity string")
    e = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("a", "d", "t"), ("d", "a", "t")], "src string, dst string, type string")
    assert [tuple(r) for r in graph.traverse(v, e, v.where("id = 'a'"), 3).collect()] == [("a", "d", 1)]
    assert {r.id: r.component for r in graph.components(e, v).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a"}


def test_evaluation(spark):
    assert one(spark, evaluation.faithfulness(F.col("a"), F.col("s")), a=("资料来源：x\nCats sleep[1]; Dogs fly high!（来源：d1）", "string"), s=("cats sleep all day", "string")) == 0.5
    assert one(spark, evaluation.faithfulness(F.col("a"), F.col("s")), a=("", "string"), s=("x", "string")) == 1.0
    assert one(spark, text.listwise_order(F.col("r"), F.col("n")), r=("2, 0, 9, 2", "string"), n=(4, "int")) == [2, 0, 1, 3]


def test_hash_embedding_and_hybrid(spark):
    import hashlib

    from tessera.operators import embedding

    docs = spark.createDataFrame([("a", "cash flow cash"), ("b", "weather report"), ("c", ""), ("d", None)], "id string, text string")
    for algorithm in ("md5", "blake2b"):
        v = {r.id: r.v for r in embedding.embed(docs, "id", "text", 16, algorithm).collect()}
        assert abs(sum(x * x for x in v["a"]) - 1) < 1e-9 and sum(v["c"]) == 0 and sum(v["d"]) == 0 and len(v["a"]) == 16
    at = int.from_bytes(hashlib.blake2b(b"cash", digest_size=8).digest(), "big") % 16
    assert {r.bucket for r in embedding.weights(docs.where("id = 'a'"), "id", "text", 16, "blake2b").collect()} >= {at}
    q = spark.createDataFrame([(1, "cash"), (2, "nothing here"), (3, None)], "query_id int, question string")
    got = [(r.query_id, r.id, r["rank"]) for r in embedding.hybrid(docs, "id", "text", q, "query_id", "question").collect() if r.query_id == 1]
    assert got[0] == (1, "a", 1)


def test_gates(spark):
    from tessera.operators import gates

    df = spark.createDataFrame([(1, "How is JING  CHENG doing?"), (2, "how are we"), (3, None), (4, "jingcheng china")], "id int, q string")
    alias = {"jing cheng": "Jingcheng", "jing cheng china": "Jingcheng China"}
    got = {r.id: (r.e, r.m) for r in df.select("id", gates.outside(F.col("q"), alias).alias("e"), gates.masked(F.col("q"), alias).alias("m")).collect()}
    assert got[1] == ("Jingcheng", "how is            doing?") and got[2] == (None, "how are we") and got[3] == (None, None) and got[4][0] == "Jingcheng China"
    v = df.limit(1).select(gates.rewrite(F.lit("Revenue in cn, concern"), [{"revenue": "REV", "sales": "REV"}, {"cn": "CN"}]).alias("v")).first().v
    assert v == ["Revenue in cn, concern", "REV in cn, concern", "Revenue in CN, concern", "sales in cn, concern"]
    items = spark.createDataFrame([("1", "What is IFRS?", "a", True, "2024-01-01", None, "INTERNAL"), ("2", "what  is ifrs?", "b", True, None, "soon", None), ("3", "Who?", "c", True, None, None, " Restricted "), ("4", "Why?", "d", False, None, None, None), ("5", "How?", "e", True, "2025-01-01", "2025-12-31", None)], "item_id string, question string, answer string, enabled boolean, valid_from string, valid_until string, sensitivity string")
    asked = spark.createDataFrame([(i, q, "2025-06-01", s, x) for i, (q, s, x) in enumerate([("WHAT IS IFRS?", False, None), ("who?", False, None), ("why?", False, None), ("how? ", False, None), ("how?", True, None), ("how?", False, "X"), ("how currently?", False, None)])], "id int, question string, reference_date string, slots boolean, external string").withColumn("reference_date", F.to_date("reference_date"))
    assert [tuple(r) for r in gates.faq(asked, items).collect()] == [(3, "5", "e")]  # a bound that is no date is never met


def test_corrective_first_passing(spark):
    from tessera.operators import gates

    q = spark.createDataFrame([("a", ["x", "x", "y"]), ("b", ["z"]), ("c", []), ("d", ["w"])], "query_id string, words array<string>")
    texts = spark.createDataFrame([("1", ["y"]), ("2", ["x"]), ("3", ["z", "q"])], "id string, words array<string>")
    hit = "query_id string, id string, rank int"
    one = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1)], hit)
    two = spark.createDataFrame([("a", "2", 1), ("b", "3", 1)], hit)
    got = sorted((r.query_id, r.stage, r.grade, r.id) for r in gates.first_passing(q, [one, two], texts).collect())
    assert got == [("a", 1, 0.666667, "2"), ("b", 1, 1.0, "3"), ("c", 0, 1.0, "1")]


def test_grids(spark):
    from tessera.operators import grids

    cells = [("s", 1, 2, "FY2023"), ("s", 1, 3, "2024H1"), ("s", 2, 1, "Revenue (US$m)"), ("s", 2, 2, "1,200"), ("s", 2, 3, "n/a"), ("s", 3, 1, "Other"), ("s", 3, 2, "5"), ("t", 1, 2, "Revenue"), ("t", 2, 1, "2024 Q1"), ("t", 2, 2, "7%"), ("u", 1, 1, None)]
    df = spark.createDataFrame([(*c, "clash") for c in cells], "sheet string, row int, col int, text string, label string")
    words = spark.createDataFrame([("revenue", "REV")], "word string, metric_code string")
    assert {tuple(r) for r in grids.facts(df, words).collect()} == {("s", 2, 2, "REV", "FY", "2023", 1200.0), ("t", 2, 2, "REV", "QUARTER", "2024Q1", 7.0)}
    assert {r.sheet: r.has_data for r in grids.candidates(df, words).collect()} == {"s": True, "t": True, "u": False}
    a = spark.createDataFrame([("AB12",), ("r3c28",), ("?",)], "c string").select(grids.a1(F.col("c")).alias("x")).collect()
    assert [tuple(r.x) for r in a[:2]] == [(12, 28), (3, 28)]
    assert grids.facts(df.limit(0), words).count() == 0


def test_relative_periods(spark):
    import datetime

    from tessera.functions import periods

    words = ["去年上半年", "上半年", "上个季度", "前年", "明年上半年", "x", None]
    df = spark.createDataFrame([(w, datetime.date(2025, 2, 1)) for w in words], "w string, d date")
    got = [r.p and tuple(r.p) for r in df.select(periods.relative(F.col("w"), F.col("d")).alias("p")).collect()]
    assert got == [("HY", "2024H1"), ("HY", "2025H1"), ("QUARTER", "2024Q4"), ("FY", "2023"), None, None, None]


def test_vectors_and_presets(spark):
    import pytest

    from tessera.operators import chunking, vectors

    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, m string")
    new = spark.createDataFrame([(2, "c"), (4, "d")], "id int, m string")
    assert {tuple(r) for r in vectors.upsert(old, new, "id").collect()} == {(1, "a"), (2, "c"), (3, None), (4, "d")}
    assert {r.id for r in vectors.delete_where(old, {"m": "a"}).collect()} == {2, 3}
    with pytest.raises(ValueError):
        vectors.delete_where(old, {})
    lines = ["# A", "第三章 总则", "1. Scope", "一、范围", "IV) X", "Outlook", "第五条 内容", "Q: why", "Really?", "A long line that has no stop but many words in it"]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    got = {p: [r.h for r in df.select(chunking.heading(F.col("t"), p).alias("h")).collect()] for p in ("layout", "laws", "book", "qa")}
    assert got["layout"] == [True] * 5 + [True, True, False, False, False]
    assert got["laws"] == [True] * 5 + [False, True, False, False, False] and got["book"] == [True] * 5 + [False] * 5
    assert got["qa"] == [False] * 7 + [True, True, False]
