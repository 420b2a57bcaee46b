"""Queries of question answering, workflows and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text, vectors
from tessera.operators import facts, qa, retrieval, workflow
from tessera.session import shared_dir, table
from tessera.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Most synonyms a vocabulary may have to be sent to the executors.
VOCABULARY = 100_000


def _vocabulary(df: DataFrame) -> dict[str, str]:
    """word -> code of a dimension table (word, code); refuses more than ``VOCABULARY`` rows."""
    rows = df.limit(VOCABULARY + 1).collect()
    if len(rows) > VOCABULARY:
        raise ValueError("the vocabulary is not of dimension size")
    return {r[0]: r[1] for r in rows if r[0]}


def _intents(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "metric_def")
    words = m.select(F.col("name_en").alias("w"), "metric_code").union(m.select("name_zh", "metric_code")).union(m.select("metric_code", "metric_code"))
    metrics = _vocabulary(words)
    entities = _vocabulary(table(s, d, "qa_golden_set").select("scope", F.col("scope").alias("c")).where("scope is not null").distinct())
    q = table(s, d, "qa_golden_set")
    i = qa.intent(F.col("question"), F.col("reference_date"), metrics, entities, {"agency": "AGENCY", "broker": "BROKER", "direct": "DIRECT"}, {"Norvik": "NORVIK"})
    return q.select("id", "reference_date", "scope", i.alias("i"))


@query()
def parse_intent(s: SparkSession, d: str) -> DataFrame:
    """Slots and route of every question."""
    i = F.col("i")
    return _intents(s, d).select(
        "id", F.array_join(i["metrics"], "|").alias("metrics"), F.array_join(i["entities"], "|").alias("entities"), F.array_join(F.transform(i["periods"], lambda p: F.concat(p["period_type"], p["period"])), "|").alias("periods"), i["channel"].alias("channel"), i["route"].alias("route")
    )


@query()
def answer_questions(s: SparkSession, d: str) -> DataFrame:
    """Every question answered from the newest visible facts, or refused."""
    f = table(s, d, "fact_metric").select("fact_id", *facts.KEY, "value", "unit", "source_doc_id", "review_status", "ingested_at")
    return qa.answer(_intents(s, d), facts.last_wins(f, ["ingested_at", "fact_id"]), "ORL_GROUP")


@query(
    """WITH t AS (SELECT user_id AS conv_id, event_id AS turn, CASE WHEN event_id % 3 = 0 THEN event_type END AS entity, CASE WHEN event_id % 4 = 0 THEN year(ts)::VARCHAR END AS period, event_id % 5 <> 0 AS remembered FROM events)
SELECT conv_id, turn, coalesce(entity, last_value(CASE WHEN remembered THEN entity END IGNORE NULLS) OVER w) AS entity, coalesce(period, last_value(CASE WHEN remembered THEN period END IGNORE NULLS) OVER w) AS period
FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def conversation_carry_forward(s: SparkSession, d: str) -> DataFrame:
    """Slots carried over the turns of a user; value and type of an event stand for slots, a third of the turns states neither."""
    e = table(s, d, "events")
    t = e.select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("entity"), F.when(F.col("event_id") % 4 == 0, F.year("ts").cast("string")).alias("period"), (F.col("event_id") % 5 != 0).alias("remembered")
    )
    return qa.carry_forward(t)


@query(
    """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'n' || c_nationkey, 'o' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey),
 n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), l AS (SELECT id, 0 AS level FROM n UNION SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.id) SELECT id, max(level)::INT AS level FROM l GROUP BY id"""
)
def topo_layers(s: SparkSession, d: str) -> DataFrame:
    """Longest-path levels of the graph region, nation, customer, order with a second way from nation to order."""
    link = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    c, o = table(s, d, "customer"), table(s, d, "orders")
    e = link(table(s, d, "nation"), "r", "n_regionkey", "n", "n_nationkey").unionByName(link(c, "n", "c_nationkey", "c", "c_custkey")).unionByName(link(o, "c", "o_custkey", "o", "o_orderkey"))
    e = e.unionByName(link(o.join(c, F.col("o_custkey") == F.col("c_custkey")), "n", "c_nationkey", "o", "o_orderkey"))
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return workflow.layers_table(nodes, e.distinct())


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'large' WHEN starts_with(o_orderpriority, '1') THEN 'urgent' ELSE 'other' END AS branch, CASE WHEN o_totalprice > 250000 THEN round(o_totalprice / 2, 3) ELSE round(o_totalprice, 3) END AS amount FROM orders")
def workflow_branch_union(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    to = lambda name, k: lambda df: df.select("o_orderkey", F.lit(name).alias("branch"), F.round(F.col("o_totalprice") / k, 3).alias("amount"))
    return workflow.branch(o, [(workflow.condition(F.col("o_totalprice"), ">", 250000), to("large", 2)), (workflow.condition(F.col("o_orderpriority"), "start with", "1"), to("urgent", 1))], to("other", 1))


@query("SELECT o_orderkey, array_to_string(list_transform(list_sort(list(l_linenumber || ':' || round(l_quantity * 2)::INT)), lambda x: '<' || x || '>'), ' ') AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def workflow_iteration(s: SparkSession, d: str) -> DataFrame:
    item = F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.round(F.col("l_quantity") * 2).cast("int").cast("string"))
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("x"))
    lines = lines.join(table(s, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    return lines.select("o_orderkey", F.array_join(workflow.iterate(F.col("x"), lambda x: F.concat(F.lit("<"), x, F.lit(">"))), " ").alias("lines"))


@query(
    """WITH RECURSIVE l AS (SELECT p_partkey, p_size::BIGINT AS v, 1 AS k, FALSE AS stop FROM part UNION ALL SELECT p_partkey, CASE WHEN v % 2 = 0 THEN v // 2 ELSE 3 * v + 1 END, k + 1, (CASE WHEN v % 2 = 0 THEN v // 2 ELSE 3 * v + 1 END) = 1 FROM l WHERE NOT stop AND k <= 20)
SELECT p_partkey, arg_max(v, k)::BIGINT AS v FROM l GROUP BY 1"""
)
def workflow_loop(s: SparkSession, d: str) -> DataFrame:
    """At most twenty steps of the 3n + 1 rule on the size of every part."""
    step = lambda v: F.when(v % 2 == 0, F.floor(v / 2)).otherwise(3 * v + 1).cast("long")
    return table(s, d, "part").select("p_partkey", workflow.loop(F.col("p_size").cast("long"), step, lambda v: v == 1, 20).alias("v"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_window_metrics(s: SparkSession, d: str) -> DataFrame:
    """Daily counts of the event stream, run as a stream over what is there."""
    path = f"{d}/events.parquet"
    schema = s.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = s.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return ingest.run_to_table(ingest.window_metrics(stream), f"{shared_dir(s)}/stream-{uuid.uuid4().hex}")


@query("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts - p >= INTERVAL 30 MINUTE GROUP BY 1")
def session_counts(s: SparkSession, d: str) -> DataFrame:
    """Sessions of a user with gaps below half an hour."""
    e = table(s, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "30 minutes")).count().groupBy("user_id").agg(F.count("*").alias("sessions"))


@query(
    "WITH c AS (SELECT chunk_id, version, ingested_at, text FROM narrative_chunk WHERE text IS NOT NULL) SELECT chunk_id, version, ingested_at, left(regexp_extract(trim(text, ' '), '^[^.!?。！？\\n]*[.!?。！？]?'), 240) AS excerpt FROM c"
)
def leading_excerpt(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "narrative_chunk").where("text is not null").select("chunk_id", "version", "ingested_at", text.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT doc_id, len(s) AS n, s[1] AS first, s[-1] AS last FROM (SELECT doc_id, list_transform(range(0, ((length(text) - 1) // 100)::BIGINT + 1), lambda i: substr(text, (i * 100 + 1)::BIGINT, 100)) AS s FROM documents WHERE length(text) > 0)")
def text_slices(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").where(F.char_length("text") > 0).select("doc_id", text.slices(F.col("text"), 100).alias("x"))
    return x.select("doc_id", F.size("x").cast("long").alias("n"), F.element_at("x", 1).alias("first"), F.element_at("x", -1).alias("last"))


@query(
    """SELECT id, CASE id WHEN 1 THEN '3|1|0|2' WHEN 2 THEN '0|1|2' WHEN 3 THEN '' ELSE '0|2|1' END AS ranks FROM (VALUES (1), (2), (3), (4)) t(id)"""
)
def listwise_parse(s: SparkSession, d: str) -> DataFrame:
    r = s.createDataFrame([(1, "3, 1, 9 and 1", 4), (2, "none", 3), (3, "", 0), (4, "0 2 1", 3)], "id int, r string, n int")
    return r.select("id", F.array_join(text.listwise_order(F.col("r"), F.col("n")).cast("array<string>"), "|").alias("ranks"))


@query(
    """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0),
 a AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))), 6) AS sim FROM s x JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) y ON x.vec_id <> y.vec_id)
SELECT a, b, sim FROM a WHERE sim >= 0.4"""
)
def similarity_links(s: SparkSession, d: str) -> DataFrame:
    """Links of a stated set of vectors to all vectors at a cosine of 0.4 or more."""
    e = table(s, d, "embeddings")
    links = retrieval.vector_links(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding", 0.4)
    return links.where("id <> query_id").select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("score").alias("sim"))


@query("SELECT chunk_id, version, ingested_at, coalesce(nullif(parent_id, ''), chunk_id) AS family, count(*) OVER (PARTITION BY coalesce(nullif(parent_id, ''), chunk_id)) AS n_family FROM narrative_chunk WHERE active = 1")
def children_by_parent(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "narrative_chunk").where("active = 1").withColumn("family", F.coalesce(F.nullif("parent_id", F.lit("")), "chunk_id"))
    n = c.groupBy("family").agg(F.count("*").alias("n_family"))
    return c.join(n, "family").select("chunk_id", "version", "ingested_at", "family", "n_family")


@query("SELECT chunk_id, version, ingested_at, CASE WHEN coalesce(window_text, '') <> '' THEN window_text WHEN coalesce(text, '') <> '' THEN text ELSE '' END AS prompt_text, source_locator AS cited, nullif(parent_locator, '') AS parent_locator FROM narrative_chunk WHERE active = 1 AND upper(coalesce(sensitivity, '')) <> 'RESTRICTED'")
def snippet_projection(s: SparkSession, d: str) -> DataFrame:
    """What goes into a prompt: the window where there is one; the hit's own locator is cited, the parent's stands beside it."""
    c = table(s, d, "narrative_chunk").where("active = 1").where(F.upper(F.coalesce("sensitivity", F.lit(""))) != "RESTRICTED")
    return c.select("chunk_id", "version", "ingested_at", F.coalesce(F.nullif("window_text", F.lit("")), F.nullif("text", F.lit("")), F.lit("")).alias("prompt_text"), F.col("source_locator").alias("cited"), F.nullif("parent_locator", F.lit("")).alias("parent_locator"))


@query("SELECT id, trim(regexp_replace(lower(question), '[?？。.！!]+$', ''), ' ') AS question_key, count(*) OVER (PARTITION BY trim(regexp_replace(lower(question), '[?？。.！!]+$', ''), ' ')) AS n_same FROM qa_golden_set")
def faq_match(s: SparkSession, d: str) -> DataFrame:
    """Questions by their normalised form, as the exact match of an FAQ uses it."""
    k = F.trim(F.regexp_replace(F.lower("question"), "[?？。.！!]+$", ""))
    q = table(s, d, "qa_golden_set").select("id", k.alias("question_key"))
    return q.join(q.groupBy("question_key").agg(F.count("*").alias("n_same")), "question_key").select("id", "question_key", "n_same")
