"""Queries of the fact store, the graph, the ledgers and the star schema facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import facts, graph, ledger
from tessera.operators.filters import visible
from tessera.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


K = "metric_code, entity, period_type, period, channel"
_ORDER = ["ingested_at", "fact_id"]


def _facts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "fact_metric")


@query(f"SELECT {K}, fact_id, value, unit, review_status FROM fact_metric QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY ingested_at DESC, fact_id DESC) = 1")
def fact_upsert_last_wins(s: SparkSession, d: str) -> DataFrame:
    """Late rows upserted over early ones."""
    f = _facts(s, d).select("fact_id", *facts.KEY, "value", "unit", "review_status", "ingested_at")
    return facts.last_wins(f, _ORDER).select(*facts.KEY, "fact_id", "value", "unit", "review_status")


@query(f"SELECT {K}, fact_id, value, unit FROM fact_metric QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY ingested_at, fact_id) = 1")
def fact_dedupe_first_wins(s: SparkSession, d: str) -> DataFrame:
    f = _facts(s, d).select("fact_id", *facts.KEY, "value", "unit", "ingested_at")
    return facts.first_wins(f, _ORDER).select(*facts.KEY, "fact_id", "value", "unit")


@query(
    f"""WITH b AS (SELECT *, (source_doc_id LIKE '%Databook%')::INT AS batch FROM fact_metric)
SELECT {K}, fact_id, value, unit FROM b QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY batch DESC, ingested_at DESC, fact_id DESC) = 1"""
)
def fact_upsert_batches(s: SparkSession, d: str) -> DataFrame:
    """The databook's facts upserted over all others."""
    f = _facts(s, d).select("fact_id", *facts.KEY, "value", "unit", "source_doc_id", "ingested_at")
    book = F.col("source_doc_id").contains("Databook")
    return facts.upsert(f.where(~book), f.where(book), _ORDER).select(*facts.KEY, "fact_id", "value", "unit")


@query(
    f"SELECT fact_id, '{{\"channel\":\"' || channel || '\",\"entity\":\"' || entity || '\",\"metric\":\"' || metric_code || '\",\"period\":\"' || period_type || period || '\"}}' AS dim_key FROM fact_metric"
)
def dim_key_json(s: SparkSession, d: str) -> DataFrame:
    return _facts(s, d).select("fact_id", facts.dim_key().alias("dim_key"))


@query("SELECT fact_id, review_status FROM fact_metric WHERE review_status IN ('auto_approved', 'auto', 'approved')")
def fact_visible_only(s: SparkSession, d: str) -> DataFrame:
    return _facts(s, d).where(visible(F.col("review_status"))).select("fact_id", "review_status")


@query("SELECT f.fact_id FROM fact_metric f WHERE f.source_doc_id NOT IN (SELECT doc_id FROM narrative_doc WHERE doc_id LIKE '%.pdf')")
def fact_delete_by_source(s: SparkSession, d: str) -> DataFrame:
    src = table(s, d, "narrative_doc").where(F.col("doc_id").endswith(".pdf")).select(F.col("doc_id").alias("source_doc_id"))
    return facts.delete_by_source(_facts(s, d), src).select("fact_id")


@query(
    f"""WITH l AS (SELECT * FROM fact_metric QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY ingested_at DESC, fact_id DESC) = 1),
 r AS (SELECT DISTINCT metric_code, entity, 'FY' AS period_type, '2020' AS period, 'TOTAL' AS channel FROM fact_metric)
SELECT r.*, l.value, l.unit, l.source_doc_id, CASE WHEN l.fact_id IS NULL THEN 'not_found' ELSE 'found' END AS status FROM r LEFT JOIN l ON l.metric_code = r.metric_code AND l.entity = r.entity AND l.period_type = r.period_type AND l.period = r.period AND l.channel = r.channel AND l.review_status IN ('auto_approved', 'auto', 'approved')"""
)
def fact_point_lookup(s: SparkSession, d: str) -> DataFrame:
    """FY2020 totals of every metric and entity, found or not."""
    last = facts.last_wins(_facts(s, d).select("fact_id", *facts.KEY, "value", "unit", "source_doc_id", "review_status", "ingested_at"), _ORDER)
    r = _facts(s, d).select("metric_code", "entity").distinct().select("metric_code", "entity", F.lit("FY").alias("period_type"), F.lit("2020").alias("period"), F.lit("TOTAL").alias("channel"))
    return facts.lookup(r, last)


_NEWEST = f"SELECT * FROM (SELECT * FROM fact_metric QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY ingested_at DESC, fact_id DESC) = 1) WHERE review_status IN ('auto_approved', 'auto', 'approved')"


def _newest(s: SparkSession, d: str) -> DataFrame:
    """The newest row of every key, if it may be shown."""
    cols = ["fact_id", *facts.KEY, "geography", "value", "unit", "source_doc_id", "source_locator", "review_status", "ingested_at"]
    return facts.last_wins(_facts(s, d).select(*cols), _ORDER).where(visible(F.col("review_status")))


@query(
    f"""WITH l AS (SELECT * FROM ({_NEWEST}) WHERE value IS NOT NULL),
 w AS (SELECT *, lag(value) OVER p AS before, lag(period) OVER p AS before_period FROM l WINDOW p AS (PARTITION BY metric_code, entity, channel, period_type, unit ORDER BY period))
SELECT metric_code, entity, channel, period_type, unit, before_period, period, round(value - before, 4) AS delta, CASE WHEN before <> 0 THEN round((value - before) / before * 100, 4) END AS pct FROM w WHERE before IS NOT NULL"""
)
def period_delta(s: SparkSession, d: str) -> DataFrame:
    """Changes between visible facts of one unit."""
    last = _newest(s, d).where("value is not null")
    return facts.deltas(last).select("metric_code", "entity", "channel", "period_type", "unit", "before_period", "period", "delta", "pct")


@query(
    f"""WITH l AS ({_NEWEST}),
 t AS (SELECT DISTINCT split_part(entity, '_', 2) AS parent, entity AS child FROM fact_metric)
SELECT parent, metric_code, period_type, period, channel, unit, round(sum(value), 4) AS total, count(value) AS n_found, array_to_string(list_sort(list_distinct(list(child))), '|') AS children FROM t LEFT JOIN l ON l.entity = t.child GROUP BY ALL"""
)
def subsidiary_rollup(s: SparkSession, d: str) -> DataFrame:
    """Sums of visible facts over the units of a market (the part of the entity after '_'), every metric, channel, period and unit apart."""
    tree = _facts(s, d).select(F.split_part("entity", F.lit("_"), F.lit(2)).alias("parent"), F.col("entity").alias("child")).distinct()
    return facts.rollup(tree, _newest(s, d), ["channel", "unit"]).withColumn("children", F.array_join("children", "|"))


@query(
    f"""WITH l AS ({_NEWEST}),
 p AS (SELECT DISTINCT entity, split_part(entity, '_', 2) AS geo FROM fact_metric)
SELECT p.geo, p.entity, l.value, l.fact_id IS NOT NULL AS found FROM p LEFT JOIN l ON l.entity = p.entity AND l.metric_code = 'STAFF' AND l.period_type = 'FY' AND l.period = '2021' AND l.channel = 'TOTAL'"""
)
def peer_comparison(s: SparkSession, d: str) -> DataFrame:
    """Staff of all peers in one year from visible facts; misses stay with found = false."""
    last = _newest(s, d).where("metric_code = 'STAFF' and period_type = 'FY' and period = '2021' and channel = 'TOTAL'")
    peers = _facts(s, d).select("entity", F.split_part("entity", F.lit("_"), F.lit(2)).alias("geo")).distinct()
    return peers.join(last.select("entity", "value", "fact_id"), "entity", "left").select("geo", "entity", "value", F.col("fact_id").isNotNull().alias("found"))


@query(
    f"""WITH a AS (SELECT * FROM fact_metric WHERE source_doc_id LIKE '%Databook%' QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY ingested_at DESC, fact_id DESC) = 1),
 b AS (SELECT * FROM fact_metric WHERE source_doc_id NOT LIKE '%Databook%' QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY ingested_at DESC, fact_id DESC) = 1)
SELECT metric_code, entity, period_type, period, channel, a.value AS va, b.value AS vb,
 CASE WHEN a.fact_id IS NOT NULL AND b.fact_id IS NOT NULL THEN CASE WHEN abs(a.value - b.value) <= 0.5 THEN 'agreed' ELSE 'conflict' END WHEN a.fact_id IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS verdict,
 CASE WHEN a.fact_id IS NOT NULL AND b.fact_id IS NOT NULL THEN CASE WHEN abs(a.value - b.value) <= 0.5 THEN 0 ELSE 10 END ELSE 50 END AS priority
FROM a FULL JOIN b USING (metric_code, entity, period_type, period, channel)"""
)
def dual_channel_verify(s: SparkSession, d: str) -> DataFrame:
    """The databook against all other sources."""
    f = _facts(s, d).select("fact_id", *facts.KEY, "value", "source_doc_id", "ingested_at")
    book = F.col("source_doc_id").contains("Databook")
    return facts.verify(facts.last_wins(f.where(book), _ORDER), facts.last_wins(f.where(~book), _ORDER), 0.5)


@query("""WITH g AS (PIVOT (SELECT entity, period, value FROM fact_metric WHERE period_type = 'FY' AND unit = 'PCT') ON period IN ('2019', '2020', '2021') USING max(value) GROUP BY entity)
SELECT entity, period, value FROM (UNPIVOT g ON "2019", "2020", "2021" INTO NAME period VALUE value) WHERE value IS NOT NULL""")
def grid_unpivot(s: SparkSession, d: str) -> DataFrame:
    f = _facts(s, d).where("period_type = 'FY' and unit = 'PCT'")
    grid = f.groupBy("entity").pivot("period", ["2019", "2020", "2021"]).agg(F.max("value"))
    return facts.unpivot(grid, "entity", ["2019", "2020", "2021"])


@query(
    """WITH q AS (SELECT id AS qid, topic, scope, year(reference_date)::VARCHAR AS y FROM qa_golden_set WHERE topic IS NOT NULL AND scope IS NOT NULL)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY i, k) AS ordinal, e AS entity, topic AS metric, p AS period FROM (SELECT *, unnest([scope, 'ORL_GROUP']) AS e, unnest([1, 2]) AS i FROM q), LATERAL (SELECT unnest([y, 'FY' || y]) AS p, unnest([1, 2]) AS k)"""
)
def subtask_expand(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "qa_golden_set").where("topic is not null and scope is not null")
    y = F.year("reference_date").cast("string")
    intents = q.select(F.col("id").alias("qid"), F.array("scope", F.lit("ORL_GROUP")).alias("entities"), F.array("topic").alias("metrics"), F.array(y, F.concat(F.lit("FY"), y)).alias("periods"))
    return facts.expand(intents)


_STAR = """n AS (SELECT n_name AS entity, r_name AS geography, year(l_shipdate)::VARCHAR AS y, (month(l_shipdate) + 5) // 6 AS h, quarter(l_shipdate) AS q, o_orderpriority AS channel, l_extendedprice * (1 - l_discount) AS rev, l_quantity AS qty
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(
    f"""WITH {_STAR}, p AS (SELECT *, 'FY' AS period_type, y AS period FROM n UNION ALL SELECT *, 'HY', y || 'H' || h FROM n UNION ALL SELECT *, 'QUARTER', y || 'Q' || q FROM n)
SELECT entity, geography, period_type, period, coalesce(channel, 'TOTAL') AS channel, round(sum(rev), 2) AS revenue, round(sum(qty), 2) AS quantity FROM p GROUP BY GROUPING SETS ((entity, geography, period_type, period, channel), (entity, geography, period_type, period))"""
)
def facts_build(s: SparkSession, d: str) -> DataFrame:
    """Facts of the star schema by nation, period of three kinds and channel with its total: summed once by quarter, then rolled up, so the large table is shuffled once."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(s, d, "customer").select("c_custkey", "c_nationkey")
    n = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("entity"), F.col("r_name").alias("geography"))
    oc = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    base = li.join(oc, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("entity", "geography", F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"), F.col("o_orderpriority").alias("channel")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"), F.sum("l_quantity").alias("qty")
    )
    y, q = F.col("y").cast("string"), F.col("q")
    kinds = F.array(
        F.struct(F.lit("FY").alias("period_type"), y.alias("period")),
        F.struct(F.lit("HY").alias("period_type"), F.concat(y, F.lit("H"), F.ceil(q / 2).cast("string")).alias("period")),
        F.struct(F.lit("QUARTER").alias("period_type"), F.concat(y, F.lit("Q"), q.cast("string")).alias("period")),
    )
    channels = F.array(F.col("channel"), F.lit("TOTAL"))
    long = base.select("entity", "geography", F.explode(kinds).alias("k"), "channel", "rev", "qty").select("entity", "geography", "k.period_type", "k.period", F.explode(channels).alias("channel"), "rev", "qty")
    return long.groupBy("entity", "geography", "period_type", "period", "channel").agg(F.round(F.sum("rev"), 2).alias("revenue"), F.round(F.sum("qty"), 2).alias("quantity"))


# Graph: regions and nations, entities that share a document, chunk parents.


def _tree(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r, n = table(s, d, "region"), table(s, d, "nation")
    v = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("INTERNAL").alias("sensitivity")).unionByName(
        n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.when(F.col("n_nationkey") % 7 == 3, "RESTRICTED").otherwise("INTERNAL").alias("sensitivity"))
    )
    ring = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("n"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("dst"), F.lit("next").alias("type"))
    e = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"), F.lit("parent_of").alias("type"))
    return v, e.unionByName(ring)


_TREE = """v AS (SELECT 'r' || r_regionkey AS id, 'INTERNAL' AS sens FROM region UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 7 = 3 THEN 'RESTRICTED' ELSE 'INTERNAL' END FROM nation),
 e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'parent_of' AS type FROM nation UNION ALL SELECT 'n' || n_nationkey, 'n' || ((n_nationkey + 1) % 25), 'next' FROM nation),
 o AS (SELECT id FROM v WHERE sens <> 'RESTRICTED')"""


@query(f"WITH {_TREE} SELECT DISTINCT src AS start, dst AS id FROM e WHERE src IN (SELECT id FROM o) AND dst IN (SELECT id FROM o) AND src LIKE 'r%'")
def graph_neighbors(s: SparkSession, d: str) -> DataFrame:
    v, e = _tree(s, d)
    return graph.neighbors(v, e, v.where(F.col("id").startswith("r")))


@query(
    f"""WITH RECURSIVE {_TREE}, t AS (SELECT id AS start, id, 0 AS depth FROM o WHERE id IN ('r0', 'r1') UNION SELECT t.start, e.dst, t.depth + 1 FROM t JOIN e ON e.src = t.id WHERE t.depth < 3 AND e.dst IN (SELECT id FROM o))
SELECT start, id, min(depth)::INT AS depth FROM t WHERE id <> start GROUP BY start, id"""
)
def graph_traverse_k(s: SparkSession, d: str) -> DataFrame:
    v, e = _tree(s, d)
    return graph.traverse(v, e, v.where("id in ('r0', 'r1')"), 3)


@query(f"WITH {_TREE} SELECT src, dst, type FROM e WHERE src IN (SELECT id FROM o WHERE id LIKE 'n%') AND dst IN (SELECT id FROM o WHERE id LIKE 'n%')")
def subgraph_edges(s: SparkSession, d: str) -> DataFrame:
    v, e = _tree(s, d)
    return graph.induced(e, graph.open_vertices(v).where(F.col("id").startswith("n")))


@query(
    """WITH m AS (SELECT DISTINCT doc_id, entity_type AS x FROM graph_entity WHERE doc_id IS NOT NULL AND entity_type IS NOT NULL)
SELECT a.x AS a, b.x AS b, count(*) AS n_groups FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.x < b.x GROUP BY ALL"""
)
def cooccurrence_pairs(s: SparkSession, d: str) -> DataFrame:
    """Entity types mentioned in the same document; a document has at most as many as there are types."""
    return graph.cooccurrence(table(s, d, "graph_entity"), "doc_id", "entity_type")


@query(
    """WITH m AS (SELECT DISTINCT doc_id, name AS x FROM graph_entity WHERE doc_id IS NOT NULL AND name IS NOT NULL)
SELECT a.x AS a, b.x AS b, count(*) AS n_groups FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.x < b.x GROUP BY ALL"""
)
def cooccurrence_names(s: SparkSession, d: str) -> DataFrame:
    """Entities named in the same document; joined by document, so a name that many documents hold is no hot key, and pairs are counted in part before the shuffle."""
    return graph.cooccurrence(table(s, d, "graph_entity"), "doc_id", "name")


_CC = """ed AS (SELECT DISTINCT chunk_id AS src, parent_id AS dst FROM narrative_chunk WHERE active = 1 AND parent_id IN (SELECT chunk_id FROM narrative_chunk WHERE active = 1) AND split_part(chunk_id, '#', 1) = split_part(parent_id, '#', 1)),
 vv AS (SELECT DISTINCT chunk_id AS id FROM narrative_chunk WHERE active = 1),
 un AS (SELECT src AS u, dst AS v FROM ed UNION SELECT dst, src FROM ed),
 rc AS (SELECT id, id AS l FROM vv UNION SELECT un.v, rc.l FROM rc JOIN un ON un.u = rc.id WHERE un.v > rc.l)"""


@query(f"WITH RECURSIVE {_CC} SELECT id, min(l) AS component FROM rc GROUP BY id")
def connected_components(s: SparkSession, d: str) -> DataFrame:
    """Groups of chunks tied by parent links inside a file."""
    a = table(s, d, "narrative_chunk").where("active = 1").select("chunk_id", "parent_id").distinct()
    ids = a.select(F.col("chunk_id").alias("id")).distinct()
    e = a.where(F.split_part("chunk_id", F.lit("#"), F.lit(1)) == F.split_part("parent_id", F.lit("#"), F.lit(1)))
    e = e.select(F.col("chunk_id").alias("src"), F.col("parent_id").alias("dst")).join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return graph.components(e, ids)


@query()
def connected_components_linked(s: SparkSession, d: str) -> DataFrame:
    """Groups of active chunks tied by any parent link, inside a file or across files."""
    a = table(s, d, "narrative_chunk").where("active = 1").select("chunk_id", "parent_id").distinct()
    ids = a.select(F.col("chunk_id").alias("id")).distinct()
    e = a.select(F.col("chunk_id").alias("src"), F.col("parent_id").alias("dst")).join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return graph.components(e, ids)


@query("SELECT r AS src, m AS dst, 'mentions' AS type, any_value(e) AS entity_type FROM (SELECT doc_id AS r, name AS m, arg_max(entity_type, ent_id) AS e FROM graph_entity GROUP BY 1, 2) GROUP BY 1, 2")
def relation_edges(s: SparkSession, d: str) -> DataFrame:
    """Document mentions entity, the last mention wins."""
    g = table(s, d, "graph_entity").select(F.col("doc_id").alias("src"), F.col("name").alias("dst"), F.lit("mentions").alias("type"), "ent_id", "entity_type")
    return graph.merge_edges(g, ["ent_id"]).select("src", "dst", "type", "entity_type")


# Ledgers over the event stream.

_EV = "ev AS (SELECT event_id, user_id, ts, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'approve' WHEN (SELECT max(event_type) FROM events) THEN 'reject' ELSE 'note' END AS action, value FROM events)"


def _events(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    act = F.when(F.col("event_type") == F.col("lo"), "approve").when(F.col("event_type") == F.col("hi"), "reject").otherwise("note")
    return e.crossJoin(F.broadcast(ends)).select("event_id", "user_id", "ts", act.alias("action"), "value")


@query(
    f"""WITH {_EV} SELECT user_id AS item, CASE arg_min(action, event_id) FILTER (action <> 'note') WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS status, min(event_id) FILTER (action <> 'note') AS decided_seq FROM ev GROUP BY user_id"""
)
def review_current_state(s: SparkSession, d: str) -> DataFrame:
    return ledger.review_state(_events(s, d), "user_id", "event_id", "action")


@query(f"WITH {_EV}, f AS (SELECT user_id, min(event_id) AS k FROM ev WHERE action <> 'note' GROUP BY 1) SELECT event_id, ev.user_id, action FROM ev JOIN f USING (user_id) WHERE action <> 'note' AND event_id > k")
def review_illegal(s: SparkSession, d: str) -> DataFrame:
    return ledger.illegal(_events(s, d), "user_id", "event_id", "action").select("event_id", "user_id", "action")


@query(
    """WITH dc AS (SELECT fact_id, CASE WHEN fact_id % 3 = 0 THEN 'approve' ELSE 'reject' END AS action, CASE WHEN fact_id % 6 = 0 THEN value * 2 END AS corrected_value FROM fact_metric WHERE review_status = 'pending')
SELECT f.fact_id, CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE review_status END AS review_status, CASE WHEN action = 'approve' THEN coalesce(corrected_value, f.value) ELSE f.value END AS value,
 CASE WHEN corrected_value IS NOT NULL THEN 'desk' END AS corrected_by FROM fact_metric f LEFT JOIN dc ON dc.fact_id = f.fact_id"""
)
def review_apply(s: SparkSession, d: str) -> DataFrame:
    f = _facts(s, d).select("fact_id", "review_status", "value")
    dec = f.where("review_status = 'pending'").select(
        "fact_id", F.when(F.col("fact_id") % 3 == 0, "approve").otherwise("reject").alias("action"), F.when(F.col("fact_id") % 6 == 0, F.col("value") * 2).alias("corrected_value"), F.lit("desk").alias("actor")
    )
    return ledger.apply_decisions(f, dec)


@query("SELECT strftime(ts, '%Y-%m-%d') AS batch_id, count(*) AS n_inputs, round(sum(value), 4) AS n_facts, count(*) FILTER (value < 0) AS n_warnings, count(*) FILTER (event_type = 'purchase') AS n_failed FROM events GROUP BY 1")
def manifest_totals(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("b"), "value", (F.col("value") < 0).cast("long").alias("w"), (F.col("event_type") == "purchase").alias("f"))
    return ledger.manifest(e, "b", "value", "w", "f").withColumn("n_facts", F.round("n_facts", 4))


@query("SELECT count(*) FILTER (confidence < 0.5) AS low, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS mid, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence IS NULL) AS without FROM fact_metric")
def confidence_buckets(s: SparkSession, d: str) -> DataFrame:
    return ledger.confidence_buckets(_facts(s, d))


@query("WITH n AS (SELECT metric_code, unit, count(*) AS n FROM fact_metric WHERE unit IS NOT NULL AND trim(unit) <> '' GROUP BY ALL) SELECT metric_code, unit AS default_unit, n FROM n QUALIFY row_number() OVER (PARTITION BY metric_code ORDER BY n DESC, unit) = 1")
def default_unit(s: SparkSession, d: str) -> DataFrame:
    """The unit a metric is stated in most often, ties by its name."""
    n = _facts(s, d).where("unit is not null and trim(unit) <> ''").groupBy("metric_code", "unit").agg(F.count("*").alias("n"))
    best = n.groupBy("metric_code").agg(F.min_by(F.struct("unit", "n"), F.struct(-F.col("n"), F.col("unit"))).alias("b"))
    return best.select("metric_code", F.col("b.unit").alias("default_unit"), "b.n")


@query("SELECT doc_id, arg_max(source_path, (ingested_at, source_path)) AS source_path, max(ingested_at) AS ingested_at FROM narrative_doc GROUP BY doc_id")
def registry_upsert(s: SparkSession, d: str) -> DataFrame:
    """The last registration of every file."""
    return table(s, d, "narrative_doc").groupBy("doc_id").agg(F.max_by("source_path", F.struct("ingested_at", "source_path")).alias("source_path"), F.max("ingested_at").alias("ingested_at"))


@query("SELECT DISTINCT a.doc_id, a.file_hash FROM narrative_doc a WHERE NOT EXISTS (SELECT 1 FROM narrative_doc b WHERE b.doc_id = a.doc_id AND b.file_hash = a.file_hash AND b.ingested_at < TIMESTAMP '2025-01-01')")
def ingest_skip_known(s: SparkSession, d: str) -> DataFrame:
    """Files whose id and hash are not registered yet."""
    n = table(s, d, "narrative_doc")
    return n.join(n.where("ingested_at < timestamp_ntz '2025-01-01 00:00:00'").select("doc_id", "file_hash"), ["doc_id", "file_hash"], "left_anti").select("doc_id", "file_hash").distinct()


@query(
    """WITH r AS (SELECT doc_id, max(CASE upper(coalesce(sensitivity, '')) WHEN 'RESTRICTED' THEN 3 WHEN 'CONFIDENTIAL' THEN 2 WHEN 'INTERNAL' THEN 1 ELSE 0 END) AS k FROM narrative_chunk GROUP BY 1)
SELECT doc_id, k::INT AS rank, CASE k WHEN 3 THEN 'RESTRICTED' WHEN 2 THEN 'CONFIDENTIAL' WHEN 1 THEN 'INTERNAL' ELSE 'PUBLIC' END AS level FROM r"""
)
def most_restrictive_by_doc(s: SparkSession, d: str) -> DataFrame:
    c = F.upper(F.coalesce("sensitivity", F.lit("")))
    k = F.when(c == "RESTRICTED", 3).when(c == "CONFIDENTIAL", 2).when(c == "INTERNAL", 1).otherwise(0)
    g = table(s, d, "narrative_chunk").groupBy("doc_id").agg(F.max(k).alias("rank"))
    return g.withColumn("level", F.when(F.col("rank") == 3, "RESTRICTED").when(F.col("rank") == 2, "CONFIDENTIAL").when(F.col("rank") == 1, "INTERNAL").otherwise("PUBLIC"))


@query("SELECT user_id, event_id, ts, last_value(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS carried FROM events")
def role_turn_windows(s: SparkSession, d: str) -> DataFrame:
    """The last value of one event type among the eight events before."""
    e = table(s, d, "events")
    lo = e.agg(F.min("event_type").alias("lo"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-8, -1)
    x = e.crossJoin(F.broadcast(lo)).withColumn("v", F.when(F.col("event_type") == F.col("lo"), F.col("value")))
    return x.select("user_id", "event_id", "ts", F.last("v", ignorenulls=True).over(w).alias("carried"))
