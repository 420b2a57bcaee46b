"""Queries of gates, grids, pages, vector tables, ledgers and graph reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import periods, text
from tessera.operators import composing, evaluation, facts, filters, gates, graph, grids, ledger, retrieval, search, vectors
from tessera.plans.corpus import _CORPUS, _bm25_sql, _corpus, _questions, sql_tokens
from tessera.plans.stores import _NEWEST, K, _newest
from tessera.session import durable, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- gates

ALIASES = {"Fadamobo": "Fadamobo", "Bivenulu Group 21": "Bivenulu", "Demonege": "Demonege", "Group 21": "Group 21"}
_BARE = r"regexp_replace(lower(coalesce(question, '')), '[\s\p{Z}]+', '', 'g')"
_OUT = "CASE " + " ".join(f"WHEN contains({_BARE}, '{a.lower().replace(' ', '')}') THEN '{ALIASES[a]}'" for a in sorted(ALIASES, key=lambda a: (-len(a), a))) + " END"


@query(f"SELECT id, {_OUT} AS external, CASE WHEN {_OUT} IS NULL THEN 'allow' ELSE 'refuse_out_of_scope' END AS decision FROM qa_golden_set")
def security_screen(s: SparkSession, d: str) -> DataFrame:
    """Questions about foreign parties are refused, whatever else they hold."""
    return table(s, d, "qa_golden_set").select("id", gates.screen(F.col("question"), ALIASES).alias("g")).select("id", "g.external", "g.decision")


@query("SELECT chunk_id, version, ingested_at FROM narrative_chunk WHERE upper(coalesce(sensitivity, '')) <> 'RESTRICTED'")
def persistence_gate(s: SparkSession, d: str) -> DataFrame:
    """Chunks whose vectors may be written."""
    return gates.persistable(table(s, d, "narrative_chunk")).select("chunk_id", "version", "ingested_at")


_SURF = r"lower(trim(regexp_replace(coalesce(question, ''), '[\s\p{Z}]+', ' ', 'g')))"
_NOW = " OR ".join(f"contains(key, '{w}')" for w in gates.REALTIME)


@query(
    f"""WITH i AS (SELECT id AS item_id, {_SURF} AS key, expected_doc AS answer, CASE WHEN topic = 'FIN' THEN '2024-01-01' END AS lo, CASE WHEN topic = 'HR' THEN '2025-06-30' WHEN topic = 'REG' THEN 'never' END AS hi, CASE WHEN scope = 'ORL_VN' THEN ' restricted ' ELSE 'INTERNAL' END AS sens
  FROM qa_golden_set WHERE case_type <> 'refusal' AND {_SURF} <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY item_id DESC) = 1),
 a AS (SELECT id, reference_date AS ref, {_SURF} AS key FROM qa_golden_set WHERE ({_OUT}) IS NULL AND case_type <> 'numeric')
SELECT a.id, item_id, answer FROM a JOIN i USING (key) WHERE NOT ({_NOW}) AND (lo IS NULL OR ref >= try_cast(lo AS DATE)) AND (hi IS NULL OR (try_cast(hi AS DATE) IS NOT NULL AND ref <= try_cast(hi AS DATE))) AND upper(trim(sens)) <> 'RESTRICTED'"""
)
def faq_lookup(s: SparkSession, d: str) -> DataFrame:
    """Entries answer questions of equal surface unless an exclusion holds."""
    g = table(s, d, "qa_golden_set")
    items = g.select(
        F.col("id").alias("item_id"), "question", F.col("expected_doc").alias("answer"), (F.col("case_type") != "refusal").alias("enabled"), F.when(F.col("topic") == "FIN", "2024-01-01").alias("valid_from"),
        F.when(F.col("topic") == "HR", "2025-06-30").when(F.col("topic") == "REG", "never").alias("valid_until"), F.when(F.col("scope") == "ORL_VN", " restricted ").otherwise("INTERNAL").alias("sensitivity"),
    )
    asked = g.select("id", "question", "reference_date", (F.col("case_type") == "numeric").alias("slots"), gates.outside(F.col("question"), ALIASES).alias("external"))
    return gates.faq(asked, items)


_TERMS = "(SELECT DISTINCT lower(term) AS term, metric_code AS code FROM (SELECT name_en AS term, metric_code FROM metric_def UNION ALL SELECT name_zh, metric_code FROM metric_def))"
_HIT = r"CASE WHEN regexp_full_match(term, '[\x00-\x7f]+') THEN regexp_matches(lower(question), '\b' || regexp_escape(term) || '\b') ELSE contains(lower(question), term) END"


def _terms(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "metric_def")
    return m.select(F.col("name_en").alias("term"), F.col("metric_code").alias("code")).union(m.select("name_zh", "metric_code"))


@query(f"SELECT DISTINCT id, 'topic' AS field, 'eq' AS op, code AS value FROM qa_golden_set JOIN {_TERMS} v ON {_HIT}")
def vocabulary_filter(s: SparkSession, d: str) -> DataFrame:
    """Filters that questions state by words of a controlled vocabulary."""
    return gates.vocabulary_filters(table(s, d, "qa_golden_set"), "id", "question", _terms(s, d), "topic")


_CUES = " OR ".join(f"contains(lower(question), '{w}')" for w in gates.COMPARISON)


@query(
    f"""WITH m AS (SELECT id, count(DISTINCT code) AS n FROM qa_golden_set JOIN {_TERMS} v ON {_HIT} GROUP BY id)
SELECT id, CASE WHEN coalesce(n, 0) > 1 OR len(list_distinct(regexp_extract_all(question, '(?:19|20)[0-9]{{2}}'))) > 1 OR {_CUES} THEN 'multi' WHEN case_type = 'numeric' AND coalesce(n, 0) > 0 THEN 'simple' ELSE 'single' END AS complexity FROM qa_golden_set LEFT JOIN m USING (id)"""
)
def question_complexity(s: SparkSession, d: str) -> DataFrame:
    """Which questions have to be taken apart."""
    g = table(s, d, "qa_golden_set")
    n = gates.vocabulary_filters(g, "id", "question", _terms(s, d), "topic").groupBy("id").agg(F.count("*").alias("n"))
    years = F.size(F.array_distinct(F.regexp_extract_all("question", F.lit("((?:19|20)[0-9]{2})"), F.lit(1))))
    route = F.when(F.col("case_type") == "numeric", "structured").otherwise("narrative")
    return g.join(n, "id", "left").select("id", gates.complexity(F.coalesce("n", F.lit(0)), F.lit(0), years, route, F.col("question")).alias("complexity"))


@query()
def query_variants(s: SparkSession, d: str) -> DataFrame:
    """Questions rewritten by the words of the metrics: code first, then other words, at most five."""
    words = {r.term.lower(): r.code for r in _terms(s, d).limit(retrieval.BROADCAST_ROWS).collect()}
    v = gates.rewrite(F.col("question"), [words])
    return table(s, d, "qa_golden_set").select("id", F.posexplode(v).alias("variant", "query"))


@query()
def corrective_retrieval(s: SparkSession, d: str) -> DataFrame:
    """French texts first; where they do not cover the question, all texts."""
    q = retrieval.query_terms(_questions(s, d), "query_id", "question")
    every = durable(search.bm25_top(_corpus(s, d), "doc_id", "text", q, 10))
    some = durable(search.bm25_top(filters.apply(_corpus(s, d), [("language", "eq", "fr")]), "doc_id", "text", q, 10))
    asked = _questions(s, d).select("query_id", F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9]+|" + text.CJK), F.lit(0)).alias("words"))
    texts = _corpus(s, d).select(F.col("doc_id").alias("id"), text.token_set(F.col("text")).alias("words"))
    return gates.first_passing(asked, [some, every], texts)


_EMB = "('0x' || substr(md5(term), 1, 8))::BIGINT % 256"


@query(
    f"""WITH {_bm25_sql(_CORPUS)},
 dc AS (SELECT id, {_EMB} AS bucket, count(*) AS tf FROM (SELECT id, unnest({sql_tokens('text')}) AS term FROM ({_CORPUS})) GROUP BY ALL), dv AS (SELECT id, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS w FROM dc),
 qc AS (SELECT query_id, {_EMB} AS bucket, count(*) AS tf FROM (SELECT query_id, unnest({sql_tokens('question')}) AS term FROM q) GROUP BY ALL), qv AS (SELECT query_id, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY query_id)) AS w FROM qc),
 v AS (SELECT query_id, dv.id, round(sum(qv.w * dv.w), 6) AS score FROM qv JOIN dv USING (bucket) GROUP BY ALL),
 h AS (SELECT query_id, id, 0 AS variant, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 5
  UNION ALL SELECT query_id, id, 1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v QUALIFY rank <= 5),
 f AS (SELECT query_id, h.id AS key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, arg_min(c.entity, (variant, rank)) AS entity FROM h JOIN retrieval_ab_corpus c ON c.doc_id = h.id GROUP BY query_id, h.id)
SELECT query_id, key, fused, entity, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, key) AS rank FROM f"""
)
def snippet_fusion(s: SparkSession, d: str) -> DataFrame:
    """Snippets found by two variants of a query, by words and by vectors, as one list."""
    q = _questions(s, d)
    one = search.bm25_top(_corpus(s, d), "doc_id", "text", retrieval.query_terms(q, "query_id", "question"), 5)
    two = search.bag_top(_corpus(s, d), "doc_id", "text", q, "query_id", "question", 5)
    hits = one.select("query_id", "id", "rank", F.lit(0).alias("variant")).unionByName(two.select("query_id", "id", "rank", F.lit(1).alias("variant")))
    texts = _corpus(s, d).select(F.col("doc_id").alias("id"), "text", "entity")
    hits = hits.join(texts, "id").select("query_id", F.col("id").alias("chunk_id"), F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source_locator"), "text", "entity", "variant", "rank")
    return gates.fuse_snippets(hits).drop("text")


# --- periods and names

_WORDS = ["去年", "今年上半年", "上半年", "去年下半年", "last quarter", "本季度", "上个季度", "前年", "this year", "明年上半年", "FY2024"]
_YEARS = "MAP {" + ", ".join(f"'{w}': {k}" for w, k in periods.YEAR_WORDS.items()) + "}"
_QUARTERS = "MAP {" + ", ".join(f"'{w}': {k}" for w, k in periods.QUARTER_WORDS.items()) + "}"


@query(
    f"""WITH w AS (SELECT id, reference_date AS ref, unnest({_WORDS}) AS word FROM qa_golden_set),
 x AS (SELECT *, CASE WHEN word LIKE '%上半年' THEN 'H1' WHEN word LIKE '%下半年' THEN 'H2' END AS half, regexp_replace(word, '[上下]半年$', '') AS head FROM w),
 y AS (SELECT *, year(ref) + CASE WHEN half IS NOT NULL AND head = '' THEN 0 ELSE {_YEARS}[head] END AS yr, year(ref) * 4 + quarter(ref) - 1 + {_QUARTERS}[word] AS qt FROM x)
SELECT id, word, CASE WHEN half IS NOT NULL THEN CASE WHEN yr IS NOT NULL THEN 'HY' END WHEN yr IS NOT NULL THEN 'FY' WHEN qt IS NOT NULL THEN 'QUARTER' END AS period_type,
 CASE WHEN half IS NOT NULL THEN yr::VARCHAR || half WHEN yr IS NOT NULL THEN yr::VARCHAR WHEN qt IS NOT NULL THEN (qt // 4)::VARCHAR || 'Q' || (qt % 4 + 1)::VARCHAR END AS period FROM y"""
)
def relative_period_words(s: SparkSession, d: str) -> DataFrame:
    """Words for years, half years and quarters at the date of every question."""
    w = table(s, d, "qa_golden_set").select("id", "reference_date", F.explode(F.array(*map(F.lit, _WORDS))).alias("word"))
    return w.select("id", "word", periods.relative(F.col("word"), F.col("reference_date")).alias("p")).select("id", "word", "p.period_type", "p.period")


@query(
    r"""WITH t AS (SELECT doc_id, title, lower(trim(regexp_replace(coalesce(title, ''), '[\s\p{Z}]+', ' ', 'g'))) AS k FROM narrative_doc JOIN (SELECT doc_id, any_value(title ORDER BY title) AS title FROM narrative_chunk GROUP BY doc_id) USING (doc_id)),
 n AS (SELECT DISTINCT lower(trim(regexp_replace(split_part(entity, '_', 1), '[\s\p{Z}]+', ' ', 'g'))) AS k, split_part(entity, '_', 1) AS code FROM fact_metric)
SELECT DISTINCT t.doc_id, title, coalesce(a.code, b.code) AS entity FROM t LEFT JOIN n a ON a.k = t.k LEFT JOIN n b ON b.k = trim(regexp_split_to_array(regexp_split_to_array(t.k, '[—\-|–:：]')[1], ' ')[1])"""
)
def normalize_entity(s: SparkSession, d: str) -> DataFrame:
    """Titles to codes of firms: as a whole, then by the first word of the part before a dash, bar or colon."""
    titles = table(s, d, "narrative_chunk").groupBy("doc_id").agg(F.min("title").alias("title"))
    t = table(s, d, "narrative_doc").select("doc_id").distinct().join(titles, "doc_id").withColumn("k", text.clean(F.coalesce("title", F.lit(""))))
    code = F.split_part("entity", F.lit("_"), F.lit(1))
    n = table(s, d, "fact_metric").select(text.clean(code).alias("k"), code.alias("code")).distinct()
    head = F.split_part(F.element_at(F.split("k", "[—\\-|–:：]"), 1), F.lit(" "), F.lit(1))
    whole = t.join(n.withColumnRenamed("code", "a"), "k", "left").withColumn("h", F.trim(head))
    return whole.join(n.select(F.col("k").alias("h"), F.col("code").alias("b")), "h", "left").select("doc_id", "title", F.coalesce("a", "b").alias("entity")).distinct()


@query("""SELECT chunk_id, version, ingested_at, '{"entity":' || coalesce('"' || entity || '"', 'null') || ',"topic":' || coalesce('"' || topic || '"', 'null') || '}' AS tags, topic AS topic_again FROM narrative_chunk""")
def tags_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Tags written as JSON and read again."""
    c = table(s, d, "narrative_chunk").withColumn("tags", F.to_json(F.struct("entity", "topic"), {"ignoreNullFields": "false"}))
    return c.select("chunk_id", "version", "ingested_at", "tags", F.from_json("tags", "map<string,string>")["topic"].alias("topic_again"))


# --- grids, colours, pages

_GRID = """f AS (SELECT source_doc_id AS sheet, raw_label AS label, CASE period_type WHEN 'FY' THEN 'FY' || period ELSE period END AS period, max(value) AS value FROM fact_metric WHERE value IS NOT NULL AND raw_label IS NOT NULL AND source_doc_id IS NOT NULL GROUP BY ALL),
 g AS (SELECT *, dense_rank() OVER (PARTITION BY sheet ORDER BY label) + 1 AS r, dense_rank() OVER (PARTITION BY sheet ORDER BY period) + 1 AS c FROM f),
 w AS (SELECT DISTINCT lower(word) AS key, metric_code FROM (SELECT name_en AS word, metric_code FROM metric_def UNION ALL SELECT name_zh, metric_code FROM metric_def)),
 k AS (SELECT g.*, metric_code FROM g LEFT JOIN w ON w.key = trim(lower(regexp_replace(label, '[(（].*?[)）]', '', 'g'))))"""


def _grid(s: SparkSession, d: str) -> DataFrame:
    """Sheets made of the facts of a source: labels down the first column, periods along the first row."""
    label = F.when(F.col("period_type") == "FY", F.concat(F.lit("FY"), "period")).otherwise(F.col("period"))
    f = table(s, d, "fact_metric").where("value is not null and raw_label is not null and source_doc_id is not null")
    f = f.groupBy(F.col("source_doc_id").alias("sheet"), F.col("raw_label").alias("label"), label.alias("period")).agg(F.max("value").alias("value"))
    f = f.withColumn("r", F.dense_rank().over(Window.partitionBy("sheet").orderBy("label")) + 1).withColumn("c", F.dense_rank().over(Window.partitionBy("sheet").orderBy("period")) + 1)
    one = F.lit(1)
    cells = f.select("sheet", F.col("r").alias("row"), F.col("c").alias("col"), F.col("value").cast("string").alias("text"))
    return cells.union(f.select("sheet", "r", one, "label").distinct()).union(f.select("sheet", one, "c", "period").distinct())


def _words(s: SparkSession, d: str) -> DataFrame:
    return _terms(s, d).withColumnRenamed("term", "word").withColumnRenamed("code", "metric_code")


@query(f"WITH {_GRID} SELECT sheet, r::INT AS row, c::INT AS col, metric_code, CASE WHEN period LIKE '%H%' THEN 'HY' WHEN period LIKE '%Q%' THEN 'QUARTER' ELSE 'FY' END AS period_type, replace(period, 'FY', '') AS period, round(value, 4) AS value FROM k WHERE metric_code IS NOT NULL")
def grid_facts(s: SparkSession, d: str) -> DataFrame:
    """Facts read from grids by their row labels and column headers."""
    return grids.facts(_grid(s, d), _words(s, d)).withColumn("value", F.round("value", 4))


@query(f"WITH {_GRID} SELECT sheet, bool_or(metric_code IS NOT NULL) AS has_data FROM k GROUP BY sheet")
def grid_candidates(s: SparkSession, d: str) -> DataFrame:
    return grids.candidates(_grid(s, d), _words(s, d))


_CELLS = "c AS (SELECT source_doc_id AS sheet, fact_id, CASE WHEN confidence IS NOT NULL THEN substr(md5(channel), 1, 6) END AS rgb, coalesce(geography, '') = 'VN' AS cond, channel FROM fact_metric)"


def _cells(s: SparkSession, d: str) -> DataFrame:
    rgb = F.when(F.col("confidence").isNotNull(), F.left(F.md5("channel"), F.lit(6)))
    return table(s, d, "fact_metric").select(F.col("source_doc_id").alias("sheet"), "fact_id", rgb.alias("rgb"), (F.coalesce("geography", F.lit("")) == "VN").alias("conditional"), "channel", "entity")


@query(f"WITH {_CELLS} SELECT sheet, rgb, count(*) AS n, row_number() OVER (PARTITION BY sheet ORDER BY count(*) DESC, rgb) AS place FROM c WHERE rgb IS NOT NULL AND NOT cond GROUP BY sheet, rgb")
def colour_clusters(s: SparkSession, d: str) -> DataFrame:
    """Reliable colours of a sheet by how often they occur."""
    return grids.clusters(_cells(s, d))


@query(f"WITH {_CELLS} SELECT DISTINCT sheet, rgb, 'channel = ' || channel AS meaning, channel AS tag FROM c WHERE rgb IS NOT NULL")
def colour_legend(s: SparkSession, d: str) -> DataFrame:
    """Legends: a coloured empty cell beside its meaning."""
    c = _cells(s, d).where("rgb is not null")
    swatch = c.select("sheet", F.col("fact_id").alias("row"), F.lit(1).alias("col"), F.lit("").alias("text"), "rgb")
    words = c.select("sheet", F.col("fact_id").alias("row"), F.lit(2).alias("col"), F.concat(F.lit("channel = "), "channel").alias("text"), F.lit(None).cast("string").alias("rgb"))
    return grids.legend(swatch.unionByName(words))


@query(
    f"""WITH {_CELLS}, e AS (SELECT DISTINCT sheet AS scope, rgb, channel FROM c WHERE rgb IS NOT NULL AND sheet NOT LIKE '%.txt')
SELECT c.fact_id, c.rgb, e.channel AS tag, (c.sheet LIKE '%.txt' OR a.scope IS NULL) AND c.rgb IS NOT NULL AS warning FROM c LEFT JOIN (SELECT DISTINCT scope FROM e) a ON a.scope = c.sheet LEFT JOIN e ON e.scope = c.sheet AND e.rgb = c.rgb"""
)
def colour_tags(s: SparkSession, d: str) -> DataFrame:
    """Tags of cells by the active mapping of their sheet; sheets of text files have theirs rejected."""
    c = _cells(s, d)
    m = c.where("rgb is not null").select(F.col("sheet").alias("scope"), "rgb", "channel").distinct().groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("rgb", "channel"))).alias("mapping"))
    none = F.lit(None).cast("map<string,string>")
    event = lambda v, a, x: m.select("scope", F.lit(v).alias("version"), F.lit(a).alias("action"), x.alias("mapping"))
    events = event(1, "register", F.create_map(F.lit("x"), F.lit("old"))).union(event(1, "confirm", none)).union(event(2, "register", F.col("mapping"))).union(event(2, "confirm", none))
    events = events.union(event(1, "reject", none).where("scope like '%.txt'")).union(event(2, "reject", none).where("scope like '%.txt'"))
    return grids.tagged(c.withColumn("scope", F.col("sheet")), grids.active_mapping(events)).select("fact_id", "rgb", "tag", "warning")


_PAGES = r"""p AS (SELECT doc_id, coalesce(nullif(regexp_extract(coalesce(source_locator, ''), '(?:page=|;p|p\.? ?)([0-9]+)', 1), ''), '0') AS page, sum(length(coalesce(text, ''))) AS chars, sum(CASE WHEN text LIKE '%' || chr(10) || '%' THEN 0.3 ELSE 0.1 END) AS cover FROM narrative_chunk WHERE active = 1 GROUP BY ALL),
 k AS (SELECT *, CASE WHEN chars >= 50 THEN CASE WHEN least(cover, 1) >= 0.55 THEN 'ocr_scan' ELSE 'digital' END ELSE CASE WHEN least(cover, 1) >= 0.55 THEN 'img_scan' ELSE 'low_text' END END AS kind FROM p)"""


def _page_rows(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "narrative_chunk").where("active = 1")
    page = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("source_locator", F.lit("")), r"(?:page=|;p|p\.? ?)([0-9]+)", 1), F.lit("")), F.lit("0"))
    p = c.groupBy("doc_id", page.alias("page")).agg(F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars"), F.sum(F.when(F.contains("text", F.lit("\n")), F.expr("0.3")).otherwise(F.expr("0.1"))).alias("cover"))
    return p.withColumn("kind", grids.page_kind(F.col("chars"), F.col("cover").cast("double")))


@query(f"WITH {_PAGES} SELECT doc_id, page, chars::BIGINT AS chars, kind FROM k")
def page_kinds(s: SparkSession, d: str) -> DataFrame:
    """Kind of every page by its text and the share a second layer covers."""
    return _page_rows(s, d).select("doc_id", "page", "chars", "kind")


@query(
    f"""WITH {_PAGES}, n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (kind = 'digital') AS dg, count(*) FILTER (kind = 'img_scan') AS im, count(*) FILTER (kind = 'ocr_scan') AS oc FROM k GROUP BY doc_id)
SELECT doc_id, n AS n_pages, CASE WHEN dg >= 0.9 * n THEN 'digital' WHEN im + oc >= 0.9 * n THEN CASE WHEN im >= oc THEN 'scanned' ELSE 'ocr_scan' END ELSE 'mixed' END AS verdict FROM n"""
)
def page_router(s: SparkSession, d: str) -> DataFrame:
    """The way each file is to be read."""
    return grids.file_verdict(_page_rows(s, d))


# --- vector table

@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def vector_upsert(s: SparkSession, d: str) -> DataFrame:
    """Vectors replaced by id."""
    e = table(s, d, "embeddings")
    return vectors.upsert(e, e.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100), "vec_id").select("vec_id", "label")


@query("SELECT 'deleted' AS what, count(*) AS n FROM embeddings WHERE label = 3 UNION ALL SELECT 'left', count(*) FROM embeddings WHERE label <> 3 OR label IS NULL")
def vector_delete_where(s: SparkSession, d: str) -> DataFrame:
    """Vectors deleted by a condition on their metadata, with the numbers."""
    e = table(s, d, "embeddings")
    left = vectors.delete_where(e, {"label": 3})
    return left.agg(F.count("*").alias("n")).select(F.lit("left").alias("what"), "n").union(e.where("label = 3").agg(F.count("*").alias("n")).select(F.lit("deleted").alias("what"), "n"))


@query(f"WITH r AS (SELECT DISTINCT doc_id FROM narrative_doc WHERE doc_id LIKE '%.pdf') SELECT chunk_id, version, ingested_at FROM narrative_chunk WHERE doc_id NOT IN (SELECT doc_id FROM r)")
def document_invalidation(s: SparkSession, d: str) -> DataFrame:
    """Everything of the files that are read anew is taken out."""
    gone = table(s, d, "narrative_doc").where("doc_id like '%.pdf'").select("doc_id").distinct()
    return table(s, d, "narrative_chunk").where("doc_id is not null").join(gone, "doc_id", "left_anti").select("chunk_id", "version", "ingested_at")


# --- ledgers and evaluation

_TABLES = ["fact_metric", "narrative_chunk", "narrative_doc", "graph_entity", "qa_golden_set", "retrieval_ab_corpus", "documents"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def row_counts(s: SparkSession, d: str) -> DataFrame:
    parts = [table(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list(version))), ',') AS versions FROM narrative_chunk GROUP BY doc_id")
def list_versions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "narrative_chunk").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("version")).cast("array<string>"), ",").alias("versions"))


@query("SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_files, count(DISTINCT source_path) AS n_paths, sum(n_chunks)::BIGINT AS n_chunks, bool_or(n_chunks IS NULL OR n_chunks = 0) AS any_failed FROM narrative_doc")
def ingest_summary(s: SparkSession, d: str) -> DataFrame:
    failed = F.col("n_chunks").isNull() | (F.col("n_chunks") == 0)
    return table(s, d, "narrative_doc").agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_files"), F.count_distinct("source_path").alias("n_paths"), F.sum("n_chunks").alias("n_chunks"), F.bool_or(failed).alias("any_failed"))


@query("SELECT event_type, round(median(value), 6) AS median, round(avg(value), 6) AS mean, min(value) AS least, count(*) AS repeats FROM events GROUP BY event_type")
def repeat_statistics(s: SparkSession, d: str) -> DataFrame:
    """Median, mean and least of repeated measurements."""
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.count("*").alias("repeats"))


@query(
    f"""WITH l AS ({_NEWEST}), r AS (SELECT DISTINCT metric_code, entity FROM fact_metric), x AS (SELECT r.*, l.fact_id, l.value FROM r LEFT JOIN l ON l.metric_code = r.metric_code AND l.entity = r.entity AND l.period_type = 'FY' AND l.period = '2020' AND l.channel = 'TOTAL')
SELECT entity, count(*) FILTER (fact_id IS NOT NULL AND value IS NOT NULL) AS ok, count(*) FILTER (fact_id IS NULL) AS not_found, count(*) FILTER (fact_id IS NOT NULL AND value IS NULL) AS no_value FROM x GROUP BY entity"""
)
def tool_status_counts(s: SparkSession, d: str) -> DataFrame:
    """How often lookups of an entity end well, find nothing, or find no value."""
    r = table(s, d, "fact_metric").select("metric_code", "entity").distinct().select("metric_code", "entity", F.lit("FY").alias("period_type"), F.lit("2020").alias("period"), F.lit("TOTAL").alias("channel"))
    got = facts.lookup(r, _newest(s, d), True)
    n = lambda c: F.count_if(c)
    found = F.col("status") == "found"
    return got.groupBy("entity").agg(n(found & F.col("value").isNotNull()).alias("ok"), n(~found).alias("not_found"), n(found & F.col("value").isNull()).alias("no_value"))


@query(
    f"""WITH a AS (SELECT * FROM fact_metric WHERE source_doc_id LIKE '%Databook%' QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY ingested_at DESC, fact_id DESC) = 1),
 b AS (SELECT * FROM fact_metric WHERE source_doc_id NOT LIKE '%Databook%' QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY ingested_at DESC, fact_id DESC) = 1)
SELECT channel, count(*) AS total, count(*) FILTER (abs(a.value - b.value) <= 0.5) AS correct, round(count(*) FILTER (abs(a.value - b.value) <= 0.5)::DOUBLE / count(*), 6) AS accuracy FROM a JOIN b USING ({K}) GROUP BY channel"""
)
def channel_accuracy(s: SparkSession, d: str) -> DataFrame:
    """Share of figures of the databook that other sources confirm, by channel."""
    f = table(s, d, "fact_metric").select("fact_id", *facts.KEY, "value", "source_doc_id", "ingested_at")
    book = F.col("source_doc_id").contains("Databook")
    a, b = (facts.last_wins(f.where(c), ["ingested_at", "fact_id"]).select(*facts.KEY, F.col("value").alias(n)) for c, n in ((book, "va"), (~book, "vb")))
    return evaluation.channel_accuracy(a.join(b, facts.KEY), "channel", "va", "vb", 0.5)


@query(
    f"""WITH a AS (SELECT * FROM fact_metric WHERE source_doc_id LIKE '%Databook%' QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY ingested_at DESC, fact_id DESC) = 1),
 b AS (SELECT * FROM fact_metric WHERE source_doc_id NOT LIKE '%Databook%' QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY ingested_at DESC, fact_id DESC) = 1),
 v AS (SELECT metric_code, entity, period_type, period, channel, CASE WHEN a.fact_id IS NOT NULL AND b.fact_id IS NOT NULL THEN CASE WHEN abs(a.value - b.value) <= 0.5 THEN 0 ELSE 10 END ELSE 50 END AS priority FROM a FULL JOIN b USING (metric_code, entity, period_type, period, channel))
SELECT entity, metric_code, period_type, period, channel, priority, row_number() OVER (PARTITION BY entity ORDER BY priority, metric_code, period_type, period, channel) AS place FROM v WHERE priority > 0"""
)
def pending_queue(s: SparkSession, d: str) -> DataFrame:
    """Open reviews of every entity, the most urgent first."""
    f = table(s, d, "fact_metric").select("fact_id", *facts.KEY, "value", "source_doc_id", "ingested_at")
    book = F.col("source_doc_id").contains("Databook")
    a, b = (facts.last_wins(f.where(c), ["ingested_at", "fact_id"]) for c in (book, ~book))
    return ledger.pending(facts.verify(a, b, 0.5).where("priority > 0"), "entity", ["metric_code", "period_type", "period", "channel"]).drop("va", "vb", "verdict")


@query(
    """WITH p AS (SELECT fact_id, source_doc_id FROM fact_metric WHERE review_status = 'pending')
SELECT fact_id AS item, 'item' AS kind, source_doc_id AS detail FROM p UNION ALL SELECT fact_id, 'audit', 'enqueued' FROM p"""
)
def enqueue_for_review(s: SparkSession, d: str) -> DataFrame:
    """Pending facts as items of the queue, each with its line in the audit."""
    return ledger.enqueue(table(s, d, "fact_metric").where("review_status = 'pending'"), "fact_id", "source_doc_id")


# --- graph reports

_TYPES = "SELECT doc_id, name, entity_type FROM graph_entity WHERE name IS NOT NULL AND doc_id IS NOT NULL"


@query(
    f"""WITH m AS (SELECT DISTINCT entity_type AS community, name, doc_id FROM ({_TYPES})), n AS (SELECT community, count(*) AS n_relations, count(DISTINCT name) AS n_members FROM m GROUP BY community)
SELECT community, n_relations, n_members, row_number() OVER (ORDER BY n_relations DESC, community) AS place FROM n QUALIFY place <= 3"""
)
def community_top(s: SparkSession, d: str) -> DataFrame:
    """The communities with most relations, ties by their name as a string."""
    m = table(s, d, "graph_entity").where("name is not null and doc_id is not null").select(F.col("entity_type").alias("community"), "name", "doc_id").distinct()
    n = m.groupBy("community").agg(F.count("*").alias("n_relations"), F.count_distinct("name").alias("n_members"))
    return graph.top_communities(n, 3)


@query(f"SELECT entity_type AS community, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM ({_TYPES}) GROUP BY entity_type")
def community_sources(s: SparkSession, d: str) -> DataFrame:
    """Source documents of the relations whose start is a member."""
    g = table(s, d, "graph_entity").where("name is not null and doc_id is not null")
    members = g.select(F.col("entity_type").alias("community"), F.col("ent_id").alias("member"))
    relations = g.select(F.col("ent_id").alias("src"), F.col("doc_id").alias("source_doc_id"))
    return graph.community_documents(members, relations).groupBy("community").agg(F.count("*").alias("n_docs"), F.min("source_doc_id").alias("first_doc"), F.max("source_doc_id").alias("last_doc"))


@query("SELECT ent_id, name FROM graph_entity WHERE entity_type = 'ORG' AND doc_id LIKE '%.pdf' UNION ALL SELECT ent_id, name FROM graph_entity WHERE entity_type <> 'ORG' AND doc_id LIKE '%.tif'")
def graph_node_where(s: SparkSession, d: str) -> DataFrame:
    """Vertices by type and metadata."""
    g = table(s, d, "graph_entity")
    return graph.where(g, {"entity_type": "ORG"}).where("doc_id like '%.pdf'").unionByName(g.where("entity_type <> 'ORG' and doc_id like '%.tif'")).select("ent_id", "name")


@query(
    """WITH s AS (SELECT name, entity_type AS bucket, count(*)::DOUBLE AS score FROM graph_entity WHERE name IS NOT NULL AND entity_type IS NOT NULL GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, bucket) AS k FROM s)
SELECT name, max(bucket) FILTER (k = 1) AS best, max(score) FILTER (k = 1) AS score, coalesce(max(score) FILTER (k = 2), 0) AS runner_up, max(score) FILTER (k = 1) >= 2 AND max(score) FILTER (k = 1) - coalesce(max(score) FILTER (k = 2), 0) >= 1 AS decided FROM r GROUP BY name"""
)
def lead_margin(s: SparkSession, d: str) -> DataFrame:
    """The type of a name by majority, decided only with enough lead over the next."""
    n = table(s, d, "graph_entity").where("name is not null and entity_type is not null").groupBy("name", F.col("entity_type").alias("bucket")).agg(F.count("*").cast("double").alias("score"))
    return evaluation.lead(n, "name", "bucket", "score", 2.0, 1.0)


@query(
    """WITH RECURSIVE one AS (SELECT chunk_id, arg_max(nullif(parent_id, ''), (version, ingested_at, coalesce(parent_id, ''))) AS p FROM narrative_chunk WHERE active = 1 GROUP BY chunk_id),
 e AS (SELECT chunk_id AS src, p AS dst FROM one WHERE p IN (SELECT chunk_id FROM one)), st AS (SELECT DISTINCT src FROM e WHERE src LIKE '%#c1'),
 t AS (SELECT src AS start, dst AS id, 1 AS depth FROM e JOIN st USING (src) UNION SELECT t.start, e.dst, depth + 1 FROM t JOIN e ON e.src = t.id WHERE depth < 3)
SELECT start, id, min(depth)::INT AS depth FROM t WHERE id <> start GROUP BY ALL"""
)
def derivation_trace(s: SparkSession, d: str) -> DataFrame:
    """What a chunk derives from within three steps along its parents."""
    last = table(s, d, "narrative_chunk").where("active = 1").groupBy("chunk_id").agg(F.max_by(F.nullif("parent_id", F.lit("")), F.struct("version", "ingested_at", F.coalesce("parent_id", F.lit("")))).alias("p"))
    ids = last.select(F.col("chunk_id").alias("id"))
    edges = last.select(F.col("chunk_id").alias("src"), F.col("p").alias("dst"), F.lit("derives").alias("type")).where("dst is not null").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    starts = edges.where("src like '%#c1'").select(F.col("src").alias("id")).distinct()
    return graph.traverse(ids, edges, starts, 3, types=["derives"]).where("id <> start")



# --- answers

_TEXTS = "SELECT chunk_id AS id, max(text) AS text FROM narrative_chunk WHERE active = 1 AND chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id"


@query(
    f"""WITH {_bm25_sql(_TEXTS)}, h AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 5),
 m AS (SELECT chunk_id AS id, max(doc_id) AS doc_id, max(text) AS text, max(sensitivity) AS sens FROM narrative_chunk WHERE active = 1 GROUP BY chunk_id),
 v AS (SELECT query_id, doc_id, text, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS rank FROM h JOIN m USING (id) WHERE upper(coalesce(sens, '')) <> 'RESTRICTED'),
 s AS (SELECT query_id, doc_id, min(rank) AS r FROM v GROUP BY ALL)
SELECT q.query_id, coalesce(a.answer, 'nothing found') AS answer, coalesce(c.sources, '') AS sources, coalesce(n_hits, 0) AS n_hits FROM q LEFT JOIN (SELECT query_id, string_agg('[' || rank || '] ' || text, chr(10) ORDER BY rank) AS answer, count(*) AS n_hits FROM v GROUP BY 1) a USING (query_id)
LEFT JOIN (SELECT query_id, string_agg(doc_id, '; ' ORDER BY r) AS sources FROM s GROUP BY 1) c USING (query_id)"""
)
def narrative_answers(s: SparkSession, d: str) -> DataFrame:
    """Questions answered by passages with their sources; restricted passages stay out."""
    c = table(s, d, "narrative_chunk").where("active = 1 and chunk_id is not null").groupBy("chunk_id").agg(F.max("doc_id").alias("doc_id"), F.max("text").alias("text"), F.max("sensitivity").alias("sensitivity"))
    q = _questions(s, d)
    hits = durable(search.bm25_top(c.where("text is not null"), "chunk_id", "text", retrieval.query_terms(q, "query_id", "question"), 5))
    return composing.narrative(q, hits.join(c.withColumnRenamed("chunk_id", "id"), "id"))


@query(
    f"""WITH l AS ({_NEWEST}), e AS (SELECT DISTINCT entity FROM fact_metric),
 t AS (SELECT entity AS qid, m.i * 2 + p.j + 1 AS ordinal, metric_code, entity, 'FY' AS period_type, period, 'TOTAL' AS channel FROM e, (VALUES (0, 'SOLVENCY'), (1, 'STAFF')) m(i, metric_code), (VALUES (0, '2020'), (1, '2021')) p(j, period)),
 g AS (SELECT t.*, l.value, l.unit FROM t LEFT JOIN l USING (metric_code, entity, period_type, period, channel)),
 x AS (SELECT *, CASE WHEN lag(unit) OVER w IS NOT DISTINCT FROM unit THEN round(value - lag(value) OVER w, 4) END AS delta FROM g WINDOW w AS (PARTITION BY qid, metric_code, entity ORDER BY ordinal))
SELECT qid, ordinal::INT AS ordinal, value IS NOT NULL AS found, CASE WHEN value IS NULL THEN entity || ' ' || metric_code || ' ' || period || ': not found' END AS missing, delta FROM x"""
)
def subtask_answers(s: SparkSession, d: str) -> DataFrame:
    """Two figures of every entity in two years, with their changes."""
    e = table(s, d, "fact_metric").select("entity").distinct()
    t = e.select("entity", F.posexplode(F.array(F.lit("SOLVENCY"), F.lit("STAFF"))).alias("i", "metric_code")).select("*", F.posexplode(F.array(F.lit("2020"), F.lit("2021"))).alias("j", "period"))
    t = t.select(F.col("entity").alias("qid"), (F.col("i") * 2 + F.col("j") + 1).alias("ordinal"), "metric_code", "entity", F.lit("FY").alias("period_type"), "period", F.lit("TOTAL").alias("channel"))
    out = composing.several(t, _newest(s, d))
    found = ~F.col("line").endswith(": not found")
    return out.select("qid", "ordinal", found.alias("found"), F.when(~found, F.col("line")).alias("missing"), "delta")


@query(
    f"""WITH {_bm25_sql(_CORPUS)}, r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 6)
SELECT r.query_id, r.id, rank, row_number() OVER (PARTITION BY r.query_id ORDER BY CASE WHEN (rank - 1) % 2 = 0 THEN rank - 1 ELSE 8 - (rank - 1) END) - 1 AS place FROM r WHERE rank <= 4"""
)
def postprocessor_chain(s: SparkSession, d: str) -> DataFrame:
    """The four best of six, best at both ends, as a chain of steps."""
    from tessera.operators import post

    top = search.bm25_top(_corpus(s, d), "doc_id", "text", retrieval.query_terms(_questions(s, d), "query_id", "question"), 6)
    steps = composing.chain(lambda x: x.where("rank <= 4"), post.lost_in_the_middle)
    return steps(top).select("query_id", "id", "rank", "place")
