"""Queries of text functions, chunking, retrieval, post-retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import periods, text, vectors
from tessera.operators import chunking, embedding, evaluation, filters, post, retrieval, search
from tessera.session import durable, table, width

H = r"[\x{4E00}-\x{9FFF}]"


def sql_tokens(x: str) -> str:
    runs = f"regexp_extract_all(lower(coalesce({x}, '')), '{H}+')"
    return (
        f"list_concat(list_concat(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), flatten(list_transform({runs}, lambda r: regexp_extract_all(r, '{H}')))), "
        f"flatten(list_transform({runs}, lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))"
    )


def sql_set(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+|{H}'))"


def _corpus(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "retrieval_ab_corpus")


def _questions(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: every question whose id is divisible by 20."""
    q = table(s, d, "qa_golden_set")
    return q.where(F.regexp_replace("id", "[^0-9]", "").cast("long") % 20 == 0).select(F.col("id").alias("query_id"), "question", "expected_doc", "topic")


_Q = "q AS (SELECT id AS query_id, question, expected_doc, topic FROM qa_golden_set WHERE regexp_replace(id, '[^0-9]', '', 'g')::BIGINT % 20 = 0)"


def _bm25_sql(docs: str, queries: str = _Q, name: str = "b") -> str:
    """CTEs ending in ``name`` (query_id, id, score); ``docs`` selects id, text."""
    return f"""{queries},
 d AS ({docs}), dt AS (SELECT id, {sql_tokens('text')} AS tk FROM d), dl AS (SELECT id, len(tk) AS dl FROM dt),
 st AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS av FROM dl),
 po AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tk) AS term FROM dt) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
 qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({sql_tokens('question')}) AS term FROM q) GROUP BY ALL),
 {name} AS (SELECT query_id, po.id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))), 6) AS score
   FROM qt JOIN po USING (term) JOIN df USING (term) JOIN dl ON dl.id = po.id CROSS JOIN st GROUP BY query_id, po.id HAVING score > 0)"""


_CORPUS = "SELECT doc_id AS id, text FROM retrieval_ab_corpus"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    f"""WITH {_bm25_sql(_CORPUS, "q AS (SELECT 'x' AS query_id, 'solvency cover hong kong' AS question)")}
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 10"""
)
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    """The ten best corpus texts for one query."""
    terms = s.sql("SELECT 'x' AS query_id, term, 1L AS qtf FROM VALUES ('solvency'), ('cover'), ('hong'), ('kong') AS t(term)")
    return retrieval.ranked(retrieval.bm25(_corpus(s, d), "doc_id", "text", terms), 10).select("id", "score", "rank")


@query(f"WITH {_bm25_sql(_CORPUS)} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 10")
def bm25_multiquery_topk(s: SparkSession, d: str) -> DataFrame:
    q = retrieval.query_terms(_questions(s, d), "query_id", "question")
    return search.bm25_top(_corpus(s, d), "doc_id", "text", q, 10)


@query(f"WITH {_bm25_sql(_CORPUS + chr(32) + 'WHERE language = ' + chr(39) + 'fr' + chr(39))} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 5")
def bm25_filtered_topk(s: SparkSession, d: str) -> DataFrame:
    """Statistics follow the filtered candidates."""
    q = retrieval.query_terms(_questions(s, d), "query_id", "question")
    docs = filters.apply(_corpus(s, d), [("language", "eq", "fr")])
    return retrieval.ranked(retrieval.bm25(docs, "doc_id", "text", q), 5)


@query(f"SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({sql_tokens('text')}) AS term FROM retrieval_ab_corpus) GROUP BY ALL")
def term_frequency(s: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(_corpus(s, d), "doc_id", "text")


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({sql_tokens('text')}) AS term FROM retrieval_ab_corpus) GROUP BY term")
def document_frequency(s: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(_corpus(s, d), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"))


@query(f"SELECT count(*) AS n, round(avg(len({sql_tokens('text')})), 6) AS avgdl FROM retrieval_ab_corpus")
def avg_doc_length(s: SparkSession, d: str) -> DataFrame:
    return retrieval.lengths(_corpus(s, d), "doc_id", "text").agg(F.count("*").alias("n"), F.round(F.sum("dl") / F.count("*"), 6).alias("avgdl"))


_COS = "CASE WHEN {n} > 0 THEN list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / {n} ELSE 0 END"
_NORM = "(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_COSINE = "round(" + _COS.format(n=_NORM) + ", 6)"


_V = f"v AS (SELECT b.vec_id AS query_id, a.vec_id AS id, {_COSINE} AS score FROM embeddings a JOIN (SELECT * FROM embeddings WHERE vec_id % 20 = 0) b ON true)"


@query(f"WITH {_V} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v QUALIFY rank <= 10")
def vector_topk(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return retrieval.vector_topk(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)


@query(f"WITH {_V} SELECT query_id, v.id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, v.id) AS rank FROM v JOIN embeddings e ON e.vec_id = v.id WHERE e.label = 3 QUALIFY rank <= 5")
def vector_where_filter(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return retrieval.vector_topk(filters.apply(e, [("label", "eq", 3)]), "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)


def _vector_sql(name: str, rows: str) -> str:
    """CTE of hash-bag weights (id, bucket, weight) of rows (id, text)."""
    bucket = "('0x' || substr(md5(term), 1, 8))::BIGINT % 256"
    return (
        f"{name}c AS (SELECT id, {bucket} AS bucket, count(*) AS tf FROM (SELECT id, unnest({sql_tokens('text')}) AS term FROM ({rows})) GROUP BY ALL), "
        f"{name} AS (SELECT id, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS weight FROM {name}c)"
    )


@query(f"WITH {_vector_sql('e', _CORPUS)} SELECT id, bucket::INT AS bucket, round(weight, 6) AS weight FROM e")
def hash_embedding(s: SparkSession, d: str) -> DataFrame:
    """Hash-bag vectors of the corpus, sparse."""
    return embedding.weights(_corpus(s, d), "doc_id", "text").select("id", "bucket", F.round("weight", 6).alias("weight"))


@query(
    f"""WITH {_bm25_sql(_CORPUS)}, {_vector_sql('dv', _CORPUS)}, {_vector_sql('qv', 'SELECT query_id AS id, question AS text FROM q')},
 w AS (SELECT qv.id AS query_id, dv.id, round(sum(qv.weight * dv.weight), 6) AS score FROM qv JOIN dv USING (bucket) GROUP BY ALL),
 rb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 50),
 rw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM w WHERE score > 0 QUALIFY rank <= 50),
 f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused FROM (SELECT query_id, id, rank FROM rb UNION ALL SELECT query_id, id, rank FROM rw) GROUP BY ALL)
SELECT f.query_id, f.id, fused, coalesce(rb.score, 0) AS bm25, coalesce(rw.score, 0) AS vector, row_number() OVER (PARTITION BY f.query_id ORDER BY fused DESC, f.id) AS rank
FROM f LEFT JOIN rb ON rb.query_id = f.query_id AND rb.id = f.id LEFT JOIN rw ON rw.query_id = f.query_id AND rw.id = f.id QUALIFY row_number() OVER (PARTITION BY f.query_id ORDER BY fused DESC, f.id) <= 10"""
)
def hybrid_rrf_topk(s: SparkSession, d: str) -> DataFrame:
    """BM25 and cosine of hash-bag vectors, 50 best each, fused by reciprocal rank."""
    return embedding.hybrid(_corpus(s, d), "doc_id", "text", _questions(s, d), "query_id", "question")


@query(
    f"""WITH {_bm25_sql("SELECT 'corpus:' || doc_id AS id, text FROM retrieval_ab_corpus")}, {_bm25_sql("SELECT 'doc:' || doc_id AS id, coalesce(title, '') || ' ' || coalesce(text, '') AS text FROM documents", "q2 AS (SELECT 1)", "b2").replace(" d AS", " d2 AS").replace("FROM d)", "FROM d2)").replace(" dt AS", " dt2 AS").replace("FROM dt)", "FROM dt2)").replace("FROM dt GROUP", "FROM dt2 GROUP").replace(" dl AS (", " dl2 AS (").replace(" st AS", " st2 AS").replace("FROM dl)", "FROM dl2)").replace(" po AS", " po2 AS").replace(" df AS (", " df2 AS (").replace("FROM po GROUP", "FROM po2 GROUP").replace(" qt AS", " qt2 AS").replace("FROM qt JOIN po USING (term) JOIN df USING (term) JOIN dl ON dl.id = po.id CROSS JOIN st", "FROM qt2 JOIN po2 po USING (term) JOIN df2 USING (term) JOIN dl2 ON dl2.id = po.id CROSS JOIN st2")},
 r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 50 UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b2 QUALIFY rank <= 50),
 f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused FROM r GROUP BY ALL)
SELECT query_id, id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS rank FROM f QUALIFY rank <= 10"""
)
def multi_library_rrf(s: SparkSession, d: str) -> DataFrame:
    """Two libraries searched apart and fused; equal ids of two libraries stay distinct."""
    q = retrieval.query_terms(_questions(s, d), "query_id", "question")
    a = _corpus(s, d).select(F.concat(F.lit("corpus:"), "doc_id").alias("id"), "text")
    b = table(s, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    ranks = [search.bm25_top(x, "id", "text", q, 50) for x in (a, b)]
    return retrieval.ranked(retrieval.rrf(ranks), 10, "fused")


@query(
    f"""WITH {_Q}, lib AS (SELECT topic AS library, string_agg(DISTINCT title, ' ') AS words FROM documents WHERE topic IS NOT NULL GROUP BY topic),
 o AS (SELECT query_id, library, len(list_intersect(list_distinct({sql_tokens('question')}), list_distinct({sql_tokens('words')}))) AS overlap FROM q JOIN lib ON true)
SELECT query_id, library, overlap::INT AS overlap FROM o QUALIFY overlap > 0 OR max(overlap) OVER (PARTITION BY query_id) = 0"""
)
def routing_by_keyword_overlap(s: SparkSession, d: str) -> DataFrame:
    return retrieval.library_scores(table(s, d, "documents").where("topic is not null"), "topic", "title", _questions(s, d), "query_id", "question")


@query(
    """SELECT chunk_id, version, ingested_at FROM narrative_chunk WHERE
 (coalesce(period, '') >= '2019' AND coalesce(period, '') <= '2021' AND coalesce(topic, '') IN ('RISK', 'REG') AND coalesce(language, '') <> 'en' AND coalesce(seq::VARCHAR, '') < '5')"""
)
def metadata_filter_and(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "narrative_chunk")
    return filters.apply(c, [("period", "between", ["2019", "2021"]), ("topic", "in", ["RISK", "REG"]), ("language", "ne", "en"), ("seq", "lt", 5)]).select("chunk_id", "version", "ingested_at")


@query("""SELECT chunk_id, version, ingested_at FROM narrative_chunk WHERE coalesce(geography, '') = 'VN' OR coalesce(topic, '') NOT IN ('RISK', 'REG', 'FIN') OR coalesce(seq::VARCHAR, '') > '9'""")
def metadata_filter_or(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "narrative_chunk")
    return filters.apply(c, [("geography", "eq", "VN"), ("topic", "nin", ["RISK", "REG", "FIN"]), ("seq", "gt", 9), ("no_such_field", "eq", "x")], "or").select("chunk_id", "version", "ingested_at")


@query("SELECT chunk_id, version, ingested_at FROM narrative_chunk WHERE active = 1 AND upper(coalesce(sensitivity, '')) <> 'RESTRICTED'")
def isolation_exit_filter(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "narrative_chunk").where("active = 1").where(filters.not_restricted(F.col("sensitivity"))).select("chunk_id", "version", "ingested_at")


@query("SELECT doc_id, CASE WHEN contains(lower(coalesce(title, '')), 'board') OR contains(lower(coalesce(text, '')), 'passport') OR contains(lower(coalesce(text, '')), '证件') THEN 'RESTRICTED' ELSE 'INTERNAL' END AS label FROM documents")
def sensitivity_classify(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.sensitivity(F.col("title"), F.col("text"), ["board"], ["passport", "证件"]).alias("label"))


_CTX = "CASE WHEN coalesce({0}, '') <> '' THEN '{1}:' || {0} END"


@query(
    "WITH c AS (SELECT chunk_id, version, ingested_at, concat_ws(' · ', "
    + ", ".join(_CTX.format(a, b) for a, b in (("title", "文档"), ("entity", "实体"), ("period", "期间"), ("heading", "章节")))
    + ") AS j FROM narrative_chunk) SELECT chunk_id, version, ingested_at, CASE WHEN j <> '' THEN '[' || j || ']' ELSE '' END AS header FROM c"
)
def context_header(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "narrative_chunk").select("chunk_id", "version", "ingested_at", text.context_header(*map(F.col, ("title", "entity", "period", "heading"))).alias("header"))


_PARA = "p AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS para, text FROM (SELECT doc_id AS id, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM {t})))"


@query(f"WITH {_PARA.format(t='documents')} SELECT id, para::INT AS para, text FROM p")
def chunk_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return chunking.paragraphs(table(s, d, "documents"), "doc_id", "text")


_FORM = r"regexp_matches(text, '^#{1,6}\s+\S') OR regexp_matches(text, '^第[0-9一二三四五六七八九十百千]+[章节篇部回讲]') OR regexp_matches(text, '^([0-9]+(\.[0-9]+)*|[一二三四五六七八九十百千]+|[IVXLCDMivxlcdm]+)[.、)）]\s*\S')"
_HEAD = f"({_FORM} OR (length(text) <= 30 AND NOT regexp_matches(text, '[。！？；…，、：.!?;,:]')))"


@query(f"WITH {_PARA.format(t='documents')}, h AS (SELECT *, {_HEAD} AS is_heading FROM p) SELECT id, para::INT AS para, sum(is_heading::INT) OVER (PARTITION BY id ORDER BY para)::BIGINT AS section, is_heading, text FROM h")
def section_numbering(s: SparkSession, d: str) -> DataFrame:
    return chunking.sections(table(s, d, "documents"), "doc_id", "text")


_PRESETS = {"laws": f"({_FORM} OR regexp_matches(text, '^第[0-9一二三四五六七八九十百千]+[条款项]'))", "book": f"({_FORM})", "qa": "(regexp_matches(text, '^([Qq][:.、)）]|问[：:、])') OR regexp_matches(text, '[?？]$'))"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS preset, * FROM (WITH {_PARA.format(t='documents')} SELECT id, count(*) FILTER ({c})::BIGINT AS n_sections, min(para) FILTER ({c})::INT AS first_heading FROM p GROUP BY id)" for n, c in _PRESETS.items()))
def preset_sections(s: SparkSession, d: str) -> DataFrame:
    """Sections of every document by the rules for laws, books and questions."""
    parts = [chunking.sections(table(s, d, "documents"), "doc_id", "text", n).groupBy("id").agg(F.max("section").alias("n_sections"), F.min(F.when(F.col("is_heading"), F.col("para"))).alias("first_heading")).select(F.lit(n).alias("preset"), "*") for n in _PRESETS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""WITH {_PARA.format(t='documents')}, h AS (SELECT *, sum({_HEAD}::INT) OVER (PARTITION BY id ORDER BY para)::BIGINT AS section FROM p)
SELECT id, para::INT AS para, section, text, md5(string_agg(text, chr(10) ORDER BY para) OVER w) AS window_md5, '#para' || min(para) OVER w || '-' || max(para) OVER w AS parent_locator FROM h WINDOW w AS (PARTITION BY id, section)"""
)
def parent_child_windows(s: SparkSession, d: str) -> DataFrame:
    """Every paragraph with the text (as a digest) and the span of its section."""
    out = chunking.parent_child(table(s, d, "documents"), "doc_id", "text")
    return out.select("id", "para", "section", "text", F.md5("window_text").alias("window_md5"), "parent_locator")


_SENTENCES = (
    f"{_PARA.format(t='retrieval_ab_corpus')}, s0 AS (SELECT id, para, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM (SELECT id, para, regexp_extract_all(text, '[^.!?。！？;；\\n]+[.!?。！？;；]*') AS l FROM p)), "
    "s AS (SELECT id, para::INT AS para, (row_number() OVER (PARTITION BY id ORDER BY para, i) - 1)::INT AS seq, trim(text, ' ') AS text FROM s0 WHERE regexp_matches(text, '[^[:punct:]\\s。！？；，、]'))"
)


@query(f"WITH {_SENTENCES} SELECT id, para, seq, text FROM s")
def chunk_sentences(s: SparkSession, d: str) -> DataFrame:
    return chunking.sentences(_corpus(s, d), "doc_id", "text")


@query(
    f"""WITH {_SENTENCES}, w AS (SELECT *, lag(text) OVER o AS t0, lag(para) OVER o AS p0, lead(text) OVER o AS t2, lead(para) OVER o AS p2 FROM s WINDOW o AS (PARTITION BY id ORDER BY seq))
SELECT id, seq, para, text, coalesce(t0 || CASE WHEN p0 = para THEN ' ' ELSE chr(10) END, '') || text || coalesce(CASE WHEN p2 = para THEN ' ' ELSE chr(10) END || t2, '') AS window_text FROM w"""
)
def sentence_window(s: SparkSession, d: str) -> DataFrame:
    return chunking.sentence_window(_corpus(s, d), "doc_id", "text", 1)


@query(
    f"""WITH RECURSIVE {_PARA.format(t='documents')},
 g AS (SELECT id, para, text AS t, 0 AS seq FROM p WHERE para = 1
  UNION ALL SELECT p.id, p.para, CASE WHEN length(g.t) + 1 + length(p.text) <= 480 THEN g.t || chr(10) || p.text ELSE p.text END, CASE WHEN length(g.t) + 1 + length(p.text) <= 480 THEN g.seq ELSE g.seq + 1 END
  FROM g JOIN p ON p.id = g.id AND p.para = g.para + 1)
SELECT id, seq::INT AS seq, t AS text FROM g QUALIFY row_number() OVER (PARTITION BY id, seq ORDER BY para DESC) = 1"""
)
def chunk_greedy_no_overlap(s: SparkSession, d: str) -> DataFrame:
    return chunking.greedy(table(s, d, "documents"), "doc_id", "text")


@query()
def chunk_document_overlap(s: SparkSession, d: str) -> DataFrame:
    return chunking.overlapped(table(s, d, "documents"), "doc_id", "text")


@query("SELECT chunk_id, version, ingested_at, version = max(version) OVER (PARTITION BY doc_id) AS is_active FROM narrative_chunk")
def chunk_version_active(s: SparkSession, d: str) -> DataFrame:
    return chunking.newest(table(s, d, "narrative_chunk")).select("chunk_id", "version", "ingested_at", "is_active")


@query("SELECT doc_id, max(version) + 1 AS next_version FROM narrative_chunk GROUP BY doc_id")
def next_version(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "narrative_chunk").groupBy("doc_id").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


_WORDS_OF = f"regexp_extract_all(lower(q.question), '[a-z0-9]+|{H}')"
_TOP = f"WITH {_bm25_sql(_CORPUS)}, t AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 10)"


def _top(s: SparkSession, d: str) -> DataFrame:
    return bm25_multiquery_topk(s, d)


@query(_TOP + ", o AS (SELECT query_id, id, rank, CASE WHEN (rank - 1) % 2 = 0 THEN rank - 1 ELSE 2 * count(*) OVER (PARTITION BY query_id) - (rank - 1) END AS o FROM t) SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS place FROM o")
def lost_in_the_middle(s: SparkSession, d: str) -> DataFrame:
    return post.lost_in_the_middle(_top(s, d)).select("query_id", "id", "rank", "place")


@query()
def mmr_select(s: SparkSession, d: str) -> DataFrame:
    texts = _corpus(s, d).select(F.col("doc_id").alias("id"), "text")
    return post.mmr(post.with_texts(_top(s, d), texts), top=5)


_SENT = "regexp_extract_all(c.text, '[^!?。！？\\n]+[!?。！？]*')"


@query(
    _TOP
    + f""", s AS (SELECT t.query_id, t.id, u.i, u.s, {sql_set('u.s')} AS st, {sql_set('q.question')} AS qs FROM t JOIN q USING (query_id) JOIN retrieval_ab_corpus c ON c.doc_id = t.id, LATERAL (SELECT unnest({_SENT}) AS s, generate_subscripts({_SENT}, 1) AS i) u),
 k AS (SELECT *, CASE WHEN len(st) > 0 THEN len(list_intersect(st, qs))::DOUBLE / len(st) ELSE 0 END AS cov FROM s)
SELECT query_id, id, coalesce(string_agg(s, '' ORDER BY i) FILTER (cov >= 0.3), arg_min(s, (-cov, i))) AS prompt_text FROM k GROUP BY query_id, id"""
)
def compress_extractive(s: SparkSession, d: str) -> DataFrame:
    texts = _corpus(s, d).select(F.col("doc_id").alias("id"), "text")
    q = _questions(s, d).select("query_id", text.token_set(F.col("question")).alias("qs"))
    return post.compress(post.with_texts(_top(s, d), texts).join(q, "query_id"), "qs", "text").select("query_id", "id", "prompt_text")


@query(
    _TOP
    + """, m AS (SELECT t.query_id, t.id, rank, CASE WHEN rank % 3 = 2 THEN 'RESTRICTED' ELSE 'INTERNAL' END AS sens FROM t),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k, row_number() OVER (PARTITION BY query_id ORDER BY id DESC) AS k2 FROM m WHERE sens <> 'RESTRICTED')
SELECT a.query_id, a.id, b.rank AS new_rank FROM o a JOIN o b ON a.query_id = b.query_id AND a.k2 = b.k UNION ALL SELECT query_id, id, rank FROM m WHERE sens = 'RESTRICTED'"""
)
def rerank_slots_restricted(s: SparkSession, d: str) -> DataFrame:
    """A judge that reverses ids; restricted rows (each third rank) keep their place."""
    from pyspark.sql import Window

    r = durable(_top(s, d)).withColumn("sensitivity", F.when(F.col("rank") % 3 == 2, "RESTRICTED").otherwise("INTERNAL"))
    judged = r.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("id"))).alias("pos"))
    return post.rerank_slots(r, judged)


@query(
    f"""WITH {_bm25_sql("SELECT chunk_id AS id, max(text) AS text FROM narrative_chunk WHERE active = 1 AND chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id")},
 r AS (SELECT query_id, split_part(id, '#', 1) AS doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 10),
 g AS (SELECT query_id, expected_doc AS doc FROM q WHERE expected_doc IS NOT NULL)
SELECT g.query_id, round(count(DISTINCT g.doc) FILTER (rank <= 5)::DOUBLE / count(DISTINCT g.doc), 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS mrr FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.doc = g.doc GROUP BY g.query_id"""
)
def recall_and_mrr(s: SparkSession, d: str) -> DataFrame:
    """Recall at 5 and reciprocal rank of the expected file of every question among the ten best chunks."""
    docs = table(s, d, "narrative_chunk").where("active = 1 and chunk_id is not null and text is not null").groupBy("chunk_id").agg(F.max("text").alias("text"))
    hits = search.bm25_top(docs, "chunk_id", "text", retrieval.query_terms(_questions(s, d), "query_id", "question"), 10)
    best = hits.groupBy("query_id", F.split_part("id", F.lit("#"), F.lit(1)).alias("id")).agg(F.min("rank").alias("rank"))
    gold = _questions(s, d).where("expected_doc is not null").select("query_id", F.col("expected_doc").alias("id")).distinct()
    return evaluation.recall_mrr(best, gold)


@query(
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\\n\\r]+'), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '^({"|".join(text.FRAMING)})')) AS l FROM retrieval_ab_corpus WHERE text IS NOT NULL),
 c AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(l, lambda x: regexp_split_to_array(regexp_replace(regexp_replace(x, '（(?:资料)?来源[：:][^）]*）', '', 'g'), '\\[[0-9]+\\]', ' ', 'g'), '[。！？!?；;]+'))), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '[A-Za-z0-9]|{H}')) AS cl FROM l),
 e AS (SELECT doc_id, unnest(cl) AS claim, generate_subscripts(cl, 1) AS i FROM c) SELECT doc_id, i::INT AS i, claim FROM e"""
)
def claims_split(s: SparkSession, d: str) -> DataFrame:
    return _corpus(s, d).select("doc_id", F.posexplode(text.claims(F.col("text"))).alias("p", "claim")).select("doc_id", (F.col("p") + 1).alias("i"), "claim")


@query("SELECT doc_id, regexp_extract_all(regexp_replace(text, '(?:FY)?(?:19|20)[0-9]{2}(?:[HQ][1-4])?', ' ', 'g'), '[0-9]+(?:[.,][0-9]+)*').array_to_string('|') AS numbers FROM retrieval_ab_corpus")
def fabrication_numbers(s: SparkSession, d: str) -> DataFrame:
    n = text.stray_numbers(F.col("text"))
    return _corpus(s, d).select("doc_id", F.array_join(n, "|").alias("numbers"))


@query(
    f"""WITH a AS (SELECT x.doc_id, x.text AS answer, y.text AS source FROM retrieval_ab_corpus x JOIN retrieval_ab_corpus y ON regexp_replace(y.doc_id, '[^0-9]', '', 'g')::BIGINT = regexp_replace(x.doc_id, '[^0-9]', '', 'g')::BIGINT + 1)
SELECT doc_id, CASE WHEN len({sql_set('source')}) = 0 THEN 1.0 ELSE round(len(list_intersect({sql_set('source')}, {sql_set('answer')}))::DOUBLE / len({sql_set('source')}), 6) END AS accuracy FROM a"""
)
def answer_accuracy(s: SparkSession, d: str) -> DataFrame:
    """Token recall of each corpus text against the next one."""
    num = F.regexp_replace("doc_id", "[^0-9]", "").cast("long")
    c = _corpus(s, d).select("doc_id", "text", num.alias("n"))
    nxt = c.select((F.col("n") - 1).alias("n"), F.col("text").alias("source"))
    return c.join(nxt, "n").select("doc_id", evaluation.accuracy(F.col("text"), F.col("source")).alias("accuracy"))


@query(
    f"""WITH c AS (SELECT doc_id, text, regexp_replace(doc_id, '[^0-9]', '', 'g')::BIGINT AS n FROM retrieval_ab_corpus), j AS (SELECT a.doc_id, a.text, {sql_set('b.text')} AS known FROM c a JOIN c b ON b.n = a.n + 1),
 l AS (SELECT doc_id, known, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\\n\\r]+'), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '^({"|".join(text.FRAMING)})')) AS l FROM j),
 k AS (SELECT doc_id, known, list_filter(list_transform(flatten(list_transform(l, lambda x: regexp_split_to_array(regexp_replace(regexp_replace(x, '（(?:资料)?来源[：:][^）]*）', '', 'g'), '\\[[0-9]+\\]', ' ', 'g'), '[。！？!?；;]+'))), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '[A-Za-z0-9]|{H}')) AS cl FROM l)
SELECT doc_id, CASE WHEN len(cl) = 0 THEN 1.0 ELSE round(len(list_filter(cl, lambda x: len(list_filter(regexp_extract_all(lower(x), '[a-z0-9]+|{H}'), lambda t: list_contains(known, t))) >= 0.6 * len(regexp_extract_all(lower(x), '[a-z0-9]+|{H}'))))::DOUBLE / len(cl), 6) END AS faithfulness FROM k"""
)
def faithfulness_score(s: SparkSession, d: str) -> DataFrame:
    num = F.regexp_replace("doc_id", "[^0-9]", "").cast("long")
    c = _corpus(s, d).select("doc_id", "text", num.alias("n"))
    nxt = c.select((F.col("n") - 1).alias("n"), F.col("text").alias("source"))
    return c.join(nxt, "n").select("doc_id", evaluation.faithfulness(F.col("text"), F.col("source")).alias("faithfulness"))


@query(
    """WITH o AS (SELECT case_type AS tag, expected_value IS NOT NULL OR refuse AS ok FROM qa_golden_set),
 g AS (SELECT tag, count(*) AS total, count(*) FILTER (ok) AS passed FROM o GROUP BY tag UNION ALL SELECT 'ALL', count(*), count(*) FILTER (ok) FROM o)
SELECT *, CASE WHEN total = 0 THEN 1.0 ELSE round(passed::DOUBLE / total, 6) END AS pass_rate FROM g"""
)
def gate_metrics_by_tag(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "qa_golden_set").select("case_type", (F.col("expected_value").isNotNull() | F.col("refuse")).alias("ok"))
    return evaluation.gates(o, "case_type", "ok")


@query(
    """WITH n AS (SELECT case_type AS name, round(avg(refuse::INT), 6) AS value FROM qa_golden_set GROUP BY 1), b AS (SELECT topic AS name, 0.5 AS base FROM qa_golden_set UNION SELECT case_type, 0.5 FROM qa_golden_set)
SELECT n.name, n.value, b.base FROM n JOIN b USING (name) WHERE value < base"""
)
def baseline_regressions(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "qa_golden_set")
    now = q.groupBy(F.col("case_type").alias("name")).agg(F.round(F.avg(F.col("refuse").cast("int")), 6).alias("value"))
    base = q.select(F.col("topic").alias("name")).union(q.select("case_type")).distinct().withColumn("value", F.lit(0.5))
    return evaluation.regressions(now, base)


@query(
    """WITH m AS (SELECT a.vec_id, list_sum(list_transform([b.embedding[1:16], b.embedding[17:32]]::DOUBLE[][], lambda q: list_max(list_transform([a.embedding[1:16], a.embedding[17:32], a.embedding[33:48]]::DOUBLE[][],
 lambda x: list_dot_product(q, x) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(x, x))))))) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = 0) SELECT vec_id, round(v, 6) AS score FROM m"""
)
def maxsim_score(s: SparkSession, d: str) -> DataFrame:
    """Late interaction of slices of vector 0 with slices of every vector."""
    e = table(s, d, "embeddings")
    part = lambda c, k: F.slice(c, 16 * k + 1, 16)
    q = e.where("vec_id = 0").select(F.array(part("embedding", 0), part("embedding", 1)).alias("q"))
    docs = e.select("vec_id", F.array(*[part("embedding", k) for k in range(3)]).alias("x"))
    return docs.crossJoin(F.broadcast(q)).select("vec_id", F.round(vectors.maxsim(F.col("q"), F.col("x")), 6).alias("score"))


@query(
    f"""WITH t AS (SELECT doc_id, term, count(*)::DOUBLE AS w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM retrieval_ab_corpus) GROUP BY ALL)
SELECT a.doc_id, round(sum(a.w * b.w), 6) AS score FROM t a JOIN t b ON a.term = b.term JOIN (SELECT min(doc_id) AS q FROM t) m ON b.doc_id = m.q GROUP BY a.doc_id"""
)
def sparse_dot_score(s: SparkSession, d: str) -> DataFrame:
    """Learned-sparse style score of all texts against the first, as an equi-join on terms."""
    t = _corpus(s, d).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").cast("double").alias("w"))
    first = t.agg(F.min("doc_id").alias("q"))
    q = t.join(F.broadcast(first), t["doc_id"] == F.col("q")).select("term", F.col("w").alias("qw"))
    return t.join(q, "term").groupBy("doc_id").agg(F.round(F.sum(F.col("w") * F.col("qw")), 6).alias("score"))


@query(
    """WITH s AS (SELECT vec_id, label, list_transform(range(0, len(embedding), 16), lambda k: embedding[k + 1:k + 16])::DOUBLE[][] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
 m AS (SELECT b.vec_id AS query_id, a.vec_id, list_sum(list_transform(b.x, lambda q: list_max(list_transform(a.x, lambda x: list_dot_product(q, x) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(x, x))))))) AS v FROM s a JOIN s b ON b.vec_id % 20 = 0)
SELECT query_id, vec_id, round(v, 6) AS score FROM m"""
)
def maxsim_score_all(s: SparkSession, d: str) -> DataFrame:
    """Late interaction of all slices of every vector whose id is divisible by 20 with all slices of every vector."""
    e = table(s, d, "embeddings").where("vec_id is not null and size(embedding) > 0")
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("embedding") / 16).cast("int") - 1), lambda k: F.slice("embedding", 16 * k + 1, 16))
    docs = e.select("vec_id", parts.alias("x")).repartition(width(s))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), parts.alias("q"))
    return docs.crossJoin(q).select("query_id", "vec_id", F.round(vectors.maxsim(F.col("q"), F.col("x")), 6).alias("score"))


@query(
    r"""WITH t AS (SELECT doc_id, term, count(*)::DOUBLE AS w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM retrieval_ab_corpus) GROUP BY ALL)
SELECT b.doc_id AS query_id, a.doc_id, round(sum(a.w * b.w), 6) AS score FROM t a JOIN t b ON a.term = b.term WHERE TRY_CAST(right(regexp_replace(b.doc_id, '[^0-9]', '', 'g'), 2) AS INT) % 20 = 0 GROUP BY ALL"""
)
def sparse_dot_score_all(s: SparkSession, d: str) -> DataFrame:
    """Learned-sparse style score of all texts against every text whose id, read by its digits, is divisible by 20."""
    number = F.right(F.regexp_replace("doc_id", "[^0-9]", ""), F.lit(2)).try_cast("int")
    return search.products(_corpus(s, d), "doc_id", "text", number % 20 == 0).withColumnRenamed("id", "doc_id")


@query(
    """WITH v(raw) AS (VALUES ('2024'), ('FY2024'), ('fy 2023 h1'), ('2022Q3'), ('2022 q5'), ('H1 2024'), ('二零二四'), ('')),
 s AS (SELECT raw, replace(upper(regexp_replace(raw, '\\s+', '', 'g')), 'FY', '') AS p FROM v)
SELECT raw, CASE WHEN regexp_matches(p, '^[0-9]{4}H[12]$') THEN 'HY' WHEN regexp_matches(p, '^[0-9]{4}Q[1-4]$') THEN 'QUARTER' WHEN regexp_matches(p, '^[0-9]{4}$') THEN 'FY' END AS period_type,
 CASE WHEN regexp_matches(p, '^[0-9]{4}([HQ][1-4])?$') AND NOT regexp_matches(p, 'H[34]$') THEN p END AS period FROM s"""
)
def normalize_period_values(s: SparkSession, d: str) -> DataFrame:
    v = s.createDataFrame([(x,) for x in ("2024", "FY2024", "fy 2023 h1", "2022Q3", "2022 q5", "H1 2024", "二零二四", "")], "raw string")
    p = periods.normalize(F.col("raw"))
    return v.select("raw", p["period_type"].alias("period_type"), p["period"].alias("period"))


@query(
    """SELECT id, (year(reference_date) - 1)::VARCHAR AS last_year, ((year(reference_date) * 4 + quarter(reference_date) - 2) // 4)::VARCHAR || 'Q' || ((year(reference_date) * 4 + quarter(reference_date) - 2) % 4 + 1)::VARCHAR AS last_quarter FROM qa_golden_set"""
)
def relative_period(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "qa_golden_set")
    return q.select("id", periods.relative_year(F.lit("last year"), F.col("reference_date")).alias("last_year"), periods.relative_quarter(F.lit("last quarter"), F.col("reference_date")).alias("last_quarter"))


@query("""WITH f AS (SELECT doc_id, source_path, list_distinct(regexp_extract_all(upper(doc_id), '(?:FY)?((?:19|20)[0-9]{2}(?:[HQ][1-4])?)', 1)) AS l FROM narrative_doc) SELECT doc_id, source_path, CASE WHEN len(l) = 1 THEN l[1] ELSE '' END AS period FROM f""")
def period_from_filename(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "narrative_doc").select("doc_id", "source_path", periods.from_filename(F.col("doc_id")).alias("period"))


_CLEAN = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' '))"


@query(
    f"""WITH w AS (SELECT {_CLEAN.format('name_en')} AS w, metric_code FROM metric_def UNION SELECT {_CLEAN.format('name_zh')}, metric_code FROM metric_def UNION SELECT lower(metric_code), metric_code FROM metric_def),
 f AS (SELECT fact_id, {_CLEAN.format('raw_label')} AS a, {_CLEAN.format("regexp_replace(raw_label, '[(（【].*$', '')")} AS b FROM fact_metric)
SELECT fact_id, coalesce(x.metric_code, y.metric_code) AS code FROM f LEFT JOIN w x ON x.w = a LEFT JOIN w y ON y.w = b"""
)
def normalize_metric(s: SparkSession, d: str) -> DataFrame:
    """Row labels to metric codes: the whole label, else the label without what follows a bracket; null where neither is a name."""
    m = table(s, d, "metric_def")
    words = m.select(text.clean(F.col("name_en")).alias("w"), "metric_code").union(m.select(text.clean(F.col("name_zh")), "metric_code")).union(m.select(F.lower("metric_code"), "metric_code")).distinct()
    f = table(s, d, "fact_metric").select("fact_id", text.clean(F.col("raw_label")).alias("a"), text.clean(F.regexp_replace("raw_label", "[(（【].*$", "")).alias("b"))
    x = words.select(F.col("w").alias("a"), F.col("metric_code").alias("x"))
    y = words.select(F.col("w").alias("b"), F.col("metric_code").alias("y"))
    return f.join(x, "a", "left").join(y, "b", "left").select("fact_id", F.coalesce("x", "y").alias("code"))


@query(
    _TOP
    + f""", g AS (SELECT query_id, list_distinct(flatten(list({sql_set('c.text')}))) AS seen FROM t JOIN retrieval_ab_corpus c ON c.doc_id = t.id WHERE rank <= 5 GROUP BY query_id)
SELECT q.query_id, CASE WHEN len({_WORDS_OF}) = 0 THEN 1.0 WHEN seen IS NULL THEN 0.0 ELSE round(len(list_filter({_WORDS_OF}, lambda x: list_contains(seen, x)))::DOUBLE / len({_WORDS_OF}), 6) END AS grade FROM q LEFT JOIN g USING (query_id)"""
)
def relevance_grade(s: SparkSession, d: str) -> DataFrame:
    """Share of the question's words, repeats counted, found in its five best texts together."""
    texts = _corpus(s, d).select(F.col("doc_id").alias("id"), "text")
    found = post.with_texts(_top(s, d).where("rank <= 5"), texts).select("query_id", text.token_set(F.col("text")).alias("t"))
    seen = found.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("seen"))
    words = F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9]+|" + text.CJK), F.lit(0))
    q = _questions(s, d).select("query_id", words.alias("q")).join(seen, "query_id", "left")
    grade = F.when(F.size("q") == 0, 1.0).when(F.col("seen").isNull(), 0.0).otherwise(F.round(F.size(F.filter("q", lambda x: F.array_contains("seen", x))) / F.size("q"), 6))
    return q.select("query_id", grade.alias("grade"))


#: Confidence from which a template is used again.
REUSE = 0.74
_FOLD = "lower(trim(regexp_replace({}, '[\\s\\p{{Z}}]+', ' ', 'g')))"


@query(
    f"""WITH {_bm25_sql(_CORPUS)}, m AS (SELECT query_id, max(score) AS top FROM b GROUP BY 1),
 o AS (SELECT query_id, b.id, len(list_intersect(list_distinct({sql_tokens('question')}), list_distinct({sql_tokens('c.text')}))) AS common, len(list_distinct({sql_tokens('question')})) AS words, score / top AS part, {_FOLD.format('question')} = {_FOLD.format('c.text')} AS exact
  FROM b JOIN m USING (query_id) JOIN q USING (query_id) JOIN retrieval_ab_corpus c ON c.doc_id = b.id),
 x AS (SELECT query_id, id, CASE WHEN exact THEN 1.0 WHEN common < 2 THEN least(round(least(1.0, 0.62 * common::DOUBLE / words + 0.38 * part), 4), {REUSE} - 0.01) ELSE round(least(1.0, 0.62 * common::DOUBLE / words + 0.38 * part), 4) END::DOUBLE AS confidence FROM o)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, id) AS rank FROM x QUALIFY rank <= 3"""
)
def template_confidence(s: SparkSession, d: str) -> DataFrame:
    """Match confidence: 1 for the same words, else 0.62 of the word overlap and 0.38 of the score against the best one, and below the threshold of reuse with fewer than two common words; three best per query."""
    from pyspark.sql import Window

    q = _questions(s, d)
    words = lambda c: F.array_distinct(text.tokens(F.col(c)))
    some = search.confidence_top(_corpus(s, d), "doc_id", "text", retrieval.query_terms(q, "query_id", "question"), 3, REUSE - 0.01)
    asked = q.where(F.size(words("question")) > 0).select("query_id", text.clean(F.col("question")).alias("key"))
    same = _corpus(s, d).select(F.col("doc_id").alias("id"), text.clean(F.col("text")).alias("key")).join(asked.select("key").distinct(), "key", "left_semi")
    least = same.where("id is not null").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where("n <= 3")
    exact = asked.join(least, "key").select("query_id", "id", F.lit(1.0).alias("confidence"))
    out = some.select("query_id", "id", F.col("score").alias("confidence")).unionByName(exact).groupBy("query_id", "id").agg(F.max("confidence").alias("confidence"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "id"))).where("rank <= 3")


@query(
    f"""WITH {_PARA.format(t='documents')}, c AS (SELECT id, para, ('0x' || substr(md5(term), 1, 8))::BIGINT % 256 AS bucket, count(*) AS tf FROM (SELECT id, para, unnest({sql_tokens('text')}) AS term FROM p) GROUP BY ALL),
 e AS (SELECT id, para, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id, para)) AS w FROM c), n AS (SELECT a.id, a.para, sum(a.w * b.w) AS cos FROM e a JOIN e b ON a.id = b.id AND a.para = b.para + 1 AND a.bucket = b.bucket GROUP BY ALL),
 d AS (SELECT p.id, p.para, CASE WHEN p.para > 1 THEN round(1 - coalesce(cos, 0), 6) END AS d FROM p LEFT JOIN n ON n.id = p.id AND n.para = p.para), l AS (SELECT id, quantile_cont(d, 0.9) AS lim FROM d GROUP BY id)
SELECT d.id, d.para::INT AS para, sum(coalesce(d >= round(lim, 6) AND d > 0, FALSE)::INT) OVER (PARTITION BY d.id ORDER BY d.para)::BIGINT AS segment FROM d JOIN l ON l.id = d.id"""
)
def semantic_segments(s: SparkSession, d: str) -> DataFrame:
    """Segments of documents cut where neighbouring paragraphs share little."""
    return chunking.semantic_cuts(table(s, d, "documents"), "doc_id", "text")
