"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import scoring, text
from gleaner.operators import cache, citations, classify, context, findings, merge, plan, producers, prompts, quality, report, retrieval, review, segments, targets
from gleaner.plans import standins as s
from gleaner.plans.standins import table
from gleaner.sources import firmware, knowledge, portscan, web
from gleaner.storage import keep, shared_dir
from gleaner.streaming import jobs

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Severity, rules and classification


@query(f"""SELECT event_id, CASE WHEN value < 5 THEN NULL WHEN value / 50 >= 9 THEN 'critical' WHEN value / 50 >= 7 THEN 'high' WHEN value / 50 >= 4 THEN 'medium' ELSE 'low' END AS severity,
  CAST({s.RANK.format("CASE WHEN value < 5 THEN NULL WHEN value / 50 >= 9 THEN 'critical' WHEN value / 50 >= 7 THEN 'high' WHEN value / 50 >= 4 THEN 'medium' ELSE 'low' END")} AS INTEGER) AS severity_rank,
  CASE WHEN value >= 5 THEN round(CAST(regexp_extract(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' (HIGH)', '^\\s*(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE), 6) END AS parsed FROM events""")
def severity_from_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = scoring.score_to_severity(F.when(F.col("value") >= 5, F.col("value") / 50))
    shown = F.when(F.col("value") >= 5, F.concat(F.floor("value").cast("string"), F.lit(" (HIGH)"))).otherwise("N/A")
    return table(spark, sf_dir, "events").select("event_id", level.alias("severity"), scoring.level_rank(level).cast("int").alias("severity_rank"), F.round(scoring.parse_score(shown), 6).alias("parsed"))


@query(f"WITH {s.FINDINGS}, {s.RULES} SELECT finding_id, rr AS risk, coalesce(rc, '') AS cra, rs IS NOT NULL AS found FROM findings LEFT JOIN rules ON lower(trim(service)) = rs")
def rule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.with_rule(s.findings(spark, sf_dir))
    return rows.select("finding_id", F.col("rule_risk").alias("risk"), F.coalesce("rule_cra", F.lit("")).alias("cra"), F.col("rule_service").isNotNull().alias("found"))


@query(f"WITH {s.CLASSIFIED} SELECT finding_id, status, method, risk_level, cra_reference, iec_reference, known_list, weakness_reason, recommendation FROM classified")
def classify_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(s.findings(spark, sf_dir)).select("finding_id", "status", "method", "risk_level", "cra_reference", "iec_reference", "known_list", "weakness_reason", "recommendation")


@query(f"""WITH {s.FINDINGS} SELECT finding_id, CASE WHEN severity IN ('critical', 'high', 'medium', 'low') THEN severity WHEN alert_risk IN ('critical', 'high', 'medium', 'low', 'info') THEN alert_risk ELSE 'info' END AS risk FROM findings""")
def fallback_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.findings(spark, sf_dir).select("finding_id", scoring.fallback_risk(F.col("severity"), F.col("alert_risk")).alias("risk"))


@query(f"""WITH {s.FINDINGS} SELECT finding_id, CASE WHEN category = 'network' THEN service || ' service' || CASE WHEN finding_id % 2 = 0 THEN ' p' || finding_id % 5 ELSE '' END || ' 1.' || finding_id % 4 ELSE title END AS query FROM findings""")
def rag_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("finding_id")
    product = F.when(n % 2 == 0, F.concat(F.lit("p"), (n % 5).cast("string"))).otherwise("")
    return s.findings(spark, sf_dir).select("finding_id", classify.retrieval_text(F.col("category"), F.col("service"), F.col("title"), product, F.concat(F.lit("1."), (n % 4).cast("string"))).alias("query"))


# Merging, ranking, grouping


@query("""WITH b AS (SELECT l_orderkey, l_returnflag AS status, CASE WHEN l_quantity >= 40 THEN 'critical' WHEN l_quantity >= 20 THEN 'low' END AS risk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC) AS r FROM lineitem)
  SELECT o_orderkey AS finding_id, coalesce(status, 'no_match') AS status, coalesce(risk, 'info') AS risk_level FROM orders LEFT JOIN b ON o_orderkey = l_orderkey AND r = 1""")
def merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = F.when(F.col("l_quantity") >= 40, "critical").when(F.col("l_quantity") >= 20, "low")
    analysis = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), F.struct("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate").alias("seq"), F.col("l_returnflag").alias("status"), risk.alias("risk_level"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"))
    return merge.merge(orders, analysis).select("finding_id", "status", "risk_level")


RANKED = f"""{s.CLASSIFIED}, firsts AS (SELECT target, min(({s.RANK.format("risk_level")}) * 1000000000::BIGINT + seq) AS first_at FROM classified GROUP BY target),
  grouped AS (SELECT target, row_number() OVER (ORDER BY first_at) AS group_rank FROM firsts)"""


@query(f"""WITH {RANKED} SELECT finding_id, c.target, status, risk_level, CAST(group_rank AS INTEGER) AS group_rank,
  CAST(row_number() OVER (PARTITION BY c.target ORDER BY {s.RANK.format("risk_level")}, seq) AS INTEGER) AS item_rank FROM classified c JOIN grouped g ON c.target = g.target""")
def risk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: findings classified, merged with their analysis, ranked by risk and grouped by target."""
    found = s.findings(spark, sf_dir)
    analysis = classify.classify(found).select("finding_id", "seq", "status", "risk_level")
    merged = merge.merge(found.select("finding_id", "seq", "target"), analysis)
    return merge.target_ranks(merged).select("finding_id", "target", "status", "risk_level", "group_rank", "item_rank")


@query(f"WITH {RANKED} SELECT c.target, CAST(group_rank AS INTEGER) AS group_rank, count(*) AS n, min({s.RANK.format('risk_level')}) AS worst FROM classified c JOIN grouped g ON c.target = g.target GROUP BY ALL")
def group_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.target_ranks(classify.classify(s.findings(spark, sf_dir)))
    return rows.groupBy("target", "group_rank").agg(F.count(F.lit(1)).alias("n"), F.min(scoring.level_rank(F.col("risk_level"))).alias("worst"))


@query("""SELECT coalesce(string_agg(DISTINCT c_name, ', ' ORDER BY c_name) FILTER (k = 0), '') AS network, coalesce(string_agg(DISTINCT c_name, ', ' ORDER BY c_name) FILTER (k = 1), '') AS firmware, '' AS webapp
  FROM (SELECT n_name AS c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 2 END AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def infer_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "network").when(F.col("c_mktsegment") == "MACHINERY", "firmware").otherwise("pentest")
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return merge.scope(rows.select(kind.alias("category"), F.col("n_name").alias("target")))


PROCESS = f"""{s.FINDINGS}, kinds AS (SELECT target, category, min(seq) AS first_at FROM findings GROUP BY ALL),
  titles AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY first_at) AS r FROM (SELECT target, title, min(seq) AS first_at FROM findings GROUP BY ALL)) WHERE r <= 15),
  process AS (SELECT target, string_agg(piece, ' ' ORDER BY part, first_at) AS query FROM (SELECT target, 0 AS part, first_at, CASE category WHEN 'network' THEN '{merge.CATEGORY_PHRASES["network"]}' WHEN 'firmware' THEN '{merge.CATEGORY_PHRASES["firmware"]}' ELSE '{merge.CATEGORY_PHRASES["webapp"]}' END AS piece FROM kinds
    UNION ALL SELECT target, 1, first_at, title FROM titles) GROUP BY target)"""


@query(f"WITH {PROCESS} SELECT target, query FROM process")
def process_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.process_query(s.findings(spark, sf_dir), "target")


@query("""SELECT 'event' AS source, CAST(0 AS INTEGER) AS ord, event_id AS id FROM events WHERE event_type = 'error' UNION ALL SELECT 'order', 1, o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT 'page', 2, page_id FROM pages""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.lit("event").alias("source"), F.lit(0).alias("ord"), F.col("event_id").alias("id")),
        table(spark, sf_dir, "orders").filter("o_orderpriority LIKE '1%'").select(F.lit("order").alias("source"), F.lit(1).alias("ord"), F.col("o_orderkey").alias("id")),
        table(spark, sf_dir, "pages").select(F.lit("page").alias("source"), F.lit(2).alias("ord"), F.col("page_id").alias("id")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Retrieval

TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM t GROUP BY term")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.term_counts(table(spark, sf_dir, "documents"), "doc_id")


def bm25_sql(docs: str, queries: str) -> str:
    """Okapi BM25 over (kb, pos, text) and (query_id, query); a negative idf becomes a quarter of the mean."""
    return f"""docs AS ({docs}), queries AS ({queries}),
      tokens AS (SELECT kb, pos, unnest({TOKENS}) AS term FROM docs), lens AS (SELECT kb, pos, len({TOKENS}) AS dl FROM docs),
      stats AS (SELECT kb, count(*) AS n, avg(dl) AS avgdl FROM lens GROUP BY kb), tfs AS (SELECT kb, pos, term, count(*) AS tf FROM tokens GROUP BY ALL),
      raw AS (SELECT kb, term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT kb, term, count(*) AS df FROM tfs GROUP BY ALL) JOIN stats USING (kb)),
      idfs AS (SELECT kb, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY kb) ELSE raw END AS idf FROM raw),
      asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM queries) GROUP BY ALL),
      scored AS (SELECT query_id, kb, pos, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked JOIN tfs USING (term) JOIN idfs USING (kb, term) JOIN lens USING (kb, pos) JOIN stats USING (kb) GROUP BY ALL),
      filled AS (SELECT q.query_id, d.kb, d.pos, coalesce(x.score, 0) AS score FROM (SELECT DISTINCT query_id FROM queries) q CROSS JOIN docs d LEFT JOIN scored x ON x.query_id = q.query_id AND x.kb = d.kb AND x.pos = d.pos),
      sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kb ORDER BY round(score, 9) DESC, pos) AS sparse_rank FROM filled) WHERE sparse_rank <= 10)"""


SPARSE = bm25_sql("SELECT lang AS kb, doc_id AS pos, text FROM documents", "SELECT item_id AS query_id, text AS query FROM benchmark")


@query(f"WITH {SPARSE} SELECT kb, term, df, round(idf, 6) AS idf FROM idfs JOIN raw USING (kb, term)")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = s.documents_as_kb(spark, sf_dir)
    weights = retrieval.term_weights(retrieval.entry_counts(docs), retrieval.corpus_stats(docs))
    return weights.select("kb", "term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {SPARSE} SELECT query_id, kb, pos, round(score, 6) AS score, CAST(sparse_rank AS INTEGER) AS sparse_rank FROM sparse")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.search_topk(s.benchmark_queries(spark, sf_dir), s.stored_documents(spark, sf_dir, "lang"))
    return rows.select("query_id", "kb", "pos", F.round("score", 6).alias("score"), "sparse_rank")


@query("SELECT * FROM (SELECT CAST(query_id AS BIGINT) AS query_id, lang AS kb, doc_id AS pos, CAST(row_number() OVER (PARTITION BY query_id, lang ORDER BY doc_id) AS INTEGER) AS sparse_rank FROM documents CROSS JOIN (SELECT unnest([1, 2]) AS query_id)) WHERE sparse_rank <= 10")
def bm25_empty_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([(1, ""), (2, "?!")], "query_id long, query string")
    return retrieval.search_topk(empty, s.stored_documents(spark, sf_dir, "lang")).select("query_id", "kb", "pos", "sparse_rank")


COMMON = bm25_sql("SELECT source AS kb, doc_id AS pos, 'a b' || repeat(' c', CAST(doc_id % 5 AS INTEGER)) || CASE WHEN doc_id % 7 = 0 THEN ' d' ELSE '' END AS text FROM documents", "SELECT unnest([1, 2, 3]) AS query_id, unnest(['a', 'c b c', 'd']) AS query")


@query(f"WITH {COMMON} SELECT query_id, kb, pos, round(score, 6) AS score, CAST(sparse_rank AS INTEGER) AS sparse_rank FROM sparse")
def bm25_common_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that most entries have weigh less than nothing, so entries without them come first."""
    n = F.col("doc_id")
    text = F.concat(F.lit("a b"), F.repeat(F.lit(" c"), (n % 5).cast("int")), F.when(n % 7 == 0, " d").otherwise(""))
    entries = table(spark, sf_dir, "documents").select(F.col("source").alias("kb"), n.alias("pos"), text.alias("text"))
    asked = spark.createDataFrame([(1, "a"), (2, "c b c"), (3, "d")], "query_id int, query string")
    return retrieval.bm25_topk(asked, entries).select("query_id", "kb", "pos", F.round("score", 6).alias("score"), "sparse_rank")


DENSE = """dense AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS pos, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) DESC, v.vec_id) AS dense_rank
  FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 10 = 0) WHERE dense_rank <= 10)"""


def dense_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.nearest_topk(asked, s.stored_vectors(spark, sf_dir))


@query(f"WITH {DENSE} SELECT query_id, pos, round(score, 6) AS score, CAST(dense_rank AS INTEGER) AS dense_rank FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_candidates(spark, sf_dir).select("query_id", "pos", F.round("score", 6).alias("score"), "dense_rank")


@query(f"WITH {DENSE} SELECT query_id, pos, CASE WHEN score IS NULL THEN NULL WHEN score >= 0.8 THEN '高' WHEN score >= 0.6 THEN '中' ELSE '低' END AS label FROM dense")
def confidence_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_candidates(spark, sf_dir).select("query_id", "pos", scoring.confidence_label(F.col("score")).alias("label"))


@query("""WITH lists AS (SELECT o_custkey AS q, o_orderkey % 40 AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders
  UNION ALL SELECT o_custkey, o_orderkey % 40, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) FROM orders)
  SELECT q, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM lists GROUP BY ALL""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), (F.col("o_orderkey") % 40).alias("key"), "o_orderkey", "o_totalprice", "o_orderdate")
    ranked = [orders.select("q", "key", F.row_number().over(Window.partitionBy("q").orderBy(*by)).alias("rank")) for by in ((F.desc("o_totalprice"), "o_orderkey"), ("o_orderdate", "o_orderkey"))]
    return retrieval.fuse(ranked[0].unionByName(ranked[1]), ["q", "key"]).select("q", "key", F.round("rrf", 9).alias("rrf"))


HYBRID_SPARSE = bm25_sql("SELECT 'all' AS kb, doc_id AS pos, text FROM documents", "SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 10 = 0")


def hybrid_sql(mode: str) -> str:
    d, x = ("dense" if mode != "sparse" else "(SELECT * FROM dense LIMIT 0)"), ("sparse" if mode != "dense" else "(SELECT * FROM sparse LIMIT 0)")
    return f"""WITH {HYBRID_SPARSE}, {DENSE}, fused AS (SELECT coalesce(d.query_id, x.query_id) AS query_id, coalesce(d.pos, x.pos) AS pos, d.score AS dense_score, dense_rank, sparse_rank,
      coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) AS rrf FROM {d} d FULL JOIN {x} x ON d.query_id = x.query_id AND d.pos = x.pos)
      SELECT query_id, pos, round(dense_score, 6) AS score, round(rrf, 9) AS rrf, CASE WHEN dense_rank IS NULL THEN 'sparse' WHEN sparse_rank IS NULL THEN 'dense' ELSE 'dense,sparse' END AS matched_by, CAST(rank AS INTEGER) AS rank
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, coalesce(dense_rank, 1000000 + sparse_rank)) AS rank FROM fused) WHERE rank <= 5"""


def hybrid(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Documents as queries over the stored index, vectors as queries over all vectors; only the side that the mode takes is searched."""
    asked = s.documents_as_kb(spark, sf_dir).filter("pos % 10 = 0").select(F.col("pos").alias("query_id"), F.col("text").alias("query"))
    sparse = retrieval.search_topk(asked, s.stored_documents(spark, sf_dir, "all")) if mode != "dense" else spark.createDataFrame([], "query_id long, pos long, sparse_rank int")
    dense = dense_candidates(spark, sf_dir) if mode != "sparse" else spark.createDataFrame([], "query_id long, pos long, score double, dense_rank int")
    rows = retrieval.hybrid(dense, sparse, ["query_id"], 5)
    return rows.select("query_id", "pos", F.round("dense_score", 6).alias("score"), F.round("rrf", 9).alias("rrf"), F.array_join("matched_by", ",").alias("matched_by"), "rank")


@query(hybrid_sql("both"))
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir, "both")


@query(hybrid_sql("dense"))
def hybrid_dense_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir, "dense")


@query(hybrid_sql("sparse"))
def hybrid_sparse_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir, "sparse")


@query(f"WITH {SPARSE} SELECT query_id, max(pos) FILTER (kb = 'de') AS de, max(pos) FILTER (kb = 'en') AS en, max(pos) FILTER (kb = 'es') AS es, max(pos) FILTER (kb = 'fr') AS fr FROM sparse WHERE sparse_rank = 1 GROUP BY query_id")
def candidates_per_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best entry of each knowledge base for each query."""
    rows = retrieval.search_topk(s.benchmark_queries(spark, sf_dir), s.stored_documents(spark, sf_dir, "lang"), k=1)
    return rows.groupBy("query_id").pivot("kb", ["de", "en", "es", "fr"]).agg(F.max("pos"))


PROCESS_SPARSE = bm25_sql("SELECT 'process' AS kb, doc_id AS pos, text FROM documents", "SELECT CAST(target AS BIGINT) AS query_id, query FROM process")


@query(f"WITH {PROCESS}, {PROCESS_SPARSE} SELECT query_id, pos, round(score, 6) AS score, CAST(sparse_rank AS INTEGER) AS sparse_rank FROM sparse WHERE sparse_rank <= 8")
def process_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best process entries for every target's query text."""
    asked = process_query(spark, sf_dir).select(F.col("target").cast("long").alias("query_id"), "query")
    rows = retrieval.search_topk(asked, s.stored_documents(spark, sf_dir, "all"), k=8)
    return rows.select("query_id", "pos", F.round("score", 6).alias("score"), "sparse_rank")


# Context and citations

TRUNCATED = rf"CASE WHEN length(own) > 1500 THEN regexp_replace(left(own, 1500), '\s+$', '') || '{text.TRUNCATION_MARK}' ELSE own END"


@query(rf"SELECT doc_id, {TRUNCATED} AS text FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS own FROM documents)")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text")).alias("text"))


PACK = rf"""WITH RECURSIVE b AS (SELECT doc_id // 20 AS g, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS i, '[CRA Article ' || doc_id || ' — ' || source || '（' || lang || '）]' || chr(10) || {TRUNCATED} AS block
  FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS own FROM documents)),
  f AS (SELECT g, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS total, CAST('' AS VARCHAR) AS text, CAST(0 AS INTEGER) AS n, CAST(0 AS INTEGER) AS d FROM b GROUP BY g
    UNION ALL SELECT f.g, b.i, CASE WHEN total + length(block) > 12000 AND n > 0 THEN total ELSE total + length(block) + 7 END, CASE WHEN total + length(block) > 12000 AND n > 0 THEN text WHEN n = 0 THEN block ELSE text || chr(10) || chr(10) || '---' || chr(10) || chr(10) || block END,
      CASE WHEN total + length(block) > 12000 AND n > 0 THEN n ELSE n + 1 END, CASE WHEN total + length(block) > 12000 AND n > 0 THEN d + 1 ELSE d END FROM f JOIN b ON b.g = f.g AND b.i = f.i + 1)
  SELECT g, CASE WHEN d > 0 THEN text || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '{context.DROPPED_NOTE[0]}' || d || '{context.DROPPED_NOTE[1]}' ELSE text END AS text, n AS n_kept, d AS n_dropped FROM f QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1"""


@query(PACK)
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents at a time as the candidates of one context."""
    block = context.clause_entry(F.concat(F.lit("Article "), F.col("doc_id").cast("string")), F.col("source"), F.col("lang"), F.col("text"), "CRA ")
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") / 20).cast("long").alias("g"), "doc_id", block.alias("block"))
    return context.pack_groups(rows, "g", "doc_id", "block")


@query(f"WITH {s.CITED} SELECT doc_id, array_to_string({s.CITATION_LIST}, '|') AS found FROM cited")
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.cited_texts(spark, sf_dir).select("doc_id", F.array_join(text.citations(F.col("answer")), "|").alias("found"))


COVER = "({0} = {1} OR ({1} <> '' AND starts_with({0}, {1}) AND NOT regexp_matches(substr({0}, length({1}) + 1, 1), '[\\p{{L}}\\p{{N}}]')))"
_BARE = ("regexp_replace(c, '^iec\\s*62443-\\d-\\d\\s+', '')", "regexp_replace(a, '^iec\\s*62443-\\d-\\d\\s+', '')")


@query(f"""WITH {s.CITED}, each AS (SELECT doc_id, allowed, unnest({s.CITATION_LIST}) AS cite, generate_subscripts({s.CITATION_LIST}, 1) AS i FROM cited),
  norm AS (SELECT DISTINCT doc_id, i, cite, trim(lower(regexp_replace(cite, '\\s+', ' ', 'g'))) AS c, lower(unnest(allowed)) AS a FROM each),
  hits AS (SELECT doc_id, i, cite, bool_or({COVER.format("c", "a")} OR {COVER.format("a", "c")} OR {COVER.format(*_BARE)} OR {COVER.format(*_BARE[::-1])}) AS ok FROM norm GROUP BY ALL),
  firsts AS (SELECT doc_id, cite, min(i) AS i FROM hits WHERE NOT ok GROUP BY ALL)
  SELECT d.doc_id, coalesce(string_agg(cite, '|' ORDER BY i), '') AS unsupported FROM documents d LEFT JOIN firsts f ON d.doc_id = f.doc_id GROUP BY d.doc_id""")
def citation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.cited_texts(spark, sf_dir)
    found = citations.unsupported(citations.cited(rows, "doc_id", "answer"), rows.select("doc_id", F.explode("allowed").alias("number")), ["doc_id"])
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "cite"))), lambda x: x["cite"]), "|").alias("unsupported")
    return rows.select("doc_id").join(found.groupBy("doc_id").agg(listed), "doc_id", "left").select("doc_id", F.coalesce("unsupported", F.lit("")).alias("unsupported"))


#: References in ten forms: blanks of several kinds, cases, prefixes, notes.
REFERENCES = ("CRA  Annex I Part I ({0}) (a) — n{1}", "Article {0}", " article  {0} — a — b{1}", "IEC 62443-4-2 CR {0}.{1}", "cra Annex II — ", "CRA Article {0}", "ANNEX I (2) ( b )", "iec 62443-4-1 SM-{0} — n", " — only a note {1}", "CRAB {0}\t({1})")
_REFERENCE = "CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN {s.quoted(form)}" for k, form in enumerate(REFERENCES)) + " END"
_BLANK = r"[\s\x{a0}]"


@query(rf"""WITH r AS (SELECT doc_id, replace(replace({_REFERENCE}, '{{0}}', CAST(doc_id % 9 AS VARCHAR)), '{{1}}', CAST(doc_id % 4 AS VARCHAR)) AS ref FROM documents),
  p AS (SELECT *, regexp_replace(split_part(ref, ' — ', 1), '^{_BLANK}+|{_BLANK}+$', '', 'g') AS id FROM r)
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(id), '^cra{_BLANK}+', ''), '{_BLANK}*\(', '(', 'g'), '{_BLANK}+', ' ', 'g') AS key, id,
    CASE WHEN contains(ref, ' — ') THEN regexp_replace(substr(ref, strpos(ref, ' — ') + 3), '^{_BLANK}+|{_BLANK}+$', '', 'g') ELSE '' END AS note,
    CASE WHEN lower(id) LIKE 'iec %' THEN 'standard' WHEN lower(id) LIKE 'annex%' THEN 'annex' ELSE 'article' END AS kind FROM p""")
def clause_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    form = F.element_at(F.array(*[F.lit(x) for x in REFERENCES]), (n % 10 + 1).cast("int"))
    ref = F.replace(F.replace(form, F.lit("{0}"), (n % 9).cast("string")), F.lit("{1}"), (n % 4).cast("string"))
    number = text.reference_id(ref)
    return table(spark, sf_dir, "documents").select("doc_id", text.clause_key(number).alias("key"), number.alias("id"), text.reference_note(ref).alias("note"), text.entry_kind(number).alias("kind"))


@query(r"""WITH kb AS (SELECT 'article ' || doc_id % 50 AS k, arg_max(regexp_replace(text, '^\s+|\s+$', '', 'g'), doc_id) AS body FROM documents WHERE regexp_replace(coalesce(text, ''), '\s+', '', 'g') <> '' GROUP BY 1)
  SELECT event_id, CASE WHEN length(body) > 4000 THEN regexp_replace(left(body, 4000), '\s+$', '') || '……' ELSE coalesce(body, '') END AS clause_text FROM events LEFT JOIN kb ON 'article ' || event_id % 60 = k""")
def clause_text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each finding's clause; a later entry of the same number wins."""
    index = context.clause_index(table(spark, sf_dir, "documents"), F.concat(F.lit("CRA Article "), (F.col("doc_id") % 50).cast("string")), F.col("doc_id"), F.col("text"))
    rows = table(spark, sf_dir, "events").select("event_id")
    return context.with_clause_text(rows, index, F.concat(F.lit("Article  "), (F.col("event_id") % 60).cast("string")))


#: Orders in which an answer has its labels; some repeat one, some lack one.
LABEL_ORDERS = ("012", "210", "1021", "01", "0120", "", "2012", "120", "00112", "102")
_ANSWER = "'x' || CASE (conv_id + turn) % 10 " + " ".join(f"WHEN {k} THEN {' || '.join(chr(39) + '【' + text.SUMMARY_LABELS[int(c)] + '】 ' + str(i) + ' ' + chr(39) + ' || t' for i, c in enumerate(order)) or chr(39) * 2}" for k, order in enumerate(LABEL_ORDERS)) + " END"
_SECTION = "regexp_replace(substr(list_filter(pieces, lambda p: starts_with(p, '{0}】'))[-1], length('{0}】') + 1), '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"


@query(rf"""WITH a AS (SELECT conv_id, turn, string_split({_ANSWER}, '【') AS pieces FROM (SELECT *, replace(coalesce(text, ''), '【', '[') AS t FROM conversations)),
  f AS (SELECT conv_id, turn, {", ".join(f"{_SECTION.format(label)} AS s{k}" for k, label in enumerate(text.SUMMARY_LABELS))} FROM a)
  SELECT conv_id, turn, CASE WHEN ok THEN s0 END AS weakness_name, CASE WHEN ok THEN s1 END AS weakness_reason, CASE WHEN ok THEN s2 END AS remediation FROM (SELECT *, s0 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL AS ok FROM f)""")
def summary_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with labels in ten orders around the texts of conversations."""
    said = F.replace(F.coalesce("text", F.lit("")), F.lit("【"), F.lit("["))
    kinds = [F.concat(F.lit("x"), *[x for i, c in enumerate(order) for x in (F.lit(f"【{text.SUMMARY_LABELS[int(c)]}】 {i} "), said)]) for order in LABEL_ORDERS]
    answer = F.element_at(F.array(*kinds), ((F.col("conv_id") + F.col("turn")) % 10 + 1).cast("int"))
    found = text.summary(answer)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("f")).select("conv_id", "turn", "f.*")


# Segmentation


@query(f"WITH {s.LINES} SELECT doc_id, n, line FROM body")
def line_noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.body_lines(s.standard_lines(spark, sf_dir)).select("doc_id", "n", "line")


CLAUSE_ROWS = rf"""{s.LINES}, marked AS (SELECT *, regexp_matches(line, '^\d+\s+FR\s+\d+\s*[–—-]\s*.+$') AS g, regexp_matches(line, '^\d+\.1 CR ') AS c, regexp_matches(line, '^\d+\.1 Security levels$') AS x FROM body),
  islands AS (SELECT *, sum(CAST(c AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n) AS clause, last_value(CASE WHEN g THEN regexp_replace(regexp_replace(line, '^\d+\s+', ''), '\s+', ' ', 'g') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM marked),
  parts AS (SELECT *, first_value(CASE WHEN c THEN regexp_extract(line, '(CR \d+\.\d+)', 1) END IGNORE NULLS) OVER w AS clause_id, first_value(CASE WHEN c THEN coalesce(grp, '') END IGNORE NULLS) OVER w AS clause_group, coalesce(last_value(CASE WHEN x THEN 'security_levels' END IGNORE NULLS) OVER w, 'requirement') AS field
    FROM islands WHERE clause > 0 AND NOT g WINDOW w AS (PARTITION BY doc_id, clause ORDER BY n))"""


@query(f"WITH {CLAUSE_ROWS} SELECT doc_id, clause, clause_id, clause_group AS \"group\", field, n, line FROM parts WHERE NOT c AND NOT x")
def clause_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.clause_lines(segments.body_lines(s.standard_lines(spark, sf_dir)))
    return rows.select("doc_id", "clause", "clause_id", "group", "field", "n", "line")


@query(rf"""WITH {s.LINES}, l AS (SELECT *, regexp_matches(line, '^(\(\d+\)|[a-z]\)|\d+\)|[•●▪◦‣]|NOTE\b|EXAMPLE\b|SL-C\b)') AS starts FROM body),
  p AS (SELECT *, lag(line) OVER w AS last, lead(starts) OVER w AS following FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n))
  SELECT doc_id, regexp_replace(string_agg(CASE WHEN last IS NULL THEN '' WHEN starts THEN chr(10) WHEN last LIKE '%-' THEN '' ELSE ' ' END || CASE WHEN line LIKE '%-' AND NOT coalesce(following, true) THEN left(line, length(line) - 1) ELSE line END, '' ORDER BY n), '^\s+|\s+$', '', 'g') AS text FROM p GROUP BY doc_id""")
def dewrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.body_lines(s.standard_lines(spark, sf_dir))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return rows.groupBy("doc_id").agg(ordered.alias("lines")).select("doc_id", segments.dewrap(F.col("lines")).alias("text"))


# Knowledge-base checks and parsing


@query("SELECT source AS kb, CAST(doc_id % 3 AS BIGINT) AS key, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, sf_dir, "documents").select(F.col("source").alias("kb"), (F.col("doc_id") % 3).alias("key")), "kb", "key")


@query("SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 620 ELSE 128 END AS expected, abs(count(*) - CASE lang WHEN 'en' THEN 620 ELSE 128 END) <= 5 AS ok FROM documents GROUP BY lang")
def count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.count_check(table(spark, sf_dir, "documents"), "lang", F.when(F.col("lang") == "en", 620).otherwise(128), 5)


@query("""SELECT lang, count(*) FILTER (trim(own) = '') AS n_empty, count(*) FILTER (regexp_matches(own, '(?i)licence agreement|copyright of IEC|Customer:\\s|Order No\\.:')) AS n_leaks, count(*) AS n
  FROM (SELECT lang, CASE WHEN doc_id % 50 = 0 THEN ' ' WHEN doc_id % 70 = 1 THEN text || ' Licence Agreement' ELSE coalesce(text, '') END AS own FROM documents) GROUP BY lang""")
def text_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("doc_id") % 50 == 0, " ").when(F.col("doc_id") % 70 == 1, F.concat("text", F.lit(" Licence Agreement"))).otherwise(F.col("text"))
    return quality.text_check(table(spark, sf_dir, "documents").select("lang", own.alias("text")), "lang")


@query("""WITH a AS (SELECT page_id, url, j, (page_id + j) % 3 AS subs, (page_id * 7 + j) % 5 AS bodies FROM (SELECT page_id, url, unnest(range(page_id % 4)) AS j FROM pages))
  SELECT page_id, 'Article ' || (page_id % 50 + j) AS article_no, CASE WHEN subs > 0 THEN 'T' || j ELSE '' END AS title,
    array_to_string(list_concat(list_transform(range(bodies), lambda i: j || '-' || i || ' ' || url), CASE WHEN subs > 1 THEN ['late T' || j] ELSE [] END), chr(10)) AS text FROM a""")
def html_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of made-up regulation pages: none to three, with none to two subtitles and none to four paragraphs each.

    Text before the first article and in an annex does not belong to any.
    """
    made = """concat('<body><p class="oj-normal">before</p>', array_join(transform(filter(sequence(0L, page_id % 4), j -> j < page_id % 4), j -> concat(
      '<p class="oj-ti-art x">Article ', page_id % 50 + j, '</p>', if((page_id + j) % 3 > 0, concat('<p class="oj-sti-art">T<b>', j, '</b></p>'), ''), '<p class="oj-ti-art">no number</p>',
      array_join(transform(filter(sequence(0L, 4L), i -> i < (page_id * 7 + j) % 5), i -> concat('<div><p class=oj-normal> ', j, '-', i, ' <i>', replace(replace(url, '&', '&amp;'), '<', '&lt;'), '</i></p></div>')), ''),
      if((page_id + j) % 3 > 1, concat('<p class="oj-sti-art">late T', j, '</p>'), ''))), ''), '<div id="anx_I"><p class="oj-normal">annex</p></div></body>')"""
    made = made.replace("T<b>', j, '</b></p>'", "T', j, '</p>'")
    return knowledge.articles(table(spark, sf_dir, "pages").select("page_id", F.expr(made).alias("page")), "page_id", "page")


@query("""WITH t AS (SELECT page_id, unnest(range(page_id % 4)) AS i FROM pages), p AS (SELECT page_id, unnest(range(page_id % 3)) AS j FROM pages), l AS (SELECT page_id, unnest(range((page_id + 1) % 3)) AS k FROM pages)
  SELECT page_id, 'Annex I Part I (' || i + 1 || ')' AS article_no, 'Part I Demands' AS title, 'A' || page_id || '-' || i AS text FROM t
  UNION ALL SELECT page_id, 'Annex I Part I (' || i + 1 || ')(a)', 'Part I Demands', 'deep ' || i || CASE WHEN page_id % 2 = 0 THEN ' more' ELSE '' END FROM t WHERE (page_id + i) % 3 = 0
  UNION ALL SELECT page_id, 'Annex I Part I (' || i + 1 || ')(a)(ii)', 'Part I Demands', 'deeper' FROM t WHERE (page_id + i) % 3 = 0 AND page_id % 2 = 0
  UNION ALL SELECT page_id, 'Annex I Part II ' || j + 1, 'Part II Process', 'plain text ' || j FROM p
  UNION ALL SELECT page_id, 'Annex III ' || 1, 'No part', 'x ' || page_id FROM pages WHERE page_id % 5 = 0
  UNION ALL SELECT page_id, 'Annex IV (' || k + 1 || ')', '', 'item ' || page_id || ' ' || k FROM l""")
def annex_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with none to three items, two levels of items in some of them, items without labels, a part without a number, and a list."""
    page = """concat('<div id="anx_I"><p class="oj-ti-grseq-1">Part I Demands</p>', array_join(transform(filter(sequence(0L, 3L), i -> i < page_id % 4), i -> concat(
      '<table><tr><td></td><td><p>(', i + 1, ')</p></td><td><span>A', page_id, '-', i, '</span>',
      if((page_id + i) % 3 = 0, concat('<table class=x><tbody><tr><td>(a)</td><td><p class="oj-normal">deep ', i, '</p>', if(page_id % 2 = 0, '<span>more</span><table><tr><td>(ii)</td><td><p class="oj-normal">deeper</p></td></tr></table>', '<p>not this</p>'), '</td></tr></tbody></table>'), ''),
      '</td></tr><tr><td>(9)</td><td><span>second row</span></td></tr></table>')), ''),
      '<p class="oj-ti-grseq-1">Part II Process</p>', array_join(transform(filter(sequence(0L, 2L), j -> j < page_id % 3), j -> concat('<table><tr><td>plain</td><td>text ', j, '</td></tr></table>')), ''), '<table></table></div>',
      if(page_id % 5 = 0, concat('<div id="anx_III"><p class="oj-ti-grseq-1">No part</p><table><tr><td>x</td><td>', page_id, '</td></tr></table></div>'), ''),
      '<div id="anx_IV">', array_join(transform(filter(sequence(0L, 2L), k -> k < (page_id + 1) % 3), k -> concat('<div class="oj-enumeration-spacing"><p>', k + 1, '.</p><p><span>item ', page_id, '</span></p><p>', k, '</p></div>')), ''), '<div><p>1.</p><p>no item</p></div></div>')"""
    return knowledge.annexes(table(spark, sf_dir, "pages").select("page_id", F.expr(page).alias("page")), "page_id", "page").select("page_id", "article_no", "title", "text")


@query(r"""WITH b AS (SELECT doc_id, coalesce(text, '') || array_to_string(list_transform(range(doc_id % 10), lambda i: ' Article' || repeat(' ', CAST(i % 3 + 1 AS INTEGER)) || (doc_id + i) % 99 || CASE WHEN i % 2 = 0 THEN chr(10) ELSE ', ' END || source || ' and Article x ' || i), '') AS body FROM documents),
  l AS (SELECT doc_id, regexp_split_to_array(body, 'Article\s+\d+') AS parts, regexp_extract_all(body, 'Article\s+\d+') AS heads, regexp_extract_all(body, 'Article\s+(\d+)', 1) AS numbers FROM b),
  e AS (SELECT doc_id, unnest(range(1, len(heads) + 1)) AS n, parts, heads, numbers FROM l)
  SELECT doc_id, CAST(n AS INTEGER) AS n, 'Article ' || numbers[n] AS article_no, regexp_replace(heads[n] || parts[n + 1], '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') AS text FROM e""")
def article_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, with none to nine articles behind each."""
    added = "array_join(transform(filter(sequence(0L, 9L), i -> i < doc_id % 10), i -> concat(' Article', repeat(' ', cast(i % 3 + 1 AS int)), (doc_id + i) % 99, if(i % 2 = 0, '\\n', ', '), source, ' and Article x ', i)), '')"
    body = F.concat(F.coalesce("text", F.lit("")), F.expr(added))
    return knowledge.split_articles(table(spark, sf_dir, "documents").select("doc_id", body.alias("body")), "doc_id", "body")


@query("""WITH e AS (SELECT event_id, event_id AS id, 'N' || event_type AS title, CASE WHEN event_id % 9 = 0 THEN '' ELSE 'a b' END AS text, '' AS extended, CASE WHEN event_id % 2 = 0 THEN 'm1' ELSE '' END AS mitigations FROM events WHERE event_id % 5 <> 0
  UNION ALL SELECT event_id, event_id + 1000000, '', event_type, 'more of it', 'x|y' FROM events WHERE event_id % 4 = 3)
  SELECT id AS event_id, 'CWE-' || id AS key, title, text, mitigations, array_to_string(list_filter([title, text, extended, replace(mitigations, '|', chr(10))], lambda p: p <> ''), chr(10)) AS embedding_text FROM e""")
def weakness_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in four forms: with a prefix, with a default namespace, a slice whose prefix is declared elsewhere, and one of two entries with a comment."""
    n = F.col("event_id")
    made = """concat('<', p, 'Weakness\n ID="', event_id, '" Name="N', event_type, '" Status="', if(event_id % 5 = 0, 'Deprecated', 'Draft'), '">', if(event_id % 9 = 0, '', concat('<', p, 'Description>a <', p, 'b> b </', p, 'b></', p, 'Description>')),
      if(event_id % 2 = 0, concat('<', p, 'Potential_Mitigations><', p, 'Mitigation><', p, 'Phase>x</', p, 'Phase><', p, 'Description>m1</', p, 'Description></', p, 'Mitigation></', p, 'Potential_Mitigations>'), ''), '</', p, 'Weakness>')"""
    second = """concat('<!-- <Weakness ID="0" Name="no"/> --><Weakness ID="', event_id + 1000000, '"><Extended_Description><p>more</p> of it</Extended_Description><Description>', event_type, '</Description><Potential_Mitigations><Mitigation><Description>x</Description></Mitigation><Mitigation/><Mitigation><Description>y</Description></Mitigation></Potential_Mitigations></Weakness>')"""
    rows = table(spark, sf_dir, "events").withColumn("p", F.when(n % 4 == 0, "w:").when(n % 4 == 2, "cwe:").otherwise("")).withColumn("own", F.expr(made))
    xml = F.when(n % 4 == 0, F.concat(F.lit("<w:List xmlns:w='urn:w'><w:Weaknesses>"), "own", F.lit("</w:Weaknesses></w:List>"))).when(n % 4 == 1, F.concat(F.lit("<List xmlns='urn:w'><Weaknesses>"), "own", F.lit("</Weaknesses></List>"))).when(n % 4 == 2, F.col("own"))
    xml = F.coalesce(xml, F.concat(F.lit("<List>"), F.expr(second), F.col("own"), F.lit("</List>")))
    found = knowledge.weaknesses(rows.select(xml.alias("xml")))
    return found.select(F.substring_index("key", "-", -1).cast("long").alias("event_id"), "key", "title", "text", F.array_join("mitigations", "|").alias("mitigations"), "embedding_text")


# Scan outputs


@query("""SELECT page_id, name, CASE WHEN regexp_matches(name, '^id_(rsa|dsa|ecdsa|ed25519)$') THEN 'high' WHEN regexp_matches(name, '(?i)^.*\\.(pem|key|p12|pfx)$') THEN 'high' WHEN name = 'shadow' THEN 'high' WHEN name = 'passwd' THEN 'medium' WHEN has THEN 'high' END AS severity
  FROM (SELECT page_id, ['id_rsa', 'x.PEM', 'shadow', 'passwd', 'hostname', 'backup.dat'][CAST(page_id % 6 AS INTEGER) + 1] AS name, page_id % 12 = 5 AS has FROM pages)""")
def filename_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    name = F.element_at(F.array(*[F.lit(x) for x in ("id_rsa", "x.PEM", "shadow", "passwd", "hostname", "backup.dat")]), (n % 6 + 1).cast("int"))
    content = F.when(n % 12 == 5, F.concat(F.lit("zz-----BEGIN EC PRIVATE KEY-----"), F.col("url"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), firmware.file_severity(name, F.length(content), content).alias("severity"))


KEYWORD_LIST = "', '".join(firmware.KEYWORDS)


@query(f"""SELECT doc_id, doc_id * 16 AS offset_decimal, '0x' || lower(to_hex(doc_id * 16)) AS offset_hex, title, list_filter(['{KEYWORD_LIST}'], lambda k: contains(lower(title), k))[1] AS matched_keyword,
  CASE WHEN list_filter(['{KEYWORD_LIST}'], lambda k: contains(lower(title), k))[1] IS NULL THEN 'info' ELSE 'high' END AS severity
  FROM (SELECT doc_id, ['Squashfs filesystem with passwd', 'gzip compressed data', 'RSA Private Key', 'Certificate in DER'][CAST(doc_id % 4 AS INTEGER) + 1] || ' ' || lang AS title FROM documents WHERE doc_id % 7 <> 0)""")
def signature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    found = F.element_at(F.array(*[F.lit(x) for x in ("Squashfs filesystem with passwd", "gzip compressed data", "RSA Private Key", "Certificate in DER")]), (n % 4 + 1).cast("int"))
    line = F.when(n % 7 == 0, "DECIMAL  HEXADECIMAL  DESCRIPTION").otherwise(F.concat(F.lit("  "), (n * 16).cast("string"), F.lit("     0x"), F.lower(F.hex(n * 16)), F.lit("   "), found, F.lit(" "), F.col("lang"), F.lit(" \t")))
    return firmware.signatures(table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))).select("doc_id", "offset_decimal", "offset_hex", "title", "matched_keyword", "severity")


@query("""SELECT event_id, target, protocol, port, service, CASE WHEN event_id % 3 = 0 THEN 'P' ELSE '' END AS product, CASE WHEN event_id % 2 = 0 THEN '1.' || event_id % 4 ELSE '' END AS version,
    trim('tcp/' || port || ' ' || service) || CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN ' (P 1.' || event_id % 4 || ')' WHEN event_id % 3 = 0 THEN ' (P)' WHEN event_id % 2 = 0 THEN ' (1.' || event_id % 4 || ')' ELSE '' END AS title
  FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS target, 'tcp' AS protocol, CAST(event_id % 1000 AS VARCHAR) AS port, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS service FROM events) WHERE event_id % 5 <> 0""")
def portscan_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with one open and one closed port; every fifth has no address."""
    n = F.col("event_id")
    name = F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit(" name='"), F.col("event_type"), F.lit("'")))
    service = F.concat(F.lit("<service"), name, F.when(n % 3 == 0, " product='P'").otherwise(""), F.when(n % 2 == 0, F.concat(F.lit(" version='1."), (n % 4).cast("string"), F.lit("'"))).otherwise(""), F.lit("/>"))
    address = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("<address addr='"), F.col("user_id").cast("string"), F.lit("'/><address addr='mac'/>")))
    xml = F.concat(F.lit("<host>"), address, F.lit("<ports><port protocol='tcp' portid='9'><state state='closed'/></port><port protocol='tcp' portid='"), (n % 1000).cast("string"), F.lit("'><state state='open'/>"), service, F.lit("</port></ports></host>"))
    hosts = portscan.parse_hosts(table(spark, sf_dir, "events").select("event_id", xml.alias("xml")), "xml")
    return portscan.open_ports(hosts).select("event_id", "target", "protocol", "port", "service", "product", "version", "title")


@query("""SELECT event_id, 'tcp/443' AS port, 's' AS script_id, CASE WHEN event_id % 4 = 0 THEN 'CVE-2014-' || (1000 + event_id % 9000) ELSE '' END AS numbers, CAST(CASE WHEN event_id % 3 = 0 THEN 9.8 WHEN event_id % 3 = 1 THEN NULL ELSE 5.0 END AS DOUBLE) AS score,
  CASE WHEN event_id % 3 = 0 THEN 'critical' WHEN event_id % 3 = 2 THEN 'medium' WHEN event_type = 'click' THEN 'low' WHEN event_type = 'view' THEN 'critical' ELSE 'medium' END AS severity,
  CASE WHEN event_id % 2 = 0 THEN 'T' ELSE 's' END || '（tcp/443）' AS title FROM events WHERE event_type <> 'error'""")
def portscan_vulns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with a vulnerable table nested in another, and one that is not vulnerable."""
    n, kind = F.col("event_id"), F.col("event_type")
    state = F.when(kind == "error", "NOT VULNERABLE").when(kind == "view", "VULNERABLE (Exploitable)").otherwise("LIKELY VULNERABLE")
    key = F.when(n % 4 == 0, F.concat(F.lit(" key='CVE-2014-"), (1000 + n % 9000).cast("string"), F.lit("'"))).otherwise("")
    scores = F.when(n % 3 == 0, "<table key='scores'><elem key='CVSSv2'>7.5 (HIGH)</elem><elem key='CVSSv3'>9.8</elem><elem>N/A</elem></table>").when(n % 3 == 2, "<table key='scores'><elem>5.0</elem></table>").otherwise("")
    factor = F.when(kind == "click", "<elem key='risk_factor'> LOW </elem>").otherwise("")
    title = F.when(n % 2 == 0, "<elem key='title'> T </elem>").otherwise("")
    xml = F.concat(F.lit("<host><address addr='"), n.cast("string"), F.lit("'/><ports><port protocol='tcp' portid='443'><state state='closed'/><script id='s'><table><table"), key, F.lit("><elem key='state'>"), state, F.lit("</elem>"), title, factor, scores, F.lit("</table></table></script></port></ports></host>"))
    rows = portscan.script_findings(table(spark, sf_dir, "events").select("event_id", xml.alias("xml")), "xml")
    return rows.select("event_id", "port", "script_id", F.array_join("cve_ids", ",").alias("numbers"), F.col("cvss_score").alias("score"), "severity", "title")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'http://h' || user_id END AS target, CASE WHEN event_id % 3 = 0 THEN 'N' ELSE event_type END AS title, 'info' AS severity, left(repeat('d' || event_id, 60), 200) AS description, CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END AS alert_risk FROM events""")
def web_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    risk = F.when(n % 5 == 0, "High").when(n % 5 == 1, "Medium").when(n % 5 == 2, "Low").when(n % 5 == 3, "Unheard of")
    body = F.to_json(F.struct(F.when(n % 4 != 0, F.concat(F.lit("http://h"), F.col("user_id").cast("string"))).alias("url"), F.when(n % 3 != 0, F.col("event_type")).alias("alert"), F.lit("N").alias("name"), risk.alias("risk"), F.repeat(F.concat(F.lit("d"), n.cast("string")), 60).alias("description")))
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json(body, web.ALERT_SCHEMA).alias("a")).select("event_id", "a.*")
    return web.alerts(rows).select("event_id", "target", "title", "severity", "description", "alert_risk")


AGENT = f"""agent AS (SELECT conv_id, turn, coalesce(text, '') AS said, turn % 4 = 3 AS plain, conv_id % 7 = 0 AS silent, conv_id % 5 = 0 AS failed,
    CASE WHEN turn % 4 = 3 THEN CASE WHEN conv_id % 7 = 0 THEN '' ELSE 'broken {{"outcome": 1 ' || coalesce(text, '') END
      ELSE 'first ```json' || chr(10) || '{{"outcome": "confirmed", "severity": "low"}}' || chr(10) || '``` ' || coalesce(text, '') || ' ```json' || chr(10) || '{{"outcome":"' || CASE WHEN turn % 2 = 0 THEN 'confirmed' ELSE 'not_confirmed' END || '","severity":"high","summary":" sum ' || turn || '"}}' || chr(10) || '``` end' END AS result FROM conversations),
  judged AS (SELECT *, CASE WHEN plain OR failed THEN 'inconclusive' WHEN turn % 2 = 0 THEN 'confirmed' ELSE 'not_confirmed' END AS outcome,
    CASE WHEN NOT plain THEN 'sum ' || turn WHEN trim(result) = '' THEN {s.quoted(web.NO_SUMMARY)} ELSE left(trim(result), 500) END AS summary FROM agent)"""


def agent_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of an agent around the texts of conversations: a block before the last one, a broken one, none at all."""
    turn, said = F.col("turn"), F.coalesce("text", F.lit(""))
    block = F.to_json(F.struct(F.when(turn % 2 == 0, "confirmed").otherwise("not_confirmed").alias("outcome"), F.lit("high").alias("severity"), F.concat(F.lit(" sum "), turn.cast("string")).alias("summary")))
    plain = F.when(F.col("conv_id") % 7 == 0, "").otherwise(F.concat(F.lit('broken {"outcome": 1 '), said))
    answer = F.when(turn % 4 == 3, plain).otherwise(F.concat(F.lit('first ```json\n{"outcome": "confirmed", "severity": "low"}\n``` '), said, F.lit(" ```json\n"), block, F.lit("\n``` end")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("result"), (F.col("conv_id") % 5 == 0).alias("is_error"))


@query(f"""WITH {AGENT} SELECT conv_id, turn, outcome, CASE WHEN outcome = 'confirmed' THEN 'high' ELSE 'info' END AS severity, summary, left(result, 4000) AS agent_result,
  CASE outcome WHEN 'confirmed' THEN {s.quoted(web.OUTCOME_TITLES["confirmed"])} WHEN 'not_confirmed' THEN {s.quoted(web.OUTCOME_TITLES["not_confirmed"])} ELSE {s.quoted(web.OUTCOME_TITLES["inconclusive"])} END AS title FROM judged""")
def agent_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.agent_findings(agent_results(spark, sf_dir)).select("conv_id", "turn", "outcome", "severity", "summary", "agent_result", "title")


@query("""WITH printed AS (SELECT conv_id, turn, coalesce(text, '') AS t, (conv_id + turn) % 4 AS kind FROM conversations)
  SELECT conv_id, turn, CASE kind WHEN 0 THEN turn % 3 = 0 WHEN 1 THEN false ELSE true END AS is_error, CASE kind WHEN 0 THEN t WHEN 1 THEN '' WHEN 2 THEN trim('error: ' || t) ELSE '[1, 2]' END AS result,
    CASE WHEN kind = 0 THEN round(turn / 8, 3) END AS cost_usd, CASE WHEN kind = 0 THEN CAST(turn AS INTEGER) END AS num_turns, CASE WHEN kind = 0 THEN 's' || conv_id END AS session_id FROM printed""")
def agent_stdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an agent printed: a full object, an empty one, plain text, and JSON that is no object."""
    t, turn, kind = F.coalesce("text", F.lit("")), F.col("turn"), (F.col("conv_id") + F.col("turn")) % 4
    whole = F.to_json(F.struct((turn % 3 == 0).alias("is_error"), t.alias("result"), (turn / 8).alias("total_cost_usd"), turn.alias("num_turns"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id")))
    stdout = F.when(kind == 0, whole).when(kind == 1, "{}").when(kind == 2, F.concat(F.lit("error: "), t)).otherwise("[1, 2]")
    rows = web.agent_stdout(table(spark, sf_dir, "conversations").select("conv_id", "turn", stdout.alias("stdout")))
    return rows.select("conv_id", "turn", "is_error", "result", F.round("cost_usd", 3).alias("cost_usd"), "num_turns", "session_id")


# Caches and generated texts

SIGNED = f"""{s.FINDINGS}, keyed AS (SELECT *, category || '|' || source || '|' || title AS signature FROM findings), cached AS (SELECT DISTINCT signature, 'a' AS answer FROM keyed WHERE finding_id % 7 = 0)"""


@query(f"WITH {SIGNED} SELECT signature, 'IEC 1|CRA 2|' || left(sha1('why|' || category), 8) || '::' || signature AS rule_key, count(*) AS n FROM keyed GROUP BY ALL")
def signature_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.findings(spark, sf_dir).withColumn("signature", cache.signature(s.findings(spark, sf_dir)))
    key = cache.rule_key(F.lit("IEC 1"), F.lit("CRA 2"), F.lit("why"), F.col("category"), F.col("signature"))
    return rows.groupBy("signature", key.alias("rule_key")).agg(F.count(F.lit(1)).alias("n"))


def cached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = s.findings(spark, sf_dir)
    rows = rows.withColumn("cache_key", cache.signature(rows)).withColumn("prompt", F.col("title")).withColumn("allowed", F.array(F.lit("CWE-1")))
    return rows, rows.filter("finding_id % 7 = 0").select("cache_key", F.lit("a").alias("answer")).distinct()


@query(f"WITH {SIGNED} SELECT finding_id, answer FROM keyed LEFT JOIN cached USING (signature)")
def cache_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.hits(*cached(spark, sf_dir)).select("finding_id", "answer")


@query(f"WITH {SIGNED} SELECT DISTINCT signature AS cache_key FROM keyed WHERE signature NOT IN (SELECT signature FROM cached)")
def cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.misses(*cached(spark, sf_dir)).select("cache_key")


def _answer(prompt: str) -> str | None:
    """Stands in for a language model: no answer, one with a made-up citation, or a good one."""
    kind = sum(map(ord, prompt)) % 3
    return [None, f"{prompt}: see CWE-2", f"{prompt}: see CWE-1"][kind]


@query(f"""WITH {SIGNED}, missing AS (SELECT DISTINCT signature, title FROM keyed WHERE signature NOT IN (SELECT signature FROM cached))
  SELECT signature AS cache_key, answer FROM cached UNION ALL SELECT signature, title || ': see CWE-1' FROM missing WHERE list_sum(list_transform(string_split(title, ''), lambda c: ascii(c))) % 3 = 2""")
def generated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after the missing texts were asked for; an answer that cites what it may not is not kept."""
    return cache.fill(*cached(spark, sf_dir), _answer)


# Plans, targets, jobs and reports


@query(f"""WITH {s.CLASSIFIED}, p AS (SELECT *, CASE WHEN status = 'matched' THEN cra_reference WHEN finding_id % 2 = 0 THEN 'IEC 62443-4-2 CR 1.' || finding_id % 9 END AS requirement_id FROM classified WHERE category IN ('network', 'webapp')),
  o AS (SELECT *, 'With authorisation, verify whether ' || service || ' on ' || target || ' can be exploited' || CASE WHEN requirement_id IS NULL THEN '' ELSE ' (requirement ' || requirement_id || ')' END AS objective FROM p)
  SELECT finding_id, CASE WHEN status = 'matched' THEN 'rule' WHEN requirement_id IS NOT NULL THEN 'iec' END AS requirement_source, requirement_id, CASE WHEN status = 'matched' THEN recommendation WHEN requirement_id IS NOT NULL THEN 't' END AS requirement_text, objective, 'python3 -m live_check ' || target || ' --objective ''' || objective || ''' --i-am-authorized' AS command FROM o""")
def test_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("finding_id")
    candidate = F.struct(F.concat(F.lit("IEC 62443-4-2 CR 1."), (n % 9).cast("string")).alias("key"), F.lit("t").alias("title"), F.lit("").alias("text"), F.lit(None).cast("string").alias("text_zh"))
    none = F.array().cast("array<struct<key:string,title:string,text:string,text_zh:string>>")
    merged = classify.classify(s.findings(spark, sf_dir)).withColumns({"clauses": F.when(n % 2 == 0, F.array(candidate)).otherwise(none), "articles": none})
    return plan.test_plan(merged).select("finding_id", F.col("requirement.source").alias("requirement_source"), F.col("requirement.id").alias("requirement_id"), F.col("requirement.text").alias("requirement_text"), "objective", "command")


@query("""SELECT event_id, CAST(i AS INTEGER) AS item_no, CASE i WHEN 0 THEN '10.' || event_id % 300 || '.0.1' WHEN 1 THEN '192.168.' || event_id % 256 || '.77/' || event_id % 40 ELSE 'host' || event_id END AS item,
    CASE i WHEN 0 THEN event_id % 300 <= 255 WHEN 1 THEN event_id % 40 <= 32 ELSE false END AS valid,
    CASE WHEN i = 0 AND event_id % 300 <= 255 THEN 1 WHEN i = 1 AND event_id % 40 <= 32 THEN CAST(pow(2, 32 - event_id % 40) AS BIGINT) END AS size,
    coalesce(CASE WHEN i = 1 AND event_id % 40 <= 32 THEN 32 - event_id % 40 > 8 END, false) AS large,
    CASE WHEN i = 0 AND event_id % 300 <= 255 THEN '10.' || event_id % 300 || '.0.1' WHEN i = 1 AND event_id % 40 <= 32 THEN
      (b >> 24) || '.' || ((b >> 16) & 255) || '.' || ((b >> 8) & 255) || '.' || (b & 255) || '/' || event_id % 40 END AS normalised
  FROM (SELECT event_id, i, ((192::BIGINT << 24) + (168::BIGINT << 16) + ((event_id % 256) << 8) + 77) - ((192::BIGINT << 24) + (168::BIGINT << 16) + ((event_id % 256) << 8) + 77) % CAST(pow(2, greatest(32 - event_id % 40, 0)) AS BIGINT) AS b FROM events CROSS JOIN (SELECT unnest([0, 1, 2]) AS i))""")
def target_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    s_ = lambda c: c.cast("string")
    listed = F.concat(F.lit("10."), s_(n % 300), F.lit(".0.1, 192.168."), s_(n % 256), F.lit(".77/"), s_(n % 40), F.lit(" ,host"), s_(n), F.lit(","))
    rows = targets.explode_targets(table(spark, sf_dir, "events").select("event_id", listed.alias("targets")), "targets")
    return rows.select("event_id", "item_no", "item", "valid", "size", "large", "normalised")


@query("""SELECT page_id, regexp_matches(own, '^https?://[^/?#]+') AS valid FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN substr(url, 5) ELSE url END AS own FROM pages)""")
def url_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("page_id") % 3 == 0, F.col("url").substr(5, 1000)).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", targets.valid_url(own).alias("valid"))


@query("""SELECT event_id AS job_id, stage, CASE WHEN st = 'pending' AND event_id % 11 = 0 THEN 'error' ELSE st END AS status FROM (SELECT event_id, stage, CASE stage WHEN 'ports' THEN CASE WHEN event_id % 2 = 0 THEN 'pending' ELSE 'skipped' END WHEN 'firmware' THEN CASE WHEN event_id % 3 = 0 THEN 'pending' ELSE 'skipped' END
  WHEN 'web' THEN 'skipped' WHEN 'analysis' THEN 'pending' ELSE CASE WHEN event_id % 5 = 0 THEN 'pending' ELSE 'skipped' END END AS st FROM events CROSS JOIN (SELECT unnest(['ports', 'firmware', 'web', 'analysis', 'report']) AS stage))""")
def stage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    jobs = table(spark, sf_dir, "events").select(n.alias("job_id"), F.when(n % 2 == 0, "10.0.0.1").alias("ip"), F.when(n % 3 == 0, "f.bin").otherwise("").alias("firmware"), F.lit(None).cast("string").alias("url"), (n % 5 == 0).alias("report"))
    rows = report.initial_stages(jobs)
    return rows.select("job_id", "stage", F.when(F.col("job_id") % 11 == 0, report.after_failure(F.col("status"))).otherwise(F.col("status")).alias("status"))


@query(f"""WITH {s.CLASSIFIED} SELECT target, CAST(CASE status WHEN 'matched' THEN 1 ELSE 2 END AS INTEGER) AS section, ({s.RANK.format("risk_level")}) * 1099511627776 + seq AS ord,
  '### ' || title || chr(10) || '- risk: ' || risk_level || CASE WHEN cra_reference IS NULL THEN '' ELSE chr(10) || '- CRA: ' || cra_reference || chr(10) || '- IEC: ' || iec_reference END AS text,
  CASE risk_level WHEN 'critical' THEN 'risk-critical' WHEN 'high' THEN 'risk-high' WHEN 'medium' THEN 'risk-medium' WHEN 'low' THEN 'risk-low' ELSE 'risk-info' END AS badge FROM classified""")
def report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.classify(s.findings(spark, sf_dir))
    blocks = report.finding_blocks(rows)
    return blocks.withColumn("badge", report.badge(F.regexp_extract("text", r"- risk: (\w+)", 1)))


# The review path: candidates of findings that no rule decides, and what is made of them

KB_OF_LANG = "CASE lang WHEN 'de' THEN 'iec' WHEN 'fr' THEN 'cra' ELSE 'cwe' END"
VECTOR_OF_QUERY = "(length(query) * 37 + ascii(right(query, 1))) % (SELECT count(*) FROM embeddings)"
FINDING_TEXT = "CASE WHEN category = 'network' THEN service || ' service' ELSE title END"
REVIEW = f"""{s.CLASSIFIED}, asked_texts AS (SELECT DISTINCT {FINDING_TEXT} AS query FROM classified WHERE status = 'needs_review'),
  {bm25_sql(f"SELECT {KB_OF_LANG} AS kb, doc_id AS pos, text FROM documents", "SELECT query AS query_id, query FROM asked_texts")},
  dense AS (SELECT * FROM (SELECT query AS query_id, d.kb, d.pos, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score,
    row_number() OVER (PARTITION BY query, d.kb ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) DESC, d.pos) AS dense_rank
    FROM asked_texts JOIN embeddings q ON q.vec_id = {VECTOR_OF_QUERY} CROSS JOIN docs d JOIN embeddings v ON v.vec_id = d.pos) WHERE dense_rank <= 10),
  fused AS (SELECT query_id, kb, pos, d.score AS dense_score, dense_rank, sparse_rank, coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) AS rrf FROM dense d FULL JOIN sparse x USING (query_id, kb, pos)),
  best AS (SELECT query_id, kb, 'K' || pos AS key, pos, round(dense_score, 6) AS score, CASE WHEN dense_rank IS NULL THEN 'sparse' WHEN sparse_rank IS NULL THEN 'dense' ELSE 'dense,sparse' END AS matched_by FROM fused QUALIFY row_number() OVER (PARTITION BY query_id, kb ORDER BY round(rrf, 12) DESC, coalesce(dense_rank, 1000000 + sparse_rank)) = 1),
  reviewed AS (SELECT c.*, w.key AS cwe_key, w.score AS cwe_score, w.matched_by AS cwe_matched_by, w.pos AS cwe_pos, i.key AS iec_key, i.pos AS iec_pos, r.key AS cra_key FROM classified c
    LEFT JOIN best w ON w.kb = 'cwe' AND w.query_id = {FINDING_TEXT} AND status = 'needs_review' LEFT JOIN best i ON i.kb = 'iec' AND i.query_id = {FINDING_TEXT} AND status = 'needs_review' LEFT JOIN best r ON r.kb = 'cra' AND r.query_id = {FINDING_TEXT} AND status = 'needs_review')"""


def reviewed_findings(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    """All findings classified and finished; all documents stand in for the knowledge bases, by language."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")
    kb = F.when(F.col("lang") == "de", "iec").when(F.col("lang") == "fr", "cra").otherwise("cwe")
    n = vectors.count()
    entries = table(spark, sf_dir, "documents").select(kb.alias("kb"), F.col("doc_id").alias("pos"), F.concat(F.lit("K"), F.col("doc_id").cast("string")).alias("key"), F.col("source").alias("title"), F.col("text").alias("body"), "text")

    def embed(asked: DataFrame) -> DataFrame:
        place = (F.length("query") * 37 + F.ascii(F.right("query", F.lit(1)))) % n
        return asked.withColumn("pos", place.cast("long")).join(vectors, "pos")

    none = F.lit("")
    rows = classify.finalize(classify.classify(s.findings(spark, sf_dir)))
    rows = rows.withColumn("query", classify.retrieval_text(F.col("category"), F.col("service"), F.col("title"), none, none))
    return review.with_candidates(rows, entries, embed, vectors=vectors, texts=texts)


@query(f"""WITH {REVIEW} SELECT finding_id, status, risk_level, weakness_reason, recommendation, CASE WHEN status = 'matched' THEN 'rule' END AS recommendation_source, cra_reference, iec_reference, cwe_key, cwe_score, cwe_matched_by, iec_key, cra_key,
  CASE WHEN status = 'matched' THEN 'rule' WHEN iec_key IS NOT NULL THEN 'iec' WHEN cra_key IS NOT NULL THEN 'cra' END AS requirement_source, CASE WHEN status = 'matched' THEN cra_reference ELSE coalesce(iec_key, cra_key) END AS requirement_id FROM reviewed""")
def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding with its verdict and texts, and the best candidate of each knowledge base for those to review."""
    rows = reviewed_findings(spark, sf_dir)
    first = lambda name: F.try_element_at(F.col(f"rag.{name}"), F.lit(1))
    basis = plan.requirement(F.col("status"), F.col("cra_reference"), F.col("rag.iec"), F.col("rag.cra"), F.col("recommendation"))
    rows = rows.withColumns({"basis": basis, "cwe": first("cwe")})
    return rows.select(
        "finding_id", "status", "risk_level", "weakness_reason", "recommendation", "recommendation_source", "cra_reference", "iec_reference",
        F.col("cwe.key").alias("cwe_key"), F.round("cwe.score", 6).alias("cwe_score"), F.array_join("cwe.matched_by", ",").alias("cwe_matched_by"), first("iec")["key"].alias("iec_key"), first("cra")["key"].alias("cra_key"),
        F.col("basis.source").alias("requirement_source"), F.col("basis.id").alias("requirement_id"),
    )


@query(f"""WITH {REVIEW}, named AS (SELECT v.*, d.source AS cwe_title FROM reviewed v LEFT JOIN documents d ON d.doc_id = cwe_pos), rows AS (SELECT *, ({s.RANK.format("risk_level")}) * 1099511627776 + seq AS ord FROM named)
  SELECT target, CAST(0 AS INTEGER) AS section, ord, '| ' || title || ' | - | ' || upper(risk_level) || ' |' AS text FROM rows
  UNION ALL SELECT target, 1, ord, '### [' || upper(risk_level) || '] ' || title || chr(10) || 'target: ' || target || chr(10) || 'reason: ' || weakness_reason || chr(10) || 'clauses: ' || iec_reference || '; ' || cra_reference || chr(10) || 'remediation: ' || recommendation FROM rows WHERE status = 'matched'
  UNION ALL SELECT target, 2, ord, '### ' || title || chr(10) || 'target: ' || target || chr(10) || 'reason: ' || coalesce(cwe_title, {s.quoted(report.NO_REASON)}) || chr(10) || 'clauses: ' || coalesce(nullif(concat_ws('; ', iec_key, cra_key), ''), {s.quoted(report.NO_CLAUSE)}) || chr(10) || 'remediation: ' || {s.quoted(report.NO_REMEDY)} FROM rows WHERE status = 'needs_review'""")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks of a report: the overview of each target, what breaks a rule, and what is to be reviewed."""
    none = F.lit(None).cast("struct<weakness_name:string,weakness_reason:string,remediation:string>")
    rows = reviewed_findings(spark, sf_dir, texts=False).withColumns({"summary": none, "state": F.lit(None).cast("string")})
    return report.sections(rows)


#: What the stand-in for a language model writes of a finding's title; some titles have no answer, some a text without sections, and some cite what they were not given.
_WRITTEN = """CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN 'plain ' || title ELSE '【弱點名稱】N ' || title || '【弱點原因】R ' || title || '【修補建議】F ' || title || CASE WHEN k % 5 = 0 THEN ' IEC 62443-4-2 CR 9.9' ELSE '' END END"""


def _write_text(prompt: str) -> str | None:
    title = re.search(r"^- title: (.*)$", prompt, re.M)[1]
    k = int(title.rpartition(" ")[2])
    if k % 7 == 0:
        return None
    if k % 11 == 0:
        return f"plain {title}"
    return f"【弱點名稱】N {title}【弱點原因】R {title}【修補建議】F {title}" + (" IEC 62443-4-2 CR 9.9" if k % 5 == 0 else "")


@query(f"""WITH {REVIEW}, told AS (SELECT *, {_WRITTEN} AS t, k % 7 <> 0 AND k % 11 <> 0 AS whole FROM (SELECT *, CAST(split_part(title, ' ', -1) AS BIGINT) AS k FROM reviewed))
  SELECT finding_id, status, CASE WHEN cwe_key IS NOT NULL THEN t END AS cwe_text, CASE WHEN iec_key IS NOT NULL THEN t END AS iec_text, CASE WHEN cra_key IS NOT NULL THEN t END AS cra_text,
    CASE WHEN status = 'needs_review' AND whole THEN 'N ' || title END AS summary_name, CASE WHEN status = 'needs_review' AND whole THEN 'F ' || title || CASE WHEN k % 5 = 0 THEN ' IEC 62443-4-2 CR 9.9' ELSE '' END END AS summary_fix,
    CASE WHEN status = 'matched' THEN t END AS weakness_name,
    CASE WHEN status = 'matched' AND t IS NOT NULL AND (k % 5 <> 0 OR k % 11 = 0) THEN t ELSE recommendation END AS recommendation,
    CASE WHEN status = 'matched' THEN CASE WHEN t IS NOT NULL AND (k % 5 <> 0 OR k % 11 = 0) THEN 'llm' ELSE 'rule' END END AS recommendation_source FROM told""")
def generated_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding with the texts that were generated for it: of candidates, summaries, names and advice."""
    stores = producers.open_stores(spark, f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}", 4)
    found = reviewed_findings(spark, sf_dir).withColumn("detail", F.lit(None).cast("string"))
    # Prompts take the candidates' texts, the rows that are kept and joined do not.
    producers.fill(producers.requests(producers.kinds(found)), stores, _write_text)
    rows = producers.first_wave(keep(found.withColumn("rag", producers.without_texts(F.col("rag")))), stores, None)
    first = lambda name: F.try_element_at(F.col(f"rag.{name}"), F.lit(1))["text_zh"].alias(f"{name}_text")
    return rows.select("finding_id", "status", first("cwe"), first("iec"), first("cra"), F.col("summary.weakness_name").alias("summary_name"), F.col("summary.remediation").alias("summary_fix"), "weakness_name", "recommendation", "recommendation_source")


@query(f"""WITH {PROCESS}, {PROCESS_SPARSE}
  SELECT query_id, {s.quoted(report.PROCESS_NOTE)} || chr(10) || chr(10) || string_agg('- K' || pos || ' ' || source || ', ' || lang, chr(10) ORDER BY sparse_rank) AS text FROM sparse JOIN documents ON doc_id = pos WHERE sparse_rank <= 8 GROUP BY query_id""")
def process_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The process requirements of every scan, as a block of its report; a target's findings are a scan here."""
    asked = process_query(spark, sf_dir).select(F.col("target").cast("long").alias("query_id"), "query")
    entries = table(spark, sf_dir, "documents").select(F.lit("process").alias("kb"), F.col("doc_id").alias("pos"), F.concat(F.lit("K"), F.col("doc_id").cast("string")).alias("key"), F.col("source").alias("title"), F.col("lang").alias("grp"), "text", F.lit(None).cast("array<float>").alias("embedding"))
    return report.process_blocks(review.process_requirements(asked, entries).withColumnRenamed("dense_score", "score"))


# Findings, prompts and what a console or a file gets


@query("""SELECT event_id, left(sha256('["' || event_type || '","src","' || user_id || '",' || CASE WHEN event_id % 6 = 0 THEN 'null' ELSE '"t' || event_id % 9 || '"' END || ',"' || event_id || '"]'), 12) AS finding_id,
  CASE WHEN event_id % 11 = 0 THEN 'unknown severity: severe' WHEN event_id % 13 = 0 THEN 'unknown severity: null' END AS error, CASE WHEN event_id % 4 = 0 THEN '{}' ELSE props END AS detail FROM events""")
def make_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    severity = F.when(n % 11 == 0, "severe").when(n % 13 == 0, F.lit(None)).otherwise("info")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("run_id"), n.alias("seq"), F.lit("network").alias("category"), F.lit("src").alias("source"), F.col("user_id").cast("string").alias("target"), severity.alias("severity"), F.when(n % 6 != 0, F.concat(F.lit("t"), (n % 9).cast("string"))).alias("title"), F.when(n % 4 != 0, F.col("props")).alias("detail"))
    made = findings.make_findings(rows)
    both = findings.valid(made).withColumn("error", F.lit(None).cast("string")).unionByName(findings.quarantined(made))
    return both.select("event_id", "finding_id", "error", "detail")


DETAIL = """detailed AS (SELECT f.*, props->>'$.k' AS k FROM findings f JOIN events e ON e.event_id = f.finding_id), lined AS (SELECT *, concat_ws(chr(10), CASE WHEN service <> '' THEN '- service: ' || service END, CASE WHEN finding_id % 3 <> 0 THEN '- port: ' || finding_id % 1000 END, CASE WHEN cve IS NOT NULL THEN '- cve_ids: ["' || cve || '"]' END, CASE WHEN k IS NOT NULL THEN '- k: ' || k END) AS lines FROM detailed)"""


def detailed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with an open detail object: empty texts, nulls and empty lists among its fields."""
    n = F.col("finding_id")
    props = table(spark, sf_dir, "events").select(F.col("event_id").alias("finding_id"), F.get_json_object("props", "$.k").alias("k"))
    detail = F.to_json(F.struct("service", F.lit("").alias("product"), F.when(n % 3 != 0, (n % 1000).cast("string")).alias("port"), "cve_ids", F.col("k").try_cast("long").alias("k")), {"ignoreNullFields": "false"})
    return s.findings(spark, sf_dir).join(props, "finding_id").withColumn("detail", detail)


@query(f"WITH {s.FINDINGS}, {DETAIL} SELECT finding_id, lines FROM lined")
def detail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detailed_findings(spark, sf_dir).select("finding_id", text.detail_lines(F.col("detail")).alias("lines"))


_HEAD = "'# Finding' || chr(10) || '- title: ' || title || chr(10) || '- category: ' || category || ' (' || source || ')'"
_NL, _TARGET = " || chr(10) || ", "'- target: ' || target"


@query(f"""WITH {s.FINDINGS}, {DETAIL}, p AS (SELECT *, nullif(lines, '') AS own FROM lined)
  SELECT finding_id, concat_ws(chr(10), {_HEAD}, {_TARGET}, '- severity: ' || coalesce(severity, ''), own) || chr(10) || chr(10) || '# Reference material; cite nothing else' || chr(10) || CASE WHEN finding_id % 4 = 0 THEN {s.quoted(prompts.NO_CONTEXT)} ELSE 'block ' || finding_id % 7 END AS advice,
    concat_ws(chr(10), {_HEAD}, {_TARGET}, own) || chr(10) || chr(10) || 'ref ' || finding_id % 5 AS remediation,
    concat_ws(chr(10), {_HEAD}, {_TARGET}, own) || chr(10) || chr(10) || '# Candidate weakness' || chr(10) || 'W' || finding_id % 9 || ' — N' || chr(10) || 'text' || chr(10) || chr(10) || '# Candidate clause' || chr(10) || CASE WHEN finding_id % 2 = 0 THEN {s.quoted(prompts.NO_CANDIDATE)} ELSE 'C1 — T' || chr(10) || left(repeat('long', 1200), 4000) END || chr(10) || chr(10) || '# Candidate article' || chr(10) || {s.quoted(prompts.NO_CANDIDATE)} AS summary,
    concat_ws(chr(10), {_HEAD}, own) || chr(10) || chr(10) || '# Why it is a weakness' || chr(10) || CASE WHEN finding_id % 2 = 0 THEN 'why' ELSE {s.quoted(prompts.NO_REASON)} END || chr(10) || chr(10) || 'clause text' || chr(10) || chr(10) || '# The rule''s advice' || chr(10) || {s.quoted(prompts.NO_ADVICE)} AS rule,
    concat_ws(chr(10), {_HEAD}, own) || chr(10) || chr(10) || '# What was found' || chr(10) || CASE WHEN finding_id % 2 = 0 THEN '- remediation: fix' || chr(10) || '- reference: CRA 1' ELSE {s.quoted(prompts.NO_BASIS)} END AS name,
    concat_ws(chr(10), {_HEAD}, {_TARGET}, own) || CASE WHEN finding_id % 3 = 0 THEN chr(10) || chr(10) || '# Requirement to test' || chr(10) || '- CR 1: t' || finding_id % 8 ELSE '' END AS objective FROM p""")
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each kind of generated text for every finding."""
    n = F.col("finding_id")
    s_ = lambda head, m: F.concat(F.lit(head), (n % m).cast("string"))
    kind = "struct<key:string,title:string,text:string>"
    weakness = F.struct(s_("W", 9).alias("key"), F.lit("N").alias("title"), F.lit("text").alias("text"))
    clause = F.when(n % 2 != 0, F.struct(F.lit("C1").alias("key"), F.lit("T").alias("title"), F.repeat(F.lit("long"), 1200).alias("text")))
    even = lambda value: F.when(n % 2 == 0, F.lit(value))
    basis = F.when(n % 3 == 0, F.struct(F.lit("CR 1").alias("id"), s_("t", 8).alias("text")))
    return detailed_findings(spark, sf_dir).select(
        "finding_id",
        prompts.advice_prompt(F.when(n % 4 != 0, s_("block ", 7)).otherwise(" ")).alias("advice"),
        prompts.remediation_prompt(s_("ref ", 5)).alias("remediation"),
        prompts.summary_prompt(weakness, clause, F.lit(None).cast(kind)).alias("summary"),
        prompts.rule_prompt(even("why"), F.lit("clause text"), F.lit(""), F.lit(None).cast("string")).alias("rule"),
        prompts.name_prompt(even("fix"), even("CRA 1")).alias("name"),
        prompts.objective_prompt(basis).alias("objective"),
    )


@query(f"WITH {s.CLASSIFIED} SELECT finding_id, CAST(row_number() OVER (ORDER BY {s.RANK.format('risk_level')}, seq) AS INTEGER) AS place FROM classified")
def risk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each finding in the order by risk, ties in input order."""
    rows = classify.classify(s.findings(spark, sf_dir)).withColumn("level", scoring.level_rank(F.col("risk_level")))
    return merge.numbered(rows, "level", "seq", "place").select("finding_id", "place")


@query(f"WITH {s.CLASSIFIED} SELECT target, risk_level, status, count(*) AS n FROM classified GROUP BY ALL")
def risk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(s.findings(spark, sf_dir)).groupBy("target", "risk_level", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {s.FINDINGS} SELECT ({s.RANK.format("severity")}) * 1099511627776 + seq AS ord, '[' || CASE WHEN length(severity) > 6 THEN upper(severity) ELSE lpad(upper(severity), 6, ' ') END || '] (' || category || '/' || source || ') ' || title || '  — ' || target AS line FROM findings WHERE severity IS NOT NULL""")
def finding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.finding_lines(s.findings(spark, sf_dir).filter("severity IS NOT NULL"))


@query(f"""WITH {s.FINDINGS} SELECT '{{"finding_id":' || finding_id || ',"category":"' || category || '","target":"' || target || '","title":"' || title || '","severity":' || CASE WHEN severity IS NULL THEN 'null' ELSE '"' || severity || '"' END || ',"cve_ids":' || CASE WHEN cve IS NULL THEN '[]' ELSE '["' || cve || '"]' END || '}}' AS value FROM findings""")
def findings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.findings_json(s.findings(spark, sf_dir).select("finding_id", "category", "target", "title", "severity", "cve_ids"))


@query(f"""WITH {s.CLASSIFIED}, p AS (SELECT *, 'With authorisation, verify whether ' || service || ' on ' || target || ' can be exploited' || CASE WHEN cra_reference IS NULL THEN '' ELSE ' (requirement ' || cra_reference || ')' END AS objective FROM classified WHERE category IN ('network', 'webapp'))
  SELECT target, seq AS ord, '## ' || title || chr(10) || chr(10) || '- target: `' || target || '`, status: ' || status || chr(10) || '- requirement: ' || CASE WHEN cra_reference IS NULL THEN 'none, a general aim' ELSE cra_reference || ' (rule)' END || chr(10) || '- aim (from a template): ' || objective || chr(10) || chr(10) || '```bash' || chr(10) || 'python3 -m live_check ' || target || ' --objective ' || chr(39) || objective || chr(39) || ' --i-am-authorized' || chr(10) || '```' AS text FROM p
  UNION ALL SELECT '', -1, {s.quoted(plan.PLAN_TITLE)} || chr(10) || chr(10) || 'made at 2024-01-01, ' || count(*) || ' tests' || chr(10) || chr(10) || {s.quoted(plan.PLAN_WARNING)} FROM p""")
def plan_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a test plan: its header and a block a test."""
    none = F.array().cast("array<struct<key:string,title:string,text:string,text_zh:string>>")
    merged = classify.classify(s.findings(spark, sf_dir)).withColumns({"clauses": none, "articles": none})
    rows = plan.test_plan(merged).join(merged.select("finding_id", "seq"), "finding_id")
    header = plan.plan_header(rows, "2024-01-01").select(F.lit("").alias("target"), F.lit(-1).cast("long").alias("ord"), "text")
    return plan.plan_blocks(rows).unionByName(header)


@query(f"""WITH scope AS ({ORACLES["infer_scope"]}) SELECT '# Security scan report' || chr(10) || chr(10) || '| item | value |' || chr(10) || '|---|---|' || chr(10) || '| time | 2024-01-01 |' || chr(10) || '| IP | ' || network || ' |' || chr(10) || '| firmware | ' || firmware || ' |' || chr(10) || '| operator | unknown |' AS text FROM scope""")
def report_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.header_block(report.metadata(spark, "2024-01-01"), infer_scope(spark, sf_dir))


@query("""SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'host' || page_id WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN url WHEN 5 THEN '10.0.0.' || page_id % 256 ELSE NULL END AS target FROM pages""")
def single_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One host or address; lists, networks, paths, blanks and addresses without a host are none."""
    n = F.col("page_id")
    s_ = n.cast("string")
    own = F.when(n % 7 == 0, F.concat(F.lit(" host"), s_, F.lit(" "))).when(n % 7 == 1, F.concat(F.lit("a,"), s_)).when(n % 7 == 2, F.concat(F.lit("10.0.0.0/"), (n % 33).cast("string"))).when(n % 7 == 3, "  ").when(n % 7 == 4, F.col("url")).when(n % 7 == 5, F.concat(F.lit("10.0.0."), (n % 256).cast("string"))).otherwise("http:///path")
    return table(spark, sf_dir, "pages").select("page_id", targets.single_target(own).alias("target"))


@query("""SELECT doc_id, 'IEC 62443-4-' || CASE WHEN doc_id % 2 = 0 THEN '2 CR ' ELSE '1 SM-' END || doc_id % 90 AS key, CASE WHEN doc_id % 2 = 0 THEN 'IEC 62443-4-2' ELSE 'IEC 62443-4-1' END AS standard,
    concat_ws(chr(10) || chr(10), CASE WHEN trim(coalesce(text, '')) <> '' THEN 'Requirement:' || chr(10) || text END, CASE WHEN doc_id % 3 = 0 THEN 'Rationale and supplemental guidance:' || chr(10) || 'why' END) AS text,
    concat_ws(chr(10), 'IEC 62443-4-' || CASE WHEN doc_id % 2 = 0 THEN '2 CR ' ELSE '1 SM-' END || doc_id % 90 || ' – T' || doc_id % 4, CASE WHEN doc_id % 5 <> 0 THEN 'G' END, nullif(text, ''), CASE WHEN doc_id % 3 = 0 THEN 'why' END) AS embedding_text,
    CASE doc_id % 4 WHEN 0 THEN '4-2' WHEN 1 THEN '4-1' END AS part FROM documents""")
def clause_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of both standards as knowledge-base entries, and the part that a file's name tells."""
    n = F.col("doc_id")
    s_ = lambda m: (n % m).cast("string")
    part = F.when(n % 2 == 0, "4-2").otherwise("4-1")
    number = F.concat(F.when(n % 2 == 0, "CR ").otherwise("SM-"), s_(90))
    rows = table(spark, sf_dir, "documents").select("doc_id", number.alias("clause_id"), F.concat(F.lit("5."), n.cast("string")).alias("clause_no"), F.concat(F.lit("T"), s_(4)).alias("title"), F.when(n % 5 != 0, "G").otherwise("").alias("group"), F.coalesce("text", F.lit("")).alias("requirement"), F.when(n % 3 == 0, "why").otherwise("").alias("rationale"), F.lit("").alias("enhancements"), F.lit("SL-C 1").alias("security_levels"))
    name = F.when(n % 4 == 0, F.concat(F.lit("/a/IEC_62443_4_2_"), n.cast("string"), F.lit(".pdf"))).when(n % 4 == 1, "x/iec62443-4-1{ed1.0}b.pdf").when(n % 4 == 2, "iec62443-4-2/other.pdf").otherwise("iec62443-3-3.pdf")
    made = segments.clause_records(rows.withColumn("part", part), F.col("part"))
    # The records keep their clause's number, which is the document here.
    return made.select(F.substring_index("clause_no", ".", -1).cast("long").alias("doc_id"), "key", "standard", "text", "embedding_text").join(table(spark, sf_dir, "documents").select("doc_id", segments.detect_part(name).alias("part")), "doc_id")


@query(rf"""SELECT doc_id, '[CWE-' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' — ' || source END || ']' || CASE WHEN own = '' THEN '' ELSE chr(10) || {TRUNCATED} END || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '{context.MITIGATIONS}' || chr(10) || '- fix ' || doc_id % 5 ELSE '' END AS block,
    'CWE-' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ',Article ' || doc_id % 9 END || ',CR 1' AS ids FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS own FROM documents)""")
def weakness_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weaknesses as context blocks, and the numbers that a text about them may cite."""
    n = F.col("doc_id")
    key = F.concat(F.lit("CWE-"), n.cast("string"))
    fixes = F.when(n % 2 == 0, F.array(F.concat(F.lit("fix "), (n % 5).cast("string"))))
    ids = context.source_ids(F.array(key, F.lit(None)), F.array(F.when(n % 4 != 0, F.concat(F.lit("Article "), (n % 9).cast("string"))).otherwise("")), F.array(F.lit("CR 1")))
    return table(spark, sf_dir, "documents").select("doc_id", context.weakness_entry(key, F.when(n % 3 != 0, F.col("source")), F.col("text"), fixes).alias("block"), F.array_join(ids, ",").alias("ids"))


@query(f"WITH {SIGNED} SELECT finding_id, 'CR ' || finding_id % 4 || '::' || signature AS remediation_key, signature || '::' || CASE WHEN finding_id % 2 = 0 THEN 'CWE-1' ELSE '' END || '::CR ' || finding_id % 4 || '::' AS summary_key FROM keyed")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = s.findings(spark, sf_dir), F.col("finding_id")
    own, clause = cache.signature(rows), F.concat(F.lit("CR "), (n % 4).cast("string"))
    return rows.select("finding_id", cache.clause_key_of(clause, own).alias("remediation_key"), cache.summary_key(own, F.when(n % 2 == 0, "CWE-1"), clause, F.lit(None)).alias("summary_key"))


# Job states, console lines and scope of scans of any size

JOB_RANK = "CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 2 WHEN event_type = 'purchase' THEN 3 WHEN event_type = 'error' AND event_id % 4 <> 0 THEN 4 END"


@query(f"""WITH e AS (SELECT *, user_id * 20 + event_id % 20 AS j FROM events), jobs AS (SELECT j, j // 20 AS u, bool_or(event_type = 'error' AND event_id % 4 = 0) AS failed FROM e GROUP BY j HAVING bool_or(event_type = 'signup')),
  told AS (SELECT j, event_id % 5 AS ord, max({JOB_RANK}) AS rank FROM e GROUP BY ALL),
  rows AS (SELECT jobs.*, s.ord, ['ports', 'firmware', 'web', 'analysis', 'report'][s.ord + 1] AS stage, rank, CASE s.ord WHEN 0 THEN u % 2 = 0 WHEN 1 THEN u % 3 = 0 WHEN 2 THEN u % 4 = 0 WHEN 3 THEN true ELSE u % 5 = 0 END AS given FROM jobs CROSS JOIN (SELECT unnest(range(5)) AS ord) s LEFT JOIN told ON told.j = jobs.j AND told.ord = s.ord)
  SELECT CAST(j AS VARCHAR) AS job_id, CAST(ord AS INTEGER) AS ord, stage, CASE WHEN NOT given THEN 'skipped' WHEN rank = 3 THEN 'done' WHEN rank = 4 OR failed THEN 'error' WHEN rank = 2 THEN 'running' ELSE 'pending' END AS status FROM rows""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of jobs from their events, which come in any order and more than once."""
    n, u = F.col("event_id"), F.col("user_id")
    kind = F.when(F.col("event_type") == "signup", jobs.SUBMITTED).when((F.col("event_type") == "error") & (n % 4 == 0), jobs.FAILED).otherwise(jobs.TOLD)
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "done").otherwise("error")
    given = lambda m, value: F.when(u % m == 0, value)
    rows = table(spark, sf_dir, "events").select((u * 20 + n % 20).cast("string").alias("job_id"), kind.alias("kind"), F.element_at(F.array(*[F.lit(x) for x in jobs.NAMES]), (n % 5 + 1).cast("int")).alias("stage"), status.alias("status"), F.col("ts").alias("at"), given(2, "10.0.0.1").alias("ip"), given(3, "f.bin").alias("firmware"), given(4, "http://a").alias("url"), (u % 5 == 0).alias("report"))
    return jobs.states(rows)


@query(f"""WITH {s.CLASSIFIED} SELECT ({s.RANK.format("risk_level")}) * 1099511627776 + seq AS ord, '[' || upper(risk_level) || '] ' || title || ' — ' || target || ': ' || CASE status WHEN 'matched' THEN 'breaks ' || iec_reference || '; ' || cra_reference ELSE 'to be reviewed' END AS line FROM classified""")
def analysis_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.analysis_lines(classify.classify(s.findings(spark, sf_dir)))


@query(f"WITH {s.FINDINGS} SELECT DISTINCT category, target FROM findings")
def scope_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.scope_rows(s.findings(spark, sf_dir))
