"""Findings, knowledge bases and texts made from the driver's tables, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import scoring, text
from gleaner.operators import classify, index, vectors


def quoted(value: str) -> str:
    """A text as an SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: services from event types, vulnerabilities and severities from values."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    service = F.when(F.col("event_type") == "error", " Telnet").when(F.col("event_type") == "view", "http").when(F.col("event_type") == "click", "UPnP").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("finding_id"),
        F.col("event_id").alias("seq"),
        F.element_at(F.array(F.lit("network"), F.lit("firmware"), F.lit("webapp")), (F.col("event_id") % 3 + 1).cast("int")).alias("category"),
        F.when(F.col("event_id") % 3 == 0, "ports").when(F.col("event_id") % 3 == 1, "image").otherwise("web").alias("source"),
        F.col("user_id").cast("string").alias("target"),
        F.concat(F.col("event_type"), F.lit(" "), (F.col("event_id") % 50).cast("string")).alias("title"),
        service.alias("service"),
        scoring.score_to_severity(F.when(F.col("value") >= 5, F.col("value") / 50)).alias("severity"),
        F.when(k >= 80, "critical").when(k >= 40, "medium").when(k >= 20, "odd").alias("alert_risk"),
        F.when(F.col("value") >= 200, F.array(F.concat(F.lit("CVE-2024-"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0")))).otherwise(F.array().cast("array<string>")).alias("cve_ids"),
    )


FINDINGS = """findings AS (SELECT event_id AS finding_id, event_id AS seq,
    ['network', 'firmware', 'webapp'][CAST(event_id % 3 AS INTEGER) + 1] AS category,
    CASE event_id % 3 WHEN 0 THEN 'ports' WHEN 1 THEN 'image' ELSE 'web' END AS source,
    CAST(user_id AS VARCHAR) AS target, event_type || ' ' || CAST(event_id % 50 AS VARCHAR) AS title,
    CASE event_type WHEN 'error' THEN ' Telnet' WHEN 'view' THEN 'http' WHEN 'click' THEN 'UPnP' ELSE event_type END AS service,
    CASE WHEN value < 5 THEN NULL WHEN value / 50 >= 9 THEN 'critical' WHEN value / 50 >= 7 THEN 'high' WHEN value / 50 >= 4 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN TRY_CAST(props->>'$.k' AS BIGINT) >= 80 THEN 'critical' WHEN TRY_CAST(props->>'$.k' AS BIGINT) >= 40 THEN 'medium' WHEN TRY_CAST(props->>'$.k' AS BIGINT) >= 20 THEN 'odd' END AS alert_risk,
    CASE WHEN value >= 200 THEN 'CVE-2024-' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') END AS cve
  FROM events)"""

RULES = "rules(rs, rr, rc, ri, rw, ra) AS (VALUES " + ", ".join("(" + ", ".join(map(quoted, (*rule, *classify.RULE_TEXTS[rule[0]]))) + ")" for rule in classify.RULES) + ")"

CLASSIFIED = f"""{FINDINGS}, {RULES}, classified AS (SELECT f.*,
    CASE WHEN rs IS NOT NULL OR cve IS NOT NULL THEN 'matched' ELSE 'needs_review' END AS status,
    CASE WHEN rs IS NOT NULL THEN 'rule' WHEN cve IS NOT NULL THEN 'known' ELSE 'review' END AS method,
    CASE WHEN rs IS NOT NULL THEN rr
         WHEN cve IS NOT NULL THEN CASE WHEN severity IN ('critical', 'high', 'medium', 'low') THEN severity ELSE 'medium' END
         WHEN severity IN ('critical', 'high', 'medium', 'low') THEN severity
         WHEN alert_risk IN ('critical', 'high', 'medium', 'low', 'info') THEN alert_risk ELSE 'info' END AS risk_level,
    CASE WHEN rs IS NOT NULL THEN rc WHEN cve IS NOT NULL THEN 'CRA Annex I Part II(1)' END AS cra_reference,
    CASE WHEN rs IS NOT NULL THEN ri WHEN cve IS NOT NULL THEN 'IEC 62443-4-2 CR 3.10' END AS iec_reference,
    CASE WHEN rs IS NULL THEN cve END AS known_list,
    CASE WHEN rs IS NOT NULL THEN rw WHEN cve IS NOT NULL THEN {quoted(classify.KNOWN_REASON[0])} || cve || {quoted(classify.KNOWN_REASON[1])} END AS weakness_reason,
    CASE WHEN rs IS NOT NULL THEN ra WHEN cve IS NOT NULL THEN {quoted(classify.KNOWN_ADVICE[0])} || cve || {quoted(classify.KNOWN_ADVICE[1])} END AS recommendation
  FROM findings f LEFT JOIN rules ON lower(trim(service)) = rs)"""

RANK = "CASE {0} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 9 END"


def documents_as_kb(spark: SparkSession, sf_dir: str, kb: str = "lang") -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col(kb).alias("kb"), F.col("doc_id").alias("pos"), "text")


def stored_documents(spark: SparkSession, sf_dir: str, kb: str) -> index.Index:
    """The stored index of all documents, by language or ("all") as one knowledge base."""
    docs = documents_as_kb(spark, sf_dir)
    return index.stored(docs if kb == "lang" else docs.withColumn("kb", F.lit(kb)), kb, [f"{sf_dir}/documents.parquet"])


def stored_vectors(spark: SparkSession, sf_dir: str) -> vectors.VectorIndex:
    """The stored index of all embeddings."""
    entries = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")
    return vectors.stored(entries, "embeddings", [f"{sf_dir}/embeddings.parquet"])


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def cited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with citations made from document ids, and the numbers that they may cite."""
    n = F.col("doc_id")
    s = lambda m: (n % m).cast("string")
    text = F.concat(F.lit("see CWE-"), s(50), F.lit(", article  "), s(13), F.lit(" and Annex I Part II ("), s(9), F.lit(")(a). IEC 62443-4-2 CR "), s(7), F.lit("."), s(15), F.lit(" RE("), s(3), F.lit("), CR 1.1; SVV-"), s(5), F.lit("; cwe-"), s(50), F.lit("."))
    allowed = F.array(F.concat(F.lit("CWE-"), s(25)), F.concat(F.lit("Article "), s(11)), F.lit("Annex I Part II"), F.lit("IEC 62443-4-2 CR 1.11"), F.lit(None).cast("string"), F.lit("IEC 62443-4-1 SVV-3"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("answer"), allowed.alias("allowed"))


CITED = """cited AS (SELECT doc_id, 'see CWE-' || doc_id % 50 || ', article  ' || doc_id % 13 || ' and Annex I Part II (' || doc_id % 9 || ')(a). IEC 62443-4-2 CR ' || doc_id % 7 || '.' || doc_id % 15
    || ' RE(' || doc_id % 3 || '), CR 1.1; SVV-' || doc_id % 5 || '; cwe-' || doc_id % 50 || '.' AS answer,
    ['CWE-' || doc_id % 25, 'Article ' || doc_id % 11, 'Annex I Part II', 'IEC 62443-4-2 CR 1.11', 'IEC 62443-4-1 SVV-3'] AS allowed FROM documents)"""
CITATION_LIST = " || ".join(f"regexp_extract_all(answer, '(?i){pattern}')" for pattern in text.CITATIONS)


def standard_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a made-up standard: all lines of its text as the body, headers and page furniture between them.

    A contents page stands before the body and a second language after it.
    """
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "own"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("size"))
    i, own = F.col("i").cast("long"), F.col("own")
    s = lambda c: F.floor(c).cast("string")
    parts = [
        F.when(i == 0, F.lit("CONTENTS")),
        F.when(i == 0, F.lit("1 Scope")),
        F.when(i % 20 == 0, F.concat(s(i / 10 + 2), F.lit(" FR "), s(i / 20 + 1), F.lit(" – Some  control"))),
        F.when(i % 10 == 0, F.concat(s(i / 10 + 2), F.lit(".1 CR "), s(i % 7), F.lit("."), s(i), F.lit(" – Title of it"))),
        F.when(i % 10 == 5, F.concat(s(i / 10 + 2), F.lit(".1 Security levels"))),
        F.when(i % 13 == 1, F.lit("IEC 62443-4-2:2019 © IEC 2019 – 3 –")),
        F.when(i % 11 == 2, F.lit("Requirement ...... 12")),
        F.when(i % 9 == 4, F.concat(F.lit("NOTE "), own)).when(i % 7 == 2, F.concat(own, F.lit("-"))).otherwise(own),
        F.when(i == F.col("size") - 1, F.lit("SOMMAIRE")),
        F.when(i == F.col("size") - 1, F.lit("Une autre langue")),
    ]
    return lines.select("doc_id", i.alias("i"), F.posexplode(F.array(*parts)).alias("part", "line")).filter("line IS NOT NULL").select("doc_id", (F.col("i") * len(parts) + F.col("part")).alias("n"), "line")


LINES = r"""lines AS (SELECT doc_id, i * 10 + part AS n, line FROM (SELECT doc_id, i, unnest(range(10)) AS part, unnest([
      CASE WHEN i = 0 THEN 'CONTENTS' END, CASE WHEN i = 0 THEN '1 Scope' END,
      CASE WHEN i % 20 = 0 THEN (i // 10 + 2) || ' FR ' || (i // 20 + 1) || ' – Some  control' END,
      CASE WHEN i % 10 = 0 THEN (i // 10 + 2) || '.1 CR ' || i % 7 || '.' || i || ' – Title of it' END,
      CASE WHEN i % 10 = 5 THEN (i // 10 + 2) || '.1 Security levels' END,
      CASE WHEN i % 13 = 1 THEN 'IEC 62443-4-2:2019 © IEC 2019 – 3 –' END,
      CASE WHEN i % 11 = 2 THEN 'Requirement ...... 12' END,
      CASE WHEN i % 9 = 4 THEN 'NOTE ' || own WHEN i % 7 = 2 THEN own || '-' ELSE own END,
      CASE WHEN i = size - 1 THEN 'SOMMAIRE' END, CASE WHEN i = size - 1 THEN 'Une autre langue' END]) AS line
    FROM (SELECT doc_id, i, ls[i + 1] AS own, len(ls) AS size FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))) WHERE line IS NOT NULL),
  limits AS (SELECT doc_id, min(n) FILTER (line IN ('SOMMAIRE', 'AVANT-PROPOS')) AS stop, min(n) FILTER (regexp_matches(line, '^1\s+Scope\s*$')) AS start FROM lines GROUP BY doc_id),
  body AS (SELECT l.* FROM lines l JOIN limits USING (doc_id) WHERE (stop IS NULL OR n < stop) AND (start IS NULL OR coalesce(start > stop, false) OR n >= start)
    AND NOT (regexp_matches(line, '^(–\s*\d+\s*–\s*)?IEC\s+62443-\d-\d:\d{4}.*?(–\s*\d+\s*–)?$') OR regexp_matches(line, '\.{4,}\s*\d+\s*$') OR regexp_matches(line, '(?i)^Customer:\s')
      OR regexp_matches(line, '(?i)^Order No\.:') OR regexp_matches(line, '(?i)licence agreement') OR regexp_matches(line, '(?i)copyright of IEC') OR regexp_matches(line, '^\s*$')))"""
