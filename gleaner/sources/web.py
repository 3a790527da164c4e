"""Web-alert and agent results."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.scoring import LEVELS

ALERT_SCHEMA = "url STRING, alert STRING, name STRING, risk STRING, param STRING, description STRING, solution STRING, cweid STRING"
# Risk words, outcomes and cut-offs.
ALERT_RISKS = {"High": "high", "Medium": "medium", "Low": "low", "Informational": "info"}
OUTCOMES = ("confirmed", "not_confirmed", "inconclusive")
BLOCK = r"(?s)```json\s*(\{.*?\})\s*```"
#: What stands for a summary if an agent gave none, and the titles of the outcomes; this project's own wording.
NO_SUMMARY = "(the agent gave no result)"
OUTCOME_TITLES = {"confirmed": "Automated test: confirmed", "not_confirmed": "Automated test: not confirmed", "inconclusive": "Automated test: inconclusive"}
RESULT_CHARS = 4000
STDOUT_SCHEMA = "is_error BOOLEAN, result STRING, total_cost_usd DOUBLE, num_turns INT, session_id STRING"
AGENT_SCHEMA = "outcome STRING, severity STRING, summary STRING, evidence STRING"


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALERT_SCHEMA).json(path, multiLine=True)


def alerts(rows: DataFrame) -> DataFrame:
    """Findings from alerts; their own risk is kept beside the severity info."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    risk = F.try_element_at(F.create_map(*[F.lit(x) for kv in ALERT_RISKS.items() for x in kv]), F.coalesce("risk", F.lit("Informational")))
    return rows.withColumns({"target": text("url"), "severity": F.lit("info"), "title": F.coalesce("alert", "name", F.lit("")), "param": text("param"), "description": F.left(text("description"), F.lit(200)), "solution": F.left(text("solution"), F.lit(300)), "cweid": text("cweid"), "alert_risk": F.coalesce(risk, F.lit("info"))})


def last_block(text: Column) -> Column:
    """The last fenced JSON object of a text; null if there is none or it is broken."""
    found = F.try_element_at(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BLOCK), F.lit(1)), F.lit(-1))
    return F.when(F.try_parse_json(found).isNotNull(), F.from_json(found, AGENT_SCHEMA))


def agent_stdout(rows: DataFrame, stdout: str = "stdout") -> DataFrame:
    """Result, error flag, cost, turns and session of what an agent printed. What is no JSON object is an error with the text as its result."""
    found = F.from_json(F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(stdout)).startswith("OBJECT"), F.lit(False)), F.col(stdout)), STDOUT_SCHEMA)
    rows = rows.withColumn("found", found)
    broken = F.col("found").isNull()
    plain = F.trim(F.coalesce(F.col(stdout), F.lit("")))
    return rows.withColumns({
        "is_error": broken | F.coalesce("found.is_error", F.lit(False)),
        "result": F.when(broken, plain).otherwise(F.coalesce("found.result", F.lit(""))),
        "cost_usd": F.col("found.total_cost_usd"),
        "num_turns": F.col("found.num_turns"),
        "session_id": F.col("found.session_id"),
    }).drop("found")


def agent_findings(rows: DataFrame, result: str = "result", is_error: str = "is_error") -> DataFrame:
    """Outcome, severity, title, summary, evidence and the result's beginning. A severity counts only if confirmed and without an error."""
    rows = rows.withColumn("found", last_block(F.col(result)))
    failed = F.coalesce(F.col(is_error), F.lit(False))
    outcome = F.when(~failed & F.col("found.outcome").isin(*OUTCOMES), F.col("found.outcome")).otherwise("inconclusive")
    rows = rows.withColumn("outcome", outcome)
    own = F.trim(F.coalesce("found.summary", F.lit("")))
    plain = F.coalesce(F.nullif(F.left(F.trim(F.coalesce(F.col(result), F.lit(""))), F.lit(500)), F.lit("")), F.lit(NO_SUMMARY))
    title = F.element_at(F.create_map(*[F.lit(x) for kv in OUTCOME_TITLES.items() for x in kv]), F.col("outcome"))
    severity = F.when((F.col("outcome") == "confirmed") & F.col("found.severity").isin(*LEVELS), F.col("found.severity")).otherwise("info")
    return rows.withColumns({"severity": severity, "title": title, "agent_result": F.left(F.coalesce(F.col(result), F.lit("")), F.lit(RESULT_CHARS)), "summary": F.when(own != "", own).otherwise(plain), "evidence": F.left(F.trim(F.coalesce("found.evidence", F.lit(""))), F.lit(2000))}).drop("found")
