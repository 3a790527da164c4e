"""Report blocks, risk badges and job stages as rows."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.scoring import confidence_label, level_rank
from gleaner.operators import document

# The stages of a job and the badge of each risk word.
STAGES = (("ports", "ip"), ("firmware", "firmware"), ("web", "url"), ("analysis", ""), ("report", "report"))
BADGES = {"CRITICAL": "risk-critical", "嚴重": "risk-critical", "HIGH": "risk-high", "高": "risk-high", "MEDIUM": "risk-medium", "MED": "risk-medium", "中": "risk-medium", "LOW": "risk-low", "低": "risk-low", "INFO": "risk-info", "資訊": "risk-info"}


def badge(cell: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in BADGES.items() for x in kv]), F.upper(F.trim(cell)))


def initial_stages(jobs: DataFrame) -> DataFrame:
    """One row a job and stage: pending, or skipped without what it needs."""
    stage = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(name).alias("stage"), F.lit(need).alias("need")) for k, (name, need) in enumerate(STAGES)]))
    given = F.create_map(F.lit("ip"), F.coalesce(F.col("ip"), F.lit("")) != "", F.lit("firmware"), F.coalesce(F.col("firmware"), F.lit("")) != "", F.lit("url"), F.coalesce(F.col("url"), F.lit("")) != "", F.lit("report"), F.coalesce(F.col("report"), F.lit(False)), F.lit(""), F.lit(True))
    rows = jobs.select("job_id", given.alias("given"), stage.alias("s"))
    return rows.select("job_id", "s.ord", "s.stage", F.when(F.element_at("given", F.col("s.need")), "pending").otherwise("skipped").alias("status"))


def after_failure(status: Column) -> Column:
    """A stage's status once its job has failed."""
    return F.when(status.isin("pending", "running"), F.lit("error")).otherwise(status)


def finding_blocks(merged: DataFrame) -> DataFrame:
    """(target, section, ord, text): one Markdown block a finding, matched ones before those to review."""
    section = F.when(F.col("status") == "matched", F.lit(1)).when(F.col("status") == "needs_review", F.lit(2)).otherwise(F.lit(3))
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(f"\n- {label}: "), c))
    text = F.concat(F.lit("### "), F.coalesce("title", F.lit("")), F.lit("\n- risk: "), F.col("risk_level"), line("CRA", F.col("cra_reference")), line("IEC", F.col("iec_reference")))
    return merged.select("target", section.alias("section"), (level_rank(F.col("risk_level")).cast("long") * F.lit(1 << 40) + F.col("seq")).alias("ord"), text.alias("text"))


def metadata(spark: SparkSession, now: str, operator: str = "unknown", ip: str = "", firmware: str = "", url: str = "") -> DataFrame:
    """One row that describes a scan; the time is given, so that reruns agree."""
    return spark.createDataFrame([(now, operator, ip, firmware, url)], "scan_time string, operator string, ip string, firmware string, url string")


#: Headings and notes of a report; this project's own wording.
NOTHING, NO_REASON, NO_REMEDY, NO_CLAUSE = "No finding.", "No candidate was found, so the reason is unknown.", "No remediation was generated; please review.", "No candidate was found."
PROCESS_NOTE = "These process requirements are a start for a self-assessment; the scan can neither prove nor disprove any of them."


def header_block(meta: DataFrame, scope: DataFrame) -> DataFrame:
    """The first block of a report: when, by whom, and what of a kind was scanned, blank kinds left out."""
    row = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"| {label} | "), F.col(c), F.lit(" |")))
    lines = [F.lit("# Security scan report"), F.lit(""), F.lit("| item | value |"), F.lit("|---|---|"), row("time", "scan_time"), row("IP", "network"), row("firmware", "firmware_scope"), row("URL", "webapp"), row("operator", "operator")]
    # One row each, so the broadcast is a row.
    both = meta.select(F.lit(1).alias("one"), "scan_time", "operator").join(F.broadcast(scope.withColumnRenamed("firmware", "firmware_scope").withColumn("one", F.lit(1))), "one")
    return both.select(F.concat_ws("\n", *lines).alias("text"))


def _place() -> Column:
    return level_rank(F.col("risk_level")).cast("long") * F.lit(1 << 40) + F.col("seq")


def _overview_text() -> Column:
    return F.concat(F.lit("| "), F.coalesce("title", F.lit("")), F.lit(" | "), F.coalesce("state", F.lit("-")), F.lit(" | "), F.upper("risk_level"), F.lit(" |"))


def _matched_text() -> Column:
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    made = F.when(F.col("recommendation_source") == "llm", F.lit(" (generated from these clauses)")).otherwise(F.lit(""))
    clauses = F.concat_ws("; ", blank("iec_reference"), blank("cra_reference"))
    lines = [F.concat(F.lit("### ["), F.upper("risk_level"), F.lit("] "), F.coalesce(blank("weakness_name"), F.col("title"))), F.concat(F.lit("target: "), F.col("target")), F.concat(F.lit("reason: "), F.coalesce(blank("weakness_reason"), blank("recommendation"), F.lit(NO_REASON))), F.concat(F.lit("clauses: "), F.when(clauses == "", F.lit(NO_CLAUSE)).otherwise(clauses)), F.concat(F.lit("remediation"), made, F.lit(": "), F.coalesce("recommendation", F.lit("")))]
    return F.concat_ws("\n", *lines)


def _review_text() -> Column:
    first = lambda kb: F.try_element_at(F.col(f"rag.{kb}"), F.lit(1))
    blank = lambda c: F.nullif(c, F.lit(""))
    cwe, iec, cra = first("cwe"), first("iec"), first("cra")
    reason = F.coalesce(blank(F.col("summary.weakness_reason")), blank(cwe["text_zh"]), blank(cwe["title"]), F.lit(NO_REASON))
    remedy = F.coalesce(blank(F.col("summary.remediation")), blank(F.concat_ws("; ", blank(iec["text_zh"]), blank(cra["text_zh"]))), F.lit(NO_REMEDY))
    clauses = F.coalesce(blank(F.concat_ws("; ", iec["key"], cra["key"])), F.lit(NO_CLAUSE))
    lines = [F.concat(F.lit("### "), F.coalesce(blank(F.col("summary.weakness_name")), F.col("title"))), F.concat(F.lit("target: "), F.col("target")), F.concat(F.lit("reason: "), reason), F.concat(F.lit("clauses: "), clauses), F.concat(F.lit("remediation: "), remedy)]
    return F.concat_ws("\n", *lines)


def sections(merged: DataFrame) -> DataFrame:
    """(target, section, ord, text): all blocks of a report, from one reading of its findings.

    Section 0 has a table row a finding, section 1 the findings that break a rule (name, reason,
    clauses and remediation, and who wrote that), section 2 those to review, from their summary, else
    from the first candidate of each knowledge base. ``merged`` has summary (weakness_name,
    weakness_reason, remediation) and rag, a struct of the arrays cwe, iec and cra of candidates (key,
    title, text_zh). Order within a section and target is by risk.
    """
    block = lambda number, text: F.struct(F.lit(number).alias("section"), text.alias("text"))
    own = F.when(F.col("status") == "matched", block(1, _matched_text())).when(F.col("status") == "needs_review", block(2, _review_text()))
    blocks = F.explode(F.array_compact(F.array(block(0, _overview_text()), own))).alias("b")
    return merged.select("target", _place().alias("ord"), blocks).select("target", "b.section", "ord", "b.text")


def process_blocks(candidates: DataFrame, run: str = "query_id") -> DataFrame:
    """(run, text): each scan's process requirements (rank, key, title, grp, score); a scan without any has no row."""
    grouped = F.when(F.coalesce("grp", F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(", "), F.col("grp")))
    sure = F.coalesce(F.concat(F.lit(" ("), confidence_label(F.col("score")), F.lit(")")), F.lit(""))
    line = F.concat(F.lit("- "), F.col("key"), F.lit(" "), F.col("title"), grouped, sure)
    # A scan has at most a handful of these.
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n")
    return candidates.groupBy(run).agg(lines.alias("lines")).select(run, F.concat(F.lit(PROCESS_NOTE + "\n\n"), F.col("lines")).alias("text"))


def finding_lines(findings: DataFrame) -> DataFrame:
    """(ord, line): what a console shows of each finding, in risk order."""
    level = F.lpad(F.upper("severity"), 6, " ")
    line = F.concat(F.lit("["), F.when(F.length("severity") > 6, F.upper("severity")).otherwise(level), F.lit("] ("), F.col("category"), F.lit("/"), F.col("source"), F.lit(") "), F.col("title"), F.lit("  — "), F.col("target"))
    return findings.select((level_rank(F.col("severity")).cast("long") * F.lit(1 << 40) + F.col("seq")).alias("ord"), line.alias("line"))


def findings_json(findings: DataFrame) -> DataFrame:
    """Each finding as one JSON object, empty fields kept."""
    return findings.select(F.to_json(F.struct(*findings.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_findings(findings: DataFrame, path: str, order: str = "seq") -> None:
    """All findings as one JSON array in their order."""
    document.write_array(findings.select(order, F.to_json(F.struct(*findings.columns), {"ignoreNullFields": "false"}).alias("value")), path, [order])


def analysis_lines(merged: DataFrame) -> DataFrame:
    """(ord, line): what a console shows of each verdict: risk, finding, status, and the clauses or that it is to be reviewed."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    clauses = F.concat_ws("; ", blank("iec_reference"), blank("cra_reference"))
    told = F.when(F.col("status") == "matched", F.concat(F.lit("breaks "), F.coalesce(F.nullif(clauses, F.lit("")), F.lit("a rule")))).when(F.col("status") == "needs_review", F.lit("to be reviewed")).otherwise(F.lit("no verdict"))
    line = F.concat(F.lit("["), F.upper("risk_level"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" — "), F.coalesce("target", F.lit("")), F.lit(": "), told)
    return merged.select(_place().alias("ord"), line.alias("line"))


def file_lines(files: DataFrame) -> DataFrame:
    """(path, line): what a console shows of each extracted file, and whether the list was cut short."""
    line = F.concat(F.lit("["), F.upper(F.coalesce("severity", F.lit("info"))), F.lit("] "), F.col("extracted_path"), F.lit(" ("), F.col("size_bytes").cast("string"), F.lit(" bytes)"), F.when(F.col("truncated"), F.lit(" (more files were not looked at)")).otherwise(F.lit("")))
    return files.select("path", line.alias("line"))


def write_markdown(blocks: DataFrame, path: str) -> None:
    """Report text, a folder a target, its lines in order; a target of any size is written by many tasks."""
    document.write_texts(blocks, path)
