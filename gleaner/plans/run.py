"""A whole run: from findings to verdicts, generated texts, test plan and report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import classify, merge, plan, producers, report, review
from gleaner.storage import keep


@dataclass(frozen=True)
class Run:
    """What a run made: all findings, the plan's rows, the report's blocks, the requirements of the process, and each stage's state."""

    merged: DataFrame
    plan: DataFrame
    blocks: DataFrame
    process: DataFrame
    stages: dict[str, str]


def run(
    findings: DataFrame,
    entries: DataFrame,
    stores: producers.Stores,
    ask: producers.Ask | None = None,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    clauses: DataFrame | None = None,
    process: DataFrame | None = None,
    progress: Callable[[str, str], None] | None = None,
) -> Run:
    """Classify findings, look up candidates, fill in generated texts, plan tests and lay out the report.

    ``findings`` has finding_id, seq, category, source, target, title, service, severity, alert_risk,
    cve_ids and detail; ``entries`` kb, pos, key, title, body, text and embedding; ``process`` the same
    for requirements of the process, with grp. Without findings all further stages are skipped. Each
    stage's rows are written once, and ``progress`` is told when one begins and ends.
    """
    stages: dict[str, str] = {}

    def tell(stage: str, state: str) -> None:
        stages[stage] = state
        if progress is not None:
            progress(stage, state)

    rows = classify.classify(findings)
    none, any_found = F.lit(None).cast("string"), not findings.isEmpty()
    tell("analysis", "running" if any_found else "skipped")
    product, version = (F.get_json_object("detail", f"$.{name}") for name in ("product", "version"))
    rows = rows.withColumn("query", classify.retrieval_text(F.col("category"), F.col("service"), F.col("title"), F.coalesce(product, F.lit("")), F.coalesce(version, F.lit(""))))
    looked_up = keep(review.with_candidates(rows, entries, embed))
    merged = keep(producers.first_wave(looked_up, stores, ask, clauses).withColumn("state", none))
    planned = keep(producers.test_plan(merged, stores, ask).join(merged.select("finding_id", "seq"), "finding_id"))
    if process is None:
        needed = merged.select(F.lit(None).cast("string").alias("query_id"), F.lit(None).cast("string").alias("text")).limit(0)
    else:
        query = merge.process_query(findings.withColumn("run", F.lit("run")), "run").withColumnRenamed("run", "query_id")
        needed = report.process_blocks(review.process_requirements(query, process, embed).withColumn("score", F.col("dense_score")))
    if any_found:
        tell("analysis", "done")
    tell("report", "running" if any_found else "skipped")
    blocks = keep(report.sections(merged))
    if any_found:
        tell("report", "done")
    return Run(merged, planned, blocks, needed, stages)


def write(made: Run, path: str) -> dict[str, str]:
    """The run's tables below ``path``: findings as one JSON array, the report and the plan as Markdown by target."""
    places = {name: f"{path}/{name}" for name in ("findings", "report", "plan")}
    report.write_findings(made.merged, places["findings"])
    report.write_markdown(made.blocks, places["report"])
    tests = plan.plan_blocks(made.plan).withColumn("section", F.lit(0))
    report.write_markdown(tests, places["plan"])
    return places
