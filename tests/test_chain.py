"""Generated texts asked once, the run from findings to report, and clauses over ranges of lines."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from gleaner.operators import document, producers, prompts, report, segments
from gleaner.plans import run as whole

CANDIDATE = "struct<key:string,title:string,text:string,score:double,matched_by:array<string>,text_zh:string>"
REVIEWED = f"finding_id string, seq long, category string, source string, target string, title string, service string, severity string, detail string, status string, risk_level string, weakness_reason string, recommendation string, cra_reference string, iec_reference string, rag struct<cwe:array<{CANDIDATE}>,iec:array<{CANDIDATE}>,cra:array<{CANDIDATE}>>, state string"
RULE = ("matched", "high", "clear text", "turn it off", "CRA Annex I Part I(2)(e) — data", "IEC 62443-4-2 CR 4.1")
NONE = ([], [], [])


def reviewed(spark):
    candidate = lambda key: [(key, f"title {key}", "text", 0.5, ["dense"], None)]
    rows = [
        ("f1", 1, "network", "ports", "10.0.0.1", "Telnet", "telnet", "high", '{"port": 23}', *RULE, NONE, None),
        ("f2", 2, "network", "ports", "10.0.0.2", "Telnet", "telnet", "high", '{"port": 2323}', *RULE, NONE, None),
        ("f3", 3, "webapp", "web", "http://a", "Odd header", None, "low", None, "needs_review", "low", None, None, None, None, (candidate("CWE-1"), candidate("IEC 62443-4-2 CR 1.1"), []), None),
        ("f4", 4, "webapp", "web", "http://b", "Odd header", None, "low", None, "needs_review", "low", None, None, None, None, (candidate("CWE-1"), candidate("IEC 62443-4-2 CR 1.1"), []), None),
        ("f5", 5, "firmware", "image", "f.bin", "Blob", None, "info", None, "needs_review", "info", None, None, None, None, NONE, None),
        ("f6", 6, "network", "ports", "10.0.0.1", "FTP", "ftp", "high", None, "matched", "high", "why", "fix", None, None, NONE, None),
    ]
    return spark.createDataFrame(rows, REVIEWED)


class Writer:
    """Stands in for a language model; each prompt it gets is a line of a file, as it runs in tasks."""

    def __init__(self, path, answer):
        self.path, self.answer = path, answer

    def __call__(self, prompt):
        with open(self.path, "a") as f:
            f.write(json.dumps(prompt) + "\n")
        return self.answer(prompt)

    def asked(self):
        return [json.loads(x) for x in open(self.path)] if self.path.exists() else []


def good(prompt):
    return "【弱點名稱】 n 【弱點原因】r【修補建議】f, see CR 4.1"


def test_prompts_are_made_of_one_finding_a_kind(spark, tmp_path):
    rows = reviewed(spark).withColumn("rag", F.when(F.col("status") == "needs_review", F.col("rag")))
    many = rows.join(spark.range(20), how="cross").withColumn("finding_id", F.concat("finding_id", F.lpad(F.col("id").cast("string"), 2, "0"))).drop("id")
    assert sorted(r.finding_id for r in producers.kinds(many).collect()) == ["f100", "f200", "f300", "f400", "f500", "f600"]
    made = lambda rows: {(r.producer, r.cache_key, r.prompt) for r in producers.requests(rows).collect()}
    assert made(producers.kinds(many)) == made(many)
    stores = producers.open_stores(spark, str(tmp_path / "s"), 2)
    producers.fill(producers.requests(producers.kinds(many)), stores, good)
    bare = many.withColumn("rag", producers.without_texts(F.col("rag")))
    assert bare.filter(F.exists("rag.cwe", lambda c: c["text"].isNotNull())).isEmpty() and not bare.filter("rag IS NULL AND status = 'needs_review'").count()
    told = lambda rows: {r.finding_id: (r.recommendation, r.weakness_name, r.summary, r.rag and [c.text_zh for c in (r.rag.cwe or []) + (r.rag.iec or [])]) for r in producers.first_wave(rows, stores, None).collect()}
    assert told(bare) == told(many) and len(told(many)) == 120


def test_second_run_asks_nothing(spark, tmp_path):
    stores, writer = producers.open_stores(spark, str(tmp_path / "s"), 2), Writer(tmp_path / "asked", good)
    got = {r.finding_id: r for r in producers.first_wave(reviewed(spark), stores, writer).collect()}
    # f1 and f2 share advice and name, f3 and f4 both candidates and the summary; f5 has a summary, f6 a name.
    assert len(writer.asked()) == 7 and len(set(writer.asked())) == 7
    assert got["f1"].recommendation == got["f2"].recommendation == good("") and got["f1"].recommendation_source == "llm"
    assert (got["f6"].recommendation, got["f6"].recommendation_source, got["f6"].weakness_name) == ("fix", "rule", good(""))
    assert got["f3"].rag.cwe[0].text_zh == got["f4"].rag.iec[0].text_zh == good("") and got["f3"].summary.weakness_name == "n" and got["f5"].summary.remediation == "f, see CR 4.1"
    assert got["f3"].weakness_name is None and got["f1"].summary is None
    again = {r.finding_id: r for r in producers.first_wave(reviewed(spark), stores, writer).collect()}
    assert again == got and len(writer.asked()) == 7
    assert {r.finding_id: r for r in producers.first_wave(reviewed(spark), stores, None).collect()} == got
    plans = producers.test_plan(producers.first_wave(reviewed(spark), stores, None), stores, lambda p: "an aim").collect()
    assert {r.finding_id: (r.objective, r.objective_from_llm) for r in plans} == {f: ("an aim", True) for f in ("f1", "f2", "f3", "f4", "f6")}


def test_what_fails_is_kept_apart_and_asked_for_again(spark, tmp_path):
    stores = producers.open_stores(spark, str(tmp_path / "s"), 2)

    def bad(prompt):
        if "Component requirement" in prompt:
            return "see CWE-99"
        if "# Candidate weakness" in prompt:
            return "no sections"
        if "# What was found" in prompt:
            raise ValueError("down")
        return None

    writer = Writer(tmp_path / "asked", bad)
    rows = {r.finding_id: r for r in producers.first_wave(reviewed(spark), stores, writer).collect()}
    assert rows["f1"].recommendation == "turn it off" and rows["f1"].recommendation_source == "rule" and rows["f1"].weakness_name is None and rows["f3"].summary is None
    failed = {(r.producer, r.reason, r.tries) for r in stores.failures.snapshot().collect()}
    assert failed == {("rule", "cites CWE-99", 1), ("summary", "a section lacks", 1), ("name", "ValueError: down", 2), ("cwe", "no answer", 2), ("iec", "no answer", 2)}
    assert stores.answers.snapshot().count() == 0 and stores.leases.snapshot().count() == 0
    assert producers.first_wave(reviewed(spark), stores, good).filter("recommendation_source = 'llm'").count() == 2
    assert stores.failures.snapshot().count() == 0


def test_runs_at_the_same_time_ask_for_different_texts(spark, tmp_path):
    stores, writer = producers.open_stores(spark, str(tmp_path / "s"), 2), Writer(tmp_path / "asked", good)
    wanted = producers.requests(reviewed(spark))
    leased = wanted.filter("producer IN ('rule', 'summary')").select("producer", "cache_key").distinct()
    stores.leases.insert(leased.withColumns({"owner": F.lit("other"), "until": F.lit(time.time() + 600)}), F.col("until") < time.time())
    producers.fill(wanted, stores, writer)
    assert {r.producer for r in stores.answers.snapshot().collect()} == {"cwe", "iec", "name"} and len(writer.asked()) == 4
    # The other run died; its lease ends.
    stores.leases.upsert(leased.withColumns({"owner": F.lit("other"), "until": F.lit(time.time() - 1)}))
    producers.fill(wanted, stores, writer)
    assert len(writer.asked()) == 7 and stores.leases.snapshot().count() == 0
    producers.fill(wanted.limit(0), stores, writer)
    assert len(writer.asked()) == 7


def test_clause_blocks(spark):
    rows = [("CRA Annex II — the note", "body"), ("Article 5", None), ("Article 5", ""), (None, "x"), ("", None)]
    block = prompts.clause_block("Head", F.col("r"), F.col("t")).alias("b")
    got = [r.b for r in spark.createDataFrame(rows, "r string, t string").select(block).collect()]
    assert got[0] == "# Head\nCRA Annex II\n(the report says: the note)\n\nText:\nbody"
    assert got[1] == got[2] == f"# Head\nArticle 5\n\n{prompts.NO_CLAUSE_TEXT}"
    assert got[3] == got[4] == f"# Head\n{prompts.NO_CLAUSE}"


def test_clause_texts_go_into_prompts(spark):
    clauses = spark.createDataFrame([("annex i part i(2)(e)", "the annex"), ("iec 62443-4-2 cr 4.1", "the requirement")], "clause string, body string")
    asked = producers.requests(reviewed(spark), clauses).filter("producer = 'rule'").collect()
    assert len(asked) == 2 and all("the annex" in r.prompt and "the requirement" in r.prompt and "the report says: data" in r.prompt for r in asked)
    assert asked[0].allowed == ["iec 62443-4-2 cr 4.1", "annex i part i(2)(e)"]


def test_a_run_from_findings_to_report(spark, tmp_path):
    findings = spark.createDataFrame(
        [("a", 1, "network", "ports", "10.0.0.1", "23/tcp", "telnet", "high", None, [], '{"product": "inetd"}'), ("b", 2, "webapp", "web", "http://a", "Cookie without flag", None, "low", "medium", [], None), ("c", 3, "firmware", "image", "f.bin", "blob", None, "info", None, ["CVE-1"], "{}")],
        "finding_id string, seq long, category string, source string, target string, title string, service string, severity string, alert_risk string, cve_ids array<string>, detail string",
    )
    kb = [(name, i, f"{name}-{i}", f"t{i}", f"body {i}", f"cookie flag {name} {i}" if i == 2 else f"other {i}", None) for name in ("cwe", "iec", "cra") for i in range(4)]
    entries = spark.createDataFrame(kb, "kb string, pos long, key string, title string, body string, text string, embedding array<double>")
    process = entries.filter("kb = 'iec'").withColumn("grp", F.lit("practice"))
    seen = []
    stores = producers.open_stores(spark, str(tmp_path / "s"), 2)
    made = whole.run(findings, entries, stores, good, None, None, process, lambda *state: seen.append(state))
    rows = {r.finding_id: r for r in made.merged.collect()}
    assert rows["a"].status == "matched" and rows["a"].recommendation_source == "llm" and rows["c"].status == "matched"
    assert [rows["b"].rag[kb][0].key for kb in ("cwe", "iec", "cra")] == ["cwe-2", "iec-2", "cra-2"] and rows["b"].rag.cra[0].text_zh == good("")
    assert {r.finding_id: r.objective for r in made.plan.collect()} == {"a": good(""), "b": good("")}
    assert seen == [("analysis", "running"), ("analysis", "done"), ("report", "running"), ("report", "done")] and made.stages == {"analysis": "done", "report": "done"}
    assert sorted((r.target, r.section) for r in made.blocks.collect()) == [("10.0.0.1", 0), ("10.0.0.1", 1), ("f.bin", 0), ("f.bin", 1), ("http://a", 0), ("http://a", 2)]
    assert "iec-0 t0, practice" in made.process.first().text
    places = whole.write(made, str(tmp_path / "out"))
    document.assemble(spark, places["findings"], str(tmp_path / "findings.json"))
    assert [f["finding_id"] for f in json.loads((tmp_path / "findings.json").read_text())] == ["a", "b", "c"]
    assert spark.read.text(f"{places['report']}/target=10.0.0.1").count() > 2
    nothing = whole.run(findings.limit(0), entries, stores, good)
    assert nothing.merged.count() == nothing.plan.count() == nothing.blocks.count() == nothing.process.count() == 0 and nothing.stages == {"analysis": "skipped", "report": "skipped"}


def test_sections_of_findings_without_analysis(spark):
    rows = reviewed(spark).withColumns({"status": F.lit("no_match"), "summary": F.lit(None).cast("struct<weakness_name:string,weakness_reason:string,remediation:string>"), "recommendation_source": F.lit(None).cast("string"), "weakness_name": F.lit(None).cast("string")})
    assert {r.section for r in report.sections(rows).collect()} == {0}


def plain_clauses(lines):
    """One pass over a document's lines."""
    group, head, field, clause, out = None, None, None, 0, []
    for n, line in lines:
        if line.startswith("4 FR"):
            group = line[2:]
        elif line.startswith("5.1 CR"):
            clause, head, field = clause + 1, (line[4:10], line[13:], group or ""), "requirement"
        elif line.startswith("5.1 S"):
            field = "security_levels"
        elif line.startswith("5.1 R"):
            field = "rationale"
        elif clause:
            out.append((clause, *head, field, n, line))
    return out


@pytest.mark.parametrize(("size", "parts"), [(4000, 8), (40, 13), (3, 8)])
def test_clauses_of_a_document_over_many_ranges(spark, size, parts):
    rng = random.Random(size)
    docs = {}
    for doc in ("long", None, "short"):
        kinds = ["4 FR 1 – Group {}", "5.1 CR 1.{} – Title {}", "5.1 Security levels", "5.1 Rationale and supplemental guidance", *["words {}"] * 16]
        docs[doc] = [(n, rng.choice(kinds).format(n % 10, n)) for n in range(size if doc == "long" else 30)]
    rows = [(doc, n, line) for doc, lines in docs.items() for n, line in lines]
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = segments.clause_lines(spark.createDataFrame(rows, "doc_id string, n long, line string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for doc, lines in docs.items():
        own = sorted((r.n, r.clause, r.clause_id, r.title, r.group, r.field, r.line) for r in got if r.doc_id == doc)
        assert own == [(n, c, i, t, g, f, x) for c, i, t, g, f, n, x in plain_clauses(lines)]
    # A clause that is cut by a range's border is one clause.
    assert segments.clauses(spark.createDataFrame([], "doc_id string, n long, line string")).count() == 0
