"""Ordered documents from many tasks, and citations by a hash join."""

import itertools
import json
import random

from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import citations, document, report

WRITE = "seq long, title string, n int"


def test_findings_are_one_array(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b,\n]", "", None, "[", "]", "é "]), i % 3 or None) for i in range(300)]
    rng.shuffle(rows)
    path = str(tmp_path / "findings")
    report.write_findings(spark.createDataFrame(rows, WRITE).repartition(5), path)
    parts = document.parts(spark, path)
    assert len(parts) > 1
    whole = "".join(open(p).read() for p in parts)
    assert [tuple(f.values()) for f in json.loads(whole)] == sorted(rows)
    read = lambda at: sorted(map(tuple, document.read_array(spark, at, WRITE).collect()))
    assert read(path) == sorted(rows)
    document.assemble(spark, path, str(tmp_path / "findings.json"))
    assert json.loads((tmp_path / "findings.json").read_text()) == json.loads(whole) and not (tmp_path / "findings").exists()
    assert read(str(tmp_path / "findings.json")) == sorted(rows)


def test_arrays_of_none_one_and_equal_rows(spark, tmp_path):
    for n, rows in enumerate(([], [(1, "x", 1)], [(1, "x", 1)] * 50)):
        path = str(tmp_path / str(n))
        report.write_findings(spark.createDataFrame(rows, WRITE), path)
        document.assemble(spark, path, f"{path}.json")
        assert [tuple(f.values()) for f in json.loads(open(f"{path}.json").read())] == rows
        assert document.read_array(spark, f"{path}.json", WRITE).count() == len(rows)


def test_a_hot_target_is_written_by_many_tasks(spark, tmp_path):
    blocks = [("hot" if i % 10 else f"t{i}", i % 3, i, f"block {i}\nline") for i in range(2000)]
    random.Random(2).shuffle(blocks)
    path = str(tmp_path / "report")
    report.write_markdown(spark.createDataFrame(blocks, "target string, section int, ord long, text string"), path)
    assert len(document.parts(spark, f"{path}/target=hot")) > 3
    document.assemble(spark, f"{path}/target=hot", str(tmp_path / "hot.md"))
    want = [t for _, _, _, t in sorted((b for b in blocks if b[0] == "hot"), key=lambda b: b[1:3])]
    assert (tmp_path / "hot.md").read_text() == "".join(f"{t}\n" for t in want)


def test_console_lines(spark):
    merged = spark.createDataFrame([(1, "a", "h", "high", "matched", "IEC 1", "CRA 2"), (2, "b", None, "low", "needs_review", None, None), (3, None, "x", "info", "no_match", "", None), (4, "d", "y", "low", "matched", "", None)], "seq long, title string, target string, risk_level string, status string, iec_reference string, cra_reference string")
    assert [r.line for r in report.analysis_lines(merged).orderBy("ord").collect()] == ["[HIGH] a — h: breaks IEC 1; CRA 2", "[LOW] b — : to be reviewed", "[LOW] d — y: breaks a rule", "[INFO]  — x: no verdict"]
    files = spark.createDataFrame([("p", "etc/shadow", 7, "high", True), ("q", "x", 0, None, False)], "path string, extracted_path string, size_bytes long, severity string, truncated boolean")
    assert [r.line for r in report.file_lines(files).orderBy("path").collect()] == ["[HIGH] etc/shadow (7 bytes) (more files were not looked at)", "[INFO] x (0 bytes)"]


NUMBERS = ["cwe-1", "cwe-12", "article 5", "article 5(1)", "article 55", "annex i", "annex i part ii", "annex i part ii (3)", "annex ii", "iec 62443-4-2 cr 1.1", "cr 1.1", "cr 1.11", "cr 1.1 re(1)", "iec 62443-4-2", "iec 62443-4-2 ", "", "é", "éa", "é a", "iec 62443-4-1 sm-1", "sm-1"]


def test_keys_meet_where_one_number_covers_another(spark):
    pairs = spark.createDataFrame(list(itertools.product(NUMBERS, NUMBERS)), "c string, a string")
    told = pairs.select("c", "a", tx.matches(F.col("c"), F.col("a")).alias("want"), F.arrays_overlap(tx.cover_keys(F.col("c"), True), tx.cover_keys(F.col("a"), False)).alias("got"))
    assert [r for r in told.collect() if r.want != r.got] == []


def test_one_whitelist_for_all_texts(spark):
    texts = spark.createDataFrame([(1, "see CWE-7 and Article 3, CWE-7"), (2, "Article 9 and CR 1.1"), (3, None), (4, "nothing")], "id long, answer string")
    allowed = spark.createDataFrame([(f"CWE-{i}",) for i in range(500)] + [("Article 9(1)",), ("IEC 62443-4-2 CR 1.1",), (None,), ("",)], "number string")
    found = citations.unsupported(citations.cited(texts, "id", "answer"), allowed, [])
    assert [(r.id, r.cite) for r in found.collect()] == [(1, "Article 3")]


def test_clause_texts_are_cut_before_they_are_joined(spark):
    """A long text is cut once a clause, not once for each of the rows that refer to it."""
    from gleaner.operators import context

    index = spark.createDataFrame([("article 1", " x" * 5000), ("article 2", "short")], "clause string, body string")
    rows = spark.createDataFrame([(1, "Article 1"), (2, "Article  2"), (3, "Article 3"), (4, None)], "id int, ref string")
    found = context.with_clause_text(rows, index, F.col("ref"))
    want = {1: (" x" * 5000).strip()[:4000].rstrip() + "……", 2: "short", 3: "", 4: ""}
    assert {r.id: r.clause_text for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.index("Join")]
    assert "4000" not in joined and "4000" in plan
