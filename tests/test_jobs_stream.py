"""Job states as a stream against the batch form, over shuffled, repeated and missing events."""

import datetime as dt
import random

from gleaner.streaming import jobs

START = dt.datetime(2024, 5, 1, 12, 0, 0)


def events(seed, n=30):
    rng, out = random.Random(seed), []

    def add(job, kind, stage, status, second, submitted=(None, None, None, None)):
        out.append((job, kind, stage, status, START + dt.timedelta(seconds=second), *submitted))

    for k in range(n):
        job = f"j{k}"
        if k % 7:
            add(job, "submitted", None, None, k, (rng.choice(["10.0.0.1", "", None]), rng.choice(["f.bin", None]), rng.choice(["http://a", ""]), rng.choice([True, False, None])))
        for stage in (*jobs.NAMES, "unknown"):
            for status in jobs.ORDER[: rng.randrange(4)]:
                add(job, "stage", stage, status, k + rng.randrange(100))
        if k % 5 == 0:
            add(job, "failed", None, None, k + 50)
    out += rng.sample(out, len(out) // 3)
    rng.shuffle(out)
    return out


def run(spark, tmp_path, batches, timeout_s):
    """The last state of each stage after all batches."""
    folder = tmp_path / "events"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, jobs.EVENT).coalesce(1).write.mode("append").json(str(folder / f"{i:03d}"))
    last = {}

    def keep(frame, _):
        for r in frame.collect():
            last[r.job_id, r.stage] = r.status

    source = spark.readStream.schema(jobs.EVENT).option("maxFilesPerTrigger", 1).json(str(folder / "*"))
    query = jobs.stream(source, timeout_s, "1 hour").writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return last


def test_stream_equals_batch(spark, tmp_path):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rows = events(1)
        # An hour of events may be late; a last event far ahead lets every timer run out.
        far = [("far", "submitted", None, None, START + dt.timedelta(days=2), "10.0.0.1", None, None, None)]
        got = run(spark, tmp_path, [rows[:60], rows[60:], far, [("later", "stage", "ports", "done", START + dt.timedelta(days=2), None, None, None, None)]], 3600 * 6)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    batch = jobs.states(spark.createDataFrame(rows + far, jobs.EVENT), 3600 * 6, str(START + dt.timedelta(days=1, hours=23)))
    want = {(r.job_id, r.stage): r.status for r in batch.collect()}
    assert got == want
    # Those that were never submitted have no state; nobody is pending but the last one.
    assert ("j7", "ports") not in got and {s for (j, _), s in got.items() if j != "far"} == {"skipped", "done", "error"} and got["far", "ports"] == "pending"


def test_batch_without_timeout(spark):
    rows = spark.createDataFrame([("a", "submitted", None, None, START, "ip", None, None, True), ("a", "stage", "ports", "done", START, None, None, None, None), ("a", "stage", "ports", "running", START, None, None, None, None), ("a", "stage", "firmware", "done", START, None, None, None, None), ("b", "stage", "ports", "done", START, None, None, None, None)], jobs.EVENT)
    got = {r.stage: r.status for r in jobs.states(rows).collect()}
    assert got == {"ports": "done", "firmware": "skipped", "web": "skipped", "analysis": "pending", "report": "pending"}
    assert {r.stage: r.status for r in jobs.states(rows.unionByName(spark.createDataFrame([("a", "failed", None, None, START, None, None, None, None)], jobs.EVENT))).collect()} == {**got, "analysis": "error", "report": "error"}
    assert jobs.states(rows.limit(0)).count() == 0
