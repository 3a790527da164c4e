from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_models_and_benchmark import brute_hits
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        assert docs.columns == COLUMNS + ["shard", "slot"] * (k == 4), name
        ids, were = [r.doc_id for r in after], {r.doc_id: r for r in before}
        assert all(tuple(r)[:5] == tuple(were[r.doc_id]) for r in after)
        if k == 0:
            lost = [truth[i] for i in were if i in truth and i not in set(ids)]
            assert sum(lost) <= 0.02 * len(truth) and sum(truth[i] == 0 for i in ids if i in truth) <= 0.03 * len(truth) and lost
        elif k == 1:
            want = brute([(r.doc_id, r.text) for r in before])
            assert sorted(ids) == sorted(i for i, (n, root) in want.items() if not n or i == root)
        elif k == 2:
            want = brute_hits([r.text for r in before], items)
            assert sorted(ids) == sorted(r.doc_id for r, w in zip(before, want, strict=True) if not w[1])
        elif k == 3:
            assert max(Counter(ids).values()) <= 3
        else:
            assert sorted(ids) == sorted(r.doc_id for r in before)
            counts = Counter(r.shard for r in after)
            assert max(counts.values()) - min(counts.values()) <= 1
            assert {(r.shard, r.slot) for r in after} == {(s, i) for s, n in counts.items() for i in range(n)}
        before = after
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in before)


def test_stages_on_odd_tables(spark, tmp_path):
    some = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    good = some[3][1] or some[4][1]
    odd = [(None, None, None, None, None), (None, good, "en", None, 1), (1, "", "en", "a", 0), (2, None, None, "a", None), (3, "word " * 60_000, "en", "b", 1), (4, "x" * 300_000, "en", None, 1)]
    rows = some + odd + [some[5]] * 3 + [(some[5][0], some[5][1], "zz", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "n_hit", "items", "class", "id", "text_key", "component", "draw", "size", "copies", "bucket", "shard", "slot", "first", "cell"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    docs = docs.withColumns({"a.b": F.lit(1.5), "x`y": F.lit(2), "n o": F.lit("z"), "doc_id.text": F.array(F.lit(1))})
    docs = docs.withColumn("m", F.create_map(F.lit("k"), F.col("n_chars"), F.lit("l"), F.lit(1).cast("long"))).withColumn("deep", F.struct(F.array(F.create_map(F.lit(1), F.lit("v"))).alias("in")))
    first, told = docs, [c for c in docs.columns if c not in ("m", "deep")]

    def plain(df):
        return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in told], F.to_json("m").alias("m"), F.to_json("deep").alias("deep"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        assert after.columns == docs.columns + ["_shard", "_slot"] * (k == 4), name
        assert [t for _, t in after.dtypes][: len(docs.columns)] == [t for _, t in docs.dtypes], name
        assert plain(after).exceptAll(plain(docs)).isEmpty() or k == 3, name
        assert plain(after).subtract(plain(docs)).isEmpty(), name
        assert stage(spark, first.limit(0), SF).isEmpty(), name
        docs = after
    assert docs.count() > 10 and docs.filter("slot = 'own slot'").count() == docs.count()


def test_reruns_agree(spark):
    runs = [sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()), key=str) for _ in range(2)]
    assert runs[0] == runs[1]
