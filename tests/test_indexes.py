"""The stored inverted index and the pruned vector search against plain Python."""

import math
import pickle
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleaner import storage
from gleaner.operators import index, retrieval, vectors


def plain_bm25(entries, queries, k):
    """(query, kb, pos, rank) by scoring every pair."""
    out = []
    tokens = {(kb, pos): Counter(re.findall("[a-z0-9]+", (text or "").lower())) for kb, pos, text in entries}
    for kb in {e[0] for e in entries}:
        own = {pos: c for (name, pos), c in tokens.items() if name == kb}
        n, mean = len(own), sum(c.total() for c in own.values()) / len(own) or 1.0
        df = Counter(t for c in own.values() for t in c)
        raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
        floor = 0.25 * sum(raw.values()) / len(raw) if raw else 0.0
        idf = {t: floor if x < 0 else x for t, x in raw.items()}
        for q, text in queries:
            asked = Counter(re.findall("[a-z0-9]+", (text or "").lower()))
            score = {pos: sum(m * idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for t, m in asked.items() if t in c) for pos, c in own.items()}
            best = sorted(score, key=lambda pos: (-round(score[pos], 9), pos))[:k]
            out += [(q, kb, pos, i + 1) for i, pos in enumerate(best)]
    return sorted(out, key=str)


def zipf_text(rng, words, n):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), words)}" for _ in range(n))


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(index, "RANGE_ENTRIES", 40)
    monkeypatch.setattr(index, "BLOCK_ENTRIES", 8)


def corpus(seed, n=600):
    rng = random.Random(seed)
    entries = [(rng.choice(["a", "b", None]), i, rng.choice([None, "", "!?", *[zipf_text(rng, 400, rng.randrange(1, 40)) for _ in range(9)]])) for i in range(n)]
    queries = [(i, rng.choice(["", None, "w1", "nothing", *[zipf_text(rng, 400, rng.randrange(1, 25)) for _ in range(8)]])) for i in range(60)]
    return entries, queries


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_scoring_every_pair(spark, tmp_path, seed):
    entries, queries = corpus(seed)
    docs = spark.createDataFrame(entries, "kb string, pos long, text string").repartition(5)
    asked = spark.createDataFrame(queries, "query_id long, query string")
    stored = index.build(docs).write(str(tmp_path / "index"))
    want = plain_bm25(entries, queries, 4)
    for block in (4096, 7):
        got = retrieval.search_topk(asked, stored, k=4, block=block).collect()
        assert sorted(((r.query_id, r.kb, r.pos, r.sparse_rank) for r in got), key=str) == want
    assert "text" not in stored.ranges.columns


def searcher_over(entries, queries, k, starts):
    """One task's search over the ranges of entries of one knowledge base, in the given order of ranges."""
    import pyarrow as pa

    counts = [Counter(re.findall("[a-z0-9]+", text)) for _, text in entries]
    mean = sum(c.total() for c in counts) / len(counts)
    df = Counter(t for c in counts for t in c)
    block = index.Block([(i, re.findall("[a-z0-9]+", text)) for i, text in enumerate(queries)])
    block.idf["k"] = np.array([abs(math.log(len(entries) - df[t] + 0.5) - math.log(df[t] + 0.5)) if t in df else 0.0 for t in block.names])
    found = index.Searcher(block, k)
    for at in starts:
        rows = pa.RecordBatch.from_arrays([pa.array(["k"] * 40), pa.array([p for p, _ in entries[at : at + 40]], pa.int64()), pa.array([t for _, t in entries[at : at + 40]])], ["kb", "pos", "text"])
        one = index._range(rows, counts[at : at + 40], mean)
        keys, terms, begin, of, worth, maxima = (one.column(c)[0].values for c in range(1, 7))
        found.add("k", keys.to_numpy(), terms, *[x.to_numpy() for x in (begin, of, worth, maxima)])
    scores = {}
    for i, text in enumerate(queries):
        asked = Counter(re.findall("[a-z0-9]+", text))
        own = {p: sum(m * block.idf["k"][block.names.index(t)] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for t, m in asked.items() if t in c) for (p, _), c in zip(entries, counts, strict=True)}
        scores[i] = sorted(own, key=lambda p: (-round(own[p], 9), p))[:k]
    return found, scores


@pytest.mark.parametrize("backwards", [False, True])
def test_block_maxima_spare_scores(small_ranges, backwards):
    rng = random.Random(3)
    entries = [(i, zipf_text(rng, 3000, 12) + (f" rare{i // 30}" * 3 if i % 30 == 0 else "")) for i in range(800)]
    queries = [f"rare{i} w2" for i in range(20)] + ["w1", "unknown", "rare1 rare2 rare3"]
    starts = list(range(0, 800, 40))
    found, want = searcher_over(entries, queries, 2, starts[::-1] if backwards else starts)
    best = found.best["k"]
    assert {i: best.keys[:, i].tolist() for i in want} == want
    assert found.scored < 0.7 * found.passed


def test_scores_are_held_in_bounded_parts(small_ranges, monkeypatch):
    """Neither the scores of a range nor the pairs of its terms with queries grow with the queries of a block."""
    rng = random.Random(5)
    entries = [(i, zipf_text(rng, 300, 30)) for i in range(400)]
    queries = [zipf_text(rng, 300, 20) for _ in range(200)]
    monkeypatch.setattr(index, "SCORE_CELLS", 1000)
    monkeypatch.setattr(index, "PAIRS", 500)
    sizes, pairs, add, add_pairs = [], [], index.Best.add, index.Block._add_pairs
    monkeypatch.setattr(index.Best, "add", lambda self, scores, *args: (sizes.append(scores.size), add(self, scores, *args))[1])
    monkeypatch.setattr(index.Block, "_add_pairs", lambda self, scores, row, term, value, count, to: (pairs.append(count.sum()), add_pairs(self, scores, row, term, value, count, to))[1])
    found, want = searcher_over(entries, queries, 4, list(range(0, 400, 40)))
    best = found.best["k"]
    assert {i: best.keys[:, i].tolist() for i in want} == want
    assert max(sizes) <= 1000 and max(pairs) <= 500 + 200


def test_row_groups_of_an_index_hold_few_ranges(spark, tmp_path):
    """Readers and writers of Parquet hold a row group, and a range is some megabytes large."""
    docs = spark.range(300).select(F.col("id").cast("string").alias("kb"), F.col("id").alias("pos"), F.lit("a b").alias("text")).coalesce(1)
    index.build(docs).write(str(tmp_path / "index"))
    (ranges,) = (tmp_path / "index" / "ranges").glob("*.parquet")
    told = pq.ParquetFile(ranges).metadata
    assert told.num_rows == 300 and max(told.row_group(i).num_rows for i in range(told.num_row_groups)) <= 8
    parts = vectors.build(spark.range(20_000).select(F.col("id").alias("pos"), F.array(F.sin("id"), F.cos("id")).alias("embedding")).coalesce(1)).write(str(tmp_path / "vectors")).cells
    (cells,) = (tmp_path / "vectors" / "cells").glob("*.parquet")
    told = pq.ParquetFile(cells).metadata
    assert told.num_rows == parts.count() > 64 >= max(told.row_group(i).num_rows for i in range(told.num_row_groups))


def test_a_range_is_a_row_of_few_megabytes():
    import pyarrow as pa

    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(20_000)}" for _ in range(400)) for _ in range(1000)]
    rows = pa.RecordBatch.from_arrays([pa.array(["k"] * 1000), pa.array(range(1000), pa.int64()), pa.array(texts)], ["kb", "pos", "text"])
    made = list(index._ranges(rows, 400.0))
    assert max(r.nbytes for r in made) <= 3 << 20
    assert [k for r in made for k in r.column(1)[0].as_py()] == list(range(1000))
    assert sum(len(r.column(4)[0]) for r in made) == sum(len(set(t.split())) for t in texts)


def full_ranges(spark, path):
    """The stored index of texts that fill some ranges."""
    word = lambda i: F.concat(F.lit("w"), F.pmod(F.hash("id", i), F.lit(20_000)).cast("string"))
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(400)), word))
    docs = spark.range(2500).select(F.lit("k").alias("kb"), F.col("id").alias("pos"), text.alias("text")).coalesce(1)
    return index.build(docs).write(str(path))


def test_a_row_group_of_full_ranges_is_a_few_megabytes(spark, tmp_path):
    """Each of its columns is one page, whose codec takes buffers of that size outside of the heap."""
    stored = full_ranges(spark, tmp_path / "index")
    (ranges,) = (tmp_path / "index" / "ranges").glob("*.parquet")
    told = pq.ParquetFile(ranges).metadata
    groups = [told.row_group(i) for i in range(told.num_row_groups)]
    assert told.num_rows >= 8 and max(g.num_rows for g in groups) <= 2 and max(g.total_byte_size for g in groups) <= 6 << 20
    assert stored.ranges.select(F.sum(F.size("pos"))).first()[0] == 2500


def test_terms_of_a_block_come_to_spark_as_arrow(spark, monkeypatch):
    """Rows of Python objects would start Python workers of a second kind beside those of the search."""
    import pyarrow as pa

    docs = spark.createDataFrame([("k", 1, "a b"), ("k", 2, "b c")], "kb string, pos long, text string")
    asked = spark.createDataFrame([(1, "c a")], "query_id long, query string")
    kept, given, create = index.build(docs).keep(), [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *args, **named: (given.append(type(data)), create(self, data, *args, **named))[1])
    assert [r.pos for r in retrieval.search_topk(asked, kept, k=1).collect()] == [1]
    assert given and set(given) == {pa.Table}


def test_full_ranges_come_to_a_search_one_at_a_time(spark, tmp_path):
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    stored = full_ranges(spark, tmp_path / "index")
    with storage.small_batches(spark):
        assert max(r.n for r in stored.ranges.mapInArrow(sizes, "n long").collect()) <= 4 << 20


def test_a_search_holds_few_arrays_of_scores_and_pairs():
    """What a range of some hundred long entries takes for a block of some thousand long queries."""
    import pyarrow as pa

    rng = random.Random(6)
    texts = [(i, zipf_text(rng, 20_000, 400)) for i in range(500)]
    block = index.Block([(i, [f"w{min(int(rng.paretovariate(0.7)), 20_000)}" for _ in range(150)]) for i in range(3000)])
    block.idf["k"] = np.ones(len(block.names))
    one = index._range(pa.RecordBatch.from_arrays([pa.array(["k"] * 500), pa.array(range(500), pa.int64()), pa.array([t for _, t in texts])], ["kb", "pos", "text"]), [Counter(t.split()) for _, t in texts], 400.0)
    keys, terms, begin, of, worth, maxima = (one.column(c)[0].values for c in range(1, 7))
    found = index.Searcher(block, 10)
    tracemalloc.start()
    found.add("k", keys.to_numpy(), terms, *[x.to_numpy() for x in (begin, of, worth, maxima)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak <= 32 << 20 and found.best["k"].full()


def test_a_task_holds_few_copies_of_a_block_and_of_scores():
    """Each Python worker holds a block, and beside the scores of a part little else once the k best are held."""
    rng = random.Random(7)
    block = index.Block([(i, [f"w{min(int(rng.paretovariate(0.5)), 50_000)}" for _ in range(150)]) for i in range(1000)])
    pairs = len(block.query)
    held = pickle.loads(pickle.dumps(block))
    assert len(pickle.dumps(block)) <= 8 * pairs + block.dense.nbytes + 8 * len(block.start) + 20 * len(block.names)
    assert [str(x) for x in held.names] == block.names and held.times.sum() == 150 * 1000
    best, scores = index.Best(10), np.random.default_rng(7).random((500, 1000))
    want = [sorted(range(500), key=lambda i: (-round(scores[i, q], 9), i))[:10] for q in range(1000)]
    best.add(scores[:250], np.arange(250))
    tracemalloc.start()
    for at in range(250, 500, 50):
        best.add(scores[at : at + 50], np.arange(at, at + 50))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert best.keys.T.tolist() == want
    # A part of 50 rows has 0.4 MB of scores.
    assert peak <= 1_600_000


def test_ties_and_late_columns_enter_the_best():
    """Equal scores go by key whichever part comes first, and only the named columns change."""
    rng = np.random.default_rng(8)
    scores = np.round(rng.random((400, 30)) * 4) / 4 - 0.5
    keys = np.array([f"k{i:03d}" for i in range(400)], object)
    best, want = index.Best(5), [sorted(range(400), key=lambda i: (-scores[i, q], i))[:5] for q in range(30)]
    for at in (200, 300, 0, 100):
        some = slice(at, at + 100)
        if at == 200:
            best.add(scores[some], keys[some])
        else:
            for columns in (np.arange(0, 30, 2), np.arange(1, 30, 2)):
                best.add(scores[some][:, columns], keys[some], columns)
    assert best.keys.T.tolist() == [[f"k{i:03d}" for i in own] for own in want]


def test_stored_rows_come_in_small_batches(spark, tmp_path):
    """While a search runs, not before or after it, Arrow batches are bounded by a few megabytes."""
    before, seen = spark.conf.get(storage.BATCH_BYTES), []

    def search(block):
        return spark.range(3).mapInArrow(lambda batches: batches, "id long"), spark.sparkContext.broadcast(block)

    def kept(df, *args, **options):
        seen.append(df.sparkSession.conf.get(storage.BATCH_BYTES))
        return storage.keep(df, *args, **options)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(index, "keep", kept)
        assert index.over_blocks(iter([[1]]), search).count() == 3
    assert seen == [storage.BATCH] and spark.conf.get(storage.BATCH_BYTES) == before


def test_best_keeps_order_at_large_scores():
    scores = np.zeros((10_000, 2))
    scores[5000, 0], scores[17, 0], scores[3:9, 1] = 2e6, 1e6, 5e6
    best = index.Best(2)
    best.add(scores, np.arange(10_000))
    assert best.keys.T.tolist() == [[5000, 17], [3, 4]]


def test_stored_index_is_written_once_and_again_for_new_files(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs = lambda n: spark.createDataFrame([("k", i, "a b") for i in range(n)], "kb string, pos long, text string")
    docs(3).write.parquet(path)
    builds = []

    def stored():
        entries = spark.read.parquet(path)
        name = f"index-test-{storage.stamp(spark, [path])}"
        return index.read(spark, storage.once(spark, name, lambda to: builds.append(to) or index.build(entries).write(to)))

    assert [stored().kbs.first()["n"] for _ in range(3)] == [3, 3, 3] and len(builds) == 1
    docs(5).write.mode("overwrite").parquet(path)
    assert stored().kbs.first()["n"] == 5 and len(builds) == 2


def test_a_failed_build_leaves_no_index(spark):
    def broken(path):
        spark.range(3).write.parquet(f"{path}/ranges")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        storage.once(spark, "index-broken", broken)
    assert storage.once(spark, "index-broken", lambda path: spark.range(4).write.parquet(path)).endswith("index-broken")
    assert spark.read.parquet(f"{storage.shared_dir(spark)}/index-broken").count() == 4


def plain_nearest(entries, queries, k):
    out = []
    for q, v in queries:
        if v is None:
            continue
        v = np.array(v, float)
        score = {}
        for pos, x in entries:
            if x is not None and len(x) == len(v) and np.linalg.norm(x) > 0:
                score[pos] = float(np.dot(v, x) / max(np.linalg.norm(v), 1e-300) / np.linalg.norm(x))
        best = sorted(score, key=lambda p: (-round(score[p], 9), p))[:k]
        out += [(q, p, i + 1) for i, p in enumerate(best)]
    return sorted(out)


def clustered(n, seed, dims=16, centres=20):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(centres, dims))
    return [[float(x) for x in centre[i % centres] * rng.uniform(0.5, 2) + rng.normal(size=dims) * 0.05] for i in range(n)]


def test_vectors_equal_comparing_every_pair(spark, tmp_path):
    near = clustered(900, 1)
    entries = [(i, v) for i, v in enumerate(near)] + [(2000 + i, near[5]) for i in range(40)] + [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0, 2.0]), (3004, [1.0, -2.0]), (3005, [0.0, 0.0])]
    queries = [(i, v) for i, v in enumerate(clustered(30, 2))] + [(100, near[5]), (101, [0.0] * 16), (102, None), (103, [1.0, 1.0]), (104, []), (105, [1.0] * 5), (106, [-x for x in near[7]])]
    docs = spark.createDataFrame(entries, "pos long, embedding array<double>").repartition(6)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    want = plain_nearest(entries, queries, 6)
    stored = vectors.build(docs).write(str(tmp_path / "vectors"))
    for block in (4096, 5):
        assert sorted((r.query_id, r.pos, r.dense_rank) for r in retrieval.nearest_topk(asked, stored, k=6, block=block).collect()) == want
    named = retrieval.dense_topk(asked, docs.withColumn("pos", F.format_string("%05d", "pos")), k=6).collect()
    assert sorted((r.query_id, int(r.pos), r.dense_rank) for r in named) == want
    assert retrieval.dense_topk(asked, docs.limit(0)).isEmpty()


def test_a_search_of_vectors_has_one_python_worker_a_task(spark):
    """Cells that are built for a search are stored before it reads them."""
    entries = spark.range(30).select(F.col("id").alias("pos"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    built = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(vectors, "search", lambda queries, index, k, query, *args: (built.append(index.cells), spark.createDataFrame([], f"{query} long, pos long, score double"))[1])
        retrieval.dense_topk(entries.withColumnRenamed("pos", "query_id"), entries)
    assert "MapInArrow" not in built[0]._jdf.queryExecution().toString() and built[0].select(F.sum(F.size("pos"))).first()[0] == 30


@pytest.mark.parametrize("n", [0, 30])
def test_a_sample_of_vectors_comes_to_spark_as_arrow(spark, tmp_path, monkeypatch, n):
    import pyarrow as pa

    entries = spark.range(n).select(F.col("id").alias("pos"), F.array(F.sin("id"), F.cos("id") + 1).alias("embedding"))
    built, given, create = vectors.build(entries), [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *args, **named: (given.append(type(data)), create(self, data, *args, **named))[1])
    stored = built.write(str(tmp_path / "vectors"))
    assert given == [pa.Table]
    assert {size: matrix.tolist() for size, matrix in stored.sample.items()} == {size: matrix.tolist() for size, matrix in built.sample.items()}


def test_vectors_of_a_length_outside_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SAMPLE", 3)
    entries = [(i, v) for i, v in enumerate(clustered(200, 3, dims=4))] + [(300, [1.0, 2.0]), (301, [2.0, 1.0])]
    queries = [(i, v) for i, v in enumerate(clustered(9, 4, dims=4))] + [(9, [1.0, 0.0])]
    docs = spark.createDataFrame(entries, "pos long, embedding array<double>")
    got = retrieval.dense_topk(spark.createDataFrame(queries, "query_id long, embedding array<double>"), docs, k=5).collect()
    assert sorted((r.query_id, r.pos, r.dense_rank) for r in got) == plain_nearest(entries, queries, 5)


def test_cells_spare_comparisons():
    import pyarrow as pa

    own = vectors.unit(np.array(clustered(4000, 5)))
    asked = [(i, v) for i, v in enumerate(clustered(50, 6)[:50])] + [(i + 50, v.tolist()) for i, v in enumerate(own[:50])]
    sample = own[::7]
    queries = vectors.Queries(asked, 3, sample)
    searcher = vectors.Searcher(queries, 3)
    for part in vectors._parts(16, pa.array(np.arange(len(own))), own, vectors.pivots_of(sample)):
        searcher.add(part.column(1)[0].as_py(), part.column(2)[0].as_py(), part.column(3)[0].as_py(), part.column(4)[0].values.to_numpy(), part.column(5)[0].values.to_numpy())
    ids, keys, _ = searcher.found()
    exact = np.rint((queries.matrix @ own.T) * 1e9)
    for q in range(len(asked)):
        want = np.lexsort((np.arange(len(own)), -exact[q]))[:3].tolist()
        assert [int(k) for i, k in zip(ids, keys, strict=True) if i == q] == want
    assert searcher.scored < 0.3 * searcher.passed


def test_an_index_reads_its_texts_once(spark, tmp_path):
    """Statistics and weights are sums over the stored ranges."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    entries, _ = corpus(4, 200)
    docs = spark.createDataFrame(entries, "kb string, pos long, text string")
    made = index.build(docs.mapInArrow(counted, docs.schema)).write(str(tmp_path / "index"))
    assert seen.value == 200
    want = retrieval.term_weights(retrieval.entry_counts(docs), retrieval.corpus_stats(docs))
    rounded = lambda rows: sorted((str(r.kb), r.term, r.df, round(r.idf, 9)) for r in rows.collect())
    assert rounded(made.terms) == rounded(want)
    assert sorted(map(str, made.kbs.select("kb", "n", "avgdl").collect())) == sorted(map(str, retrieval.corpus_stats(docs).collect()))


def test_tokens_of_texts_end_with_the_text():
    import pyarrow as pa

    texts = ["ab c1", "", "d", "é-x", "--", "9 9", "tail"]
    tokens, counts = index.tokens_of(pa.array(["skipped", *texts])[1:])
    assert tokens.to_pylist() == [t for x in texts for t in re.findall("[a-z0-9]+", x)] and counts.tolist() == [2, 0, 1, 1, 0, 2, 1]


def test_blocks_of_queries_with_few_terms_read_few_terms(spark, tmp_path, monkeypatch):
    """Many queries of a small vocabulary do not read a large index again for each block."""
    entries, queries = corpus(3)
    queries = [(q, text if q % 3 else "w1 w2 w2 w5") for q, text in queries]
    stored = index.build(spark.createDataFrame(entries, "kb string, pos long, text string").repartition(3)).write(str(tmp_path / "index"))
    asked = spark.createDataFrame(queries, "query_id long, query string")
    terms = {t for _, text in queries for t in re.findall("[a-z0-9]+", text or "")}
    few = index.narrowed(stored.ranges, asked.select(F.col("query").alias("text")))
    assert {t for r in few.select("terms").collect() for t in r.terms} <= terms and few.select(F.sum(F.size("pos"))).first()[0] == len(entries)
    monkeypatch.setattr(index, "QUERY_BLOCK", 16)
    got = retrieval.search_topk(asked, stored, k=4, block=16).collect()
    assert sorted(((r.query_id, r.kb, r.pos, r.sparse_rank) for r in got), key=str) == plain_bm25(entries, queries, 4)
    monkeypatch.setattr(index, "FEW_TERMS", 3)
    assert index.narrowed(stored.ranges, asked.select(F.col("query").alias("text"))) is stored.ranges


def test_groups_of_queries_score_as_one_block(monkeypatch):
    """Rows that share few terms with a group of queries are not multiplied by its matrix, and scores are the same."""
    import pyarrow as pa

    rng = random.Random(9)
    texts = [" ".join(f"{lang}{min(int(rng.paretovariate(0.8)), 300)}" for _ in range(40)) for lang in ("x", "y") for _ in range(400)]
    rng.shuffle(texts)
    lists = [t.split() for t in texts]
    monkeypatch.setattr(index, "LIKE", 4)
    plain, own = index.Block(list(enumerate(lists))), index.Block(given=(pa.array(range(800)), pa.array([t for x in lists for t in x]), np.array([len(x) for x in lists])))
    assert len(own.edges) > 2 and sorted(own.ids.to_pylist()) == list(range(800))
    assert own.dense.size < 0.7 * plain.dense.size
    docs = [Counter(x) for x in lists[:50]]
    pairs = [(i, plain.names.index(t), own.names.index(t), n / 7) for i, c in enumerate(docs) for t, n in c.items()]
    row, a, b, value = (np.array(x) for x in zip(*pairs, strict=True))
    want, got = plain.product(row, a, value, 50, np.arange(800)), own.product(row, b, value, 50, np.arange(800))
    assert np.allclose(got, want[:, own.ids.to_pylist()], atol=1e-9)
    some = np.arange(0, 800, 7)
    assert np.allclose(own.product(row, b, value, 50, some), got[:, some], atol=1e-9)


def test_entries_that_no_query_can_take_are_not_scored(small_ranges):
    rng = random.Random(4)
    entries = [(i, "w1 w2 w2" if i < 40 else "w1" + " other" * rng.randrange(1, 20)) for i in range(800)]
    found, want = searcher_over(entries, [f"w2 w1 q{i}" for i in range(50)], 3, list(range(0, 800, 40)))
    assert {i: found.best["k"].keys[:, i].tolist() for i in want} == want and found.scored <= found.passed / 20


@pytest.mark.parametrize("shape", [(3, 5), (8, 8), (1, 7), (40, 33)])
def test_places_of_few_true_cells(shape):
    """Scores that may enter the best are found eight cells at a time, the last ones too."""
    mask = np.random.default_rng(2).random(shape) < 0.1
    mask[-1, -1] = True
    assert index.true_places(mask).tolist() == np.flatnonzero(mask).tolist()


def test_long_queries_hold_few_pairs_at_once(monkeypatch):
    """Pairs of a part are some that a core's cache holds."""
    pairs, add = [], index.Block._add_pairs
    monkeypatch.setattr(index.Block, "_add_pairs", lambda self, scores, row, begin, value, count, to: (pairs.append(count.sum()), add(self, scores, row, begin, value, count, to))[1])
    rng = random.Random(2)
    entries = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(200))) for i in range(40)]
    found, want = searcher_over(entries, [" ".join(f"w{rng.randrange(3000)}" for _ in range(200)) for _ in range(300)], 4, [0])
    assert {i: found.best["k"].keys[:, i].tolist() for i in want} == want and sum(pairs) > 40_000 and max(pairs) <= 33_000


def test_search_of_nothing_and_for_nothing(spark):
    """Blocks without a query, without a token, and an index without entries."""
    none = spark.createDataFrame([], "kb string, pos long, text string")
    one = spark.createDataFrame([("k", 1, "a"), ("k", 2, None)], none.schema)
    asked = spark.createDataFrame([(1, None), (2, "?!")], "query_id long, query string")
    assert retrieval.bm25_topk(asked, none).count() == 0
    assert retrieval.bm25_topk(asked.limit(0), one).count() == 0
    assert sorted((r.query_id, r.pos) for r in retrieval.bm25_topk(asked, one).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]
