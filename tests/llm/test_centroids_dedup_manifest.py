"""Centroid clustering, exact deduplication and the Merkle manifest against plain Python."""

import contextlib
import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import centroids, exact_dedup, manifest, queries

SF = "/root/testdata/sf0.001"


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue()


# --- exact deduplication ---

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (None, "a"), (3, "a"), (6, "A"), (7, "x" * 200_000), (8, "x" * 200_000 + "y"), (9, "x" * 200_000), (None, "only"), (None, "only"), (10, " a")]


def plain_classes(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, F.length, lambda text: F.lit(1)])
def test_classes_compare_content_whatever_the_digest(spark, digest):
    rows = ROWS * 1 + [(100 + i, f"copy {i % 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.classes(docs, digest=digest).collect()
    groups = plain_classes(rows)
    assert len(got) == len(rows)
    by_class = defaultdict(list)
    for r in got:
        by_class[(r["keep_id"], r["size"])].append(r)
    want = defaultdict(int)
    for keep, size in groups.values():
        want[(keep, size)] += size
    assert {k: len(v) for k, v in by_class.items()} == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["id"] == r["keep_id"] for r in got if r["kept"])
    texts = {i: t or "" for i, t in rows if i is not None}
    assert all((r["keep_id"], r["size"]) == groups[texts[r["id"]]] for r in got if r["id"] is not None)


def test_deduplicate_keeps_rows_with_any_columns(spark):
    names = ["doc_id", "text", "a.b", "salt", "digest", "hot", "c`d", "whole", "c0"]
    docs = spark.createDataFrame([(i, t, 1.5, "s", {"k": i}, True, None, i, "x") for i, t in ROWS], "i long, t string, a double, s string, m map<string,long>, h boolean, c string, w long, z string").toDF(*names)
    got = exact_dedup.deduplicate(docs)
    assert got.columns == names and [t for _, t in got.dtypes] == [t for _, t in docs.dtypes]
    rows = got.collect()
    groups = plain_classes(ROWS)
    assert sorted((r["text"] or "", r["doc_id"], r["whole"]) for r in rows if r["doc_id"] is not None) == sorted((t, k, k) for t, (k, _) in groups.items() if k is not None)
    assert len(rows) == len(groups)


def test_dedup_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.classes(docs).collect() == [] and exact_dedup.deduplicate(docs).collect() == []


def test_hot_text_is_salted_and_no_python_runs(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text")).repartition(12)
    rows = docs.select(F.col("doc_id").alias("id"), "text").withColumn("digest", exact_dedup.sha256(F.col("text")))
    hot = spark.createDataFrame([("hot",)], "text string").select(exact_dedup.sha256(F.col("text")).alias("digest"))
    assert exact_dedup._hot_rows(rows, 4000) < 2000
    salts = exact_dedup._salted(rows, hot).filter("text = 'hot'").select("salt").distinct().count()
    assert salts == 12
    found = exact_dedup.classes(docs)
    assert found.filter("size = 2000 AND keep_id = 3998").count() == 2000 and found.filter("kept").count() == 2001
    for df in (found, exact_dedup.deduplicate(docs), queries.op12_exact_dedup(spark, SF)):
        assert not any(word in plan_of(df) for word in ("Python", "Arrow", "Pandas", "ExternalRDD"))


# --- Merkle manifest ---


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The root, and for each node its steps (left, right)."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, place in enumerate(at):
            run = level[place // 16 * 16 : place // 16 * 16 + 16]
            steps[k].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
            at[k] = place // 16
        level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    return level[0], steps


def plain_manifest(rows):
    def lowered(t):
        return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    sources = defaultdict(list)
    for r in rows:
        seen = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] is not None
        sources[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), plain_leaf(r, lowered(r["text"]) if seen else r["text"])))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(sources[s])]) for s in order]
    root, tops = plain_tree([t[0] for t in trees])
    found = []
    for s, (subroot, steps), top in zip(order, trees, tops, strict=True):
        for (has, doc_id, own, seen), path in zip(sorted(sources[s]), steps, strict=True):
            folded = seen
            for left, right in path + top:
                folded = sha(left + folded + right)
            found.append((doc_id if has else None, own, subroot, root, sha("".join(a + b for a, b in path + top)), folded, folded == root))
    return sorted(found, key=str)


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def rows_with_sources(sizes, seed=0):
    rng, rows = random.Random(seed), []
    for source, n in sizes.items():
        rows += [(rng.randrange(10**6), rng.choice(["Abc", "", None, "ÄÖ É", "lower", "Z" * 50_000]), rng.choice(["en", None]), source, rng.choice([None, 3])) for _ in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 16, "b": 17, "B": 1, "é": 15, "": 2}, {"hot": 300, "x": 31, None: 1}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest_query(spark, tmp_path, sizes):
    rows = rows_with_sources(sizes)
    rows += rows[:2] + [(None, "No Id", None, next(iter(sizes)), 1)] * 2
    sf = documents(spark, tmp_path, rows)
    df = queries.op13_manifest(spark, sf)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])
    assert sorted((tuple(r) for r in df.collect()), key=str) == want


def test_manifest_of_odd_tables(spark, tmp_path):
    assert queries.op13_manifest(spark, documents(spark, tmp_path / "none", [])).collect() == []
    rows = rows_with_sources({"a": 20, None: 3})
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plain = manifest.manifest(docs).collect()
    odd = docs.withColumns({name: F.lit(7) for name in ("tree", "idx", "n", "node", "path", "step", "key", "a.b", "x`y")}).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    assert sorted(map(str, manifest.manifest(odd).collect())) == sorted(map(str, plain))
    assert all(r["folded_root"] == r["root"] for r in plain)
    # Any other row in the place of a leaf is found out.
    other = manifest.manifest(docs, presented={"text": F.concat(F.coalesce("text", F.lit("")), F.lit("!"))}).collect()
    assert all(r["folded_root"] != r["root"] for r in other)


# --- centroid clustering ---


def plain_clusters(vectors, k=16, rounds=3, dims=64):
    kept = []
    for vec_id, v in vectors:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, [int(np.floor(64 * float(x))) for x in v]))
    first = sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:k]
    cents = [list(v) for _, v in first]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest():
        return [min((apart(v, c), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        of = [j for _, j in nearest()]
        for j in range(len(cents)):
            own = [v for (_, v), a in zip(kept, of, strict=True) if a == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = nearest()
    per = defaultdict(int)
    for d, j in last:
        per[j] += d
    return sorted((vec_id, j, d, per[j], sum(per.values()), sha(",".join(map(str, cents[j])))) for (vec_id, _), (d, j) in zip(kept, last, strict=True))


def embeddings(spark, path, vectors):
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def random_vectors(n, seed, spread=1.0, centres=9):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(centres, 64)) * spread
    return [(i, [float(np.float32(x)) for x in centre[i % centres] + rng.normal(size=64) * 0.3]) for i in range(n)]


@pytest.mark.parametrize("name", ["clusters", "ties", "few", "odd", "large"])
def test_centroid_query(spark, tmp_path, name):
    vectors = {
        "clusters": lambda: random_vectors(600, 1),
        "ties": lambda: [(i, [float(i % 2), *[0.0] * 63]) for i in range(90)],
        "few": lambda: random_vectors(5, 2) + random_vectors(5, 2),
        "odd": lambda: [*random_vectors(60, 3), (70, None), (71, []), (72, [1.0] * 63), (73, [None] + [1.0] * 63), (74, [float("nan")] * 64), (75, [float("inf")] * 64), (76, [-0.001] * 64)],
        "large": lambda: [(i, [float(np.float32(x * 30_000)) for x in v]) for i, v in random_vectors(80, 4)],
    }[name]()
    df = queries.op11_centroids(spark, embeddings(spark, tmp_path, vectors))
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(tuple(r) for r in df.collect()) == plain_clusters(vectors)


def test_centroids_of_empty_and_extreme_tables(spark, tmp_path):
    df = queries.op11_centroids(spark, embeddings(spark, tmp_path / "a", []))
    assert df.collect() == [] and dict(df.dtypes)["distance"] == "bigint"
    huge = [(None, [3e38] * 64), (1, [-3e38] * 64), (1, [0.0] * 64)]
    rows = queries.op11_centroids(spark, embeddings(spark, tmp_path / "b", huge)).collect()
    assert len(rows) == 3 and all(r["distance"] == 0 for r in rows)


def test_bounds_spare_scans_and_hold(spark, tmp_path):
    vectors = spark.createDataFrame(random_vectors(2000, 5, spread=3.0), "vec_id long, embedding array<float>")
    found, cents = centroids.cluster(vectors.withColumn("cluster", F.lit(1)).withColumn("a.b", F.lit(2)), rounds=12)
    rows = found.collect()
    assert sum(r["scans"] for r in rows) < 0.6 * 13 * len(rows)
    for r in rows[::37]:
        d = np.sort(np.sqrt(((np.array(r["vector"]) - cents) ** 2).sum(1)))
        assert r["upper"] >= d[0] * (1 - 1e-12) and r["lower"] <= d[1]
