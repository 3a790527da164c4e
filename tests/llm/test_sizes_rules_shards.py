import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict, namedtuple

import pytest
from pyspark.sql import functions as F

from gleaner.llm import mixing, queries, rules, sharding

Sized = namedtuple("Sized", "doc_id source size draw")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def odd_texts():
    loop = "a b c d e f g"
    return [None, "", " \n\t ", "x", f"{loop} {loop}", f"é ü {loop}\n{loop}\n{loop}\n\n", "w " * 400, "L" * 5000, "  nbsp em", "one\x0btwo\x1cthree", "# * $ <b> | &", "a b c d e\na b c d e\n x \n x "]


def test_rules_match_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + odd_texts()
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in rules.ledger(rules.measure(docs)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(t), t
        n, repeated = r.n_words, r.n_repeat_words
        assert bool(r.fail_bits & rules.mask("base")) == (n < 10 or 100 * repeated > 20 * n)


def test_ablation_counts_bits(spark):
    led = spark.createDataFrame([(0,), (1,), (1,), (3,), (2,), (4,)], "fail_bits long")
    got = {r.rule: (r.n_fail, r.n_only) for r in rules.ablation(led, "base").collect()}
    assert got == {"few_words": (3, 2), "repeated_windows": (2, 1)}


def level(sizes, weights, most=3.0):
    """Targets by resharing the excess again and again."""
    total, capped, target = sum(sizes), set(), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(most * sizes[i] for i in capped)
        target = {i: most * sizes[i] for i in capped} | {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        above = {i for i in free if target[i] > most * sizes[i]}
        if not above:
            return [target[i] for i in range(len(sizes))]
        capped |= above


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5, 7, 0, 300], [0, 0], [10], [5, 5, 1000]])
def test_targets_reshare_the_excess(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_mixing_comes_near_its_targets(spark, sf):
    rows = queries.op4_mixing(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(docs[r.doc_id].text or "")) and 0 <= r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        source = docs[r.doc_id].source
        taken[source] += r.taken
        target[source] = r.target
        largest[source] = max(largest[source], r["size"])
    assert len(rows) == len(docs)
    for source, t in target.items():
        # The closing document is the nearest one, so half of the largest bounds what is missing.
        assert abs(taken[source] - t) <= 0.5 * largest[source] + 1
    assert sorted(rows) == sorted(queries.op4_mixing(spark, sf).collect())


def plain_mix(rows):
    """Words taken by id: whole copies, then the sample in Pareto order, then the closing document of each source."""
    sources = sorted({r.source for r in rows}, key=lambda x: (x is None, x or ""))
    sizes = [sum(r.size for r in rows if r.source == x) for x in sources]
    out = {}
    for source, size, target in zip(sources, sizes, level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]), strict=True):
        own = [r for r in rows if r.source == source]
        whole = math.floor(target / size + 1e-9) if size else 0
        chance = target / size - whole if size else 0
        chance = chance if chance > 1e-9 else 0
        for r in own:
            out[r.doc_id] = whole * r.size
        if not chance:
            continue
        u = {r.doc_id: (((r.draw % 2**64) >> 12) + 0.5) / 2**52 for r in own}
        odds = {i: (x / (1 - x)) / (chance / (1 - chance)) for i, x in u.items()}
        order, rest, taken = sorted(own, key=lambda r: (odds[r.doc_id], r.draw)), target - whole * size, 0
        for k, r in enumerate(order):
            if taken + r.size > rest:
                left = order[k:]
                break
            taken += r.size
            out[r.doc_id] += r.size
        else:
            continue
        gap = rest - taken
        near = [r for r in left if abs(r.size - gap) < gap]
        if near:
            r = min(near, key=lambda r: (abs(r.size - gap), odds[r.doc_id], r.draw))
            out[r.doc_id] += r.size
    return out


def test_mixing_takes_the_documents_of_a_plain_sample(spark, sf):
    rows = mixing.measured(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert len({r.draw for r in rows}) == len(rows)
    got = {r.doc_id: r.taken for r in queries.op4_mixing(spark, sf).collect()}
    assert got == plain_mix([Sized(r.doc_id, r.source, r["size"], r.draw) for r in rows])


def test_mixing_odd_rows(spark):
    many = [(i, f"w{i} " * (i % 7), "en", None if i % 3 else "a", 1) for i in range(200)]
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "x", "b", 0), *many, many[5], many[5]], SCHEMA)
    assert mixing.mix(docs).columns == docs.columns
    total = docs.select(F.sum(mixing.word_count())).first()[0]
    assert abs(mixing.mix(docs).select(F.sum(mixing.word_count())).first()[0] - total) <= 6
    assert mixing.mix(docs.limit(0)).count() == 0
    clash = docs.withColumn("size", F.lit("s")).withColumn("draw", F.lit(0)).withColumn("copies", F.lit(0)).withColumn("target", F.lit(1)).withColumn("row", F.lit(1))
    assert mixing.mix(clash).columns == clash.columns


def test_copies_of_a_row_are_mixed_one_by_one(spark, tmp_path):
    same = [(7, "one two three four five six seven eight nine ten", "en", "a", 1)] * 100
    other = [(1000 + i, f"w{i} " * 10, "en", "b", 1) for i in range(100)]
    docs = spark.createDataFrame(same + other, SCHEMA).repartition(6)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op4_mixing(spark, str(tmp_path)).collect()
    assert len(rows) == 200
    for ids, target in ((lambda i: i == 7, 2000 * 5 / 7), (lambda i: i != 7, 2000 * 2 / 7)):
        own = [r for r in rows if ids(r.doc_id)]
        assert own[0].target == pytest.approx(target) and abs(sum(r.taken for r in own) - target) <= 5
        assert all(r.taken % 10 == 0 and r.taken <= 30 for r in own)
    mixed = [r.doc_id for r in mixing.mix(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()]
    assert Counter(mixed)[7] == sum(r.taken for r in rows if r.doc_id == 7) // 10
    assert Counter(i for i in mixed if i != 7) == {r.doc_id: r.taken // 10 for r in rows if r.doc_id != 7 and r.taken}


def test_shards_are_even_and_gapless(spark, sf):
    rows = queries.op8_sharding(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(queries.SHARDS)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, queries.op8_sharding(spark, sf).collect()), key=str)


def test_shard_query_matches_plain_buckets(spark, sf):
    """Buckets from each row's hash, laid one behind the other; shards are equal ranges of that order."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    slim = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("crc")).withColumn("size", F.col("size") + 16)
    hashed = slim.withColumn("scatter", F.xxhash64(F.lit(0), F.xxhash64(F.lit(0), "doc_id", "size", "crc"))).collect()
    total, n = sum(r["size"] for r in hashed), len(hashed)
    buckets = max(1, queries.SHARDS, -(-total // sharding.BUCKET_BYTES))
    own = {r.doc_id: r.scatter % buckets for r in hashed}
    before, at = {}, 0
    for b in range(buckets):
        before[b], at = at, at + sum(x == b for x in own.values())
    rows = queries.op8_sharding(spark, sf).collect()
    first = [-(-s * n // queries.SHARDS) for s in range(queries.SHARDS + 1)]
    places = {r.doc_id: first[r.shard] + r.slot for r in rows}
    assert sorted(places.values()) == list(range(n))
    for b in range(buckets):
        inside = sorted(places[i] for i, x in own.items() if x == b)
        assert inside == list(range(before[b], before[b] + len(inside)))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "rows", None) for r in rows)


def test_shard_query_places_whole_rows(spark, sf, monkeypatch):
    """The operator gets every column, and the query reads size and checksum off the texts that it gives back."""
    placed = []
    own = sharding.external_shuffle

    def changed(df, *args, **options):
        placed.append(df.columns)
        return own(df, *args, **options).withColumn("text", F.lit("xyz"))

    with monkeypatch.context() as patch:
        patch.setattr(sharding, "external_shuffle", changed)
        rows = queries.op8_sharding(spark, sf).select("size", "text_crc32").distinct().collect()
    assert [tuple(r) for r in rows] == [(19, zlib.crc32(b"xyz"))]
    assert set(spark.read.parquet(f"{sf}/documents.parquet").columns) <= set(placed[0])


def test_shuffle_keeps_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, "", None, "a", 2)] + [(7, "same", "en", "a", 4)] * 9 + [(i, "t" * i, "en", "b", i) for i in range(50)], SCHEMA)
    got = sharding.external_shuffle(docs, 4, bucket_bytes=200)
    assert got.drop("shard", "slot").exceptAll(docs).count() == 0 and got.count() == docs.count()
    assert sharding.external_shuffle(docs.limit(0), 4).count() == 0
    clash = docs.withColumn("shard", F.lit("x")).withColumn("bucket", F.lit("y")).withColumn("at", F.lit(1)).withColumn("cell", F.lit(1))
    got = sharding.external_shuffle(clash, 4)
    assert got.columns == [*clash.columns, "_shard", "slot"] and got.count() == docs.count()
    assert got.filter("shard = 'x'").count() == docs.count()


def test_copies_of_a_row_are_dealt_to_all_buckets(spark):
    docs = spark.range(101_000).selectExpr("if(id < 100000, -1, id) AS doc_id", "if(id < 100000, 'the same text', concat('text ', id)) AS text")
    got = sharding.external_shuffle(docs, 20, bucket_bytes=1 << 18)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 101_000 and max(sizes) <= 2 * 101_000 / 20
    counts = [r["count"] for r in got.groupBy("shard").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).filter("slots = count AND last = count - 1").collect()]
    assert len(counts) == 20 and max(counts) - min(counts) <= 1
    assert got.groupBy("doc_id", "text").count().exceptAll(docs.groupBy("doc_id", "text").count()).isEmpty()


def test_shuffle_moves_rows(spark):
    order = [r.id for r in sharding.external_shuffle(spark.range(2000), 1, F.lit(1)).orderBy("slot").collect()]
    assert order != sorted(order) and sorted(order) == list(range(2000))
    assert hashlib.sha256(str(order).encode()).hexdigest() == hashlib.sha256(str([r.id for r in sharding.external_shuffle(spark.range(2000), 1, F.lit(1)).orderBy("slot").collect()]).encode()).hexdigest()


def test_write_shards(spark, tmp_path):
    sharding.write_shards(sharding.external_shuffle(spark.range(100), 4, F.lit(1)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().filter("count = 25").count() == 4
