import hashlib
import re
import time
import zlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import decontamination, language, quality, queries, textscan, toxicity
from gleaner.llm.common import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(texts, items, window=10):
    windows = {}
    for item, text in items:
        w = item_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes, out = {len(w) for w in windows}, []
    for text in texts:
        words, hit, found = item_words(text), set(), set()
        for i in range(len(words)):
            for n in sizes:
                if (own := windows.get(tuple(words[i : i + n]))) and i + n <= len(words):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((len(words), len(hit), found))
    return out


def check_hits(spark, texts, items, **more):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.scan(docs, bench, **more).collect()}
    want = brute_hits(texts, items)
    for i, (n, hit, found) in enumerate(want):
        r = got[i]
        assert (r.n_words, r.n_hit, set(r["items"])) == (n, hit, {str(x) for x in found}), texts[i]
        assert sum(e - s for s, e in zip(r.spans[::2], r.spans[1::2], strict=True)) == hit
    clean = {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()}
    assert clean == {i for i, w in enumerate(want) if not w[1]}


def test_hits_match_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    passage = items[3][1]
    check_hits(spark, [*texts, passage, f"x {passage.upper()} y {items[4][1]}{items[4][1]}", None, ""], items)


@pytest.mark.parametrize("seed", range(4))
def test_hits_on_few_words(spark, seed):
    rng = np.random.default_rng(seed)
    some = lambda n: " ".join(rng.choice(["a", "B", "c,", "é"], n))
    items = [(i, some(int(rng.choice([0, 1, 2, 3, 9, 10, 11, 25])))) for i in range(12)] + [(50, None), (51, "a"), (51, "a")]
    texts = [some(int(n)) for n in rng.integers(0, 80, 60)] + [None, "", "a", "é", "  "]
    check_hits(spark, texts, items, block_words=[20, 10**6][seed % 2])


def brute_longest(texts, items, window=10):
    """Words of the longest match of a window at least, or of a whole shorter item."""
    out = []
    for text in texts:
        words, best = item_words(text), 0
        for _, item in items:
            own = item_words(item)
            least = min(window, len(own)) or 1
            for i in range(len(words)):
                for j in range(len(own)):
                    if j and len(own) - j < window:
                        break
                    n = 0
                    while i + n < len(words) and j + n < len(own) and words[i + n] == own[j + n]:
                        n += 1
                    best = max(best, n if n >= least else 0)
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_longest_match_of_each_document(spark, seed):
    rng = np.random.default_rng(seed)
    some = lambda n: " ".join(rng.choice(["a", "b", "c"], n))
    items = [(i, some(int(rng.choice([1, 3, 10, 12, 30])))) for i in range(6)]
    texts = [some(int(n)) for n in rng.integers(0, 60, 20)] + [items[k][1] for k in range(6)] + [f"x {items[5][1]} y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (10**6, 30):
        got = {r.doc_id: r.longest for r in decontamination.scan(docs, bench, block_words=block_words).collect()}
        assert [got[i] for i in range(len(texts))] == brute_longest(texts, items)


def test_repetitive_texts_take_near_linear_time():
    text = " ".join(["one", "two", "three", "four"] * 5000)
    own = [part.hashes() for part in textscan.slices(pa.array([text]), textscan.ALPHANUMERIC, lower=True)]
    began = time.time()
    block = decontamination.Block.of(["a"], own, 10)
    tracemalloc.start()
    n_words, n_hit, longest, spans, items = decontamination.hits(pa.array([text, f"x {text}", "one two"]), block, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n_hit.to_pylist() == [20_000, 20_000, 0] and longest.to_pylist() == [20_000, 20_000, 0] and items.to_pylist() == [["a"], ["a"], []]
    assert time.time() - began < 2 and peak < 200 << 20


def test_scan_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", [1])], "doc_id long, text string, n_hit string, items array<int>")
    got = decontamination.scan(docs, spark.createDataFrame([(1, "b")], "item_id long, text string"))
    assert got.columns == [*docs.columns, "n_words", "_n_hit", "longest", "spans", "_items"]
    row = got.first()
    assert (row["n_hit"], row["_n_hit"], row["_items"], row["longest"]) == ("x", 1, ["1"], 1)


def test_empty_benchmark_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", [1]), (None, None, None, None)], "doc_id long, text string, n_hit string, items array<int>")
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.decontaminate(docs, bench)
    assert got.columns == docs.columns and got.count() == 2
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0


def test_longest_matches_are_verbatim(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = {str(r.doc_id): item_words(r.text) for r in docs.collect()}
    items = {str(r.item_id): item_words(r.text) for r in bench.collect()}
    got = decontamination.longest_matches(docs, bench).collect()
    assert got
    for r in got:
        doc, item = texts[r.doc_id], items[r.item_id]
        assert doc[r.doc_word : r.doc_word + r.n_words] == item[r.item_word : r.item_word + r.n_words]
    best = {(r.item_id, r.item_word): r.n_words for r in got}
    joined = {k: " " + " ".join(v) + " " for k, v in texts.items()}
    for item, words in items.items():
        for i in range(0, len(words) - 9, 7):
            length = max((n for n in range(10, len(words) - i + 1) if any(f" {' '.join(words[i : i + n])} " in t for t in joined.values())), default=0)
            assert best.get((item, i), 0) == length


def test_benchmark_query_digest(spark, sf):
    rows = queries.op6_decontamination(spark, sf).collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(docs, brute_hits(docs.values(), items), strict=True))
    for r in rows:
        n, hit, found = want[r.doc_id]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), digest, hit > 0)


def test_words_of_slices(monkeypatch):
    monkeypatch.setattr(textscan, "SLICE_BYTES", 7)
    texts = ["ab cd", "", "ef", "gh", None, " ", "a" * 40 + " b", "é\tü"]
    words = []
    for part in textscan.slices(pa.array(texts)):
        for k in range(part.hi - part.lo):
            words.append([part.data[s : s + n].tobytes().decode() for s, n in zip(part.starts[part.bounds[k] : part.bounds[k + 1]], part.lengths[part.bounds[k] : part.bounds[k + 1]], strict=True)])
    assert words == [["ab", "cd"], [], ["ef"], ["gh"], [], [], ["a" * 40, "b"], ["é", "ü"]]


def rate(rows, truth, value):
    own = [(getattr(r, value), truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    return sum(a == b for a, b in own) / len(own), own


SF1 = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    rows = queries.op1_quality(spark, SF1).collect()
    assert len(rows) == spark.read.parquet(f"{SF1}/documents.parquet").count()
    assert rate(rows, truth, "predicted")[0] > 0.93 and all(0 <= r.score <= 1 for r in rows)


def plain_score(text, model):
    """Every filter at every byte, every chunk, one after the other."""
    data = (text or "").encode()
    n = -(-(len(data) + quality.WIDTH) // quality.BLOCK)
    data = np.frombuffer(data.ljust(n * quality.BLOCK + quality.WIDTH, b"\0"), np.uint8)
    out = sum(model.filters[j][data[j : j + n * quality.BLOCK]] for j in range(quality.WIDTH))
    tops = out.reshape(n, quality.BLOCK, -1).max(1)
    begins = [0]
    while begins[-1] + quality.CHUNK < n:
        begins.append(begins[-1] + quality.STRIDE)
    chunks = np.array([np.maximum(tops[b : b + quality.CHUNK].max(0) + model.bias, 0) for b in begins])
    return 1 / (1 + np.exp(-(np.concatenate([chunks.mean(0), chunks.max(0)]) @ model.weights + model.offset)))


def test_quality_query_matches_a_plain_network(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries.quality_model(spark, docs.select("doc_id", "text"), sf)
    rows = {r.doc_id: r for r in queries.op1_quality(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        assert r.score == pytest.approx(plain_score(texts[i], model), abs=1e-4)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5)


def test_quality_covers_all_bytes_at_any_slicing(monkeypatch):
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), rng.normal(size=quality.FILTERS).astype(np.float32), rng.normal(size=2 * quality.FILTERS), 0.1)
    texts = ["", None, "a", "word " * 400, "é" * 3000, "x" * 64, "y" * 65]
    whole = quality.score_batch(pa.array(texts), model, model.pair_tables())
    monkeypatch.setattr(textscan, "SLICE_BYTES", 1024)
    assert quality.score_batch(pa.array(texts), model, model.pair_tables()) == pytest.approx(whole, abs=1e-5)
    # Brute force: every window of every chunk.
    for text, got in zip(texts, whole, strict=True):
        data = (text or "").encode()
        n = -(-(len(data) + quality.WIDTH) // quality.BLOCK)
        data = data.ljust(n * quality.BLOCK + quality.WIDTH, b"\0")
        out = np.array([sum(model.filters[j, data[i + j]] for j in range(quality.WIDTH)) for i in range(n * quality.BLOCK)])
        begins, k = [0], 0
        while begins[-1] + quality.CHUNK < n:
            begins.append(begins[-1] + quality.STRIDE)
        chunks = np.array([np.maximum(out[b * quality.BLOCK : min(n, b + quality.CHUNK) * quality.BLOCK].max(0) + model.bias, 0) for b in begins])
        z = np.concatenate([chunks.mean(0), chunks.max(0)]) @ model.weights + model.offset
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_fits_do_not_depend_on_the_order_of_repeated_ids(spark):
    rows = [(i, f"text {i % 7} {'bad' * (i % 2)} number {k}") for i in range(60) for k in range(2)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    models = [(quality.fit(docs, labels), toxicity.fit(docs, labels)) for docs in (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows[::-1], "doc_id long, text string"))]
    assert all(np.array_equal(a, b) for a, b in zip((models[0][0].filters, models[0][1].weights), (models[1][0].filters, models[1][1].weights), strict=True))
    docs = spark.createDataFrame([(1, "a", 5)], "doc_id long, text string, score int")
    got = quality.score(docs, models[0][0])
    assert got.columns == ["doc_id", "text", "score", "_score"] and got.first().score == 5


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", None, None, 1), (None, None, None, None, None)], SCHEMA)
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality.score(docs, model, name="text_score")
    assert got.columns == [*docs.columns, "text_score"] and {r.text_score for r in got.collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_language_on_held_out_texts(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()}
    assert rate(queries.op10_language(spark, SF1).collect(), truth, "lang_pred")[0] > 0.97


def brute_model(rows):
    """Words seen twice in a language, and n-grams of all words, with their log shares."""
    languages = sorted({lang for _, lang in rows})
    words = {k: Counter(w for t, lang in rows if lang == k for w in re.findall(r"[a-z\x80-\U0010FFFF]+", t.lower())) for k in languages}

    def shares(counts):
        keys = sorted(set().union(*counts.values()))
        total = {k: sum(counts[k].values()) + 0.5 * (len(keys) + 1) for k in languages}
        return {key: [np.log((counts[k][key] + 0.5) / total[k]) for k in languages] for key in keys}

    known = {w for c in words.values() for w, n in c.items() if n > 1}
    grams = []
    for n in range(1, 6):
        own = {k: Counter() for k in languages}
        for k in languages:
            for w, times in words[k].items():
                for i in range(len(w) + 3 - n):
                    own[k][f" {w} "[i : i + n]] += times
            own[k].pop(" ", None)
        grams.append(shares(own))
    return languages, shares({k: Counter({w: c for w, c in words[k].items() if w in known}) for k in languages}), grams


def brute_language(text, model):
    languages, known, grams = model
    total = np.zeros(len(languages))
    for word in re.findall(r"[a-z\x80-\U0010FFFF]+", text.lower()):
        if word in known:
            total += known[word]
            continue
        for n in range(5, 0, -1):
            found = [g for i in range(len(word) + 3 - n) if (g := f" {word} "[i : i + n]) in grams[n - 1]]
            if found:
                total += np.mean([grams[n - 1][g] for g in found], axis=0)
                break
    return languages[int(total.argmax())], total


def test_language_query_matches_a_plain_model(spark, sf):
    """All words count, of any length, and all of their n-grams."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    long = "z" * 41 + "é" * 30
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()] + [(10**6, f"{long} {long} q", "xx")]
    model = brute_model([(t, lang) for _, t, lang in rows if t is not None and lang is not None])
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = language.fit(frame)
    assert len(fitted.words) == len(model[1]) and [len(g) for g in fitted.grams] == [len(g) for g in model[2]]
    texts = [(t or "").lower()[:3000] for _, t, _ in rows] + [long, "z" * 50, f"{long}x", "ééé"]
    got = language.score_batch(pa.array(texts), fitted)
    for text, own in zip(texts, got, strict=True):
        assert own == pytest.approx(brute_language(text, model)[1], rel=1e-9, abs=1e-6)
    assert brute_language(f"{long}x", model)[0] == "xx"


def test_language_query_over_whole_texts(spark, sf):
    """The query against a plain model that is fitted on the same documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fold = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 for r in docs}
    model = brute_model([(r.text, r.lang) for r in docs if fold[r.doc_id] and r.text is not None and r.lang is not None])
    rows = {r.doc_id: r for r in queries.op10_language(spark, sf).collect()}
    assert len(rows) == len(docs)
    for r in docs:
        own = rows[r.doc_id]
        assert own.held_out == (fold[r.doc_id] == 0)
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert own.lang_pred == "und"
            continue
        best, total = brute_language(r.text, model)
        share = np.exp(total - total.max())
        assert own.lang_pred == best and own.score == pytest.approx(1 / share.sum(), abs=1e-6)


def test_language_odd_texts(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", None, 1), (2, "le chat et le chien", "fr", None, 1), (3, "the the and", "en", None, 1)], SCHEMA)
    model = language.fit(docs)
    odd = spark.createDataFrame([(1, None, None, None, 0), (2, "", None, None, 0), (3, "12 34!", None, None, 0), (4, "CHIENNE", None, None, 0), (5, "dogs", None, None, 0), (6, "中文", None, None, 0)], SCHEMA)
    got = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [got[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert got[4].lang_pred == "fr" and got[5].lang_pred == "en" and got[6].lang_pred in ("en", "fr") and 0 < got[6].score <= 1
    nothing = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}


def test_language_backs_off_to_shorter_grams():
    known = Counter({"abcdef": 3, "xy": 2})
    other = Counter({"zzz": 3})
    keys = {n: sorted({f" {w} "[i : i + n] for w in (*known, *other) for i in range(len(w) + 3 - n)} - {" "}) for n in range(1, 6)}
    grams, scores = [], []
    for n in range(1, 6):
        codes = np.array([language._gram_hashes(np.array([ord(c) for c in k], np.uint64), n)[0] for k in keys[n]])
        order = np.argsort(codes)
        grams.append(codes[order])
        scores.append(np.full((len(codes), 1), float(n)))
    model = language.Model(["a"], np.zeros(0, np.uint64), np.zeros((1, 1)), grams, scores)
    data = np.frombuffer(b"abcdeq abcq xq qz qqq", np.uint8)
    part = next(textscan.slices(pa.array([data.tobytes().decode()])))
    got = language.unseen_scores(part.data, part.starts, part.lengths, model)[:, 0]
    assert got.tolist() == [5.0, 4.0, 2.0, 2.0, 0.0]


def test_toxicity_on_held_out_labels(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    rows = queries.op9_toxicity(spark, SF1).collect()
    share, own = rate(rows, truth, "predicted")
    assert share > 0.85 and sum(a > b for a, b in own) <= 0.02 * len(own)
    assert all(0 <= r.expected_severity <= 2 and 0 <= r.score <= 1 and r.grade in (0, 1, 2) for r in rows)


def plain_mix64(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def plain_features(word):
    """Hashes of a word and of its beginnings that are shorter than it, byte by byte."""
    data, value, out = word.encode(), 0, []
    for k, byte in enumerate(data[:32]):
        value = (value * 0x5851F42D4C957F2D + plain_mix64((byte + 1) * 0x9E3779B97F4A7C15 % 2**64)) % 2**64
        if k + 1 in toxicity.PREFIXES and len(data) > k + 1:
            out.append(plain_mix64((value + k + 1) % 2**64))
    whole = value if len(data) <= 32 else int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")
    return [*out, plain_mix64(whole)]


def test_toxicity_query_matches_plain_scoring(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF1}/labels.parquet").filter(fold("doc_id", 3) != 1))
    weights = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op9_toxicity(spark, SF1).collect()
    assert len(rows) == len(texts) and len(weights) > 5
    for r in rows:
        counts = Counter(h for word in item_words(texts[r.doc_id]) for h in plain_features(word) if h in weights)
        s = sum(weights[h] * np.log1p(n) for h, n in counts.items())
        upto = [1 / (1 + np.exp(-(t - s))) for t in model.thresholds]
        each = np.diff([0.0, *upto, 1.0])
        assert r.score == pytest.approx(1 - upto[0], abs=1e-9) and r.expected_severity == pytest.approx(float(each @ np.arange(len(each))), abs=1e-9)
        assert r.grade == int(each.argmax()) and r.predicted == int(r.score >= 0.5)


def test_toxicity_given_grades_are_ordered():
    texts = [f"fine words here {i}" for i in range(60)] + [f"bad words here {i}" for i in range(40)] + [f"bad awful words here {i}" for i in range(40)]
    given = np.array([0] * 60 + [1] * 40 + [2] * 40)
    model = toxicity.fit_texts(pa.array(texts), given)
    assert len(model.thresholds) == 2 and np.all(np.diff(model.thresholds) > 0)
    rows, places, counts = toxicity.batch_counts(pa.array(texts), model.words)
    s = np.bincount(rows, weights=np.log1p(counts) * model.weights[places], minlength=len(texts))
    assert s[:60].max() < s[60:100].min() and s[60:100].max() < s[100:].min()


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, 0), (None, "", None, None, 0)], SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.predict(docs.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == 2 and all(r.score < 0.5 for r in got)
