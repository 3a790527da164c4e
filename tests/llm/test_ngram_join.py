import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import ngram_join, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def gram_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Size and smallest reachable id of each (id, text)."""
    sets = {i: gram_set(t) for i, t in rows}
    at: dict = {}
    for i, s in sets.items():
        for g in s:
            at.setdefault(g, []).append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared: dict = {}
        for g in s:
            for j in at[g]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, k in shared.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)


def result(rows):
    return {r.id: (r.n, r.id if r.least is None else r.least) for r in rows}


def altered(rng, words, edits):
    words = list(words)
    for k in rng.integers(0, len(words), edits):
        words[k] = f"x{rng.integers(0, 10**9)}"
    return " ".join(words)


def corpus(seed):
    """Near copies at and about the bound, copies, hot passages, short texts."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = " ".join(rng.choice(vocabulary, 40))
    texts = [None, "", "  \n", "One", "one", "one two", "ONE\ttwo", "a b c d", "a b c d e", "a b c d e f"]
    for _ in range(12):
        words = rng.choice(vocabulary, int(rng.integers(6, 300)))
        texts += [altered(rng, words, int(e)) for e in rng.integers(0, max(1, len(words) // 30) + 1, 6)] + [" ".join(words).upper()] * 2
    texts += [f"{passage} {' '.join(rng.choice(vocabulary, 60))} {passage if k % 2 else ''}" for k in range(40)]
    base = rng.choice(vocabulary, 120)
    texts += [altered(rng, base, 2) for _ in range(60)]
    return list(enumerate(rng.permutation(np.array(texts, object)).tolist()))


@pytest.mark.parametrize(("seed", "block", "pairs"), [(0, 2_000_000, 32), (1, 700, 32), (2, 2_000_000, 1)])
def test_components_match_brute_force(spark, monkeypatch, seed, block, pairs):
    monkeypatch.setattr(ngram_join, "PAIR_ROWS", pairs)
    rows = corpus(seed)
    assert result(ngram_join.join(frame(spark, rows), block_entries=block).collect()) == brute(rows)


def test_documents_match_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_ngram_join(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_spanning_links_connect_what_is_linked(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 60, int(n))).astype(np.uint64) for n in rng.integers(1, 40, 80)]
    sets += [np.unique(np.concatenate([sets[i], rng.integers(0, 60, 1).astype(np.uint64)])) for i in range(40)]
    sizes = np.array([len(s) for s in sets])

    def roots(pairs):
        label = list(range(len(sets)))
        for _ in sets:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    every = []
    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 80 * (sizes[i] + sizes[j] - k):
                every.append((i, j))
    got = ngram_join.spanning_links(sizes, sets, 80)
    assert roots(got) == roots(every) and len(got) < len(sets)
    assert all((max(p), min(p)) in set(every) for p in got)


def test_components_of_long_paths(spark):
    path = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1005, 1001), (7, 7)]
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(301)) and {got[k] for k in (1000, 1001, 1005)} == {1000}
    assert ngram_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicate_keeps_one_of_each(spark):
    rows = corpus(3)
    want = brute(rows)
    docs = frame(spark, rows)
    kept = {r.doc_id for r in ngram_join.deduplicate(docs).collect()}
    assert kept == {i for i, (n, root) in want.items() if not n or i == root}


def test_deduplicate_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(50))
    rows = [(1, long), (1, long), (None, long), (None, f"{long} more"), (None, None), (2, ""), (2, ""), (None, "alone by itself"), (9, "word " * 30_000)]
    docs = frame(spark, rows).withColumn("n", F.lit("n")).withColumn("class", F.lit(1)).withColumn("id", F.lit(2)).withColumn("text_key", F.lit("k"))
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, (r.text or "")[:9]) for r in kept.collect()), key=str) == sorted([(1, "w0 w1 w2 "), (None, ""), (2, ""), (2, ""), (None, "alone by "), (9, "word word")], key=str)
    assert ngram_join.deduplicate(docs.limit(0)).count() == 0


def test_second_product_finds_what_the_first_one_missed(spark):
    """Rows that are linked but come to different blocks at first."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 400)]
    # Each text shares four fifths with the next one, so the least first n-gram changes along the way.
    texts = {k: " ".join(words[7 * k : 7 * k + 110]) for k in range(40)}
    docs = frame(spark, texts.items())
    signed = ngram_join.signatures(docs, 5, 80)
    chosen = ngram_join.candidates(signed, 80)
    entries = ngram_join.prefix_entries(signed, chosen, 80)
    alone = spark.createDataFrame([], "node long, root long")
    left = ngram_join.between(entries, alone, chosen, 80).collect()
    assert len({r["class"] for r in left}) == 40
    assert result(ngram_join.join(docs).collect()) == brute(list(texts.items()))
