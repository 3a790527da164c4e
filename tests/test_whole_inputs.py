"""Queries over whole texts and tables, against plain Python; some of their SQL in the catalogue takes less."""

import math
import re
from collections import Counter

from gleaner.plans import catalogue


def write(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def bm25(texts, asked, k):
    """{query: the k best keys}, ties and entries without a common term by key."""
    tokens = {key: Counter(re.findall("[a-z0-9]+", text.lower())) for key, text in texts.items()}
    mean = sum(sum(t.values()) for t in tokens.values()) / len(tokens)
    df = Counter(term for t in tokens.values() for term in t)
    idf = {term: math.log(len(tokens) - n + 0.5) - math.log(n + 0.5) for term, n in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    score = lambda q, key: sum(n * (idf[t] if idf[t] >= 0 else low) * tokens[key][t] * 2.5 / (tokens[key][t] + 1.5 * (0.25 + 0.75 * sum(tokens[key].values()) / mean)) for t, n in tokens[q].items())
    return {q: sorted(tokens, key=lambda key: (-round(score(q, key), 9), key))[:k] for q in asked}


def test_hybrid_asks_with_whole_texts(spark, tmp_path):
    start = "the same opening words stand before every one of these documents, so that eighty characters tell nothing "
    texts = {n: start + " ".join(f"w{(n * m + m) % 23}" for m in range(1, 4 + n % 5)) + f" x{n} y{n}" for n in range(40)}
    path = write(
        spark, tmp_path,
        documents=([(n, text, "en", "s", len(text)) for n, text in texts.items()], "doc_id long, text string, lang string, source string, n_chars long"),
        embeddings=([(n, [1.0, n / 40]) for n in texts], "vec_id long, embedding array<float>"),
    )
    want = bm25(texts, range(0, 40, 10), 5)
    got = {(r.query_id, r["rank"]): r.pos for r in catalogue.hybrid_sparse_only(spark, path).collect()}
    assert got == {(q, i): pos for q, keys in want.items() for i, pos in enumerate(keys, 1)}
    both = {(r.query_id, r.pos) for r in catalogue.hybrid_topk(spark, path).collect() if "sparse" in r.matched_by}
    assert {(q, keys[0]) for q, keys in want.items()} <= both


def test_every_page_gives_its_articles(spark, tmp_path):
    path = write(spark, tmp_path, pages=([(n, f"u{n}?a&b<c", "h") for n in range(24)], "page_id long, url string, html string"))
    got = sorted((r.page_id, r.article_no, r.title, r.text) for r in catalogue.html_articles(spark, path).collect())
    want = []
    for n in range(24):
        for j in range(n % 4):
            subs, bodies = (n + j) % 3, [f"{j}-{i} u{n}?a&b<c" for i in range((n * 7 + j) % 5)]
            want.append((n, f"Article {n % 50 + j}", f"T{j}" if subs else "", "\n".join(bodies + [f"late T{j}"] * (subs > 1))))
    assert got == sorted(want)


def test_segments_take_all_lines_of_a_text(spark, tmp_path):
    texts = {n: "\n".join(" ".join(f"d{n}l{i}w{w}" for w in range(9 + i % 4)) for i in range(size)) for n, size in ((7, 1), (8, 25), (108, 120))} | {9: "", 10: None}
    path = write(spark, tmp_path, documents=([(n, text) for n, text in texts.items()], "doc_id long, text string"))
    shown = {n: [f"NOTE {x}" if i % 9 == 4 else f"{x}-" if i % 7 == 2 else x for i, x in enumerate(text.split("\n"))] for n, text in texts.items() if text}
    header = r"1 Scope|\d+ FR \d+ – Some  control|\d+\.1 (CR \d+\.\d+ – Title of it|Security levels)"
    body, clauses = {}, {}
    for r in sorted(catalogue.line_noise_filter(spark, path).collect(), key=lambda r: (r.doc_id, r.n)):
        body.setdefault(r.doc_id, []).append(r.line)
    assert {n: [x for x in lines if not re.fullmatch(header, x)] for n, lines in body.items()} == shown | {9: [], 10: []}
    for r in sorted(catalogue.clause_segment(spark, path).collect(), key=lambda r: (r.doc_id, r.n)):
        clauses.setdefault(r.doc_id, []).append((r.clause, r.field, r.line))
    assert clauses == {n: [(i // 10 + 1, "security_levels" if i % 10 >= 5 else "requirement", x) for i, x in enumerate(lines)] for n, lines in shown.items()}
    for r in catalogue.dewrap_lines(spark, path).collect():
        want = ""
        for line in body[r.doc_id]:
            want = line if not want else f"{want}\n{line}" if line.startswith("NOTE") else want[:-1] + line if want.endswith("-") else f"{want} {line}"
        assert r.text == want
