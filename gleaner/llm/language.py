"""Language identification: known words first, then ever shorter character n-grams.

A word that the model knows scores its log frequency in each language. A word it does not know
scores the mean log frequency of its longest known n-grams: of all of its 5-grams that are known, or
else of its 4-grams, and so on down to single characters; the word's edges count as characters. The
language with the largest sum wins.

The model is fitted on about ``PER_LANGUAGE`` labelled documents of each language, chosen by a hash of
their ids; that bound is a parameter. All words of these documents count, of any length, and all
n-grams of the words; Spark counts both. Scoring covers every text as a whole.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; if nothing was
learned, all are; ties go to the first language by name; equal texts, repeated rows too, get equal
results; a very long text or word is taken whole, a slice of texts at a time; an empty table gives no
rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import textscan
from gleaner.llm.common import keep

PER_LANGUAGE = 2000
LONGEST = 5
#: Added to each count of a word or n-gram.
SMOOTH = 0.5
#: Bytes of a word: ASCII small letters and whatever isn't ASCII. Texts are lower-cased before.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
WORDS = r"[a-z\x{80}-\x{10FFFF}]+"
_EDGE = 0x20


@dataclass
class Model:
    languages: list[str]
    words: np.ndarray  # sorted hashes
    word_scores: np.ndarray  # (words + 1) x languages; the last row is 0
    grams: list[np.ndarray]  # by length from 1: sorted hashes
    gram_scores: list[np.ndarray]


def _tally(found: pd.DataFrame, key: str, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """The keys of (lang, key, n) rows and the log share that each has in each language, smoothed."""
    row, keys = pd.factorize(found[key], sort=True)
    place = found["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy(np.int64)
    table = np.zeros((len(keys), len(languages)))
    np.add.at(table, (row, place), found["n"].to_numpy(float))
    return list(keys), np.log((table + SMOOTH) / (table.sum(0) + SMOOTH * (len(keys) + 1)))


def _gram_hashes(chars: np.ndarray, n: int) -> np.ndarray:
    total = chars[: len(chars) - n + 1].astype(np.uint64)
    for j in range(1, n):
        total = total * np.uint64(0x100000001B3) + chars[j : len(chars) - n + 1 + j]
    return textscan.mix64(total + np.uint64(n << 58))


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 0) -> Model:
    """``rows`` has doc_id, text and lang. Words and n-grams are counted by Spark; what comes back are the counts of the sample."""
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(0, np.uint64), np.zeros((1, 0)), [], [])
    part = F.element_at(F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))]), F.col("lang"))
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < part * 1_000_000)
    each = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))).alias("word"))
    tally = keep(each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    # A word seen once says little about whole words; its n-grams still count.
    often = tally.groupBy("word").agg(F.max("n").alias("most")).filter("most > 1")
    known, scores = _tally(tally.join(often, "word").select("lang", "word", "n").toPandas(), "word", languages)
    hashes = _word_hashes(known)
    order = np.argsort(hashes)
    grams, gram_scores = [], []
    pieces = ", ".join(f"CASE WHEN length(word) + 3 > {n} THEN transform(sequence(1, length(word) + 3 - {n}), i -> substring(concat(' ', word, ' '), i, {n})) ELSE array() END" for n in range(1, LONGEST + 1))
    each = tally.select("lang", "n", F.explode(F.expr(f"flatten(array({pieces}))")).alias("gram")).filter("gram <> ' '")
    sums = each.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    size = sums["gram"].str.len()
    for n in range(1, LONGEST + 1):
        keys, shares = _tally(sums[size == n], "gram", languages)
        chars = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32)
        codes = _gram_hashes(chars, n)[::n] if keys else np.zeros(0, np.uint64)
        place = np.argsort(codes)
        grams.append(codes[place])
        gram_scores.append(shares[place])
    return Model(languages, hashes[order], np.vstack([scores[order], np.zeros((1, len(languages)))]), grams, gram_scores)


def _word_hashes(words: list[str]) -> np.ndarray:
    found = [part.hashes() for part in textscan.slices(pa.array(words, pa.string()), WORD_BYTES)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _find(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places in ``ordered``; len(ordered) where there is none."""
    if not len(ordered):
        return np.zeros(len(values), np.int64)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return np.where(ordered[at] == values, at, len(ordered))


def unseen_scores(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """Scores of words, given by their bytes, from their longest known n-grams."""
    scores = np.zeros((len(starts), len(model.languages)))
    if not len(starts):
        return scores
    begin = np.concatenate([[0], np.cumsum(lengths + 1)]) + 1
    flat = np.full(begin[-1], _EDGE, np.uint8)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[np.repeat(begin[:-1], lengths) + within] = data[np.repeat(starts, lengths) + within]
    chars = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    edge = chars == _EDGE
    word_of = np.cumsum(edge) - 1  # an edge belongs to the word behind it
    waiting = np.ones(len(starts), bool)
    for n in range(LONGEST, 0, -1):
        if len(chars) < n or not waiting.any():
            continue
        count = len(chars) - n + 1
        ok = ~edge[:count] if n == 1 else np.ones(count, bool)
        for j in range(1, n - 1):
            ok &= ~edge[j : count + j]
        owner = word_of[:count]
        ok &= (owner >= 0) & (owner < len(starts))
        index = np.flatnonzero(ok)
        index = index[waiting[owner[index]]]
        place = _find(model.grams[n - 1], _gram_hashes(chars, n)[index])
        hit = place < len(model.grams[n - 1])
        own = owner[index[hit]]
        if not len(own):
            continue
        seen = np.bincount(own, minlength=len(starts))
        for k in range(len(model.languages)):
            total = np.bincount(own, model.gram_scores[n - 1][place[hit], k], minlength=len(starts))
            scores[:, k] += np.where(seen > 0, total / np.maximum(seen, 1), 0)
        waiting &= seen == 0
    return scores


def score_batch(texts: pa.Array, model: Model) -> np.ndarray:
    """Sums of scores: a row for each text, a column for each language."""
    total = np.zeros((len(texts), len(model.languages)))
    for part in textscan.slices(texts, WORD_BYTES):
        place = _find(model.words, part.hashes())
        unseen = place == len(model.words)
        rare = unseen_scores(part.data, part.starts[unseen], part.lengths[unseen], model)
        for k in range(len(model.languages)):
            own = model.word_scores[place, k]
            own[unseen] = rare[:, k]
            sums = np.concatenate([[0.0], np.cumsum(own)])
            total[part.lo : part.hi, k] = np.diff(sums[part.bounds])
    return total


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """Ids with lang_pred and score, the winner's share of all languages' likelihoods."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            letters = np.array(batch.column(2).to_pylist(), bool)
            if not model.languages:
                names, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                total = score_batch(batch.column(1), model)
                best = total.argmax(1)
                share = np.exp(np.maximum(total - total.max(1, keepdims=True), -700))
                score = np.where(letters, share.max(1) / share.sum(1), 0.0)
                names = [model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_column).alias("id"), F.lower("text").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, f"id {id_type}, lang_pred string, score double").withColumnRenamed("id", id_column)
