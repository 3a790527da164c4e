"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

One weight vector is shared by all ordered thresholds: P(grade <= k) = sigmoid(threshold_k - w x).
x holds log(1 + count) of the features in the model, which are whole words and word beginnings of
``PREFIXES`` bytes (insults come in many inflected forms). The outputs are the probability of each grade, put
together as the expected severity, and the chance of any toxicity.

Fitting takes a bounded sample: at most ``FIT_ROWS`` labelled documents are drawn by a hash of their
ids, and those of them of at most ``FIT_BYTES`` bytes are used; it takes the ``FEATURES`` features whose presence says most about the label. Where the labels say only
toxic or not, ``grades`` makes severities of them: a toxic document is severe if it has more toxic
markers than the median toxic document.

Defined cases: null and empty texts have no features; with no labels, or no toxic one, the expected
severity is near 0 for every text; equal texts, repeated rows too, get equal grades; very long texts
are scored whole, a slice of texts at a time; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import textscan

FIT_ROWS, FIT_BYTES = 4000, 32_768
FEATURES, LEAST_DOCS = 1000, 4
STEPS, RATE, PENALTY = 400, 0.05, 2e-5
PREFIXES = (4, 5, 6, 7, 8)
WORD_BYTES = textscan.ALPHANUMERIC


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than there are grades


def occurring(part: textscan.Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of features and the words where they occur: whole words, then each size of beginning."""
    yield part.hashes(), np.arange(len(part.starts))
    for word, hashes in part.prefix_hashes(PREFIXES):
        yield hashes, word


def batch_counts(texts: pa.Array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and count of the given words in each text."""
    rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sieve = np.zeros(1 << 16, bool)
    sieve[words >> np.uint64(48)] = True
    for part in textscan.slices(texts, WORD_BYTES, lower=True):
        for hashes, word in occurring(part):
            may = np.flatnonzero(sieve[hashes >> np.uint64(48)])
            at = np.minimum(np.searchsorted(words, hashes[may]), max(len(words) - 1, 0))
            hit = words[at] == hashes[may] if len(may) else np.zeros(0, bool)
            rows.append(np.searchsorted(part.bounds, word[may[hit]], "right") - 1 + part.lo)
            places.append(at[hit])
    pairs, counts = np.unique(np.concatenate(rows) * np.int64(len(words) + 1) + np.concatenate(places), return_counts=True)
    return pairs // (len(words) + 1), pairs % (len(words) + 1), counts


def select_words(texts: pa.Array, toxic: np.ndarray, features: int = FEATURES, least: int = LEAST_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the features that tell most by the log-likelihood ratio, and which of them mark toxicity."""
    held, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in textscan.slices(texts, WORD_BYTES, lower=True):
        for hashes, word in occurring(part):
            kinds, of = np.unique(hashes, return_inverse=True)
            width = part.hi - part.lo
            once = np.unique(of.reshape(-1) * np.int64(width) + np.searchsorted(part.bounds, word, "right") - 1)
            held.append(kinds[once // width])
            rows.append(once % width + part.lo)
    row = np.concatenate(rows)
    words, of = np.unique(np.concatenate(held), return_inverse=True)
    with_word = np.bincount(of, minlength=len(words)).astype(float)
    toxic_with = np.bincount(of, weights=toxic[row], minlength=len(words))
    n, n_toxic = len(toxic), float(toxic.sum())
    cells = [(toxic_with, with_word, n_toxic), (with_word - toxic_with, with_word, n - n_toxic), (n_toxic - toxic_with, n - with_word, n_toxic), (n - with_word - n_toxic + toxic_with, n - with_word, n - n_toxic)]
    gain = sum(np.where(o > 0, o * np.log(np.maximum(o, 1e-9) * n / np.maximum(a * b, 1e-9)), 0) for o, a, b in cells)
    gain[with_word < least] = 0
    best = np.argsort(-gain, kind="stable")[:features]
    best = np.sort(best[gain[best] > 4])
    marks = toxic_with[best] / max(n_toxic, 1) > 4 * (with_word[best] - toxic_with[best] + 0.5) / max(n - n_toxic, 1)
    return words[best], marks & (gain[best] > 12)


def grades(rows: np.ndarray, places: np.ndarray, counts: np.ndarray, marks: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for clean documents, 1 and 2 for toxic ones with fewer and with more markers.

    The count is not set against the length, since neither are the features.
    """
    own = np.bincount(rows, weights=counts * marks[places] if len(places) else None, minlength=len(toxic))
    middle = np.median(own[toxic]) if toxic.any() else 0.0
    return np.where(toxic, np.where(own > middle, 2, 1), 0)


def train(rows: np.ndarray, places: np.ndarray, counts: np.ndarray, n_words: int, grade: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the penalised log-likelihood of the whole sample."""
    value = np.log1p(counts)
    weights = np.zeros(n_words)
    share = (np.cumsum(np.bincount(grade, minlength=levels))[:-1] + 1) / (len(grade) + 2)
    first, gaps = np.log(share[0] / (1 - share[0])), np.log(np.maximum(np.diff(np.log(share / (1 - share))), 0.05))
    packed = np.concatenate([weights, [first], gaps])
    m, v = np.zeros_like(packed), np.zeros_like(packed)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, STEPS + 1):
        weights, theta = packed[:n_words], _thresholds(packed[n_words:])
        s = np.bincount(rows, weights=value * weights[places], minlength=len(grade))
        bound = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = sigmoid(bound[grade + 1] - s), sigmoid(bound[grade] - s)
        upper, lower = np.where(grade == levels - 1, 1.0, upper), np.where(grade == 0, 0.0, lower)
        p = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
        slope_s = (up - low) / len(grade)
        slope_theta = np.zeros(levels - 1)
        for k in range(levels - 1):
            slope_theta[k] = (-up[grade == k].sum() + low[grade == k + 1].sum()) / len(grade)
        slope = np.concatenate([np.bincount(places, weights=value * slope_s[rows], minlength=n_words) + PENALTY * weights, [slope_theta.sum()], [slope_theta[j + 1 :].sum() * np.exp(packed[n_words + 1 + j]) for j in range(levels - 2)]])
        m += 0.1 * (slope - m)
        v += 0.01 * (slope * slope - v)
        packed = packed - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return packed[:n_words], _thresholds(packed[n_words:])


def _thresholds(packed: np.ndarray) -> np.ndarray:
    return packed[0] + np.concatenate([[0.0], np.cumsum(np.exp(packed[1:]))])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, seed: int = 0) -> Model:
    """``labels`` has doc_id and toxic (0 or 1, or a higher grade); of several for a document the highest counts, of several texts of an id the least."""
    ids = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= fit_bytes).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    texts, given = pa.array(rows["text"].tolist(), pa.string()), rows["toxic"].to_numpy(np.int64)
    return fit_texts(texts, given)


def fit_texts(texts: pa.Array, given: np.ndarray) -> Model:
    toxic = given > 0
    if not toxic.any() or toxic.all():
        share = (toxic.sum() + 1) / (len(toxic) + 2) if len(toxic) else 1e-3
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.array([np.log((1 - share) / share), np.log((1 - share) / share) + 1]))
    words, marks = select_words(texts, toxic)
    counts = batch_counts(texts, words)
    if given.max() == 1:
        given = grades(*counts, marks, toxic)
    return Model(words, *train(*counts, len(words), given, int(max(given.max(), 1)) + 1))


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """Ids with the chance of any toxicity, the expected severity and the likeliest grade."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            rows, places, counts = batch_counts(batch.column(1), model.words)
            s = np.bincount(rows, weights=np.log1p(counts) * model.weights[places] if len(places) else None, minlength=batch.num_rows)
            upto = 1 / (1 + np.exp(-np.clip(model.thresholds - s[:, None], -30, 30)))
            each = np.diff(np.hstack([np.zeros((len(s), 1)), upto, np.ones((len(s), 1))]), axis=1)
            expected = each @ np.arange(each.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 - upto[:, 0]), pa.array(expected), pa.array(each.argmax(1).astype(np.int32))], ["id", "score", "expected_severity", "grade"])

    rows = docs.select(F.col(id_column).alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, score double, expected_severity double, grade int").withColumnRenamed("id", id_column)
