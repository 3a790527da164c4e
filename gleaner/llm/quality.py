"""Quality classification by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover it from end to end. Learned filters
of ``WIDTH`` bytes slide over every byte; their rectified outputs are max-pooled over each chunk, and
the chunks' vectors are combined, by mean and by maximum, into the input of one logistic unit.

A filter is a table of weights for each byte at each of its places, so applying it is a sum of table
look-ups; two places are looked up at once. Training runs on the driver on a bounded sample: at most
``FIT_ROWS`` labelled documents of at most ``FIT_BYTES`` bytes each, chosen by a hash of their ids.
Scoring covers all bytes of all texts, in slices of a few MB.

Defined cases: null and empty texts are a chunk of zero bytes and get the score of that; with no
labels, or labels of one kind only, every score is the smoothed share of good ones; equal texts get
equal scores, repeated rows too; an empty table gives no rows; other columns pass, and if one is named
like the score, the added column gets underscores before its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import textscan
from gleaner.llm.common import free_name, on_plain_names

FILTERS, WIDTH = 8, 6
#: Bytes of a block; a chunk is CHUNK blocks and the next one starts STRIDE blocks later.
BLOCK, CHUNK, STRIDE = 64, 4, 3
FIT_ROWS, FIT_BYTES = 3000, 16_384
EPOCHS, BATCH, RATE = 8, 32, 0.02


@dataclass
class Model:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 2 * FILTERS
    offset: float

    def pair_tables(self) -> np.ndarray:
        """For places 2j and 2j + 1 together: WIDTH / 2 x 65536 x FILTERS."""
        f = self.filters
        return (f[0::2, :, None, :] + f[1::2, None, :, :]).reshape(WIDTH // 2, 65536, FILTERS)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts at multiples of BLOCK with zero bytes between, and each one's first block."""
    blocks = -(-(np.diff(offsets) + WIDTH) // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(first[-1] * BLOCK + WIDTH, np.uint8)
    for at, lo, hi in zip((first[:-1] * BLOCK).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out[at : at + hi - lo] = data[lo:hi]
    return out, first


def chunk_blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last block of every chunk, and each text's first chunk. The last chunk ends with its text."""
    blocks = np.diff(first)
    chunks = np.maximum(1, -(-(blocks - CHUNK) // STRIDE) + 1)
    start = np.concatenate([[0], np.cumsum(chunks)])
    k = np.arange(start[-1]) - np.repeat(start[:-1], chunks)
    begin = np.repeat(first[:-1], chunks) + k * STRIDE
    return begin, np.minimum(begin + CHUNK, np.repeat(first[1:], chunks)) - 1, start


def convolve(tables: np.ndarray, out: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Filter outputs, without bias, at every byte before the final padding.

    Each text ends in zero bytes; where a filter would reach over them into the next text, it gets
    what it gives on zero bytes.
    """
    n = len(out) - WIDTH
    pair = out[:-1].astype(np.int32) * 256 + out[1:]
    total = tables[0][pair[:n]]
    for j in range(1, WIDTH // 2):
        total += tables[j][pair[2 * j : n + 2 * j]]
    ends = first[1:] * BLOCK
    for j in range(1, WIDTH):
        total[ends - j] = total[ends - WIDTH]
    return total


def pool(outputs: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximum over each chunk."""
    tops = outputs.reshape(-1, BLOCK, FILTERS).max(1)
    found = tops[begin]
    for j in range(1, CHUNK):
        np.maximum(found, tops[np.minimum(begin + j, end)], out=found)
    return found


def features(pooled: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.hstack([np.add.reduceat(pooled, start[:-1]) / np.diff(start)[:, None], np.maximum.reduceat(pooled, start[:-1])])


def train(texts: list[bytes], good: np.ndarray, seed: int = 0) -> Model:
    """Adam on the logistic loss; gradients reach a filter at the byte where its chunk's maximum is."""
    rng = np.random.default_rng(seed)
    share = (good.sum() + 1) / (len(good) + 2)
    model = Model(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), float(np.log(share / (1 - share))))
    if good.all() or not good.any():
        return model
    model.weights = rng.normal(0, 0.3, 2 * FILTERS)
    state: dict[str, list[np.ndarray]] = {}
    step = 0

    def adam(name: str, value: np.ndarray, slope: np.ndarray) -> np.ndarray:
        m, v = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m += 0.1 * (slope - m)
        v += 0.01 * (slope * slope - v)
        return value - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)

    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            step += 1
            own = [texts[i] for i in pick]
            data = np.frombuffer(b"".join(own), np.uint8)
            out, first = padded(data, np.concatenate([[0], np.cumsum([len(t) for t in own])]))
            begin, end, start = chunk_blocks(first)
            outputs = convolve(model.pair_tables(), out, first)
            raw = pool(outputs, begin, end) + model.bias
            pooled = np.maximum(raw, 0)
            x = features(pooled, start)
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.offset, -30, 30)))
            slope = (p - good[pick]) / len(pick)
            back = slope[:, None] * model.weights
            text_of = np.repeat(np.arange(len(pick)), np.diff(start))
            down = back[text_of, :FILTERS] / np.diff(start)[text_of, None]
            top = np.maximum.reduceat(pooled, start[:-1])[text_of]
            down = down + np.where(pooled == top, back[text_of, FILTERS:], 0)
            down = np.where(raw > 0, down, 0).astype(np.float32)
            shaped = np.zeros_like(model.filters)
            windows = outputs.reshape(-1, BLOCK, FILTERS)
            tops, arg = windows.max(1), windows.argmax(1)
            reach = np.minimum(begin[:, None] + np.arange(CHUNK), end[:, None])
            winner = np.take_along_axis(reach[:, :, None] + np.zeros(FILTERS, np.int64), tops[reach].argmax(1)[:, None, :], 1)[:, 0, :]
            place = winner * BLOCK + arg[winner, np.arange(FILTERS)]
            for j in range(WIDTH):
                np.add.at(shaped[j], (out[place + j], np.broadcast_to(np.arange(FILTERS), place.shape)), down)
            model.filters = adam("filters", model.filters, shaped + 1e-5 * model.filters)
            model.bias = adam("bias", model.bias, down.sum(0))
            model.weights = adam("weights", model.weights, x.T @ slope + 1e-4 * model.weights)
            model.offset = float(adam("offset", np.array([model.offset]), np.array([slope.sum()]))[0])
    return model


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, seed: int = 0) -> Model:
    """``labels`` has doc_id and quality (0 or 1); of several for a document, and of several texts of an id, the least counts.

    The ids are chosen on the labels alone, and at most ``fit_rows`` of them are sent to the documents.
    """
    ids = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(fit_rows)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).filter(F.octet_length("text") <= fit_bytes).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.encode(F.min("text"), "utf-8").alias("text")).toPandas()
    rows = rows.sort_values("doc_id")
    return train([bytes(t) for t in rows["text"]], rows["quality"].to_numpy() > 0, seed)


def score_batch(texts: pa.Array, model: Model, tables: np.ndarray) -> np.ndarray:
    texts = textscan.as_strings(texts)
    data, offsets = textscan.buffers(texts)
    scores, lo = np.zeros(len(texts)), 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + textscan.SLICE_BYTES // 4, "right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        if offsets[hi] - offsets[lo] > textscan.SLICE_BYTES:
            pooled, start = _long(data[offsets[lo] : offsets[hi]], tables), np.array([0, 0])
            start[1] = len(pooled)
        else:
            out, first = padded(data, offsets[lo : hi + 1])
            begin, end, start = chunk_blocks(first)
            pooled = pool(convolve(tables, out, first), begin, end)
        z = features(np.maximum(pooled + model.bias, 0), start) @ model.weights + model.offset
        scores[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        lo = hi
    return scores


def _long(data: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The pooled chunks of one very long text, its blocks' maxima taken a stretch at a time."""
    out, first = padded(data, np.array([0, len(data)]))
    step = textscan.SLICE_BYTES // 4
    tops = [convolve(tables, out[at : at + step + WIDTH], first[:1]).reshape(-1, BLOCK, FILTERS).max(1) for at in range(0, len(out) - WIDTH, step)]
    begin, end, _ = chunk_blocks(first)
    tops = np.concatenate(tops)
    return np.maximum.reduce([tops[np.minimum(begin + j, end)] for j in range(CHUNK)])


def score(docs: DataFrame, model: Model, text_column: str = "text", name: str = "score", keep_text: bool = True) -> DataFrame:
    """``docs`` with each text's probability of being good in a last column."""
    return on_plain_names(docs, lambda plain: _score(plain, model, text_column, name, keep_text), text_column)


def _score(docs: DataFrame, model: Model, text_column: str, name: str, keep_text: bool) -> DataFrame:
    (name,) = free_name(docs, name)
    held = docs.sparkSession.sparkContext.broadcast(model)
    outputs = [c for c in docs.columns if keep_text or c != text_column]
    inputs = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        tables = model.pair_tables()
        for batch in batches:
            scores = pa.array(score_batch(batch.column(inputs.index(text_column)), model, tables))
            yield pa.RecordBatch.from_arrays([*[batch.column(inputs.index(c)) for c in outputs], scores], [*outputs, name])

    return docs.mapInArrow(run, docs.select(*[f"`{c}`" for c in outputs]).schema.add(name, "double"))


def accept(docs: DataFrame, model: Model, least: float = 0.5, text_column: str = "text") -> DataFrame:
    """The documents whose score is at least ``least``."""

    def good(plain: DataFrame) -> DataFrame:
        scored = _score(plain, model, text_column, "score", True)
        return scored.filter(F.col(scored.columns[-1]) >= least).drop(scored.columns[-1])

    return on_plain_names(docs, good, text_column)
