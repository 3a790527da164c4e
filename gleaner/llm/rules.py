"""Quality rules kept as a ledger of failure bits.

Each rule is evaluated once per document; the ledger row holds what was measured and one bit per
failed rule. A policy is a set of rules under a version name, that is, a mask: applying another
version or asking what each rule alone removes needs the ledger only, not the texts.

Defined cases: null and empty texts have no words and fail ``few_words``; an empty table gives an
empty ledger; other columns do not matter; equal rows, repeated ones too, get equal ledger rows; very
long texts are measured whole, a slice of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import textscan

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaims")

#: A rule's place is its bit and never changes; new rules are added at the end.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > 5 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "repeated_lines": "n_lines > 3 AND 10 * n_dup_lines > 5 * n_lines",
    "shouting": "n_letters >= 40 AND 10 * n_upper > 7 * n_letters",
    "exclaiming": "10 * n_exclaims > 5 * n_words AND n_words > 0",
}
#: Versioned policies: names of the rules that reject a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols", "short_words", "long_words", "shouting"),
    "v2": tuple(RULES),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True


def measure_batch(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of every text in an Arrow string array."""
    texts = textscan.as_strings(texts)
    out = {m: np.zeros(len(texts), np.int64) for m in MEASURES}
    for part in textscan.slices(texts):
        rows = slice(part.lo, part.hi)
        out["n_words"][rows] = np.diff(part.bounds)
        lead = (part.data & 0xC0) != 0x80
        out["word_chars"][rows] = textscan.per_row_sum(lead & textscan.NOT_SPACE[part.data], part.offsets)
        out["n_symbols"][rows] = textscan.per_row_sum(_SYMBOL[part.data], part.offsets)
        out["n_upper"][rows] = textscan.per_row_sum(_UPPER[part.data], part.offsets)
        out["n_letters"][rows] = textscan.per_row_sum(_LETTER[part.data], part.offsets)
        out["n_exclaims"][rows] = textscan.per_row_sum(part.data == 0x21, part.offsets)
        out["n_repeat_words"][rows] = repeated_words(part)
    for i, text in enumerate(texts):
        text = text.as_py()
        if "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            out["n_lines"][i], out["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
        else:
            out["n_lines"][i] = min(1, out["n_words"][i])
    return out


def repeated_words(part: textscan.Slice, width: int = 5) -> np.ndarray:
    """Words, for each row, in ``width``-word windows that the row has twice or more."""
    hashes, first = textscan.windows(part.hashes(), part.bounds, width)
    row = np.searchsorted(part.bounds, first, "right") - 1
    keys = textscan.mix64(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    n = int(part.bounds[-1])
    edge = np.zeros(n + width + 1, np.int64)
    np.add.at(edge, first[again], 1)
    np.add.at(edge, first[again] + width, -1)
    return textscan.per_row_sum(np.cumsum(edge)[:n] > 0, part.bounds)


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids with the measures of their texts."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure_batch(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[m]) for m in MEASURES]], ["id", *MEASURES])

    schema = ", ".join([f"id {id_type}", *[f"{m} long" for m in MEASURES]])
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def ledger(measures: DataFrame) -> DataFrame:
    """The measures with ``fail_bits``: bit k is set where rule k fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measures.withColumn("fail_bits", total.cast("long"))


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(rule) for rule in POLICIES[policy])


def passes(policy: str) -> F.Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects.

    Rows are first counted by their bits, so what is left to go over is at most one row for each
    combination of failed rules.
    """
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << list(RULES).index(name)).cast("long").alias("bit")) for name in POLICIES[policy]])
    each = counts.select("bits", "n", F.explode(rules).alias("r"))
    fails, alone = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_fail"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only"))
