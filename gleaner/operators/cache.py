"""Memo tables for generated texts, and the calls that fill them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import finding_signature, unsupported_citations
from gleaner.operators.store import KeyedStore
from gleaner.storage import keep


def signature_key(*parts: Column) -> Column:
    return F.concat_ws("::", *[F.coalesce(p, F.lit("")) for p in parts])


def rule_key(iec: Column, cra: Column, reason: Column, advice: Column, signature: Column) -> Column:
    digest = F.left(F.sha1(F.concat_ws("|", F.coalesce(reason, F.lit("")), F.coalesce(advice, F.lit("")))), F.lit(8))
    return F.concat(F.concat_ws("|", F.coalesce(iec, F.lit("")), F.coalesce(cra, F.lit("")), digest), F.lit("::"), signature)


def hits(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Rows with the answer that the cache has for their key, else null."""
    return rows.join(cache.select(key, "answer"), key, "left")


def misses(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """One row for each key that the cache lacks. Rows are reduced to distinct keys before they move; of several prompts the least is asked."""
    once = rows.groupBy(key).agg(F.min(F.struct("prompt", "allowed")).alias("one")).select(key, "one.*")
    return once.join(cache.select(key), key, "left_anti")


def generate(missing: DataFrame, ask: Callable[[str], str | None], key: str = "cache_key") -> DataFrame:
    """(key, allowed, answer) of the prompts, by an injected function. What it can't answer is not cached."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "allowed": batch["allowed"], "answer": [ask(p) for p in batch["prompt"]]})

    kind = missing.schema[key].dataType.simpleString()
    return missing.select(key, "prompt", "allowed").mapInPandas(run, f"{key} {kind}, allowed array<string>, answer string").filter("answer IS NOT NULL")


def fill(rows: DataFrame, cache: DataFrame, ask: Callable[[str], str | None], key: str = "cache_key") -> DataFrame:
    """The cache with answers for the rows' missing keys; those that cite other than allowed sources are discarded.

    The answers are written once, so later actions and retries don't ask again.
    """
    answers = keep(generate(misses(rows, cache, key), ask, key))
    good = answers.filter(F.size(unsupported_citations(F.col("answer"), F.col("allowed"))) == 0)
    return cache.select(key, "answer").unionByName(good.select(key, "answer"))


#: A kept cache: the text that a producer made for a key.
SCHEMA = "producer string, cache_key string, answer string"


def open_store(spark: SparkSession, path: str, buckets: int = 16) -> KeyedStore:
    """The caches of all producers in one versioned table; a folder without one is an empty table."""
    return KeyedStore(spark, path, SCHEMA, ["producer", "cache_key"], buckets)


def load(store: KeyedStore, producer: str, key: str = "cache_key") -> DataFrame:
    """A producer's cache as of the last version; a version that cannot be read is an error, not an empty cache."""
    return store.snapshot().filter(F.col("producer") == producer).select(F.col("cache_key").alias(key), "answer")


def save(store: KeyedStore, producer: str, cache: DataFrame, key: str = "cache_key") -> int:
    """Put answers into a producer's cache, the least of several of a key, in one step; the new version."""
    once = cache.groupBy(key).agg(F.min("answer").alias("answer"))
    return store.upsert(once.select(F.lit(producer).alias("producer"), F.col(key).alias("cache_key"), "answer"))


def signature(rows: DataFrame) -> Column:
    return finding_signature(F.col("category"), F.col("source"), F.col("title"))


def clause_key_of(reference: Column, signature: Column) -> Column:
    """Key of a remediation: what it refers to, and the kind of finding."""
    return signature_key(reference, signature)


def summary_key(signature: Column, weakness: Column, clause: Column, article: Column) -> Column:
    """Key of a summary: the kind of finding and its three candidates; an absent one counts as blank."""
    return signature_key(signature, weakness, clause, article)
