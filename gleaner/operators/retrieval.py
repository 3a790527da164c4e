"""Hybrid retrieval: BM25 and cosine over stored indexes, and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.text import tokenize
from gleaner.operators import index as ix
from gleaner.operators import vectors
from gleaner.operators.index import QUERY_BLOCK, Index, corpus_stats, entry_counts, term_weights
from gleaner.operators.vectors import VectorIndex

__all__ = ["bm25_topk", "corpus_stats", "dense_topk", "entry_counts", "fuse", "hybrid", "nearest_topk", "postings", "rrf", "search_topk", "term_counts", "term_weights", "top"]

# Constant of the fusion and how many candidates go into it.
FUSION_K = 60
CANDIDATES = 10


def postings(entries: DataFrame, kb: str = "kb", key: str = "pos", text: str = "text") -> DataFrame:
    """(kb, term, pos, tf, dl): one row for each term of an entry. A kb's statistics are its own."""
    tokens = entries.select(kb, key, tokenize(F.col(text)).alias("tokens"))
    each = tokens.select(kb, key, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return each.groupBy(kb, "term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))


def term_counts(entries: DataFrame, key: str = "pos", text: str = "text") -> DataFrame:
    """(term, n, df): how often a term occurs, and how many entries have it; an entry is a key that is not null.

    Where no key is repeated or null, each row counts its terms by itself: terms combine before the
    shuffle, which moves a row a term and task. Else rows of a key are brought together first.
    """
    keys = entries.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    tokens = entries.select(key, tokenize(F.col(text)).alias("tokens"))
    if keys.filter((F.col("rows") > 1) | F.col(key).isNull()).isEmpty():
        once = lambda array, n, df: F.transform(array, lambda t: F.struct(t.alias("term"), F.lit(n).alias("n"), F.lit(df).alias("df")))
        each = tokens.select(F.inline(F.concat(once(F.col("tokens"), 1, 0), once(F.array_distinct("tokens"), 0, 1))))
        return each.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    each = tokens.select(key, F.explode("tokens").alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("term").agg(F.sum("n").alias("n"), F.count(key).alias("df"))


def top(scored: DataFrame, by: list[str], score: str, key: str, k: int, rank: str) -> DataFrame:
    """The k best of each group. Spark limits each partition's groups before it shuffles them."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.round(score, 9).desc(), key))
    return scored.withColumn(rank, place).filter(F.col(rank) <= k)


def search_topk(queries: DataFrame, index: Index, k: int = CANDIDATES, kb: str = "kb", key: str = "pos", query: str = "query_id", block: int = QUERY_BLOCK) -> DataFrame:
    """(query, kb, pos, score, sparse_rank): k entries of the index a query and kb, whether or not they share a term.

    A term that a query repeats counts again. Entries without a common term score 0, so they come
    before those with a negative score; ties go by ``pos``.
    """
    found = ix.search(queries, index, k, query, block).withColumnsRenamed({"kb": kb, "pos": key})
    return top(found, [query, kb], "score", key, k, "sparse_rank")


def bm25_topk(queries: DataFrame, entries: DataFrame, k: int = CANDIDATES, kb: str = "kb", key: str = "pos", query: str = "query_id", text: str = "text", block: int = QUERY_BLOCK) -> DataFrame:
    """``search_topk`` over entries without an index, which is built and kept for this search."""
    return search_topk(queries, ix.build(entries, kb, key, text).keep(), k, kb, key, query, block)


def nearest_topk(queries: DataFrame, index: VectorIndex, k: int = CANDIDATES, key: str = "pos", query: str = "query_id", vector: str = "embedding", block: int = vectors.QUERY_BLOCK) -> DataFrame:
    """(query, pos, score, dense_rank): the k entries of a vector index nearest by cosine.

    Entries without a vector, with one of zeros, or with one of another length than the query's are
    left out; ties go by ``pos``.
    """
    found = vectors.search(queries, index, k, query, vector, block).withColumnRenamed("pos", key)
    return top(found, [query], "score", key, k, "dense_rank")


def dense_topk(queries: DataFrame, entries: DataFrame, k: int = CANDIDATES, key: str = "pos", query: str = "query_id", vector: str = "embedding", block: int = vectors.QUERY_BLOCK) -> DataFrame:
    """``nearest_topk`` over entries without an index, which is built and kept: a task that built and searched would hold two Python workers."""
    return nearest_topk(queries, vectors.build(entries, key, vector).keep(), k, key, query, vector, block)


def rrf(rank: Column, k: int = FUSION_K) -> Column:
    """What a place in one list adds to an entry's fused score."""
    return F.lit(1.0) / (F.lit(k) + rank)


def fuse(lists: DataFrame, by: list[str], k: int = FUSION_K) -> DataFrame:
    """Fused scores of (list, rank, key) rows; a key that a list repeats counts again."""
    return lists.groupBy(*by).agg(F.sum(rrf(F.col("rank"), k)).alias("rrf"))


def hybrid(dense: DataFrame, sparse: DataFrame, by: list[str], k: int, key: str = "pos", mode: str = "both") -> DataFrame:
    """The k best by fusion of the two candidate lists, with what matched them.

    ``dense`` has score and dense_rank, ``sparse`` sparse_rank. Ties go to the dense list's order,
    then to the sparse list's. ``mode`` is both, dense or sparse, for when one side is missing.
    """
    d = dense.select(*by, key, F.col("score").alias("dense_score"), "dense_rank")
    s = sparse.select(*by, key, "sparse_rank")
    d, s = (d.limit(0) if mode == "sparse" else d), (s.limit(0) if mode == "dense" else s)
    both = d.join(s, [*by, key], "full_outer")
    zero = F.lit(0.0)
    score = F.coalesce(rrf(F.col("dense_rank")), zero) + F.coalesce(rrf(F.col("sparse_rank")), zero)
    matched = F.array_compact(F.array(F.when(F.col("dense_rank").isNotNull(), "dense"), F.when(F.col("sparse_rank").isNotNull(), "sparse")))
    order = F.coalesce(F.col("dense_rank"), F.lit(1_000_000) + F.col("sparse_rank"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.round("rrf", 12).desc(), "order"))
    return both.withColumns({"rrf": score, "matched_by": matched, "order": order}).withColumn("rank", place).filter(F.col("rank") <= k).drop("order")
