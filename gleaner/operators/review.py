"""Candidates for findings that no rule decides, and process requirements of a whole scan."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import retrieval
from gleaner.storage import keep

# The knowledge bases of single findings and how many candidates each gives, and those of a scan.
KBS = ("cwe", "iec", "cra")
PER_FINDING, PER_SCAN = 1, 8
CANDIDATE = "array<struct<key:string,title:string,text:string,score:double,matched_by:array<string>,text_zh:string>>"


def hybrid_candidates(asked: DataFrame, entries: DataFrame, k: int, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, rank, entry columns, dense_score, matched_by): the k best entries of one knowledge base.

    ``asked`` has query_id and query, ``entries`` kb, pos, text to search, embedding and a payload.
    ``embed`` adds the vector ``embedding`` to the queries; without it only words count.
    """
    sparse = retrieval.bm25_topk(asked, entries)
    return _fused(sparse, asked, entries, k, embed)


def _fused(sparse: DataFrame, asked: DataFrame, entries: DataFrame, k: int, embed: Callable[[DataFrame], DataFrame] | None, vectors: DataFrame | None = None) -> DataFrame:
    if embed is None:
        dense = sparse.select("query_id", "pos", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("dense_rank")).limit(0)
    else:
        own = entries.select("pos", "embedding") if vectors is None else entries.select("pos").join(vectors.select("pos", "embedding"), "pos")
        dense = retrieval.dense_topk(embed(asked).select("query_id", "embedding"), own)
    fused = retrieval.hybrid(dense, sparse, ["query_id"], k, mode="sparse" if embed is None else "both")
    # Kept, so its size is known: few rows are broadcast to the entries, whose texts then stay where they are read.
    best = keep(fused.select("query_id", "pos", "rank", "dense_score", "matched_by"))
    return best.join(entries.drop("embedding", "kb"), "pos")


def with_candidates(findings: DataFrame, kb: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, k: int = PER_FINDING, text: str = "query", vectors: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """``findings`` with ``rag``, a struct of an array of candidates for each knowledge base.

    Only findings that need review are looked up, and each of their texts once, whatever the number of
    findings that have it. ``kb`` has kb, pos, key, title, body (text), text to search and embedding; with
    ``vectors`` (pos, embedding) it has no embedding, so texts are not moved to be joined with theirs.
    Without ``texts`` candidates have none, and no finding's row carries those of its candidates.
    """
    review = findings.filter("status = 'needs_review'").select(F.col(text).alias("query")).distinct()
    asked = keep(review.withColumn("query_id", F.xxhash64("query")))
    found = asked.select("query_id", "query")
    # One search over the words of all knowledge bases, which have statistics of their own.
    words = keep(retrieval.bm25_topk(asked, kb.filter(F.col("kb").isin(*KBS))))
    for name in KBS:
        best = _fused(words.filter(F.col("kb") == name), asked, kb.filter(F.col("kb") == name), k, embed, vectors)
        one = F.struct("key", "title", (F.col("body") if texts else F.lit(None).cast("string")).alias("text"), F.col("dense_score").alias("score"), "matched_by", F.lit(None).cast("string").alias("text_zh"))
        # At most k candidates a text.
        listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("one")))), lambda x: x["one"])
        found = found.join(best.groupBy("query_id").agg(listed.cast(CANDIDATE).alias(name)), "query_id", "left")
    none = F.array().cast(CANDIDATE)
    # A row a text, kept: however often the findings are read, nothing is searched again.
    rag = keep(found.select(F.col("query").alias(text), F.struct(*[F.coalesce(name, none).alias(name) for name in KBS]).alias("rag")))
    looked_up = findings.withColumn("asked", F.when(F.col("status") == "needs_review", F.col(text)))
    return looked_up.join(rag.withColumnRenamed(text, "asked"), "asked", "left").drop("asked")


def process_requirements(asked: DataFrame, entries: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, rank and entry columns): the process requirements nearest to each scan's query text.

    A scan without findings has no query text and no rows, and neither has one of an empty knowledge base.
    """
    return hybrid_candidates(asked.filter("coalesce(query, '') <> ''"), entries, PER_SCAN, embed)
