"""Exact deduplication by skew-safe combining.

Rows with the same text become one in three stages, each of which groups by the digest and the text
itself, so that a digest never stands for a text: copies in a task are combined before anything
moves, the digests of many rows are merged under salts, and the winners of the salts are combined
into one winner a text. A salt is the number of the task that read the row, so a task sends each text
once, however many copies it holds; texts of few rows have no salt and are merged at once. Every step
is a DataFrame function. Texts cross the network once, those of salted digests a second time.

The rows are then labelled by digest. Winners of digests that stand for one text label by broadcast
(salted digests, whose number has a bound) or by a join in which no key has many rows; a digest that
stands for several texts is labelled by the text.

Defined cases: a null text counts as the empty text; a null id is smaller than any other; of rows
that are equal in id and text exactly one stays; very long texts are compared whole; an empty table
gives no rows; other columns pass through ``deduplicate``, whatever their names and types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import keep, plain_names, quoted

#: A digest is salted if it has more than this share of a shuffle partition's rows, so at most HOT_PARTS x partitions are.
HOT_PARTS = 4
SALTS = 256


def sha256(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(text, 256))


def _hot_rows(rows: DataFrame, total: int) -> int:
    """Rows from which on a digest is salted."""
    return max(1, total // (HOT_PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _salted(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with the salt of hot digests, -1 elsewhere."""
    marked = rows.join(F.broadcast(hot.select("digest", F.lit(True).alias("hot"))), "digest", "left")
    return marked.withColumn("salt", F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(F.lit(-1))).drop("hot")


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest: Callable[[F.Column], F.Column] = sha256) -> DataFrame:
    """One row a document: id, digest, keep_id (the largest id of its text), size (rows of its text) and kept."""
    rows = docs.select(quoted(id_column).alias("id"), F.coalesce(quoted(text_column), F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))
    slim = keep(rows.select("id", "digest", F.monotonically_increasing_id().alias("row")))
    last = F.coalesce(F.max_by("row", "id"), F.max("row")).alias("last")
    repeated = keep(slim.groupBy("digest").agg(F.count(F.lit(1)).alias("all"), last).filter("all > 1"))
    hot = keep(repeated.filter(F.col("all") > _hot_rows(rows, slim.count())).select("digest"))

    merged = _salted(rows, hot).groupBy("digest", "salt", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
    merged = keep(merged.select("digest", "salt", F.when(F.col("salt") >= 0, F.col("text")).alias("text"), "keep_id", "size"))
    combined = merged.filter("salt >= 0").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("size").alias("size"))
    found = merged.filter("salt < 0").select("digest", "keep_id", "size").unionByName(combined.drop("text"))
    # A digest has as many rows as its text, or else it stands for several texts.
    winners = keep(found.join(repeated, "digest").withColumn("whole", F.col("size") == F.col("all")).drop("all"))
    several = winners.filter("NOT whole").select("digest").distinct()

    few = F.broadcast(hot)
    labels = winners.filter("whole").drop("whole")
    cold = slim.join(few, "digest", "left_anti").join(labels.join(few, "digest", "left_anti"), "digest", "left")
    labelled = cold.unionByName(slim.join(F.broadcast(labels.join(few, "digest", "left_semi")), "digest"))
    out = ["id", "digest", F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("size"), F.coalesce(F.col("row") == F.col("last"), F.lit(True)).alias("kept")]
    if several.isEmpty():
        return labelled.select(*out)
    exact = keep(rows.join(several, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()))
    by_text = exact.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("size"), last)
    return labelled.join(several, "digest", "left_anti").select(*out).unionByName(exact.join(by_text, ["digest", "text"]).select(*out))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest: Callable[[F.Column], F.Column] = sha256) -> DataFrame:
    """The rows that stay, with their own columns: of each text the row with the largest id."""
    plain, named = plain_names(docs)
    rows = plain.select(F.struct(*plain.columns).alias("whole"), F.struct(named[id_column]).alias("id"), F.coalesce(named[text_column], F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))
    counts = keep(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("all")))
    total = counts.agg(F.sum("all")).first()[0] or 0
    hot = keep(counts.filter(F.col("all") > _hot_rows(rows, total)).select("digest"))
    win = [F.max_by("whole", "id").alias("whole"), F.max("id").alias("id")]
    merged = _salted(rows, hot).groupBy("digest", "salt", "text").agg(*win)
    merged = keep(merged.select("digest", "salt", F.when(F.col("salt") >= 0, F.col("text")).alias("text"), "whole", "id"))
    combined = merged.filter("salt >= 0").groupBy("digest", "text").agg(*win)
    stay = merged.filter("salt < 0").select("whole").unionByName(combined.select("whole"))
    return stay.select("whole.*").toDF(*docs.columns)
