"""Checks on knowledge bases before they are used."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.segments import LICENCE_LEAK


def duplicate_keys(entries: DataFrame, *key: str) -> DataFrame:
    return entries.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def count_check(entries: DataFrame, by: str, expected: Column, tolerance: int) -> DataFrame:
    """Whether each group has the expected number of entries, within a tolerance."""
    counts = entries.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("expected", expected).withColumn("ok", F.abs(F.col("n") - F.col("expected")) <= tolerance)


def text_check(entries: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Entries of each group without text, and with traces of a licence notice."""
    own = F.trim(F.coalesce(F.col(text), F.lit("")))
    return entries.groupBy(by).agg(F.count_if(own == "").alias("n_empty"), F.count_if(own.rlike(LICENCE_LEAK)).alias("n_leaks"), F.count(F.lit(1)).alias("n"))
