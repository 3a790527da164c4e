"""Citations of texts against whitelists of any size, as a join by hash."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as tx


def cited(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, cite): the citations of each text in order, each once, with the place of the first."""
    each = texts.select(key, F.posexplode(F.array_distinct(tx.citations(F.col(text)))).alias("i", "cite"))
    return each


def unsupported(citations: DataFrame, allowed: DataFrame, by: list[str], number: str = "number") -> DataFrame:
    """The rows of ``citations`` (with cite) that no number of ``allowed`` covers; ``by`` are what both are matched within.

    Both sides give the keys that a cover has in common, so it is an equi-join: no citation is compared
    with numbers that it does not share a beginning with. With ``by`` empty there is one whitelist for all.
    """
    known = allowed.filter(F.coalesce(number, F.lit("")) != "").select(*by, F.explode(F.array_distinct(tx.cover_keys(tx.normalize(F.col(number)), False))).alias("cover_key")).distinct()
    # A citation that many texts share is matched once where the whitelist is the same for all.
    asked = citations.select(*by, "cite").distinct().withColumn("cover_key", F.explode(F.array_distinct(tx.cover_keys(tx.normalize(F.col("cite")), True))))
    good = asked.join(known, [*by, "cover_key"], "left_semi").select(*by, "cite").distinct()
    return citations.join(good, [*by, "cite"], "left_anti")
