"""The constructor of findings: one form for all sources, with numbers that reruns agree on."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.scoring import LEVELS

ID_CHARS = 12


def finding_id(*parts: Column) -> Column:
    """A number made from what identifies a finding; null and the empty text differ."""
    digest = F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)
    return F.left(digest, F.lit(ID_CHARS))


def make_findings(rows: DataFrame, run: str = "run_id", order: str = "seq") -> DataFrame:
    """``rows`` (category, source, target, severity, title, detail) with finding_id and ``error``.

    A severity that is none of the five gives an error instead of stopping the job; ``valid`` and
    ``quarantined`` part the rows. A null detail is an empty object.
    """
    ident = finding_id(*[F.col(c) for c in (run, "source", "target", "title", order)])
    known = F.coalesce(F.col("severity").isin(*LEVELS), F.lit(False))
    error = F.when(~known, F.concat(F.lit("unknown severity: "), F.coalesce("severity", F.lit("null"))))
    return rows.withColumns({"finding_id": ident, "detail": F.coalesce("detail", F.lit("{}")), "error": error})


def valid(made: DataFrame) -> DataFrame:
    return made.filter("error IS NULL").drop("error")


def quarantined(made: DataFrame) -> DataFrame:
    return made.filter("error IS NOT NULL")
