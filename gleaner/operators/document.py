"""One ordered document from many tasks: a JSON array, or a text for each of many targets.

Rows are dealt by ranges of their order, so a document of any size, and a target with any share of the
rows, is written by many tasks, and its parts stand in order of their names. Each part is written so
that the parts, one behind the other, are the document. ``assemble`` makes one file of them: where the
store can join files it moves no data, elsewhere the driver's JVM copies in pieces of a megabyte.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import storage
from gleaner.storage import keep


def _ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def write_array(rows: DataFrame, path: str, order: list[str], value: str = "value") -> None:
    """The JSON values of a column as one array in the order of the others, a value a line. Rows that tie come in any order."""
    own = keep(rows.select(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.col(value).alias("value")).withColumn("uid", F.monotonically_increasing_id()))
    names = [*[f"o{k}" for k in range(len(order))], "uid"]
    ends = own.agg(F.min(F.struct(*names))["uid"].alias("first"), F.max(F.struct(*names))["uid"].alias("last")).first()
    if ends["first"] is None:
        rows.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    line = F.concat(F.when(F.col("uid") == ends["first"], F.lit("[\n")).otherwise(F.lit("")), F.col("value"), F.when(F.col("uid") == ends["last"], F.lit("\n]")).otherwise(F.lit(",")))
    _ranged(own, names).select(line.alias("value")).write.mode("overwrite").text(path)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of an array that ``write_array`` wrote, its parts or the file made of them, read by many tasks."""
    lines = spark.read.text(path).filter(~F.col("value").isin("[", "]", "[]"))
    return lines.select(F.from_json(F.regexp_replace("value", ",$", ""), schema).alias("r")).select("r.*")


def write_texts(blocks: DataFrame, path: str, by: str = "target", order: tuple[str, ...] = ("section", "ord"), text: str = "text") -> None:
    """The texts of each target in order, a folder of parts a target."""
    own = keep(blocks.select(by, *order, text))
    _ranged(own, [by, *order]).select(by, text).write.mode("overwrite").partitionBy(by).text(path)


def parts(spark: SparkSession, path: str) -> list[str]:
    """The parts of a document in order."""
    return sorted(f"{path}/{name}" for name in storage.names(spark, path) if name.startswith("part-"))


def assemble(spark: SparkSession, path: str, to: str) -> None:
    """One file of a document's parts, put in place in one step; the parts go."""
    draft = f"{to}.{uuid.uuid4().hex}"
    storage.join_files(spark, parts(spark, path), draft)
    if not storage.rename_new(spark, draft, to):
        storage.remove(spark, draft)
        raise FileExistsError(to)
    storage.remove(spark, path)
