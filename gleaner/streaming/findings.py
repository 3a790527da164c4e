"""Classification of findings as they arrive. The steps keep no state, so any output mode that appends will do."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.classify import classify

FINDING = "finding_id STRING, seq LONG, category STRING, target STRING, title STRING, service STRING, severity STRING, alert_risk STRING, cve_ids ARRAY<STRING>"


def classified(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the JSON findings that are put into a folder, classified."""
    return classify(spark.readStream.schema(FINDING).json(path))


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet folder, once each, and stop when all of it is there."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
