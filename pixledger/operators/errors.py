"""Error rows: what to tell the user, and whether to try again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixledger.schemas import DEFAULT_ERROR, ERRORS


def error_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERRORS, "error_type string, title string, suggestion string, can_retry boolean")


def classify_errors(rows: DataFrame) -> DataFrame:
    """Add title, suggestion and can_retry; unknown types count as server errors.

    The dimension is a constant of seven rows, so broadcasting it is safe.
    """
    known = [row[0] for row in ERRORS]
    kind = F.when(F.col("error_type").isin(known), F.col("error_type")).otherwise(DEFAULT_ERROR)
    dimension = error_dimension(rows.sparkSession).withColumnRenamed("error_type", "_kind")
    return (
        rows.withColumn("_kind", kind)
        .join(F.broadcast(dimension), "_kind", "left")
        .withColumn("error_type", F.col("_kind"))
        .drop("_kind")
    )
