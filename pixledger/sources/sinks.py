"""Writing the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_FILE = 5_000_000


def write_catalog(metadata: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by tool, in few files. The rebalancing shuffle lets Spark split a tool
    that made most files and merge the small ones; file size is bounded besides."""
    (
        metadata.hint("rebalance", "tool").write.mode(mode)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy("tool")
        .parquet(path)
    )


def read_catalog(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_json(rows: DataFrame, out: str = "json") -> DataFrame:
    """Each row as one JSON object with nulls kept."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias(out))
