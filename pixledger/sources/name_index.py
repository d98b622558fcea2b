"""Search by a part of the name in a large catalog, without reading all of it.

The catalog is written in groups of files that lie near each other in the order of folders and names, with a table of
the three-letter pieces that a group's names hold. A search intersects the groups of its own pieces, reads those groups,
by their folders' names, and applies the literal test to their rows. Common pieces cost one row a group, so the table grows
with groups times kinds of pieces, not with files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixledger.operators.inventory import search

GROUP, PIECE = "file_group", "piece"
ROWS, PIECES = "rows", "pieces"
LENGTH = 3
#: Folders of pieces, by their hash: a search lists and reads one for each of its pieces.
PIECE_BUCKETS = 64


def pieces(name: Column) -> Column:
    """The distinct pieces of ``LENGTH`` characters of a name as it is searched, lower-cased."""
    low = F.lower(name)
    last = F.char_length(low) - LENGTH + 1
    starts = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
    found = F.transform(starts, lambda i: F.substr(low, i, F.lit(LENGTH)))
    return F.when(last > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def _bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(PIECE_BUCKETS)).cast("int")


def write_indexed(inventory: DataFrame, path: str, groups: int) -> None:
    """Write rows with folder and name in about ``groups`` groups, and their pieces."""
    ordered = inventory.repartitionByRange(groups, "folder", "name").withColumn(GROUP, F.spark_partition_id())
    ordered.write.partitionBy(GROUP).parquet(f"{path}/{ROWS}")
    rows = inventory.sparkSession.read.parquet(f"{path}/{ROWS}")
    held = rows.select(GROUP, F.explode(pieces(F.col("name"))).alias(PIECE)).distinct()
    held.withColumn("bucket", _bucket(F.col(PIECE))).repartition("bucket").sortWithinPartitions("bucket", PIECE).write.partitionBy("bucket").parquet(f"{path}/{PIECES}")


def groups_with(spark: SparkSession, path: str, query: str) -> list[int] | None:
    """Numbers of the groups whose names hold every piece of ``query``; None if it is too short to have one."""
    asked = spark.range(1).select(F.explode(pieces(F.lit(query))).alias(PIECE)).withColumn("bucket", _bucket(F.col(PIECE))).collect()
    if not asked:
        return None
    held = spark.read.parquet(f"{path}/{PIECES}")
    held = held.where(F.col("bucket").isin(sorted({r["bucket"] for r in asked})) & F.col(PIECE).isin([r[PIECE] for r in asked]))
    full = held.groupBy(GROUP).agg(F.count("*").alias("n")).where(F.col("n") == len(asked))
    return sorted(r[GROUP] for r in full.collect())  # group numbers


def search_indexed(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The rows whose name contains ``query`` in any case, as ``inventory.search`` finds them."""
    rows = spark.read.parquet(f"{path}/{ROWS}")
    found = groups_with(spark, path, query)
    if found is not None:
        rows = rows.where(F.col(GROUP).isin(found)) if found else rows.where("false")
    return search(rows, query).drop(GROUP)
