"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures
from pixledger.operators.resolve import resolve_metadata

Query = Callable[[SparkSession, str], DataFrame]
# name -> (query, oracle SQL or None)
Queries = dict[str, tuple[Query, str | None]]


def params_text(params: str = "params") -> Column:
    """Params as sorted ``key=value`` pairs in one string."""
    return F.expr(
        f"coalesce(array_join(array_sort(transform(map_entries({params}), e -> concat(e.key, '=', e.value))), '|'), '')"
    )


def joined(values: str) -> Column:
    return F.coalesce(F.array_join(values, "|"), F.lit(""))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_metadata(fixtures.tagged_files(spark, sf_dir))


def usable_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata rows without the files beyond the limits."""
    return metadata(spark, sf_dir).where(F.col("tool").isNotNull())


def big_folders(inventory: DataFrame) -> DataFrame:
    """The inventory as if all files of one event type lay in one folder."""
    return inventory.withColumn("folder", F.regexp_replace("folder", "/user[0-9]+$", ""))
