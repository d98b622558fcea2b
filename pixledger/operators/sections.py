"""What a metadata panel shows: section flags, counts and entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixledger.schemas import CORE_KEYS, OTHER_KNOWN_KEYS, SECONDARY_LABELS

KNOWN_KEYS = [*CORE_KEYS, *SECONDARY_LABELS, *OTHER_KNOWN_KEYS]


def _filled(keys: list[str]) -> Column:
    """The keys, in the given order, whose param is not empty."""
    return F.filter(
        F.array(*[F.lit(key) for key in keys]),
        lambda key: F.coalesce(F.col("params")[key] != "", F.lit(False)),
    )


def _count(values: str) -> Column:
    return F.coalesce(F.size(values), F.lit(0))


def core_param_count(metadata: DataFrame) -> DataFrame:
    return metadata.withColumn("core_param_count", F.size(_filled(CORE_KEYS)))


def model_count(metadata: DataFrame) -> DataFrame:
    model = F.coalesce(F.col("params")["Model"] != "", F.lit(False)).cast("int")
    return metadata.withColumn("model_count", model + _count("loras") + _count("models"))


def compact_params(metadata: DataFrame) -> DataFrame:
    """Drop empty values from params."""
    return metadata.withColumn(
        "params", F.map_filter("params", lambda _, value: value.isNotNull() & (value != ""))
    )


def extra_keys(metadata: DataFrame) -> DataFrame:
    """Param keys no section knows."""
    return metadata.withColumn(
        "extra_keys", F.array_except(F.map_keys("params"), F.array(*[F.lit(key) for key in KNOWN_KEYS]))
    )


def section_flags(metadata: DataFrame) -> DataFrame:
    counted = extra_keys(model_count(metadata))
    return counted.withColumns(
        {
            "has_core": F.size(_filled(CORE_KEYS)) > 0,
            "has_secondary": F.size(_filled(list(SECONDARY_LABELS))) > 0,
            "has_model": F.col("model_count") > 0,
            "has_advanced": F.size("extra_keys") > 0,
        }
    ).drop("model_count", "extra_keys")


def secondary_entries(metadata: DataFrame) -> DataFrame:
    """One row per filled secondary param: file_id, pos, key, label, value."""
    labels = F.create_map(*[F.lit(x) for pair in SECONDARY_LABELS.items() for x in pair])
    return metadata.select(
        "file_id", "params", F.posexplode(_filled(list(SECONDARY_LABELS))).alias("pos", "key")
    ).select("file_id", "pos", "key", labels[F.col("key")].alias("label"), F.col("params")[F.col("key")].alias("value"))


def param_rows(metadata: DataFrame) -> DataFrame:
    """One row per param: file_id, key, value."""
    return metadata.select("file_id", F.explode("params").alias("key", "value"))


def model_rows(metadata: DataFrame) -> DataFrame:
    """One row per model of a file, with the short form of its hash."""
    return metadata.select("file_id", F.posexplode("models").alias("pos", "_model")).select(
        "file_id", "pos", "_model.name", "_model.param", "_model.hash", hash8(F.col("_model.hash")).alias("hash8")
    )


def hash8(value: Column) -> Column:
    return F.substring(value, 1, 8)
