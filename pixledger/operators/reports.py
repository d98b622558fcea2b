"""Collection-wide reports over the metadata table.

Each is one aggregate with map-side combine on small keys, so a tool, folder or
value that covers much of the catalog costs one row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixledger.operators.sections import section_flags
from pixledger.schemas import CORE_KEYS, SECONDARY_LABELS


def tool_distribution(metadata: DataFrame) -> DataFrame:
    """Files per (folder, tool), per folder and in all; totals have NULLs."""
    return metadata.rollup("folder", "tool").agg(F.count(F.lit(1)).alias("files"))


def param_facets(metadata: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Files per value of each core and secondary param."""
    keys = keys or [*CORE_KEYS, *SECONDARY_LABELS]
    wanted = F.map_filter("params", lambda key, value: key.isin(keys) & (value != ""))
    return (
        metadata.select(F.explode(wanted).alias("key", "value"))
        .groupBy("key", "value")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def _weight(text: F.Column) -> F.Column:
    """A number as Python reads it; the suffixes the JVM allows (``1f``, ``0.5d``) make none."""
    return F.when(~text.rlike(r"[dDfF]\s*\z"), text.try_cast("double"))


def lora_rows(metadata: DataFrame) -> DataFrame:
    """One row per LoRA mention: file_id, lora, weight (NULL if none or no number)."""
    mention = F.col("_mention")
    at = F.instr(mention, ":")
    return metadata.select("file_id", F.explode("loras").alias("_mention")).select(
        "file_id",
        F.when(at > 0, F.substr(mention, F.lit(1), at - 1)).otherwise(mention).alias("lora"),
        _weight(F.when(at > 0, F.substr(mention, at + 1))).alias("weight"),
    )


def lora_usage(metadata: DataFrame) -> DataFrame:
    """Files, mentions and mean weight per LoRA.

    A file's mentions are merged inside its row, so counting files needs no
    distinct.
    """
    name = lambda mention: F.substring_index(mention, ":", 1)
    per_file = metadata.select(
        F.explode(F.array_distinct(F.transform("loras", name))).alias("lora"), "loras"
    )
    weights = F.transform(
        F.filter("loras", lambda mention: (name(mention) == F.col("lora")) & F.contains(mention, F.lit(":"))),
        lambda mention: _weight(F.substr(mention, F.instr(mention, ":") + 1)),
    )
    known = F.filter("_weights", lambda w: w.isNotNull())
    mentions = F.size(F.filter("loras", lambda mention: name(mention) == F.col("lora")))
    return (
        per_file.withColumns({"_weights": weights, "_mentions": mentions})
        .select(
            "lora",
            "_mentions",
            F.aggregate(known, F.lit(0.0), lambda total, w: total + w).alias("_sum"),
            F.size(known).alias("_n"),
        )
        .groupBy("lora")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("_mentions").alias("mentions"),
            (F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean_weight"),
        )
    )


def completeness_report(metadata: DataFrame) -> DataFrame:
    """Per tool: files, and the share of them that fill each section."""
    flags = ["has_core", "has_secondary", "has_model", "has_advanced"]
    return (
        section_flags(metadata.where(F.col("tool").isNotNull()))
        .groupBy("tool")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.avg((F.col("prompt") != "").cast("double")).alias("prompt_share"),
            *[F.avg(F.col(flag).cast("double")).alias(flag.replace("has_", "") + "_share") for flag in flags],
        )
    )
