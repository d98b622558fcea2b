"""From embedded tags to one metadata record per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixledger.functions import jsonvalues as jv
from pixledger.functions import paths
from pixledger.operators.a1111 import parse_a1111
from pixledger.operators.comfy import parse_comfy
from pixledger.operators.inventory import check_limits, only_images
from pixledger.operators.json_formats import parse_flat_json, parse_swarm, with_json_object
from pixledger.operators.stages import settle
from pixledger.schemas import (
    METADATA_COLUMNS,
    MODEL_TYPE,
    NOVELAI_PROMPT_PREFIX,
    TOOL_NOVELAI,
    TOOL_UNKNOWN,
)

TAG_COLUMNS = ["parameters", "prompt_json", "workflow_json", "user_comment", "sidecar_text"]


def attach_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Add the text of ``<stem>.txt`` in the same folder as ``sidecar_text``.

    (folder, stem) is unique among sidecars and near-unique among images, so the
    join key cannot be hot; its sides are plain columns before the join.
    """
    keyed = files.withColumn("_stem", paths.stem(F.col("name")))
    texts = sidecars.select("folder", F.col("stem").alias("_stem"), F.col("text").alias("sidecar_text"))
    return keyed.join(texts, ["folder", "_stem"], "left").drop("_stem")


def with_novelai_prefix(df: DataFrame, record: str) -> DataFrame:
    """Parameter text whose prompt opens with the tell-tale phrase is NovelAI's."""
    parsed = F.col(record)
    return df.withColumn(
        record,
        F.when(
            F.startswith(parsed["prompt"], F.lit(NOVELAI_PROMPT_PREFIX)),
            parsed.withField("tool", F.lit(TOOL_NOVELAI)),
        ).otherwise(parsed),
    )


def resolve_records(df: DataFrame, out: str = "record") -> DataFrame:
    """Add the record of the first format that accepts, NULL if none does, and
    ``<out>_error``. Later parsers see only rows the earlier ones declined."""
    staged = with_json_object(df, "parameters", "_object")
    staged = staged.withColumn(
        "_comment", F.when(~F.coalesce(F.map_contains_key("_object", F.lit("sui_image_params")), F.lit(False)), F.col("user_comment"))
    )
    staged = with_json_object(staged, "_comment", "_comment_object")
    staged = parse_swarm(staged, ["_object", "_comment_object"], "_swarm", settled=False)

    undecided = F.col("_swarm").isNull()
    staged = staged.withColumns(
        {
            "_prompt_json": F.when(undecided, F.col("prompt_json")),
            "_workflow_json": F.when(undecided, F.col("workflow_json")),
        }
    )
    staged = parse_comfy(staged, "_prompt_json", "_workflow_json", "_comfy", settled=False)

    undecided = undecided & F.col("_comfy").isNull()
    staged = staged.withColumn("_object", F.when(undecided, F.col("_object")))
    staged = parse_flat_json(staged, "_object", "_novelai", "_easy", settled=False)

    undecided = undecided & F.col("_novelai").isNull() & F.col("_easy").isNull()
    staged = staged.withColumn("_text", F.when(undecided, F.col("parameters")))
    staged = parse_a1111(staged, "_text", "_a1111", settled=False)
    plain = ~jv.looks_like_object(F.col("_text"))
    staged = with_novelai_prefix(staged.withColumn("_a1111_text", F.when(plain, F.col("_a1111"))), "_a1111_text")

    undecided = undecided & F.col("_a1111").isNull()
    staged = staged.withColumn("_sidecar", F.when(undecided, F.col("sidecar_text")))
    staged = parse_a1111(staged, "_sidecar", "_from_sidecar", settled=False)

    order = ["_swarm", "_comfy", "_novelai", "_easy", "_a1111_text", "_a1111", "_from_sidecar"]
    resolved = staged.withColumns(
        {out: F.coalesce(*order), f"{out}_error": F.col("_comfy_error")}
    )
    temporary = (
        "_object", "_comment", "_comment_object", "_prompt_json", "_workflow_json", "_text",
        "_sidecar", "_comfy_error", *order,
    )
    return settle(resolved, out, f"{out}_error", drop=temporary)


def envelope(resolved: DataFrame, record: str = "record") -> DataFrame:
    """Lay the record out as metadata columns: defaults where nothing was
    recognised, the file's own name and size, and the error columns.

    A file beyond the limits keeps its error and no record.
    """
    value = F.col(record)
    rejected = F.col("error_type").isNotNull()
    field = lambda name, empty: F.when(~rejected, F.coalesce(value[name], empty)).alias(name)
    flagged = F.col(f"{record}_error")
    return resolved.select(
        "file_id",
        *[c for c in ("folder", "mtime", "length") if c in resolved.columns],
        field("tool", F.lit(TOOL_UNKNOWN)),
        field("prompt", F.when(value.isNull(), "")),
        field("negative_prompt", F.when(value.isNull(), "")),
        field("params", F.create_map().cast("map<string,string>")),
        field("loras", F.array().cast("array<string>")),
        field("models", F.array().cast(f"array<{MODEL_TYPE}>")),
        F.when(~rejected, value["date"]).alias("date"),
        F.when(~rejected, value["generation_time"]).alias("generation_time"),
        "width",
        "height",
        "name",
        F.coalesce("error_type", F.when(flagged.isNotNull(), F.lit("invalid_file"))).alias("error_type"),
        F.coalesce("error_message", flagged).alias("error_message"),
    )


def resolve_metadata(files: DataFrame) -> DataFrame:
    """Metadata of every image file, one row each, in one pass without a shuffle.

    Input: inventory columns plus the tag columns. Over-limit files get an error
    row and are not parsed.
    """
    checked = check_limits(only_images(files))
    usable = F.col("error_type").isNull()
    # Tags of rejected files are blanked so that no parser spends time on them.
    checked = checked.withColumns({c: F.when(usable, F.col(c)) for c in TAG_COLUMNS})
    return envelope(resolve_records(checked))


def metadata_table(resolved: DataFrame) -> DataFrame:
    return resolved.select(*METADATA_COLUMNS)
