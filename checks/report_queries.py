"""Panel sections and collection-wide reports over the metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import reference_sql as ref
from checks.common import Queries, joined, metadata, usable_metadata
from checks.folder_queries import COVERS, NODES
from pixledger import schemas
from pixledger.operators import reports, sections
from pixledger.plans.browse import folder_overview


def _over(function, *columns):
    return lambda spark, sf: function(usable_metadata(spark, sf)).select(*columns)


def extra_keys(spark, sf):
    kept = sections.extra_keys(usable_metadata(spark, sf))
    return kept.select("file_id", joined_sorted("extra_keys").alias("extra_keys"))


def joined_sorted(values):
    return F.array_join(F.array_sort(values), "|")


def overview(spark, sf):
    table = folder_overview(fx.inventory(spark, sf), metadata(spark, sf), "/")
    return table.select(
        "path", "has_children", joined("cover_images").alias("covers"), "image_count", "parsed_files", "main_tool"
    )


def completeness(spark, sf):
    report = reports.completeness_report(usable_metadata(spark, sf))
    return report.select(
        "tool", "files", *[F.round(c, 6).alias(c) for c in report.columns if c.endswith("_share")]
    )


def lora_usage(spark, sf):
    usage = reports.lora_usage(usable_metadata(spark, sf))
    return usage.select("lora", "files", "mentions", F.round("mean_weight", 6).alias("mean_weight"))


def _listed(values) -> str:
    return f"[{', '.join(repr(v) for v in values)}]"


_CORE, _OTHER = _listed(schemas.CORE_KEYS), _listed(schemas.OTHER_KNOWN_KEYS)
_SECONDARY, _LABELS = _listed(schemas.SECONDARY_LABELS), _listed(schemas.SECONDARY_LABELS.values())
_KEYS = "list_transform(params, lambda p: p.k)"
# The number of models by file, zero where there are none.
_MODELS = """model_counts AS (SELECT file_id, count(*) AS models FROM swarm_models GROUP BY ALL)"""
_CORE_COUNT = f"len(list_filter({_KEYS}, lambda k: list_contains({_CORE}, k)))"
_SECONDARY_COUNT = f"len(list_filter({_KEYS}, lambda k: list_contains({_SECONDARY}, k)))"
_MODEL_COUNT = (
    f"CAST(list_contains({_KEYS}, 'Model') AS INT) + len(loras) + CASE WHEN tool = 'SwarmUI' THEN coalesce(models, 0) ELSE 0 END"
)
_EXTRA = f"""list_filter({_KEYS}, lambda k: NOT list_contains({_CORE}, k) AND NOT list_contains({_SECONDARY}, k)
    AND NOT list_contains({_OTHER}, k))"""
_WITH_MODELS = "meta LEFT JOIN model_counts USING (file_id)"


def _oracle(sql):
    return fx.oracle(sql, inventory=True, tags=True, ctes=f"{ref.META}, {_MODELS}")


_FLAGS = f"""SELECT file_id, tool, prompt, {_CORE_COUNT} > 0 AS has_core, {_SECONDARY_COUNT} > 0 AS has_secondary,
    {_MODEL_COUNT} > 0 AS has_model, len({_EXTRA}) > 0 AS has_advanced FROM {_WITH_MODELS}"""

QUERIES: Queries = {
    "A7_core_param_count": (
        _over(sections.core_param_count, "file_id", "core_param_count"),
        _oracle(f"SELECT file_id, CAST({_CORE_COUNT} AS INT) AS core_param_count FROM meta"),
    ),
    "A8_model_count": (
        _over(sections.model_count, "file_id", "model_count"),
        _oracle(f"SELECT file_id, CAST({_MODEL_COUNT} AS INT) AS model_count FROM {_WITH_MODELS}"),
    ),
    "U2_extra_keys": (
        extra_keys,
        _oracle(f"SELECT file_id, coalesce(array_to_string(list_sort({_EXTRA}), '|'), '') AS extra_keys FROM meta"),
    ),
    "F14_section_flags": (
        _over(sections.section_flags, "file_id", "has_core", "has_secondary", "has_model", "has_advanced"),
        _oracle(f"SELECT file_id, has_core, has_secondary, has_model, has_advanced FROM ({_FLAGS})"),
    ),
    "F15_secondary_entries": (
        lambda spark, sf: sections.secondary_entries(usable_metadata(spark, sf)),
        _oracle(
            f"""SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY slot) - 1 AS INT) AS pos, key,
              {_LABELS}[slot] AS label, value
            FROM (SELECT file_id, p.k AS key, p.v AS value, list_position({_SECONDARY}, p.k) AS slot
              FROM (SELECT file_id, unnest(params) AS p FROM meta)) WHERE slot > 0"""
        ),
    ),
    "D6_param_rows": (
        lambda spark, sf: sections.param_rows(usable_metadata(spark, sf)),
        _oracle("SELECT file_id, p.k AS key, p.v AS value FROM (SELECT file_id, unnest(params) AS p FROM meta)"),
    ),
    "L1_tool_distribution": (
        lambda spark, sf: reports.tool_distribution(usable_metadata(spark, sf)),
        _oracle("SELECT folder, tool, count(*) AS files FROM meta GROUP BY ROLLUP (folder, tool)"),
    ),
    "L2_param_facets": (
        lambda spark, sf: reports.param_facets(usable_metadata(spark, sf)),
        _oracle(
            f"""SELECT p.k AS key, p.v AS value, count(*) AS files FROM (SELECT unnest(params) AS p FROM meta)
            WHERE list_contains({_CORE}, p.k) OR list_contains({_SECONDARY}, p.k) GROUP BY ALL"""
        ),
    ),
    "L3_lora_usage": (
        lora_usage,
        _oracle(
            """SELECT lora, count(DISTINCT file_id) AS files, count(*) AS mentions, round(avg(weight), 6) AS mean_weight
            FROM (SELECT file_id, string_split(l, ':')[1] AS lora,
                try_cast(nullif(array_to_string(string_split(l, ':')[2:], ':'), '') AS DOUBLE) AS weight
              FROM (SELECT file_id, unnest(loras) AS l FROM meta)) GROUP BY lora"""
        ),
    ),
    "L3_lora_rows": (
        lambda spark, sf: reports.lora_rows(usable_metadata(spark, sf)),
        _oracle(
            """SELECT file_id, string_split(l, ':')[1] AS lora,
                try_cast(nullif(array_to_string(string_split(l, ':')[2:], ':'), '') AS DOUBLE) AS weight
              FROM (SELECT file_id, unnest(loras) AS l FROM meta)"""
        ),
    ),
    "L5_completeness": (
        completeness,
        _oracle(
            f"""SELECT tool, count(*) AS files, round(avg(CAST(prompt <> '' AS INT)), 6) AS prompt_share,
              round(avg(CAST(has_core AS INT)), 6) AS core_share,
              round(avg(CAST(has_secondary AS INT)), 6) AS secondary_share,
              round(avg(CAST(has_model AS INT)), 6) AS model_share,
              round(avg(CAST(has_advanced AS INT)), 6) AS advanced_share FROM ({_FLAGS}) GROUP BY tool"""
        ),
    ),
    "E2_folder_overview": (
        overview,
        fx.oracle(
            """SELECT path, true AS has_children, coalesce(covers, '') AS covers, image_count, parsed_files, main_tool
            FROM tree LEFT JOIN covers ON path = folder LEFT JOIN (
              SELECT folder AS path, sum(files) AS parsed_files, arg_max(tool, (files, tool)) AS main_tool
              FROM (SELECT folder, tool, count(*) AS files FROM meta GROUP BY ALL) GROUP BY ALL) USING (path)""",
            inventory=True,
            tags=True,
            ctes=f"{ref.META}, {NODES}, {COVERS}",
        ),
    ),
}
