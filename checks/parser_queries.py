"""LoRA mentions, the five formats, and the metadata cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import reference_sql as ref
from checks.common import Queries, joined, metadata, params_text
from pixledger.functions import jsonvalues as jv
from pixledger.functions import loras
from pixledger.functions.text import strip
from pixledger.operators import a1111, comfy, json_formats, resolve, sections


def _loras(function):
    def query(spark, sf):
        tags = fx.raw_tags(spark, sf)
        return tags.where("parameters IS NOT NULL").select(
            "file_id", F.coalesce(F.array_join(function(F.col("parameters")), "|"), F.lit("")).alias("loras")
        )

    return query


def _record(df, name):
    """The parts of one record column, as comparable strings."""
    record = f"{name}."
    return df.where(F.col(name).isNotNull()).select(
        "file_id",
        F.col(record + "prompt").alias("prompt"),
        F.col(record + "negative_prompt").alias("negative_prompt"),
        params_text(record + "params").alias("params"),
        joined(record + "loras").alias("loras"),
    )


def markers(spark, sf):
    """The prompt and negative prompt cut out by the marker search."""
    return _record(a1111.parse_a1111(fx.raw_tags(spark, sf), out="r"), "r").select(
        "file_id", "prompt", "negative_prompt"
    )


def param_patterns(spark, sf):
    """One row per parameter found by the patterns."""
    parsed = a1111.parse_a1111(fx.raw_tags(spark, sf), out="r")
    return parsed.select("file_id", F.explode("r.params").alias("key", "value"))


def size_split(spark, sf):
    parsed = a1111.parse_a1111(fx.raw_tags(spark, sf), out="r").where("r IS NOT NULL")
    return parsed.select(
        "file_id", F.expr("r.params['Width']").alias("width"), F.expr("r.params['Height']").alias("height")
    )


def strip_text(spark, sf):
    padded = F.concat(F.lit("  \t\n"), "parameters", F.lit(" \r\n"))
    return fx.raw_tags(spark, sf).where("parameters IS NOT NULL").select("file_id", strip(padded).alias("text"))


def json_sniff(spark, sf):
    """Which texts look like an object, and how many keys they hold."""
    tags = json_formats.with_json_object(fx.raw_tags(spark, sf), "parameters", "o")
    return tags.select(
        "file_id",
        F.coalesce(jv.looks_like_object(F.col("parameters")), F.lit(False)).alias("looks_like_object"),
        F.size(F.map_keys("o")).alias("keys"),
    )


def python_text(spark, sf):
    """Every plain value of the flat JSON formats as Python text."""
    tags = json_formats.with_json_object(fx.raw_tags(spark, sf), "parameters", "o")
    values = tags.select("file_id", F.explode(F.expr(jv.describe_values_sql("o"))).alias("key", "value"))
    return values.where("value.kind NOT IN ('dict', 'list')").select("file_id", "key", F.col("value.text").alias("value"))


def model_ending(spark, sf):
    nodes = comfy.with_graph(fx.raw_tags(spark, sf))
    return nodes.where("nodes IS NOT NULL").select("file_id", joined_expr(comfy.node_loras("nodes")).alias("loras"))


def joined_expr(values):
    return F.coalesce(F.array_join(values, "|"), F.lit(""))


def fallbacks(spark, sf):
    """Generation time of each Swarm file: its own, else the preparation time."""
    return _swarm(spark, sf).select("file_id", F.col("r.generation_time").alias("generation_time"))


def novelai_prefix(spark, sf):
    parsed = a1111.parse_a1111(fx.raw_tags(spark, sf), out="r")
    return resolve.with_novelai_prefix(parsed, "r").where("r IS NOT NULL").select("file_id", F.col("r.tool").alias("tool"))


def parse_a1111(spark, sf):
    return _record(a1111.parse_a1111(fx.raw_tags(spark, sf), out="r"), "r")


def parse_comfy(spark, sf):
    return _record(comfy.parse_comfy(fx.raw_tags(spark, sf), out="r"), "r")


def parse_novelai(spark, sf):
    return _record(json_formats.parse_novelai_json(fx.raw_tags(spark, sf), out="r"), "r")


def parse_easydiffusion(spark, sf):
    tags = fx.raw_tags(spark, sf)
    return _record(json_formats.parse_easydiffusion(tags, out="r"), "r")


def _swarm(spark, sf):
    tags = json_formats.with_json_object(fx.raw_tags(spark, sf), "parameters", "p")
    tags = json_formats.with_json_object(tags, "user_comment", "c")
    return json_formats.parse_swarm(tags, ["p", "c"], "r").where("r IS NOT NULL")


def parse_swarm(spark, sf):
    swarm = _swarm(spark, sf)
    more = swarm.select("file_id", F.col("r.date").alias("date"), F.col("r.generation_time").alias("generation_time"))
    return _record(swarm, "r").join(more, "file_id")


def swarm_models(spark, sf):
    metadata = _swarm(spark, sf).select("file_id", F.col("r.models").alias("models"))
    return sections.model_rows(metadata)


def swarm_lora_weights(spark, sf):
    """One row per LoRA with its own, listed or default weight."""
    return _swarm(spark, sf).select("file_id", F.posexplode("r.loras").alias("pos", "lora"))


def swarm_used_loras(spark, sf):
    """LoRAs that only the list of used models names."""
    return swarm_lora_weights(spark, sf).where(~F.col("lora").contains(":")).select("file_id", "lora")


def swarm_params(spark, sf):
    """Swarm params after empty values are dropped."""
    return _swarm(spark, sf).select("file_id", F.explode("r.params").alias("key", "value"))


def compact_params(spark, sf):
    """Params with every other value blanked, then compacted."""
    swarm = _swarm(spark, sf).select("file_id", F.col("r.params").alias("params"))
    blanked = swarm.withColumn("params", F.expr("transform_values(params, (k, v) -> IF(length(v) % 2 = 0, '', v))"))
    return sections.compact_params(blanked).select("file_id", F.explode("params").alias("key", "value"))


def graph_nodes(spark, sf):
    nodes = comfy.with_graph(fx.raw_tags(spark, sf))
    return nodes.select("file_id", F.explode("nodes").alias("n")).select(
        "file_id", F.col("n.pos").alias("pos"), F.col("n.id").alias("id"), F.col("n.type").alias("type")
    )


def graph_links(spark, sf):
    nodes = comfy.with_graph(fx.raw_tags(spark, sf)).select("file_id", "nodes")
    return comfy.graph_links(nodes)


def merge_node_params(spark, sf):
    nodes = comfy.with_graph(fx.raw_tags(spark, sf))
    return nodes.select("file_id", F.explode(comfy.graph_params("nodes")).alias("key", "value"))


def pick_prompts(spark, sf):
    nodes = comfy.with_graph(fx.raw_tags(spark, sf)).where("nodes IS NOT NULL")
    texts = nodes.withColumn("texts", comfy.prompt_texts("nodes"))
    ordered = texts.withColumn("ordered", comfy.longest_first("texts"))
    return ordered.select(
        "file_id", F.get("ordered", F.lit(0)).alias("prompt"), F.get("ordered", F.lit(1)).alias("negative_prompt")
    )


def lora_union(spark, sf):
    parsed = comfy.parse_comfy(fx.raw_tags(spark, sf), out="r").where("r IS NOT NULL")
    return parsed.select("file_id", F.posexplode("r.loras").alias("pos", "lora"))


def attach_sidecars(spark, sf):
    """Sidecar texts as a table of their own, joined back by folder and stem."""
    files = fx.inventory(spark, sf).withColumn("stem", F.regexp_replace("name", r"(.)\.[^.]+$", "$1"))
    sidecars = files.join(fx.raw_tags(spark, sf), "file_id").where("sidecar_text IS NOT NULL")
    texts = sidecars.select("folder", "stem", F.col("sidecar_text").alias("text"))
    return resolve.attach_sidecars(files.drop("stem"), texts).select("file_id", "sidecar_text")


def resolve_metadata(spark, sf):
    meta = metadata(spark, sf)
    return meta.select(
        "file_id", "tool", "prompt", "negative_prompt", params_text().alias("params"), joined("loras").alias("loras"),
        "date", "generation_time",
    )


def envelope(spark, sf):
    return metadata(spark, sf).select("file_id", "tool", "width", "height", "name")


def invalid_on_error(spark, sf):
    """All image files: over-limit ones as error rows, the rest untouched by them."""
    meta = resolve.metadata_table(resolve.resolve_metadata(fx.tagged_files(spark, sf)))
    return meta.select("file_id", "tool", "error_type", "error_message")


TAGS = dict(tags=True)
RECORD = f"SELECT file_id, prompt, negative_prompt, {ref.PARAMS_TEXT} AS params, {ref.LORAS_TEXT} AS loras FROM "
A1111 = ref.a1111("raw_tags", "parameters", "a1111")


def _oracle(sql, ctes="", **kwargs):
    return fx.oracle(sql, ctes=ctes, tags=True, **kwargs)


def _lora_oracle(items):
    return _oracle(
        f"SELECT file_id, coalesce(array_to_string({items}, '|'), '') AS loras FROM raw_tags WHERE parameters IS NOT NULL"
    )


_TAG_ITEMS = "list_transform(regexp_extract_all(parameters, '(?i)<lora:[^:>]+(?::[^>]+)?>'), lambda t: t[7:length(t) - 1])"
_LIST_ITEMS = """list_filter(list_transform(flatten(list_transform(regexp_extract_all(parameters, 'LoRA:\\s*\\[([^\\]]+)\\]', 1),
    lambda l: string_split(l, ','))), lambda i: trim(i)), lambda i: i <> '')"""

QUERIES: Queries = {
    "F1_tag_loras": (_loras(loras.tag_loras), _lora_oracle(_TAG_ITEMS)),
    "F2_listed_loras": (_loras(loras.listed_loras), _lora_oracle(_LIST_ITEMS)),
    "F3_extract_loras": (_loras(loras.extract_loras), _lora_oracle(ref.lora_list("parameters"))),
    "A11_distinct_ordered": (
        lambda spark, sf: _loras(loras.extract_loras)(spark, sf).select(
            "file_id", F.posexplode(F.split("loras", r"\|")).alias("pos", "lora")
        ).where("lora <> ''"),
        _oracle(
            f"""SELECT file_id, CAST(slot - 1 AS INT) AS pos, l[slot] AS lora FROM (SELECT file_id, l,
              unnest(range(1, len(l) + 1)) AS slot FROM (SELECT file_id, {ref.lora_list("parameters")} AS l FROM raw_tags))"""
        ),
    ),
    "F4_markers": (markers, _oracle("SELECT file_id, prompt, negative_prompt FROM a1111", A1111)),
    "F5_param_patterns": (
        param_patterns,
        _oracle("SELECT file_id, p.k AS key, p.v AS value FROM (SELECT file_id, unnest(params) AS p FROM a1111)", A1111),
    ),
    "F6_size_split": (
        size_split,
        _oracle(
            """SELECT file_id, nullif(regexp_extract(txt, '(?i)Size:\\s*(\\d+)x\\d+', 1), '') AS width,
              nullif(regexp_extract(txt, '(?i)Size:\\s*\\d+x(\\d+)', 1), '') AS height
            FROM a1111_a JOIN a1111 USING (file_id)""",
            A1111,
        ),
    ),
    "F7_strip": (
        strip_text,
        _oracle("SELECT file_id, parameters AS text FROM raw_tags WHERE parameters IS NOT NULL"),
    ),
    "F8_json_sniff": (
        json_sniff,
        _oracle(
            """SELECT file_id, coalesce(parameters LIKE '{%', false) AS looks_like_object,
              CASE WHEN json_valid(parameters) THEN CAST(len(json_keys(parameters)) AS INT) END AS keys FROM raw_tags"""
        ),
    ),
    "F9_exif_comment": (
        lambda spark, sf: _exif_comments(spark, sf),
        _oracle("SELECT file_id, user_comment FROM raw_tags WHERE user_comment IS NOT NULL"),
    ),
    "F10_model_ending": (
        model_ending,
        _oracle(
            "SELECT t.file_id, coalesce(array_to_string(loras, '|'), '') AS loras FROM comfy_joined t LEFT JOIN comfy_loras USING (file_id)",
            ref.COMFY_ROWS.strip(),
        ),
    ),
    "F11_fallbacks": (fallbacks, _oracle("SELECT file_id, generation_time FROM swarm", ref.SWARM.strip())),
    "F12_python_text": (
        python_text,
        _oracle(
            """SELECT file_id, v.key AS key, CASE v.type WHEN 'BOOLEAN' THEN CASE v.value->>'$' WHEN 'true' THEN 'True'
              ELSE 'False' END ELSE v.value->>'$' END AS value
            FROM (SELECT * FROM raw_tags WHERE json_valid(parameters)) t, json_each(t.parameters) v
            WHERE v.type NOT IN ('OBJECT', 'ARRAY')"""
        ),
    ),
    "F13_novelai_prefix": (
        novelai_prefix,
        _oracle(
            """SELECT file_id, CASE WHEN prompt LIKE 'masterpiece, best quality,%' THEN 'NovelAI' ELSE 'A1111' END AS tool
            FROM a1111""",
            A1111,
        ),
    ),
    "D1_parse_a1111": (parse_a1111, _oracle(RECORD + "a1111", A1111)),
    "D2_parse_comfy": (parse_comfy, _oracle(RECORD + "comfy", ref.COMFY.strip())),
    "D3_parse_novelai_json": (parse_novelai, _oracle(RECORD + "novelai", ref.NOVELAI)),
    "D4_parse_easydiffusion": (parse_easydiffusion, _oracle(RECORD + "easy", ref.EASY)),
    "D5_parse_swarm": (
        parse_swarm,
        _oracle(RECORD.replace(" FROM ", ", date, generation_time FROM ") + "swarm", ref.SWARM.strip()),
    ),
    "P15_hash8": (
        swarm_models,
        _oracle(
            "SELECT file_id, pos, name, param, hash, hash[1:8] AS hash8 FROM swarm_models", ref.SWARM.strip()
        ),
    ),
    "J3_lora_weights": (
        swarm_lora_weights,
        _oracle(
            """SELECT file_id, CAST(slot - 1 AS INT) AS pos, loras[slot] AS lora FROM (
              SELECT file_id, loras, unnest(range(1, len(loras) + 1)) AS slot FROM swarm_loras)""",
            ref.SWARM.strip(),
        ),
    ),
    "J4_used_loras": (
        swarm_used_loras,
        _oracle(
            """SELECT file_id, name AS lora FROM swarm_mentions m WHERE weight IS NULL AND NOT EXISTS (
              SELECT 1 FROM swarm_mentions o WHERE o.file_id = m.file_id AND o.name = m.name AND o.slot < m.slot)""",
            ref.SWARM.strip(),
        ),
    ),
    "D5_swarm_params": (
        swarm_params,
        _oracle(
            "SELECT file_id, p.k AS key, p.v AS value FROM (SELECT file_id, unnest(params) AS p FROM swarm)",
            ref.SWARM.strip(),
        ),
    ),
    "A12_compact_params": (
        compact_params,
        _oracle(
            """SELECT file_id, p.k AS key, p.v AS value FROM (SELECT file_id, unnest(params) AS p FROM swarm)
            WHERE length(p.v) % 2 = 1""",
            ref.SWARM.strip(),
        ),
    ),
    "D2_graph_nodes": (
        graph_nodes,
        _oracle(
            """SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1 AS INT) AS pos, id, type
            FROM nodes""",
            ref.COMFY_ROWS.strip(),
        ),
    ),
    "J2_graph_links": (
        graph_links,
        _oracle(
            "SELECT file_id, node_id, input, ref AS linked_id, value FROM scalars WHERE kind = 'ARRAY'",
            ref.COMFY_ROWS.strip(),
        ),
    ),
    "A9_merge_node_params": (
        merge_node_params,
        _oracle("SELECT file_id, k AS key, v AS value FROM comfy_params", ref.COMFY_ROWS.strip()),
    ),
    "A10_pick_prompts": (
        pick_prompts,
        _oracle("SELECT file_id, prompt, negative_prompt FROM comfy_joined", ref.COMFY_ROWS.strip()),
    ),
    "U3_lora_union": (
        lora_union,
        _oracle(
            """SELECT file_id, CAST(slot - 1 AS INT) AS pos, loras[slot] AS lora FROM (
              SELECT file_id, loras, unnest(range(1, len(loras) + 1)) AS slot FROM comfy)""",
            ref.COMFY.strip(),
        ),
    ),
    "J1_attach_sidecars": (
        attach_sidecars,
        _oracle("SELECT i.file_id, sidecar_text FROM inventory i LEFT JOIN raw_tags USING (file_id)", inventory=True),
    ),
    "D6_resolve_metadata": (
        resolve_metadata,
        _oracle(
            RECORD.replace("file_id,", "file_id, tool, date, generation_time,", 1) + "every", ref.ALL_META, inventory=True
        ),
    ),
    "D7_envelope": (
        envelope,
        _oracle("SELECT file_id, tool, width, height, name FROM every", ref.ALL_META, inventory=True),
    ),
    "D8_invalid_on_error": (
        invalid_on_error,
        _oracle(
            f"""SELECT i.file_id, m.tool, CASE WHEN m.file_id IS NULL THEN 'invalid_file' END AS error_type,
              CASE WHEN i.length > 78643200 THEN 'Image is too large (> 75 MB)'
                WHEN m.file_id IS NULL THEN 'Image dimensions exceed limit (> 104,857,600 pixels)' END AS error_message
            FROM (SELECT * FROM inventory WHERE {ref.IS_IMAGE}) i LEFT JOIN meta m USING (file_id)""",
            ref.META,
            inventory=True,
        ),
    ),
}


def _exif_comments(spark, sf):
    from checks.source_queries import image_bytes
    from pixledger.sources.tags import extract_tags

    files = image_bytes(spark, sf).where("user_comment IS NOT NULL").select("file_id", "content")
    return extract_tags(files, "content").select("file_id", "user_comment")
