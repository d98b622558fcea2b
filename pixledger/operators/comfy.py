"""Node graphs: prompts, sampler settings and models from a workflow's nodes.

A graph is one row's JSON, so all work stays inside the row: nodes become an
array in document order and links are looked up in it. Nothing is exploded and
nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixledger.functions import jsonvalues as jv
from pixledger.functions.loras import drop_model_ending_sql, extract_loras
from pixledger.functions.text import bind_sql
from pixledger.operators.stages import finish
from pixledger.schemas import RECORD_TYPE, TOOL_COMFY

# Node types and the inputs read from each.
PROMPT_TYPES = ["CLIPTextEncode"]
SAMPLER_TYPES = ["KSampler", "KSamplerAdvanced"]
LORA_TYPES = ["LoraLoader", "LoraLoaderModelOnly"]
VAE_TYPES = ["VAEDecode", "VAELoader"]
CHECKPOINT_TYPE = "CheckpointLoaderSimple"
UPSCALE_TYPE = "UpscaleModelLoader"
CONTROLNET_TYPE = "ControlNetLoader"
CLIP_SKIP_TYPE = "CLIPSetLastLayer"
READ_TYPES = [
    *PROMPT_TYPES, *SAMPLER_TYPES, *LORA_TYPES, *VAE_TYPES,
    CHECKPOINT_TYPE, UPSCALE_TYPE, CONTROLNET_TYPE, CLIP_SKIP_TYPE,
]

LIST_INPUTS_MESSAGE = "Unable to parse metadata: node inputs are not an object"

_NODE = "struct<id:variant,class_type:variant,type:variant,inputs:map<string,variant>>"


def with_graph(
    df: DataFrame, prompt: str = "prompt_json", workflow: str = "workflow_json", out: str = "nodes", settled: bool = True
) -> DataFrame:
    """Add the graph's nodes as an array in document order; NULL without a graph.

    The prompt text is used if it is a JSON object. The workflow text steps in
    only where the prompt is missing, malformed or ``null``.
    Element: STRUCT<pos, id, type, inputs MAP<STRING, STRUCT<kind,text,ref>>,
    first STRUCT<kind,text,ref>, bad_inputs>.
    """
    staged = df.withColumn("_own", jv.parse_object(F.col(prompt), "string"))
    fallback = F.when(
        F.col(workflow).isNotNull() & ~jv.is_other_json(F.col(prompt)),
        jv.parse_object(F.col(workflow), "string"),
    )
    staged = staged.withColumn("_top", F.when(F.col("_own").isNotNull(), F.col("_own")).otherwise(fallback))
    # A "nodes" list replaces the map of nodes by id.
    staged = staged.withColumn("_listed", F.from_json(F.col("_top")["nodes"], "array<string>", jv.STRICT))
    staged = staged.withColumn("_parsed", F.expr(_PARSED_SQL))
    temporary = ("_own", "_top", "_listed", "_parsed")
    return finish(staged.withColumn(out, F.expr(_NODES_SQL)), out, drop=temporary, settled=settled)


_ENTRIES_SQL = """IF(_listed IS NOT NULL,
    transform(_listed, text -> named_struct('key', CAST(NULL AS STRING), 'value', text)),
    map_entries(_top))"""
_PARSED_SQL = f"""transform({_ENTRIES_SQL}, e -> named_struct('key', e.key, 'value', e.value,
    'node', from_json(e.value, '{_NODE}', map('allowSingleQuotes', 'false'))))"""
_TYPE_SQL = """coalesce(nullif(try_variant_get(e.node.class_type, '$', 'string'), ''),
    try_variant_get(e.node.type, '$', 'string'))"""
_NODE_SQL = f"""named_struct(
    'pos', pos,
    'id', coalesce(e.key, try_variant_get(e.node.id, '$', 'string')),
    'type', {_TYPE_SQL},
    'inputs', inputs,
    'first', get(filter(map_values(inputs), v -> v.kind <> 'list'), 0),
    'bad_inputs', e.node.inputs IS NULL AND {_TYPE_SQL} IN ({jv.sql_list(READ_TYPES)})
      AND get_json_object(e.value, '$.inputs') IS NOT NULL)"""
_INPUTS_SQL = jv.describe_values_sql(jv.last_values_sql("e.node.inputs"))
_NODES_SQL = f"transform(_parsed, (e, pos) -> {bind_sql(_INPUTS_SQL, 'inputs', _NODE_SQL)})"


def scalar_sql(nodes: str, value: str) -> str:
    """SQL for the text of an input. A link gives the linked node's first plain
    input, one hop; the last node wins if ids repeat."""
    linked = f"try_element_at(filter({nodes}, m -> m.id = value.ref), -1)"
    return bind_sql(value, "value", f"IF(value.kind = 'list', {linked}.first.text, value.text)")


def _of_type_sql(nodes: str, types: list[str]) -> str:
    return f"filter({nodes}, n -> n.type IN ({jv.sql_list(types)}))"


def last_sql(nodes: str, types: list[str], pick: str) -> str:
    """SQL for the last non-null pick over nodes ``n`` of the types, in document order."""
    picks = f"transform({_of_type_sql(nodes, types)}, n -> {pick})"
    return f"try_element_at(filter({picks}, t -> t IS NOT NULL), -1)"


def _either_sql(name: str, other: str) -> str:
    value = f"n.inputs['{name}']"
    return f"IF({jv.truthy_sql(value)}, {value}, n.inputs['{other}'])"


def _string_sql(value: str) -> str:
    """SQL for a non-empty string input, else NULL."""
    return bind_sql(value, "value", "IF(value.kind = 'str' AND value.text <> '', value.text, NULL)")


def graph_params(nodes: str) -> Column:
    """Params of the graph: for each key the last node that gives a value wins."""
    sampler = {
        "Seed": "n.inputs['seed']",
        "Steps": "n.inputs['steps']",
        "CFG": _either_sql("cfg", "cfg_scale"),
        "Sampler": _either_sql("sampler_name", "sampler"),
    }
    named = {
        "Model": ([CHECKPOINT_TYPE], "n.inputs['ckpt_name']"),
        "VAE": (VAE_TYPES, _either_sql("vae_name", "vae")),
        "UpscaleModel": ([UPSCALE_TYPE], "n.inputs['model_name']"),
        "ControlNet": ([CONTROLNET_TYPE], "n.inputs['control_net_name']"),
    }
    pairs = {key: last_sql("samplers", SAMPLER_TYPES, scalar_sql(nodes, value)) for key, value in sampler.items()}
    pairs |= {key: last_sql(nodes, types, _string_sql(value)) for key, (types, value) in named.items()}
    pairs["clip_skip"] = last_sql(
        nodes, [CLIP_SKIP_TYPE], scalar_sql(nodes, "n.inputs['stop_at_clip_layer']")
    )
    # Four keys read the samplers, which are picked once.
    return F.expr(bind_sql(_of_type_sql(nodes, SAMPLER_TYPES), "samplers", jv.present_sql(pairs)))


def prompt_texts(nodes: str) -> Column:
    """Texts of the prompt nodes, in document order."""
    inputs = f"transform({_of_type_sql(nodes, PROMPT_TYPES)}, n -> n.inputs['text'])"
    return F.expr(f"transform(filter({inputs}, v -> v.kind = 'str'), v -> v.text)")


def longest_first(texts: str) -> Column:
    """Texts by length, longest first, document order among equals."""
    ranked = f"transform({texts}, (t, pos) -> named_struct('n', -char_length(t), 'pos', pos, 'text', t))"
    return F.expr(f"transform(sort_array({ranked}), r -> r.text)")


def node_loras(nodes: str) -> Column:
    """``name:strength`` per LoRA node, or ``name`` where the strength is a link."""
    name = drop_model_ending_sql(_string_sql("n.inputs['lora_name']"))
    strength = "n.inputs['strength_model']"
    suffix = f"IF({strength}.kind <> 'list' AND {strength}.text IS NOT NULL, concat(':', {strength}.text), '')"
    mentions = f"transform({_of_type_sql(nodes, LORA_TYPES)}, n -> concat({name}, {suffix}))"
    return F.expr(f"filter({mentions}, t -> t IS NOT NULL)")


def parse_comfy(
    df: DataFrame, prompt: str = "prompt_json", workflow: str = "workflow_json", out: str = "comfy", settled: bool = True
) -> DataFrame:
    """Add a record struct, NULL without a graph, and ``<out>_error``.

    A node of a known type whose inputs are not an object is read as having none,
    and the row is flagged.
    """
    staged = with_graph(df, prompt, workflow, "_nodes", settled)
    staged = staged.withColumns(
        {
            "_texts": prompt_texts("_nodes"),
            "_params": F.when(F.col("_nodes").isNotNull(), graph_params("_nodes")),
            "_node_loras": node_loras("_nodes"),
            f"{out}_error": F.expr(f"IF(exists(_nodes, n -> n.bad_inputs), '{LIST_INPUTS_MESSAGE}', NULL)"),
        }
    )
    staged = staged.withColumns(
        {
            "_ordered": longest_first("_texts"),
            "_loras": F.array_distinct(F.concat("_node_loras", extract_loras(F.array_join("_texts", " ")))),
        }
    )
    record = f"""CAST(named_struct('tool', '{TOOL_COMFY}', 'prompt', coalesce(get(_ordered, 0), ''),
        'negative_prompt', coalesce(get(_ordered, 1), ''), 'params', _params, 'loras', _loras,
        'models', NULL, 'date', NULL, 'generation_time', NULL) AS {RECORD_TYPE})"""
    parsed = staged.withColumn(out, F.expr(f"IF(_nodes IS NOT NULL, {record}, NULL)"))
    temporary = ("_nodes", "_texts", "_params", "_node_loras", "_ordered", "_loras")
    return finish(parsed, out, f"{out}_error", drop=temporary, settled=settled)


def graph_links(df: DataFrame, nodes: str = "nodes") -> DataFrame:
    """One row per link between nodes of a file: what it names and the value it gives."""
    keep = [F.col(c) for c in df.columns if c != nodes]
    per_node = df.select(*keep, nodes, F.explode(nodes).alias("_node"))
    per_input = per_node.select(
        *keep, nodes, F.col("_node.id").alias("node_id"), F.explode("_node.inputs").alias("input", "_value")
    ).where(F.col("_value.kind") == "list")
    return per_input.select(
        *keep,
        "node_id",
        "input",
        F.col("_value.ref").alias("linked_id"),
        F.expr(scalar_sql(nodes, "_value")).alias("value"),
    )
