"""Generators that embed one JSON object: two flat ones and a nested one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixledger.functions import jsonvalues as jv
from pixledger.functions.loras import drop_model_ending_sql, extract_loras
from pixledger.functions.text import SPACES_SQL, bind_sql, python_float_sql
from pixledger.operators.stages import finish
from pixledger.schemas import MODEL_TYPE, RECORD_TYPE, TOOL_EASY, TOOL_NOVELAI, TOOL_SWARM

# Output key -> field in the JSON.
NOVELAI_FIELDS = {
    "Steps": "steps", "Sampler": "sampler", "Seed": "seed", "CFG": "scale", "Model": "model",
    "sm": "sm", "sm_dyn": "sm_dyn", "noise_schedule": "noise_schedule",
    "width": "width", "height": "height", "cfg_rescale": "cfg_rescale",
}
EASY_FIELDS = {"Seed": "seed", "Steps": "steps", "Sampler": "sampler", "CFG": "cfg_scale", "Model": "model"}
EASY_REQUIRED = ["prompt", "negative_prompt", "width", "height"]
SWARM_KEY = "sui_image_params"
# Always kept as text, even 0; the others only when they hold something.
SWARM_TEXT_FIELDS = {"Seed": "seed", "Steps": "steps", "CFG": "cfgscale", "Width": "width", "Height": "height"}
SWARM_FIELDS = {
    "Sampler": "sampler", "Scheduler": "scheduler", "Model": "model",
    "SwarmVersion": "swarm_version", "AspectRatio": "aspectratio",
}
SWARM_TIMES = ["date", "generation_time", "prep_time"]
USED_LORAS = "used_loras"


def with_json_object(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the JSON object in a text that starts with a brace, parsed once, as
    ``map<string,variant>``; NULL otherwise."""
    return df.withColumn(
        out, F.when(jv.looks_like_object(F.col(text)), jv.parse_object(F.col(text)))
    )


def _prompt_sql(value: str) -> str:
    """A missing key reads as empty; an explicit null stays NULL."""
    return f"IF({value} IS NOT NULL, {value}.text, '')"


def _flat_record_sql(tool: str, params: str) -> str:
    return f"""CAST(named_struct('tool', '{tool}', 'prompt', _prompt, 'negative_prompt', _negative,
        'params', {params}, 'loras', _loras, 'models', NULL, 'date', NULL, 'generation_time', NULL)
        AS {RECORD_TYPE})"""


def _flat_params(fields: dict[str, str]) -> dict[str, str]:
    return {key: f"_fields.{field}.text" for key, field in fields.items()}


def parse_flat_json(
    df: DataFrame, obj: str = "params_object", novelai: str = "novelai", easy: str = "easydiffusion", settled: bool = True
) -> DataFrame:
    """Add the records of both flat formats; each NULL where its signature is absent."""
    required = " AND ".join(f"_fields.{key} IS NOT NULL" for key in EASY_REQUIRED)
    names = dict.fromkeys(["Software", *EASY_REQUIRED, *NOVELAI_FIELDS.values(), *EASY_FIELDS.values()])
    staged = df.withColumn("_described", F.expr(jv.describe_values_sql(obj)))
    staged = staged.withColumn("_fields", F.expr(jv.fields_sql("_described", list(names))))
    staged = staged.withColumns(
        {
            "_is_novelai": F.expr(
                "_fields.Software.kind IN ('str', 'list') AND contains(_fields.Software.text, 'NovelAI')"
            ),
            "_is_easy": F.expr(f"{required} AND NOT map_contains_key(_described, '{SWARM_KEY}')"),
            "_prompt": F.expr(_prompt_sql("_fields.prompt")),
            "_negative": F.expr(_prompt_sql("_fields.negative_prompt")),
        }
    )
    searched = F.expr("concat(coalesce(_prompt, 'None'), ' ', coalesce(_negative, 'None'))")
    staged = staged.withColumn("_loras", extract_loras(F.when(F.expr("_is_novelai OR _is_easy"), searched)))
    staged = jv.with_present(staged, "_novelai_params", _flat_params(NOVELAI_FIELDS), "_is_novelai")
    staged = jv.with_present(staged, "_easy_params", _flat_params(EASY_FIELDS), "_is_easy")
    novelai_record = _flat_record_sql(TOOL_NOVELAI, "_novelai_params")
    easy_record = _flat_record_sql(TOOL_EASY, "_easy_params")
    parsed = staged.withColumns(
        {
            novelai: F.expr(f"IF(_is_novelai, {novelai_record}, NULL)"),
            easy: F.expr(f"IF(_is_easy, {easy_record}, NULL)"),
        }
    )
    temporary = (
        "_described", "_fields", "_is_novelai", "_is_easy", "_prompt", "_negative", "_loras", "_novelai_params", "_easy_params",
    )
    return finish(parsed, novelai, easy, drop=temporary, settled=settled)


def parse_novelai_json(df: DataFrame, text: str = "parameters", out: str = "novelai") -> DataFrame:
    parsed = with_json_object(df, text, "_object")
    return parse_flat_json(parsed, "_object", out, "_other").drop("_object", "_other")


def parse_easydiffusion(df: DataFrame, text: str = "parameters", out: str = "easydiffusion") -> DataFrame:
    parsed = with_json_object(df, text, "_object")
    return parse_flat_json(parsed, "_object", "_other", out).drop("_object", "_other")


# A weight in the parallel list: a number, or text of one; else 1.0. A trailing
# letter d or f makes a number to the JVM only.
_LISTED_NUMBER_SQL = rf"""CASE
    WHEN w.kind = 'bool' THEN IF(w.text = 'True', 1D, 0D)
    WHEN w.kind IN ('str', 'int', 'float') AND NOT rlike(w.text, r'[dDfF]\s*$')
      THEN try_cast(btrim(w.text, {SPACES_SQL}) AS DOUBLE) END"""
_LISTED_WEIGHT_SQL = bind_sql(
    bind_sql("get(_weight_list, at)", "x", jv.describe_sql("x")),
    "w",
    f"coalesce({python_float_sql(_LISTED_NUMBER_SQL)}, '1.0')",
)
# An object's own weight, as text; a missing one is 1.0.
_OWN_WEIGHT_SQL = bind_sql(
    "try_variant_get(l, '$.weight', 'variant')",
    "x",
    f"IF(x IS NULL, '1.0', coalesce({jv.describe_sql('x')}.text, 'None'))",
)
_WEIGHTED_SQL = f"""coalesce(transform(_lora_list, (l, at) -> CASE
    WHEN startswith(schema_of_variant(l), 'OBJECT') THEN named_struct(
      'name', {drop_model_ending_sql("try_variant_get(l, '$.model', 'string')")}, 'weight', {_OWN_WEIGHT_SQL})
    WHEN schema_of_variant(l) = 'STRING' THEN named_struct(
      'name', {drop_model_ending_sql("try_variant_get(l, '$', 'string')")}, 'weight', {_LISTED_WEIGHT_SQL})
    END), array())"""
_USED_SQL = f"""coalesce(transform(
    filter(_models, m -> try_variant_get(m, '$.param', 'string') = '{USED_LORAS}'),
    u -> named_struct('name', {drop_model_ending_sql("try_variant_get(u, '$.name', 'string')")},
      'weight', CAST(NULL AS STRING))), array())"""
# Each name once, the first mention of it.
_NAMED_SQL = f"IF(_holder IS NOT NULL, filter(concat({_WEIGHTED_SQL}, {_USED_SQL}), l -> l.name <> ''), NULL)"
_SWARM_LORAS_SQL = """transform(
    IF(size(array_distinct(_names)) = size(_names), _named, filter(_named, (l, at) -> array_position(_names, l.name) = at + 1)),
    l -> concat_ws(':', l.name, l.weight))"""
_MODELS_SQL = f"""coalesce(transform(_models, m -> named_struct(
    'name', try_variant_get(m, '$.name', 'string'),
    'param', try_variant_get(m, '$.param', 'string'),
    'hash', try_variant_get(m, '$.hash', 'string'))), CAST(array() AS ARRAY<{MODEL_TYPE}>))"""


def with_swarm_parts(df: DataFrame, objects: list[str]) -> DataFrame:
    """Stage the pieces of the first object that carries the image parameters."""
    holders = ", ".join(f"IF(map_contains_key({o}, '{SWARM_KEY}'), {o}, NULL)" for o in objects)
    staged = df.withColumn("_holder", F.expr(f"coalesce({holders})"))
    image, extra = f"_holder['{SWARM_KEY}']", "_holder['sui_extra_data']"
    as_map = "'$', 'map<string,variant>'"
    return staged.withColumns(
        {
            "_image": F.expr(jv.describe_values_sql(f"try_variant_get({image}, {as_map})")),
            "_extra": F.expr(jv.describe_values_sql(f"try_variant_get({extra}, {as_map})")),
            "_models": F.expr("try_variant_get(_holder['sui_models'], '$', 'array<variant>')"),
            "_lora_list": F.expr(f"try_variant_get({image}, '$.loras', 'array<variant>')"),
            "_weight_list": F.expr(f"try_variant_get({image}, '$.loraweights', 'array<variant>')"),
        }
    )


def parse_swarm(df: DataFrame, objects: list[str], out: str = "swarm", settled: bool = True) -> DataFrame:
    """Add a record struct from the first of the JSON objects with image
    parameters; NULL without any."""
    params = {key: f"nullif(_fields.{field}.text, '')" for key, field in SWARM_TEXT_FIELDS.items()}
    params |= {key: jv.truthy_text_sql(f"_fields.{field}") for key, field in SWARM_FIELDS.items()}
    extra = {field: jv.truthy_text_sql(f"_times.{field}") for field in SWARM_TIMES}
    record = f"""CAST(named_struct('tool', '{TOOL_SWARM}',
        'prompt', {_prompt_sql("_fields.prompt")},
        'negative_prompt', {_prompt_sql("_fields.negativeprompt")},
        'params', _swarm_params, 'loras', {_SWARM_LORAS_SQL}, 'models', {_MODELS_SQL},
        'date', {extra["date"]},
        'generation_time', coalesce({extra["generation_time"]}, {extra["prep_time"]})) AS {RECORD_TYPE})"""
    names = ["prompt", "negativeprompt", *SWARM_TEXT_FIELDS.values(), *SWARM_FIELDS.values()]
    staged = with_swarm_parts(df, objects).withColumns(
        {
            "_fields": F.expr(jv.fields_sql("_image", names)),
            "_times": F.expr(jv.fields_sql("_extra", SWARM_TIMES)),
            "_named": F.expr(_NAMED_SQL),
        }
    )
    staged = staged.withColumn("_names", F.expr("transform(_named, l -> l.name)"))
    staged = jv.with_present(staged, "_swarm_params", params, "_holder IS NOT NULL")
    temporary = (
        "_holder", "_image", "_extra", "_models", "_lora_list", "_weight_list", "_fields", "_times", "_named", "_names",
        "_swarm_params",
    )
    parsed = staged.withColumn(out, F.expr(f"IF(_holder IS NOT NULL, {record}, NULL)"))
    return finish(parsed, out, drop=temporary, settled=settled)
