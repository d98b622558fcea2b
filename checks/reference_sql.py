"""Building blocks of the oracle SQL: each operator's rules said again in DuckDB.

Every constant below is the body of one or more CTEs over ``inventory`` and
``raw_tags``; queries put together what they need.
"""

from __future__ import annotations

IS_IMAGE = r"regexp_matches(name, '.\.(jpg|jpeg|png|gif|bmp|webp|tiff)$', 'i')"
VISIBLE = f"{IS_IMAGE} AND name NOT LIKE '.%'"

# Natural key: pairs of (text, number after it), -1 for none.
NATURAL_KEY = r"""list_transform(regexp_extract_all(lower(name), '[^0-9]*[0-9]+|[^0-9]+$'), lambda p: {
    't': regexp_extract(p, '^([^0-9]*)', 1),
    'n': coalesce(try_cast(nullif(regexp_extract(p, '([0-9]+)$', 1), '') AS HUGEINT), -1)})"""

IMAGES = f"""images AS (SELECT *, concat(folder, '/', name) AS path, {NATURAL_KEY} AS nk
    FROM inventory WHERE {VISIBLE})"""
# The same images as if each event type were one big folder.
BIG_IMAGES = f"""images AS (SELECT * REPLACE (regexp_replace(folder, '/user[0-9]+$', '') AS folder),
    concat(regexp_replace(folder, '/user[0-9]+$', ''), '/', name) AS path, {NATURAL_KEY} AS nk
    FROM inventory WHERE {VISIBLE})"""

ANCESTORS = """list_transform(range(1, len(string_split(folder, '/')) + 1),
    lambda i: CASE WHEN i = 1 THEN '/' ELSE array_to_string(string_split(folder, '/')[1:i], '/') END)"""

PARAMS_TEXT = """coalesce(array_to_string(list_sort(list_transform(params,
    lambda p: concat(p.k, '=', p.v))), '|'), '')"""
LORAS_TEXT = "coalesce(array_to_string(loras, '|'), '')"


def lora_list(text: str) -> str:
    """First mention of each tag and listed item, in order."""
    tags = rf"""list_transform(regexp_extract_all({text}, '(?i)<lora:[^:>]+(?::[^>]+)?>'),
        lambda t: t[7:length(t) - 1])"""
    listed = rf"""list_filter(list_transform(flatten(list_transform(
        regexp_extract_all({text}, 'LoRA:\s*\[([^\]]+)\]', 1), lambda l: string_split(l, ','))),
        lambda i: trim(i)), lambda i: i <> '')"""
    return distinct_in_order(f"list_concat({tags}, {listed})")


def distinct_in_order(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


# The texts that parameters are written in, in the order they are looked for.
_A1111_PATTERNS = {
    "Steps": r"Steps:\s*(\d+)",
    "Sampler": r"Sampler:\s*([^,\n]+?)(?:,|\n|$)",
    "CFG": r"CFG Scale:\s*([\d.]+)",
    "Seed": r"Seed:\s*(\d+)",
    "Model": r"Model:\s*([^,\n]+?)(?:,|\n|$)",
    "Scheduler": r"Scheduler:\s*([^,\n]+?)(?:,|\n|$)",
    "model_hash": r"Model hash:\s*(\w+)",
    "clip_skip": r"Clip skip:\s*(\d+)",
    "hires_upscale": r"Hires upscale:\s*([\d.]+)",
    "hires_steps": r"Hires steps:\s*(\d+)",
    "denoising_strength": r"Denoising strength:\s*([\d.]+)",
    "Width": r"Size:\s*(\d+)x\d+",
    "Height": r"Size:\s*\d+x(\d+)",
    "vae": r"VAE:\s*([^,\n]+?)(?:,|\n|$)",
    "ensd": r"ENSD:\s*(\d+)",
    "aesthetic_score": r"Aesthetic score:\s*([\d.]+)",
}


def params_list(pairs: dict[str, str]) -> str:
    cells = ", ".join(f"{{'k': '{k}', 'v': {v}}}" for k, v in pairs.items())
    return f"list_filter([{cells}], lambda p: p.v IS NOT NULL)"


def a1111(source: str, text: str, name: str) -> str:
    """CTEs that end in ``name`` (file_id, prompt, negative_prompt, params, loras)."""
    found = lambda marker, of: f"nullif(strpos({of}, '{marker}'), 0)"
    starts = ", ".join(
        f"CASE WHEN strpos(txt, '{m}') > 1 THEN strpos(txt, '{m}') END" for m in ("Steps:", "Size:", "Seed:", "Model:")
    )
    cuts = " ".join(
        f"WHEN {found(m, 'rough')} > 1 THEN trim(rough[1:strpos(rough, '{m}') - 1], {_BLANKS})"
        for m in ("Steps:", "Size:", "Seed:", "Model:", "Sampler:")
    )
    params = params_list(
        {k: f"nullif(trim(regexp_extract(txt, '(?i){p}', 1)), '')" for k, p in _A1111_PATTERNS.items()}
    )
    return f"""
{name}_a AS (SELECT file_id, {text} AS txt, strpos(lower({text}), 'negative prompt:') AS neg FROM {source}
    WHERE {text} <> ''),
{name}_b AS (SELECT *, least({starts}) AS start FROM {name}_a),
{name}_c AS (SELECT *,
    trim(CASE WHEN neg > 0 THEN txt[1:neg - 1] WHEN start IS NOT NULL THEN txt[1:start - 1] ELSE txt END,
        {_BLANKS}) AS prompt,
    CASE WHEN neg > 0 THEN trim(txt[neg + 16:CASE WHEN start > neg THEN start - 1 ELSE length(txt) END],
        {_BLANKS}) END AS rough FROM {name}_b),
{name}_d AS (SELECT file_id, prompt, coalesce(CASE {cuts} ELSE rough END, '') AS negative_prompt,
    {params} AS params, txt FROM {name}_c),
{name} AS (SELECT file_id, prompt, negative_prompt, params,
    {lora_list("concat(prompt, ' ', negative_prompt, ' ', txt)")} AS loras FROM {name}_d
    WHERE len(params) > 0 OR len({lora_list("txt")}) > 0)"""


_BLANKS = "concat(' ', chr(9), chr(10), chr(13))"

# Node graphs, by way of rows per node and per input.
COMFY_ROWS = """
graphs AS (SELECT file_id, CASE WHEN json_valid(prompt_json) THEN prompt_json ELSE workflow_json END AS j
    FROM raw_tags WHERE prompt_json IS NOT NULL OR workflow_json IS NOT NULL),
nodes AS (SELECT g.file_id, n.key AS id, n.id AS pos, n.value->>'$.class_type' AS type, n.value->'$.inputs' AS inputs
    FROM graphs g, json_each(g.j) n),
inputs AS (SELECT n.file_id, n.id AS node_id, n.pos, n.type AS type, i.key AS input, i.id AS slot, i.type AS kind,
    i.value->>'$' AS text, i.value->>'$[0]' AS ref FROM nodes n, json_each(n.inputs) i),
firsts AS (SELECT file_id, node_id, arg_min(text, slot) AS value FROM inputs WHERE kind <> 'ARRAY' GROUP BY ALL),
scalars AS (SELECT i.*, CASE WHEN i.kind = 'ARRAY' THEN f.value ELSE i.text END AS value
    FROM inputs i LEFT JOIN firsts f ON f.file_id = i.file_id AND f.node_id = i.ref),
comfy_params AS (SELECT file_id, k, arg_max(value, pos) AS v FROM (
    SELECT *, CASE WHEN type IN ('KSampler', 'KSamplerAdvanced') THEN
        CASE input WHEN 'seed' THEN 'Seed' WHEN 'steps' THEN 'Steps' WHEN 'cfg' THEN 'CFG'
          WHEN 'sampler_name' THEN 'Sampler' END
      WHEN type = 'CheckpointLoaderSimple' AND input = 'ckpt_name' THEN 'Model' END AS k FROM scalars)
    WHERE k IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
comfy_texts AS (SELECT file_id, pos, text, row_number() OVER (PARTITION BY file_id ORDER BY length(text) DESC, pos) AS rank
    FROM inputs WHERE type = 'CLIPTextEncode' AND input = 'text' AND kind = 'VARCHAR'),
comfy_loras AS (SELECT file_id, list(concat(regexp_replace(name, '\\.safetensors$', ''), ':', strength) ORDER BY pos) AS loras
    FROM (SELECT file_id, pos, any_value(text) FILTER (WHERE input = 'lora_name') AS name,
        any_value(text) FILTER (WHERE input = 'strength_model') AS strength
      FROM inputs WHERE type IN ('LoraLoader', 'LoraLoaderModelOnly') GROUP BY ALL) GROUP BY ALL),
comfy_joined AS (SELECT file_id, string_agg(text, ' ' ORDER BY pos) AS texts,
    any_value(text) FILTER (WHERE rank = 1) AS prompt, any_value(text) FILTER (WHERE rank = 2) AS negative_prompt
    FROM comfy_texts GROUP BY ALL)"""
_ALL_COMFY_LORAS = f"list_concat(coalesce(l.loras, []), {lora_list('t.texts')})"
COMFY = f"""{COMFY_ROWS},
comfy AS (SELECT t.file_id, t.prompt, t.negative_prompt, p.params, {distinct_in_order(_ALL_COMFY_LORAS)} AS loras
    FROM comfy_joined t LEFT JOIN comfy_loras l USING (file_id)
    LEFT JOIN (SELECT file_id, list({{'k': k, 'v': v}}) AS params FROM comfy_params GROUP BY ALL) p USING (file_id))"""


def _title_bool(value: str) -> str:
    return f"CASE {value} WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' ELSE {value} END"


def _flat(name: str, condition: str, fields: dict[str, str]) -> str:
    params = params_list({k: _title_bool(f"(parameters->>'$.{f}')") for k, f in fields.items()})
    text = "concat(parameters->>'$.prompt', ' ', parameters->>'$.negative_prompt')"
    return f"""{name} AS (SELECT file_id, parameters->>'$.prompt' AS prompt,
    parameters->>'$.negative_prompt' AS negative_prompt, {params} AS params, {lora_list(text)} AS loras
    FROM (SELECT * FROM raw_tags WHERE json_valid(parameters)) WHERE {condition})"""


NOVELAI = _flat(
    "novelai",
    "contains(parameters->>'$.Software', 'NovelAI')",
    {"Steps": "steps", "Sampler": "sampler", "Seed": "seed", "CFG": "scale", "Model": "model", "sm": "sm",
     "sm_dyn": "sm_dyn", "noise_schedule": "noise_schedule", "width": "width", "height": "height",
     "cfg_rescale": "cfg_rescale"},
)
EASY = _flat(
    "easy",
    "list_has_all(json_keys(parameters), ['prompt', 'negative_prompt', 'width', 'height'])"
    " AND NOT list_contains(json_keys(parameters), 'sui_image_params')",
    {"Seed": "seed", "Steps": "steps", "Sampler": "sampler", "CFG": "cfg_scale", "Model": "model"},
)

_SWARM_PARAMS = params_list(
    {
        k: f"nullif(j->>'$.sui_image_params.{f}', '')"
        for k, f in {
            "Seed": "seed", "Steps": "steps", "CFG": "cfgscale", "Sampler": "sampler", "Scheduler": "scheduler",
            "Model": "model", "SwarmVersion": "swarm_version", "AspectRatio": "aspectratio", "Width": "width",
            "Height": "height",
        }.items()
    }
)
SWARM = rf"""
swarm_json AS (SELECT file_id, j FROM (
    SELECT file_id, CASE WHEN json_valid(parameters) AND list_contains(json_keys(parameters), 'sui_image_params')
      THEN parameters WHEN json_valid(user_comment) THEN user_comment END AS j FROM raw_tags)
    WHERE list_contains(json_keys(j), 'sui_image_params')),
swarm_mentions AS (
    SELECT s.file_id, CAST(l.key AS INT) AS slot, regexp_replace(CASE WHEN l.type = 'OBJECT' THEN l.value->>'$.model'
        ELSE l.value->>'$' END, '\.safetensors$', '') AS name,
      CASE WHEN l.type = 'OBJECT' THEN coalesce(l.value->>'$.weight', '1.0')
        ELSE coalesce(CAST(try_cast(json_extract_string(s.j, concat('$.sui_image_params.loraweights[', l.key, ']')) AS DOUBLE) AS VARCHAR), '1.0')
        END AS weight
    FROM swarm_json s, json_each(s.j, '$.sui_image_params.loras') l
    UNION ALL
    SELECT s.file_id, 1000000 + CAST(m.key AS INT), regexp_replace(m.value->>'$.name', '\.safetensors$', ''), NULL
    FROM swarm_json s, json_each(s.j, '$.sui_models') m WHERE m.value->>'$.param' = 'used_loras'),
swarm_first AS (SELECT file_id, name, min(slot) AS slot, arg_min(concat_ws(':', name, weight), slot) AS mention
    FROM swarm_mentions GROUP BY ALL),
swarm_loras AS (SELECT file_id, list(mention ORDER BY slot) AS loras FROM swarm_first GROUP BY ALL),
swarm_models AS (SELECT s.file_id, CAST(m.key AS INT) AS pos, m.value->>'$.name' AS name, m.value->>'$.param' AS param,
    m.value->>'$.hash' AS hash FROM swarm_json s, json_each(s.j, '$.sui_models') m),
swarm AS (SELECT file_id, j->>'$.sui_image_params.prompt' AS prompt,
    j->>'$.sui_image_params.negativeprompt' AS negative_prompt, {_SWARM_PARAMS} AS params, loras,
    j->>'$.sui_extra_data.date' AS date,
    coalesce(j->>'$.sui_extra_data.generation_time', j->>'$.sui_extra_data.prep_time') AS generation_time
    FROM swarm_json LEFT JOIN swarm_loras USING (file_id))"""

_FIELDS = "file_id, prompt, negative_prompt, params, loras"
# Usable files: images within the limits.
USABLE = f"""usable AS (SELECT * FROM inventory WHERE {IS_IMAGE} AND length <= 78643200
    AND CAST(width AS BIGINT) * height <= 104857600)"""
# The first format that accepts a file wins.
RECORDS = f"""{SWARM}, {COMFY}, {NOVELAI}, {EASY},
{a1111("raw_tags", "parameters", "a1111")},
{a1111("raw_tags", "sidecar_text", "sidecar")},
candidates AS (
    SELECT 1 AS rank, 'SwarmUI' AS tool, {_FIELDS}, date, generation_time FROM swarm
    UNION ALL SELECT 2, 'ComfyUI', {_FIELDS}, NULL, NULL FROM comfy
    UNION ALL SELECT 3, 'NovelAI', {_FIELDS}, NULL, NULL FROM novelai
    UNION ALL SELECT 4, 'EasyDiffusion', {_FIELDS}, NULL, NULL FROM easy
    UNION ALL SELECT 5, CASE WHEN prompt LIKE 'masterpiece, best quality,%' THEN 'NovelAI' ELSE 'A1111' END,
        {_FIELDS}, NULL, NULL FROM a1111
    UNION ALL SELECT 6, 'A1111', {_FIELDS}, NULL, NULL FROM sidecar),
records AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY rank) = 1)"""
META = f"""{USABLE}, {RECORDS},
meta AS (SELECT u.file_id, u.folder, u.mtime, u.name, u.width, u.height, coalesce(r.tool, 'Unknown') AS tool,
    coalesce(r.prompt, '') AS prompt, coalesce(r.negative_prompt, '') AS negative_prompt,
    coalesce(r.params, []) AS params, coalesce(r.loras, []) AS loras, r.date, r.generation_time
    FROM usable u JOIN raw_tags USING (file_id) LEFT JOIN records r USING (file_id))"""
# The same with an error row, of size and name only, for each image beyond the limits.
ALL_META = f"""{META},
every AS (SELECT * FROM meta UNION ALL
    SELECT file_id, folder, mtime, name, width, height, NULL, NULL, NULL, NULL, NULL, NULL, NULL
    FROM inventory WHERE {IS_IMAGE} AND file_id NOT IN (SELECT file_id FROM usable))"""
