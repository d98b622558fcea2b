"""The parsers over texts of more kinds than the catalog's: all patterns, all fallbacks, list graphs, repeated keys.

The texts are derived from the given tables by SQL that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import reference_sql as ref
from checks.common import Queries, joined, params_text
from pixledger.operators import a1111, comfy, json_formats

#: Every label in turn, in other case, order and spacing; some left out, some twice, some with values that do not match.
TEXTS_SQL = """
SELECT event_id AS file_id, concat(
  CASE event_id % 4 WHEN 0 THEN 'a red fox' WHEN 1 THEN concat('hills, hires STEPS: ', event_id % 9, chr(10)) WHEN 2 THEN '' ELSE 'Seed of doubt <lora:x' END,
  CASE event_id % 5 WHEN 0 THEN concat(chr(10), 'NEGATIVE prompt: low, Sampler: none') WHEN 1 THEN '' WHEN 2 THEN concat(chr(10), 'Negative prompt:') ELSE concat(chr(10), 'Negative prompt: bad ', event_id) END,
  chr(10),
  CASE WHEN event_id % 2 = 0 THEN concat('Steps: ', event_id % 50, ', ') ELSE concat('steps:', event_id % 50, ',Steps: 7, ') END,
  CASE event_id % 3 WHEN 0 THEN 'Sampler: DPM++ 2M Karras, ' WHEN 1 THEN concat('sampler:Euler a', chr(10)) ELSE '' END,
  CASE event_id % 4 WHEN 0 THEN 'CFG scale: 7.5, ' WHEN 1 THEN 'CFG Scale: 7, ' WHEN 2 THEN 'cfg SCALE:.5, ' ELSE 'CFG: 3, ' END,
  CASE event_id % 3 WHEN 0 THEN concat('Seed: ', event_id, ', ') WHEN 1 THEN 'Seed: -1, ' ELSE concat('seed:  ', event_id, ', ') END,
  CASE event_id % 4 WHEN 0 THEN 'Size: 512x768, ' WHEN 1 THEN 'size: 64x32, ' WHEN 2 THEN '' ELSE 'Size: 12 x 5, ' END,
  CASE event_id % 3 WHEN 0 THEN 'Model hash: ab12CD, ' ELSE '' END,
  CASE event_id % 5 WHEN 0 THEN 'Model: sd xl_base 1.0, ' WHEN 1 THEN 'model:v2,' ELSE '' END,
  CASE event_id % 7 WHEN 0 THEN 'Clip skip: 2, ' WHEN 1 THEN 'CLIP SKIP:1, ' ELSE '' END,
  CASE event_id % 6 WHEN 0 THEN 'Hires upscale: 1.5, Hires steps: 10, ' WHEN 1 THEN 'hires upscale: 2, ' ELSE '' END,
  CASE event_id % 5 WHEN 2 THEN 'Denoising strength: 0.35, ' ELSE '' END,
  CASE event_id % 5 WHEN 3 THEN 'VAE: kl f8.pt, ' WHEN 4 THEN 'vae:x' ELSE '' END,
  CASE event_id % 9 WHEN 0 THEN ', ENSD: 31337' WHEN 1 THEN ', ensd:5' ELSE '' END,
  CASE event_id % 8 WHEN 0 THEN concat(', Scheduler: Karras', chr(10)) WHEN 1 THEN ', scheduler: simple' ELSE '' END,
  CASE event_id % 6 WHEN 5 THEN ', Aesthetic score: 6.25' ELSE '' END) AS parameters
FROM events
"""

#: Node graphs as objects and as lists, with each name or its stand-in given, empty, zero or missing.
GRAPHS_SQL = """
WITH parts AS (SELECT event_id AS file_id,
    CASE event_id % 5 WHEN 0 THEN '"cfg":0,"cfg_scale":6.5' WHEN 1 THEN '"cfg_scale":4' WHEN 2 THEN '"cfg":8.0' WHEN 3 THEN '"cfg":8.0,"cfg_scale":1' ELSE '"denoise":1' END AS cfg,
    CASE event_id % 4 WHEN 0 THEN '"sampler_name":"euler"' WHEN 1 THEN '"sampler_name":"","sampler":"dpm"' WHEN 2 THEN '"sampler":"ddim"' ELSE '"seed":1' END AS sampler,
    CASE event_id % 3 WHEN 0 THEN '"vae_name":"a.vae"' WHEN 1 THEN '"vae":"b.vae"' ELSE '"vae_name":"","vae":"c.vae"' END AS vae,
    CASE event_id % 7 WHEN 0 THEN '"class_type":"","type":' WHEN 1 THEN '"type":' ELSE '"class_type":' END AS kind,
    CASE WHEN event_id % 11 = 0 THEN '"steps":1,"steps":2' ELSE '"steps":["9",1]' END AS steps, event_id % 2 = 0 AS listed
  FROM events)
SELECT file_id, concat(CASE WHEN listed THEN '{"extra":1,"nodes":[{"id":3,' ELSE '{"3":{' END, kind, '"KSamplerAdvanced","inputs":{', cfg, ',', sampler, ',', steps, '}},',
    CASE WHEN listed THEN '{"id":"9",' ELSE '"9":{' END, kind, '"PrimitiveInt","inputs":{"link":["3",0],"value":', file_id, '}},',
    CASE WHEN listed THEN '{"id":4,' ELSE '"4":{' END, kind, '"VAELoader","inputs":{', vae, '}},',
    CASE WHEN listed THEN '{"id":5,' ELSE '"5":{' END, kind, '"UpscaleModelLoader","inputs":{"model_name":"up', file_id % 3, '"}},',
    CASE WHEN listed THEN '{"id":6,' ELSE '"6":{' END, kind, '"ControlNetLoader","inputs":{"control_net_name":"edge"}},',
    CASE WHEN listed THEN '{"id":7,' ELSE '"7":{' END, kind, '"LoraLoaderModelOnly","inputs":{"lora_name":"style.safetensors"}},',
    CASE WHEN listed THEN '{"id":8,' ELSE '"8":{' END, kind, '"CLIPSetLastLayer","inputs":{"stop_at_clip_layer":-2}}', CASE WHEN listed THEN ']}' ELSE '}' END) AS prompt_json,
  CAST(NULL AS STRING) AS workflow_json
FROM parts
"""

#: Swarm objects with either name of the generation time, and keys that come twice.
SWARM_SQL = """
SELECT event_id AS file_id, concat('{"sui_image_params":{"prompt":"old","prompt":"p', event_id % 3, '","seed":1,"steps":', event_id % 30, ',"seed":', event_id, '},"sui_extra_data":{',
    CASE event_id % 4 WHEN 0 THEN '"generation_time":"2 s","prep_time":"1 s"' WHEN 1 THEN '"generation_time":"","prep_time":"1 s"' WHEN 2 THEN '"prep_time":"3 s"' ELSE '"date":"d"' END, '}}') AS parameters
FROM events
"""


def _texts(spark, sf, sql):
    fx._view(spark, sf, "events")
    return spark.sql(sql)


def every_pattern(spark, sf):
    parsed = a1111.parse_a1111(_texts(spark, sf, TEXTS_SQL), out="r").where("r IS NOT NULL")
    return parsed.select("file_id", "r.prompt", "r.negative_prompt", params_text("r.params").alias("params"), joined("r.loras").alias("loras"))


def every_fallback(spark, sf):
    graphs = comfy.parse_comfy(_texts(spark, sf, GRAPHS_SQL), out="r")
    return graphs.select("file_id", params_text("r.params").alias("params"), joined("r.loras").alias("loras"))


def repeated_keys(spark, sf):
    objects = json_formats.with_json_object(_texts(spark, sf, SWARM_SQL), "parameters", "_object")
    parsed = json_formats.parse_swarm(objects, ["_object"], "r")
    return parsed.select("file_id", "r.prompt", params_text("r.params").alias("params"), "r.generation_time")


_FALLBACKS_SQL = """
SELECT event_id AS file_id, array_to_string(list_sort(list_filter([
    CASE event_id % 5 WHEN 0 THEN 'CFG=6.5' WHEN 1 THEN 'CFG=4' WHEN 4 THEN NULL ELSE 'CFG=8.0' END, 'ControlNet=edge',
    CASE event_id % 4 WHEN 0 THEN 'Sampler=euler' WHEN 1 THEN 'Sampler=dpm' WHEN 2 THEN 'Sampler=ddim' ELSE 'Seed=1' END,
    concat('Steps=', CASE WHEN event_id % 11 = 0 THEN 2 ELSE event_id END), concat('UpscaleModel=up', event_id % 3),
    CASE event_id % 3 WHEN 0 THEN 'VAE=a.vae' WHEN 1 THEN 'VAE=b.vae' ELSE 'VAE=c.vae' END, 'clip_skip=-2'], lambda p: p IS NOT NULL)), '|') AS params, 'style' AS loras
FROM events
"""
_REPEATED_SQL = """
SELECT event_id AS file_id, concat('p', event_id % 3) AS prompt, concat('Seed=', event_id, '|Steps=', event_id % 30) AS params,
  CASE event_id % 4 WHEN 0 THEN '2 s' WHEN 1 THEN '1 s' WHEN 2 THEN '3 s' END AS generation_time FROM events
"""

QUERIES: Queries = {
    "F5_every_pattern": (
        every_pattern,
        f"WITH texts AS ({TEXTS_SQL}), {ref.a1111('texts', 'parameters', 'found')} SELECT file_id, prompt, negative_prompt, {ref.PARAMS_TEXT} AS params, {ref.LORAS_TEXT} AS loras FROM found",
    ),
    "F11_every_fallback": (every_fallback, _FALLBACKS_SQL),
    "F8_repeated_keys": (repeated_keys, _REPEATED_SQL),
}
