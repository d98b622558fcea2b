"""Inventory and tags derived from the given tables.

The SQL is the same for Spark and DuckDB, so each oracle starts from the same
rows as the query it checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixledger.operators.stages import settle

#: Rows of narrow tables from which one task derives and parses texts.
ROWS_PER_TASK = 50_000

INVENTORY_SQL = """
SELECT event_id AS file_id,
       concat('/pictures/', event_type, '/user', CAST(user_id AS STRING)) AS folder,
       concat(CASE WHEN event_id % 37 = 0 THEN '.' ELSE '' END, 'Img', CAST(event_id AS STRING),
              CASE event_id % 9 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.jpeg'
                WHEN 3 THEN '.webp' WHEN 4 THEN '.gif' WHEN 5 THEN '.PNG' WHEN 6 THEN '.txt'
                WHEN 7 THEN '.tif' ELSE '.bmp' END) AS name,
       ts AS mtime,
       CAST(floor(value * 400000) AS BIGINT) AS length,
       CAST(256 + (event_id * 37) % 12000 AS INT) AS width,
       CAST(256 + (event_id * 91) % 12000 AS INT) AS height
FROM events
"""

RAW_TAGS_SQL = """
WITH b AS (
  SELECT e.event_id AS file_id, e.event_id % 8 AS kind, e.event_id % 16 AS kind16, e.event_id % 3 AS m3,
         CAST(e.event_id AS STRING) AS id, CAST(10 + e.event_id % 40 AS STRING) AS steps,
         CAST(64 * (4 + e.event_id % 13) AS STRING) AS w, CAST(64 * (4 + e.event_id % 11) AS STRING) AS h,
         CAST(e.event_id % 10 AS STRING) AS d, p.p_name AS pname, p.p_brand AS brand, p.p_type AS ptype
  FROM (SELECT event_id, event_id % (SELECT count(*) FROM part) AS pk FROM events) e
  JOIN part p ON p.p_partkey = e.pk
), t AS (
  SELECT *,
    concat(pname, ', <lora:', ptype, ':0.', d, '> <LORA:base>', chr(10), 'Negative prompt: blurry ', d, chr(10),
           'Steps: ', steps, ', Sampler: Euler a, CFG scale: 7.', d, ', Seed: ', id, ', Size: ', w, 'x', h,
           ', Model hash: abc', d, ', Model: ', brand, ', Clip skip: 2, LoRA: [', ptype, ':0.', d, ', extra]') AS a1111
  FROM b
), j AS (
  SELECT *,
    concat('{"sui_image_params":{"prompt":"', pname, '","negativeprompt":"bad","seed":', id, ',"steps":', steps,
           ',"cfgscale":7.0,"sampler":"euler","scheduler":"","model":"', brand, '","width":', w, ',"height":', h, ',"loras":',
           CASE WHEN kind16 = 4 THEN concat('[{"model":"', ptype, '.safetensors","weight":0.5},{"model":"style"}]')
                ELSE concat('["', ptype, '.safetensors","style"],"loraweights":["0.8"]') END,
           '},"sui_extra_data":{"date":"2024-01-0', CAST(1 + file_id % 9 AS STRING), '","prep_time":"1.', d, ' sec"},',
           '"sui_models":[{"name":"', brand, '","param":"model","hash":"0xabcdef', d, '"},{"name":"used', d, '.safetensors","param":"used_loras","hash":"0x1"}]}') AS swarm,
    concat('{"9":{"class_type":"PrimitiveInt","inputs":{"link":["3",0],"value":', id, '}},',
           '"3":{"class_type":"KSampler","inputs":{"seed":["9",0],"steps":', steps, ',"cfg":7.0,"sampler_name":"euler","model":["4",0]}},',
           '"4":{"class_type":"CheckpointLoaderSimple","inputs":{"ckpt_name":"', brand, '"}},',
           '"10":{"class_type":"LoraLoader","inputs":{"lora_name":"', ptype, '.safetensors","strength_model":0.', d, '}},',
           '"7":{"class_type":"CLIPTextEncode","inputs":{"text":"bad"}},',
           '"6":{"class_type":"CLIPTextEncode","inputs":{"text":"', pname, ' <lora:txt:1>"}}}') AS comfy
  FROM t
)
SELECT file_id,
  CASE WHEN kind = 0 THEN a1111
       WHEN kind = 1 THEN concat('masterpiece, best quality, ', a1111)
       WHEN kind = 2 THEN concat('{"Software":"NovelAI","prompt":"', pname, ' <lora:n:1>","negative_prompt":"low","steps":', steps, ',"sampler":"k_euler","seed":', id, ',"scale":5.5,"sm":true,"width":', w, ',"height":', h, '}')
       WHEN kind = 3 THEN concat('{"prompt":"', pname, '","negative_prompt":"ugly","width":', w, ',"height":', h, ',"seed":', id, ',"steps":', steps, ',"cfg_scale":7.5,"model":"', brand, '"}')
       WHEN kind = 4 AND m3 <> 0 THEN swarm
       WHEN kind = 5 THEN a1111
       WHEN kind = 7 THEN pname END AS parameters,
  CASE WHEN kind = 5 AND m3 <> 0 THEN comfy WHEN kind = 5 THEN '{broken' END AS prompt_json,
  CASE WHEN kind = 5 AND m3 = 0 THEN comfy END AS workflow_json,
  CASE WHEN kind = 4 AND m3 = 0 THEN swarm END AS user_comment,
  CASE WHEN kind = 6 THEN a1111 END AS sidecar_text
FROM j
"""


def _view(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for table in tables:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        # A catalog lies in many files. The test tables are one small file each, so
        # their narrow rows are spread before the long texts are derived from them.
        # Their number grows with the rows, so that a task's work does not.
        if table == "events":
            width = max(spark.sparkContext.defaultParallelism, df.count() // ROWS_PER_TASK)
            if df.rdd.getNumPartitions() < width:
                df = df.repartition(width, "event_id")
        df.createOrReplaceTempView(table)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    _view(spark, sf_dir, "events")
    # Names are derived here but would be stored; filters must not derive them anew.
    return settle(spark.sql(INVENTORY_SQL), "folder", "name")


def raw_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    _view(spark, sf_dir, "events", "part")
    return spark.sql(RAW_TAGS_SQL)


def tagged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows with their tags."""
    return inventory(spark, sf_dir).join(raw_tags(spark, sf_dir), "file_id")


def oracle(sql: str, inventory: bool = False, tags: bool = False, ctes: str = "") -> str:
    """Oracle SQL with the derived tables it needs as leading CTEs."""
    parts = []
    if inventory:
        parts.append(f"inventory AS ({INVENTORY_SQL})")
    if tags:
        parts.append(f"raw_tags AS ({RAW_TAGS_SQL})")
    if ctes:
        parts.append(ctes)
    return (f"WITH {', '.join(parts)} " if parts else "") + sql
