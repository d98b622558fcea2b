"""Golden rows for the five formats and the cascade, quirks included."""

import json
import re

import pytest
from pyspark.sql import functions as F

from pixledger.operators import a1111, comfy, json_formats, resolve

TAGS = "file_id long, parameters string, prompt_json string, workflow_json string, user_comment string, sidecar_text string"


def tags(spark, rows):
    full = [(i, *[row.get(k) for k in ("parameters", "prompt_json", "workflow_json", "user_comment", "sidecar_text")]) for i, row in enumerate(rows)]
    return spark.createDataFrame(full, TAGS)


def records(df, name="r"):
    rows = df.orderBy("file_id").select(name).collect()
    return [None if row[0] is None else row[0].asDict(recursive=True) for row in rows]


def a1111_records(spark, texts):
    return records(a1111.parse_a1111(tags(spark, [{"parameters": t} for t in texts]), out="r"))


def test_a1111_full(spark):
    text = (
        "a cat, <lora:x:0.5> \U0001f600\nNegative prompt: dog\nSteps: 20, Sampler: Euler a, CFG scale: 7.5, Seed: 42, "
        "Size: 512x768, Model hash: ab_1, Model: my model , VAE: v.pt, Clip skip: 2, Hires upscale: 1.5, Hires steps: 9,"
        " Denoising strength: 0.4, ENSD: 31337, Aesthetic score: 6.1, Scheduler: Karras"
    )
    (r,) = a1111_records(spark, [text])
    assert r["prompt"] == "a cat, <lora:x:0.5> \U0001f600"
    assert r["negative_prompt"] == "dog"
    assert r["params"] == {
        "Steps": "20", "Sampler": "Euler a", "CFG": "7.5", "Seed": "42", "Model": "my model", "Scheduler": "Karras",
        "model_hash": "ab_1", "clip_skip": "2", "hires_upscale": "1.5", "hires_steps": "9", "denoising_strength": "0.4",
        "Width": "512", "Height": "768", "vae": "v.pt", "ensd": "31337", "aesthetic_score": "6.1",
    }
    assert r["loras"] == ["x:0.5"]


@pytest.mark.parametrize(
    "text, prompt, negative, params",
    [
        # Marker at the very start does not open the parameters.
        ("Steps: 5, Seed: 1", "Steps: 5,", "", {"Steps": "5", "Seed": "1"}),
        # The cut of the negative text takes the first listed marker, not the earliest.
        ("p Seed: 1 Negative prompt: bad Sampler: a Model: m Steps: 4", "p Seed: 1", "bad Sampler: a Model: m",
         {"Seed": "1", "Sampler": "a Model: m Steps: 4", "Model": "m Steps: 4", "Steps": "4"}),
        ("p Negative prompt: bad Sampler: x Steps: 5", "p", "bad", {"Sampler": "x Steps: 5", "Steps": "5"}),
        # Parameters before the negative prompt.
        ("p Steps: 5\nNEGATIVE PROMPT: bad\nSeed: 7", "p Steps: 5", "bad", {"Steps": "5", "Seed": "7"}),
        # A negative seed is no match.
        ("p\nSteps: 4, Seed: -1", "p", "", {"Steps": "4"}),
        # Hires steps can answer for Steps, but only the exact case opens the parameters.
        ("p\nHires steps: 3, Steps: 9", "p\nHires steps: 3,", "", {"Steps": "3", "hires_steps": "3"}),
        # Unicode digits and spaces.
        ("p\nSteps:\u00a0٢٠, Seed: 1", "p", "", {"Steps": "٢٠", "Seed": "1"}),
        # A blank value is kept as an empty one.
        ("p\nSampler:  , Steps: 1", "p\nSampler:  ,", "", {"Sampler": "", "Steps": "1"}),
        # Any case of the label; a capital X gives no size.
        ("p\nsteps: 6, SIZE: 5X6", "p\nsteps: 6, SIZE: 5X6", "", {"Steps": "6"}),
        ("p Negative prompt: n\nSize: 5x6", "p", "n", {"Width": "5", "Height": "6"}),
    ],
)
def test_a1111_quirks(spark, text, prompt, negative, params):
    (r,) = a1111_records(spark, [text])
    assert (r["prompt"], r["negative_prompt"], r["params"]) == (prompt, negative, params)


def test_a1111_declines_without_parameters(spark):
    assert a1111_records(spark, ["just a prompt", "", None, "Negative prompt: x"]) == [None] * 4
    (r,) = a1111_records(spark, ["only <lora:a:1>"])
    assert r["params"] == {} and r["loras"] == ["a:1"]


def comfy_records(spark, graphs):
    rows = [g if isinstance(g, dict) and "prompt_json" in g else {"prompt_json": json.dumps(g)} for g in graphs]
    return records(comfy.parse_comfy(tags(spark, rows), out="r"))


def node(kind, **inputs):
    return {"class_type": kind, "inputs": inputs}


def test_comfy_links_and_last_writer(spark):
    graph = {
        "1": node("KSampler", seed=["5", 0], steps=20, cfg=0, cfg_scale=6.5, sampler_name="", sampler="euler"),
        "2": node("KSamplerAdvanced", seed=["9", 0], noise_seed=3, steps=None, cfg=["6", 1]),
        "5": node("Primitive", link=["1", 0], value=18446744073709551615),
        "6": node("Note", flag=True, other=3),
        "3": node("CheckpointLoaderSimple", ckpt_name="m.safetensors"),
        "4": node("VAELoader", vae_name="v"),
        "7": node("UpscaleModelLoader", model_name="u"),
        "8": node("ControlNetLoader", control_net_name="c"),
        "10": node("CLIPSetLastLayer", stop_at_clip_layer=-2),
        "11": {"type": "LoraLoader", "inputs": {"lora_name": "a.safetensors", "strength_model": 0.8}},
        "12": node("LoraLoaderModelOnly", lora_name="b", strength_model=["5", 0]),
        "13": node("LoraLoader", lora_name=["5", 0], strength_model=1),
    }
    (r,) = comfy_records(spark, [graph])
    assert r["params"] == {
        "Seed": "18446744073709551615", "Steps": "20", "CFG": "True", "Sampler": "euler", "Model": "m.safetensors",
        "VAE": "v", "UpscaleModel": "u", "ControlNet": "c", "clip_skip": "-2",
    }
    assert r["loras"] == ["a:0.8", "b"]
    assert (r["prompt"], r["negative_prompt"]) == ("", "")


def test_comfy_prompts(spark):
    graph = {
        "1": node("CLIPTextEncode", text="short"),
        "2": node("CLIPTextEncode", text=["9", 0]),
        "3": node("CLIPTextEncode", text='["9",0]'),
        "4": node("CLIPTextEncode", text="equal 1"),
        "5": node("CLIPTextEncode", text="equal 2"),
        "6": node("CLIPTextEncode", text=12345678901),
        "7": "not a node",
    }
    (r,) = comfy_records(spark, [graph])
    assert (r["prompt"], r["negative_prompt"]) == ('["9",0]', "equal 1")


def test_comfy_graph_choice(spark):
    good = json.dumps({"1": node("CLIPTextEncode", text="hi")})
    rows = [
        {"prompt_json": "null", "workflow_json": good},
        {"prompt_json": "{broken", "workflow_json": good},
        {"prompt_json": "[1]", "workflow_json": good},
        {"prompt_json": None, "workflow_json": good},
        {"prompt_json": "{}", "workflow_json": good},
        {"prompt_json": "5"},
        {"prompt_json": None},
    ]
    found = [r and r["prompt"] for r in comfy_records(spark, rows)]
    assert found == ["hi", "hi", None, "hi", "", None, None]


def test_comfy_node_list(spark):
    graph = {
        "version": 0.4,
        "nodes": [
            {"id": 7, "type": "KSampler", "inputs": {"seed": [9, 0], "steps": 3}},
            {"id": 9, "type": "Seed", "inputs": {"value": 77}},
            "junk",
        ],
    }
    (r,) = comfy_records(spark, [graph])
    assert r["params"] == {"Seed": "77", "Steps": "3"}


def test_comfy_list_inputs_are_flagged(spark):
    graphs = [
        {"nodes": [{"id": 1, "type": "KSampler", "inputs": [{"name": "model"}]}, {"id": 2, "type": "CLIPTextEncode", "inputs": {"text": "p"}}]},
        {"nodes": [{"id": 1, "type": "Other", "inputs": []}]},
    ]
    df = comfy.parse_comfy(tags(spark, [{"prompt_json": json.dumps(g)} for g in graphs]), out="r").orderBy("file_id")
    rows = df.select("r.prompt", "r_error").collect()
    assert rows[0].prompt == "p" and rows[0].r_error is not None
    assert rows[1].r_error is None


def test_novelai(spark):
    texts = [
        json.dumps({"Software": "NovelAI 4", "prompt": "p <lora:a:1>", "steps": 28, "scale": 5.0, "sm": False, "seed": None, "width": 8, "height": 9}),
        json.dumps({"Software": None, "prompt": "p"}),
        json.dumps({"Software": 5}),
        "{'Software': 'NovelAI'}",
    ]
    found = records(json_formats.parse_novelai_json(tags(spark, [{"parameters": t} for t in texts]), out="r"))
    assert found[0]["params"] == {"Steps": "28", "CFG": "5.0", "sm": "False", "width": "8", "height": "9"}
    assert (found[0]["prompt"], found[0]["negative_prompt"], found[0]["loras"]) == ("p <lora:a:1>", "", ["a:1"])
    assert found[1:] == [None, None, None]


def test_easydiffusion(spark):
    base = {"prompt": "p", "negative_prompt": None, "width": 1, "height": 2, "cfg_scale": 7, "seed": 0}
    texts = [json.dumps(base), json.dumps({**base, "sui_image_params": {}}), json.dumps({"prompt": "p"})]
    found = records(json_formats.parse_easydiffusion(tags(spark, [{"parameters": t} for t in texts]), out="r"))
    assert found[0]["params"] == {"CFG": "7", "Seed": "0"}
    assert found[0]["negative_prompt"] is None
    assert found[1:] == [None, None]


def swarm_record(spark, data):
    df = json_formats.with_json_object(tags(spark, [{"parameters": json.dumps(data)}]), "parameters", "o")
    return records(json_formats.parse_swarm(df, ["o"], "r"))[0]


def test_swarm(spark):
    image = {
        "prompt": "p", "negativeprompt": "n", "seed": None, "steps": 0, "cfgscale": 7.0, "sampler": 0, "scheduler": "",
        "model": "m", "width": 5, "loras": ["a.safetensors", "b", "c", "a", 7, "d", "e", ""],
        "loraweights": ["0.5", "bad", 1, "9", 2, True, None],
    }
    models = [
        {"name": "m", "param": "model", "hash": "0x1"},
        {"name": "b.safetensors", "param": "used_loras"},
        {"name": "z.safetensors", "param": "used_loras", "hash": None},
    ]
    r = swarm_record(spark, {"sui_image_params": image, "sui_models": models, "sui_extra_data": {"date": "", "prep_time": "1 sec", "generation_time": ""}})
    assert r["params"] == {"Steps": "0", "CFG": "7.0", "Model": "m", "Width": "5"}
    assert r["loras"] == ["a:0.5", "b:1.0", "c:1.0", "d:1.0", "e:1.0", "z"]
    assert [m["name"] for m in r["models"]] == ["m", "b.safetensors", "z.safetensors"]
    assert (r["date"], r["generation_time"]) == (None, "1 sec")


def test_swarm_lora_objects(spark):
    loras = [{"model": "a", "weight": 0.5}, {"model": "b"}, {"model": "c", "weight": None}, {"model": "d", "weight": 1}, {"weight": 2}, {"model": "a", "weight": 9}]
    r = swarm_record(spark, {"sui_image_params": {"loras": loras}})
    assert r["loras"] == ["a:0.5", "b:1.0", "c:None", "d:1"]
    assert (r["prompt"], r["params"], r["models"]) == ("", {}, [])


def test_swarm_null_parts_do_not_fail(spark):
    r = swarm_record(spark, {"sui_image_params": None, "sui_extra_data": None, "sui_models": None})
    assert (r["tool"], r["prompt"], r["params"], r["loras"], r["models"]) == ("SwarmUI", "", {}, [], [])


A = "p\nSteps: 5, Seed: 1"
SWARM = json.dumps({"sui_image_params": {"prompt": "s", "seed": 1}})
GRAPH = json.dumps({"1": node("CLIPTextEncode", text="g")})
CASES = [
    ({"parameters": SWARM, "prompt_json": GRAPH}, "SwarmUI", "s"),
    ({"parameters": A, "user_comment": "  " + SWARM}, "SwarmUI", "s"),
    ({"parameters": A, "prompt_json": GRAPH}, "ComfyUI", "g"),
    ({"parameters": A, "prompt_json": "[1]"}, "A1111", "p"),
    ({"parameters": A}, "A1111", "p"),
    ({"parameters": "masterpiece, best quality, " + A}, "NovelAI", "masterpiece, best quality, p"),
    ({"parameters": "{masterpiece, best quality, " + A}, "A1111", "{masterpiece, best quality, p"),
    ({"parameters": "{a|b} " + A}, "A1111", "{a|b} p"),
    ({"parameters": "no params", "sidecar_text": A}, "A1111", "p"),
    ({"sidecar_text": "masterpiece, best quality, " + A}, "A1111", "masterpiece, best quality, p"),
    ({"parameters": "no params"}, "Unknown", ""),
    ({"sidecar_text": "words only"}, "Unknown", ""),
    ({}, "Unknown", ""),
    ({"parameters": "{bad json", "user_comment": "{bad"}, "Unknown", ""),
]


def test_cascade(spark):
    df = tags(spark, [case[0] for case in CASES])
    files = df.select("*", F.lit("/f").alias("folder"), F.concat(F.lit("n"), "file_id", F.lit(".png")).alias("name"),
                      F.lit(5).cast("long").alias("length"), F.lit(10).alias("width"), F.lit(20).alias("height"))
    rows = resolve.metadata_table(resolve.resolve_metadata(files)).orderBy("file_id").collect()
    assert [(r.tool, r.prompt) for r in rows] == [case[1:] for case in CASES]
    assert {(r.width, r.height, r.error_type) for r in rows} == {(10, 20, None)}
    assert rows[0].params == {"Seed": "1"} and rows[-1].params == {}


def test_limits_are_strict(spark):
    rows = [(1, "a.png", 78643200, 10240, 10240), (2, "b.png", 78643201, 1, 1), (3, "c.png", None, 50000, 50000), (4, "d.png", None, None, None), (5, "e.txt", 1, 1, 1)]
    files = spark.createDataFrame(rows, "file_id long, name string, length long, width int, height int")
    files = files.select("*", *[F.lit(None).cast("string").alias(c) for c in resolve.TAG_COLUMNS])
    found = {r.file_id: (r.tool, r.error_type) for r in resolve.resolve_metadata(files).collect()}
    assert found == {1: ("Unknown", None), 2: (None, "invalid_file"), 3: (None, "invalid_file"), 4: ("Unknown", None)}


def test_filters_on_the_result_do_not_copy_the_parsers(spark):
    """A filter on a parsed column must not be pushed through the parsers."""
    df = tags(spark, [{"parameters": A}]).select("*", F.lit("n.png").alias("name"), F.lit(1).cast("long").alias("length"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    resolved = resolve.resolve_metadata(df)
    plain = len(resolved._jdf.queryExecution().optimizedPlan().toString())
    filtered = resolved.where("tool = 'A1111' AND prompt <> ''")
    assert len(filtered._jdf.queryExecution().optimizedPlan().toString()) < 1.2 * plain
    assert filtered.count() == 1


def test_the_last_of_repeated_keys_counts_in_every_format(spark):
    graph = '{"1":{"class_type":"CLIPTextEncode","inputs":{"text":"oldlonger"}},"1":{"class_type":"CLIPTextEncode","inputs":{"text":"x","text":"new"}}}'
    (r,) = records(comfy.parse_comfy(tags(spark, [{"prompt_json": graph}]), out="r"))
    assert (r["prompt"], r["negative_prompt"]) == ("new", "")
    flat = '{"Software":"NovelAI","prompt":"a","prompt":"b","steps":1,"steps":2}'
    (r,) = records(json_formats.parse_novelai_json(tags(spark, [{"parameters": flat}]), out="r"))
    assert r["prompt"] == "b" and r["params"]["Steps"] == "2"
    easy = '{"prompt":"a","negative_prompt":"n","width":1,"height":2,"seed":1,"prompt":"b","seed":7}'
    (r,) = records(json_formats.parse_easydiffusion(tags(spark, [{"parameters": easy}]), out="r"))
    assert r["prompt"] == "b" and r["params"]["Seed"] == "7"
    swarm = '{"sui_image_params":{"prompt":"p","seed":1,"seed":2},"other":{"k":1,"k":2}}'
    rows = resolve.resolve_records(tags(spark, [{"parameters": swarm}, {"user_comment": swarm}]))
    for r in records(rows, "record"):
        assert r["tool"] == "SwarmUI" and r["params"]["Seed"] == "2"


def test_a1111_patterns_run_once_and_rows_are_settled_once(spark):
    """A pattern is evaluated once a text; inside the cascade no parser unpacks its rows again."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    texts = tags(spark, [{"parameters": "Steps: 20"}])
    assert plan(a1111.parse_a1111(texts, out="r")).count("(?iU)Steps:") == 1
    assert plan(resolve.resolve_records(texts)).count("Generate ") == 1


def test_a_key_is_searched_once_and_a_graph_built_once(spark):
    """Values are taken out of an object's map once, however often a record uses them; nodes are made in one pass."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    texts = json_formats.with_json_object(tags(spark, [{"parameters": "{}"}]), "parameters", "object")
    swarm = plan(json_formats.parse_swarm(texts, ["object"]))
    assert [len(re.findall(rf"_image#\d+\[{key}\]", swarm)) for key in ("seed", "sampler", "prompt")] == [1, 1, 1]
    flat = plan(json_formats.parse_flat_json(texts, "object"))
    assert [len(re.findall(rf"_described#\d+\[{key}\]", flat)) for key in ("seed", "steps", "prompt")] == [1, 1, 1]
    assert plan(comfy.with_graph(texts)).count("bad_inputs,") == 1


def test_swarm_without_image_object_and_with_nulls(spark):
    cases = [
        '{"sui_image_params":5,"sui_extra_data":[1],"sui_models":7}',
        '{"sui_image_params":{"prompt":null,"seed":0,"steps":"","cfgscale":null,"sampler":0,"scheduler":false,"model":[]},"sui_extra_data":{"date":0,"generation_time":"","prep_time":"1 sec"}}',
        '{"sui_image_params":{"loras":["b","a.safetensors","b","a"],"loraweights":[1,"0.5",2]}}',
    ]
    empty, nulls, repeated = records(resolve.resolve_records(tags(spark, [{"parameters": c} for c in cases])), "record")
    assert (empty["prompt"], empty["negative_prompt"], empty["params"], empty["loras"], empty["models"]) == ("", "", {}, [], [])
    assert (nulls["prompt"], nulls["negative_prompt"], nulls["params"]) == (None, "", {"Seed": "0"})
    assert (nulls["date"], nulls["generation_time"]) == (None, "1 sec")
    assert repeated["loras"] == ["b:1.0", "a:0.5"]


def test_links_and_first_inputs_of_a_graph(spark):
    """A link gives the linked node's first plain input in document order, also of a node with one input or repeated keys."""
    graph = (
        '{"1":{"class_type":"KSampler","inputs":{"seed":["2",0],"steps":["3",0],"cfg":["4",0]}},'
        '"2":{"class_type":"P","inputs":{"z":["9",0],"b":7,"a":8}},"3":{"class_type":"P","inputs":{"v":5}},'
        '"4":{"class_type":"P","inputs":{"k":1,"j":2,"k":3}},"5":{"class_type":"P"}}'
    )
    (r,) = records(comfy.parse_comfy(tags(spark, [{"prompt_json": graph}]), out="r"))
    assert r["params"] == {"Seed": "7", "Steps": "5", "CFG": "3"}


@pytest.mark.parametrize(
    "text, params",
    [
        # The first mention has no value of the right shape.
        ("Steps: many, steps: 5, Steps: 6", {"Steps": "5"}),
        # Folding changes the places of what follows.
        ("ß ŉ İ a\nstEPS: 7, mySampler: x y", {"Steps": "7", "Sampler": "x y"}),
        ("cat steps: 7, SIZE: 5X6, size: 5x6, Model:  ", {"Steps": "7", "Model": ""}),
        ("Seed: 1, Size: 64x32, Seed: 2", {"Seed": "1", "Width": "64", "Height": "32"}),
    ],
)
def test_a1111_first_value_of_each_label(spark, text, params):
    (r,) = a1111_records(spark, [text])
    assert r["params"] == params


def test_a1111_empty_and_missing_texts(spark):
    assert a1111_records(spark, ["", None, " ", "<lora:a:1>"])[:3] == [None, None, None]
