"""Golden rows for the column functions; expectations worked out by hand."""

import json

from pyspark.sql import functions as F

from pixledger.functions import jsonvalues as jv
from pixledger.functions import loras, paths, text


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in df.orderBy("i").select(expression).collect()]


def test_image_suffix_needs_a_name_before_the_dot(spark):
    names = [".png", "a.PNG", "x.tif", "x.tiff", "a.b.jpeg", "a.", "_u.png", "png", "a.png.txt", ".a.gif"]
    expected = [False, True, False, True, True, False, True, False, False, True]
    assert column(spark, names, paths.is_image(F.col("v"))) == expected


def test_suffix_and_stem(spark):
    names = ["a.b.png", ".png", "a.", "noext", "x.TXT"]
    assert column(spark, names, paths.suffix(F.col("v"))) == [".png", "", "", "", ".TXT"]
    assert column(spark, names, paths.stem(F.col("v"))) == ["a.b", ".png", "a.", "noext", "x"]


def test_animated_looks_at_the_last_dot_only(spark):
    assert column(spark, [".gif", "a.WebP", "gif", "a.gif.png"], paths.is_animated(F.col("v"))) == [True, True, True, False]


def python_key(name):
    """Natural order as nested lists; superscripts and the like count as text."""
    import re

    parts = re.split(r"(\d+)", name)
    return [int(part) if i % 2 else part.lower() for i, part in enumerate(parts)]


NAMES = [
    "a1", "a02", "a2", "a10", "A3", "a", "ab", "a1b", "a1 b", "10.png", "9.png", "", "x" + "9" * 45, "x1" + "0" * 45,
    "1²3.png", "1²12.png", "٣.png", "4.png", "Ä1", "ä1b", "z", "Img007", "img7a", "img08", "a.1", "a1.5", "a1.10", "~1", "000", "00", "0",
]


def test_natural_key_sorts_as_python_lists_do(spark):
    keys = column(spark, NAMES, text.natural_key(F.col("v")))
    order = sorted(range(len(NAMES)), key=lambda i: (keys[i].encode(), i))
    expected = sorted(range(len(NAMES)), key=lambda i: (python_key(NAMES[i]), i))
    assert [NAMES[i] for i in order] == [NAMES[i] for i in expected]
    equal = dict(zip(NAMES, keys))
    assert equal["a02"] == equal["a2"] and equal["000"] == equal["0"]


def test_reversed_key_turns_the_order_round(spark):
    natural = column(spark, NAMES, text.natural_key(F.col("v")))
    reverse = column(spark, NAMES, text.reversed_key(text.natural_key(F.col("v"))))
    down = sorted(set(natural), key=lambda k: k.encode(), reverse=True)
    assert sorted(set(reverse)) == [reverse[natural.index(k)] for k in down]


def test_collated_order_puts_accents_beside_their_letter(spark):
    df = spark.createDataFrame([(n,) for n in ["z1", "é2", "e10", "E2", "f"]], "name string")
    rows = df.orderBy(text.collated_key(F.col("name")), "name").collect()
    assert [r.name for r in rows] == ["E2", "e10", "é2", "f", "z1"]


def test_strip_takes_unicode_space(spark):
    values = ["\u00a0 a b \u2003", "\x1cx\x1f", "\t\n", "plain", "a\u3000", "", "\ufeffx"]
    assert column(spark, values, text.strip(F.col("v"))) == [v.strip() for v in values]


def test_python_float_text(spark):
    values = [7.0, 7.25, 1e-05, 0.0001, 0.00123, 1e16, 1.5e16, 123456789.5, 1e15, -2.5e-7, 1e100, 0.5, -0.0, 1234567.0,
              12345678.0, 9.999e22, float("inf"), float("nan")]
    found = column(spark, values, F.expr(text.python_float_sql("v")), "double")
    assert found == [str(v) for v in values]


def test_clean_path(spark):
    values = ['  "/a b/" ', "'/a'", "/a", "\"", "''", "\ufeff/a\t", '""/a""']
    assert column(spark, values, paths.clean_path(F.col("v"))) == ["/a b/", "/a", "/a", "", "", "/a", '"/a"']


def test_under_root(spark):
    values = ["/g", "/g/", "/g/a", "/gx", "/g/../x", "/x/../g/a", "/g/./a//b", "/", "/g/a/../.."]
    expected = [True, True, True, False, False, True, True, False, False]
    assert column(spark, values, paths.under_root(F.col("v"), "/g/")) == expected
    assert column(spark, values, paths.under_root(F.col("v"), "/")) == [True] * len(values)


def test_breadcrumb(spark):
    values = ["/a/b", "C:\\x\\y", "\\\\srv\\share", "a/b", "", "/a//b/"]
    names = column(spark, values, F.transform(paths.breadcrumb(F.col("v")), lambda c: c["full_path"]))
    assert names == [["/a", "/a/b"], ["C:", "C:\\x", "C:\\x\\y"], ["\\\\srv", "\\\\srv\\share"], ["a", "a/b"], [], ["/a", "/a/b"]]


def test_breadcrumb_collapse(spark):
    crumbs = paths.breadcrumb(F.col("v"))
    values = ["/a/b/c/d", "/a/b/c/d/e/f"]
    visible = F.transform(paths.breadcrumb_visible(crumbs), lambda c: c["name"])
    hidden = F.transform(paths.breadcrumb_hidden(crumbs), lambda c: c["name"])
    assert column(spark, values, visible) == [list("abcd"), list("adef")]
    assert column(spark, values, hidden) == [[], list("bc")]


def test_last_segment(spark):
    assert column(spark, ["/a/b/", "C:\\x", "", "/"], paths.last_segment(F.col("v"))) == ["b", "x", "Albums", "Albums"]


LORA_TEXTS = [
    "<lora:a:0.5> <LORA:b> <lora:a:0.5>",
    "<lora:a:0.5:0.7>",
    "<lora:x:>",
    "LoRA: [a, , b] lora: [x] LoRA:\u00a0[ c ]",
    "<lora:a> LoRA: [a, b:1]",
    "none",
]


def test_loras(spark):
    expected = [["a:0.5", "b"], ["a:0.5:0.7"], [], ["a", "b", "c"], ["a", "b:1"], []]
    assert column(spark, LORA_TEXTS, loras.extract_loras(F.col("v"))) == expected


def test_search_is_literal(spark):
    assert column(spark, ["50%_a", "50xxa", "ÄB"], text.lower_contains(F.col("v"), "0%_")) == [True, False, False]
    assert column(spark, ["ÄB"], text.lower_contains(F.col("v"), "äb")) == [True]


def test_json_values_as_python_text(spark):
    values = {"s": "x", "i": 5, "big": 18446744073709551615, "f": 7.0, "small": 1e-05, "t": True, "n": None, "neg": -2.50}
    described = jv.describe_values_sql("m")
    df = spark.createDataFrame([(json.dumps(values),)], "v string").withColumn("m", jv.parse_object(F.col("v")))
    found, keys = df.select(F.expr(described).alias("d")).select("d", F.map_keys("d")).first()
    assert {k: v.text for k, v in found.items()} == {k: None if v is None else str(v) for k, v in values.items()}
    assert keys == list(values)
    assert {k: v.kind for k, v in found.items()} == {
        "s": "str", "i": "int", "big": "int", "f": "float", "small": "float", "t": "bool", "n": "null", "neg": "float",
    }


def test_only_strict_json_objects_parse(spark):
    values = ['{"a":1}', '{"a":1} x', "{'a':1}", "[1]", "null", "", '{"a":1}{"b":2}', '{"a":1},{"b":2}', ' {"a": {"b": [1]}}\n', "{broken", None]
    parsed = [m is not None for m in column(spark, values, jv.parse_object(F.col("v"), "string"))]
    assert parsed == [True, False, False, False, False, False, False, False, True, False, False]
    other = column(spark, values, jv.is_other_json(F.col("v")))
    assert other == [False, False, False, True, False, False, False, False, False, False, False]


def test_truth_of_values(spark):
    values = {"a": "", "b": "0", "c": 0, "d": 0.0, "e": False, "f": [], "g": {}, "h": None, "i": 1, "j": [0], "k": True}
    df = spark.createDataFrame([(json.dumps(values),)], "v string").withColumn("m", jv.parse_object(F.col("v")))
    df = df.withColumn("d", F.expr(jv.describe_values_sql("m")))
    row = df.select(*[F.expr(jv.truthy_sql(f"d['{k}']")).alias(k) for k in [*values, "missing"]]).first().asDict()
    assert row == {**{k: bool(v) for k, v in values.items()}, "missing": False}


def test_paths_of_stores_and_roots(spark):
    values = ["s3a://b/p/x.png", "s3a://b/x.png", "s3a://b", "/x.png", "/", "/a/b"]
    assert column(spark, values, paths.parent(F.col("v"))) == ["s3a://b/p", "s3a://b", "s3a://b", "/", "/", "/a"]
    found = column(spark, values, paths.ancestors(F.col("v")))
    assert found[0] == ["s3a://b", "s3a://b/p", "s3a://b/p/x.png"] and found[2] == ["s3a://b"]
    assert found[4] == ["/"] and found[5] == ["/", "/a", "/a/b"]
    detours = ["s3a://b/a/../c//d", "s3a://b/..", "/a/./b/"]
    assert column(spark, detours, paths.normalise(F.col("v"))) == ["s3a://b/c/d", "s3a://b", "/a/b"]
    assert column(spark, detours, paths.under_root(F.col("v"), "s3a://b")) == [True, True, False]
    assert column(spark, ["/r/.h/x", "/r/a/.x", "/r/a"], paths.in_hidden(F.col("v"), "/r")) == [True, True, False]
    assert column(spark, ["/.r/a/x"], paths.in_hidden(F.col("v"), "/.r")) == [False]


def test_the_last_of_repeated_keys_counts(spark):
    from pixledger.functions.jsonvalues import describe_values_sql, parse_object

    values = ['{"b":1,"a":"x","b":{"k":1,"k":2}}', '{"a":[{"s":1,"s":"t"}]}', "[1]", "{"]
    frame = spark.createDataFrame([(v,) for v in values], "v string").withColumn("m", parse_object(F.col("v")))
    found = [r[0] for r in frame.selectExpr(f"{describe_values_sql('m')} AS d").collect()]
    assert frame.select(F.map_keys("m")).first()[0] == ["b", "a"]
    assert found[0]["b"]["text"] == '{"k":2}' and found[0]["a"]["text"] == "x"
    assert found[1]["a"]["text"] == '[{"s":"t"}]' and found[2] is None and found[3] is None


def test_very_long_numbers_keep_their_order(spark):
    names = ["a" + "1" * 20_000, "a" + "9" * 9_999, "a" + "2" * 20_000]
    keys = column(spark, names, text.natural_key(F.col("v")))
    assert sorted(range(3), key=lambda k: keys[k]) == [1, 0, 2]
