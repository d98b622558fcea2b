"""JSON objects as maps whose values keep their JSON type.

Each text is parsed once into ``map<string,variant>``, which keeps key order and
types, then turned into ``map<string,struct<kind,text,ref>>``: ``text`` is what
Python's ``str()`` gives for the value, so parsers only look keys up.

Functions ending in ``_sql`` return SQL text, so that long expressions over
lambda variables are built in one go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixledger.functions.text import PY_SPACES, bind_sql, python_float_sql

STRICT = {"allowSingleQuotes": "false"}
REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def accept_repeated_keys() -> None:
    """Let the session read objects with repeated keys inside a value, where the last one counts.

    Without the setting Spark takes such a text as malformed. Nothing else hangs on it.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(REPEATED_KEYS) != "true":
        spark.conf.set(REPEATED_KEYS, "true")


def looks_like_object(text: Column) -> Column:
    return F.startswith(F.ltrim(text, F.lit(PY_SPACES)), F.lit("{"))


def parse_strict(text: Column, element: str) -> Column:
    """One JSON value as ``element``; NULL unless the text is exactly one value.

    The brackets make trailing text after the value malformed, which the JSON
    reader would otherwise ignore, and a second value shows in the array's size.
    """
    accept_repeated_keys()
    wrapped = F.from_json(F.concat(F.lit("["), text, F.lit("\n]")), f"array<{element}>", STRICT)
    single = F.filter(F.array(wrapped), lambda values: F.size(values) == 1)
    return F.get(F.get(single, 0), 0)


def parse_object(text: Column, value: str = "variant") -> Column:
    """A JSON object as a map, or NULL for anything else.

    Of a repeated key the last value counts, at the place of the first.
    """
    return last_values(parse_strict(text, f"map<string,{value}>"))


def last_values(entries: Column) -> Column:
    """A map as the JSON reader gives it, repeated keys included, with each key's last value."""
    return F.get(F.transform(F.filter(F.array(entries), lambda m: m.isNotNull()), _settled), 0)


def _settled(m: Column) -> Column:
    keys = F.map_keys(m)
    values = F.transform(F.array_distinct(keys), lambda k: F.get(F.map_values(m), F.size(keys) - F.array_position(F.reverse(keys), k).cast("int")))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), m).otherwise(F.map_from_arrays(F.array_distinct(keys), values))


def last_values_sql(entries: str) -> str:
    """SQL for ``last_values``."""
    last = "get(map_values(m), size(map_keys(m)) - CAST(array_position(reverse(map_keys(m)), k) AS INT))"
    once = "array_distinct(map_keys(m))"
    return bind_sql(entries, "m", f"IF(m IS NULL OR size(m) < 2 OR size({once}) = size(m), m, map_from_arrays({once}, transform({once}, k -> {last})))")


def is_other_json(text: Column) -> Column:
    """Whether the text is valid JSON yet neither an object nor ``null``."""
    kind = F.schema_of_variant(parse_strict(text, "variant"))
    return F.coalesce((kind != "VOID") & ~F.startswith(kind, F.lit("OBJECT")), F.lit(False))


def describe_sql(value: str) -> str:
    """SQL for STRUCT<kind, text, ref> of a variant. kind: str, int, float, bool,
    null, list or dict; ``ref`` is the first of a two-element list, as node links
    are written.

    A decimal without fraction is a float such as 7.0, unless it is too large for
    a long: then it was an integer literal.
    """
    string = f"try_variant_get({value}, '$', 'string')"
    number = python_float_sql(f"try_variant_get({value}, '$', 'double')")
    is_long_int = f"startswith(t, 'DECIMAL') AND length({string}) > 18 AND NOT contains({string}, '.')"
    body = f"""CASE
      WHEN t = 'STRING' THEN named_struct('kind', 'str', 'text', {string}, 'ref', CAST(NULL AS STRING))
      WHEN t = 'BIGINT'
        THEN named_struct('kind', 'int', 'text', CAST(try_variant_get({value}, '$', 'bigint') AS STRING), 'ref', CAST(NULL AS STRING))
      WHEN {is_long_int}
        THEN named_struct('kind', 'int', 'text', {string}, 'ref', CAST(NULL AS STRING))
      WHEN t = 'BOOLEAN'
        THEN named_struct('kind', 'bool', 'text', initcap({string}), 'ref', CAST(NULL AS STRING))
      WHEN t IS NULL OR t = 'VOID'
        THEN named_struct('kind', 'null', 'text', CAST(NULL AS STRING), 'ref', CAST(NULL AS STRING))
      WHEN startswith(t, 'OBJECT')
        THEN named_struct('kind', 'dict', 'text', to_json({value}), 'ref', CAST(NULL AS STRING))
      WHEN startswith(t, 'ARRAY') THEN named_struct('kind', 'list', 'text', to_json({value}), 'ref',
        IF(size(try_variant_get({value}, '$', 'array<variant>')) = 2,
           try_variant_get({value}, '$[0]', 'string'), NULL))
      ELSE named_struct('kind', 'float', 'text', {number}, 'ref', CAST(NULL AS STRING)) END"""
    return bind_sql(f"schema_of_variant({value})", "t", body)


def describe_values_sql(values: str) -> str:
    """SQL for a ``map<string,variant>`` with described values."""
    return f"transform_values({values}, (k, v) -> {describe_sql('v')})"


def truthy_sql(value: str) -> str:
    """SQL for the Python truth of a described value; missing is false."""
    return f"""coalesce(CASE {value}.kind
        WHEN 'str' THEN {value}.text <> ''
        WHEN 'int' THEN {value}.text <> '0'
        WHEN 'float' THEN {value}.text NOT IN ('0.0', '-0.0')
        WHEN 'bool' THEN {value}.text = 'True'
        WHEN 'list' THEN {value}.text <> '[]'
        WHEN 'dict' THEN {value}.text <> '{{}}'
        ELSE false END, false)"""


def truthy_text_sql(value: str) -> str:
    """SQL for the text of a value that Python counts as true, else NULL."""
    return f"IF({truthy_sql(value)}, {value}.text, NULL)"


def fields_sql(described: str, names: list[str]) -> str:
    """SQL for a struct of a described object's values under the given keys; a value is NULL
    only where its key is missing, the struct only where there is no object.

    Held in a column it spares parsers the search for a key at each use of its value.
    """
    cells = ", ".join(f"'{name}', {described}['{name}']" for name in names)
    return f"IF({described} IS NOT NULL, named_struct({cells}), NULL)"


def with_present(df: DataFrame, out: str, pairs: dict[str, str], given: str) -> DataFrame:
    """Add a params map without the entries whose value is NULL; NULL unless ``given``.

    The cells are a column of their own: as the argument of a lambda function they
    would be interpreted, not compiled.
    """
    cells = f"{out}_cells"
    staged = df.withColumn(cells, F.expr(f"IF({given}, map({map_cells(pairs)}), NULL)"))
    kept = F.map_filter(cells, lambda key, value: value.isNotNull())
    return staged.withColumn(out, F.when(F.col(cells).isNotNull(), kept)).drop(cells)


def present_sql(pairs: dict[str, str]) -> str:
    """SQL for a params map without the entries whose value is NULL."""
    return f"map_filter(map({map_cells(pairs)}), (k, v) -> v IS NOT NULL)"


def map_cells(pairs: dict[str, str]) -> str:
    """SQL for the arguments of ``map``."""
    return ", ".join(f"'{key}', {value}" for key, value in pairs.items())


def sql_list(values: list[str]) -> str:
    return ", ".join(f"'{value}'" for value in values)
