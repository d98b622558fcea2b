"""LoRA mentions in prompt text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixledger.functions.text import RE_SPACE, bind_sql, strip

# Fixed patterns: the tag form, any case; the list form, exact case.
TAG = r"(?i)<lora:([^:>]+)(?::([^>]+))?>"
LISTING = rf"(?U)LoRA:{RE_SPACE}*\[([^\]]+)\]"
MODEL_ENDING = ".safetensors"


def tag_loras(text: Column) -> Column:
    """``<lora:name:weight>`` tags as ``name:weight``, or ``name`` alone."""
    tags = F.regexp_extract_all(text, F.lit(TAG), F.lit(0))
    return F.transform(tags, lambda tag: F.substr(tag, F.lit(7), F.length(tag) - 7))


def listed_loras(text: Column) -> Column:
    """Items of every ``LoRA: [a, b]`` list, trimmed, blanks dropped."""
    lists = F.regexp_extract_all(text, F.lit(LISTING), F.lit(1))
    items = F.flatten(F.transform(lists, lambda one: F.split(one, ",")))
    return F.filter(F.transform(items, strip), lambda item: item != "")


def extract_loras(text: Column) -> Column:
    """Tags, then listed items, each once, in order of appearance."""
    return F.array_distinct(F.concat(tag_loras(text), listed_loras(text)))


def drop_model_ending_sql(name: str) -> str:
    """SQL for a model file name without its usual ending."""
    cut = f"IF(endswith(m, '{MODEL_ENDING}'), substr(m, 1, length(m) - {len(MODEL_ENDING)}), m)"
    return bind_sql(name, "m", cut)
