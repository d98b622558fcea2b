"""Path helpers: names, suffixes, ancestors, containment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixledger.functions.text import js_strip
from pixledger.schemas import ANIMATED_EXTENSIONS, IMAGE_SUFFIXES


STORE = r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/]*"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def store(path: Column) -> Column:
    """Scheme and authority of a URL such as ``s3a://bucket``; empty for a plain path."""
    return F.when(F.contains(path, F.lit("://")), F.regexp_extract(path, STORE, 0)).otherwise(F.lit(""))


def top(path: Column) -> Column:
    """The root folder above a path: ``/``, or the store of a URL."""
    return F.coalesce(F.nullif(store(path), F.lit("")), F.lit("/"))


def parent(path: Column) -> Column:
    """Folder part of a path; that of a top-level entry and of a root is the root."""
    cut = F.length(path) - F.length(file_name(path)) - 1
    return F.when(cut <= F.length(store(path)), top(path)).otherwise(F.substr(path, F.lit(1), cut))


def join(folder: Column, name: Column) -> Column:
    """The path of an entry of a folder."""
    return F.when(F.endswith(folder, F.lit("/")), F.concat(folder, name)).otherwise(F.concat_ws("/", folder, name))


def _last_dot(name: Column) -> Column:
    return F.length(name) - F.length(F.substring_index(name, ".", -1))


def has_suffix(name: Column) -> Column:
    """A dot that is neither the first nor the last character."""
    return (_last_dot(name) > 1) & (_last_dot(name) < F.length(name))


def suffix(name: Column) -> Column:
    return F.when(has_suffix(name), F.substr(name, _last_dot(name))).otherwise(F.lit(""))


def stem(name: Column) -> Column:
    return F.when(has_suffix(name), F.substr(name, F.lit(1), _last_dot(name) - 1)).otherwise(name)


def is_image(name: Column) -> Column:
    """One pattern, so that a derived name is computed once."""
    endings = "|".join(suffix[1:] for suffix in IMAGE_SUFFIXES)
    return name.rlike(rf"(?is).\.(?:{endings})\z")


def is_hidden(name: Column) -> Column:
    return F.startswith(name, F.lit("."))


def in_hidden(path: Column, root: str) -> Column:
    """Whether the path or a folder of it below ``root`` has a name that starts with a dot."""
    below = F.substr(path, F.lit(len(root.rstrip("/")) + 1))
    return F.contains(below, F.lit("/."))


def is_animated(name: Column) -> Column:
    """By the text after the last dot, so ``.gif`` alone counts here."""
    return F.lower(F.substring_index(name, ".", -1)).isin(ANIMATED_EXTENSIONS)


def clean_path(path: Column) -> Column:
    """Trim, then drop one quote at either end."""
    return F.regexp_replace(js_strip(path), r"\A[\"']|[\"']\z", "")


def segments(path: Column) -> Column:
    """Non-empty parts between slashes of either kind."""
    return F.filter(F.split(path, r"[\\/]+"), lambda part: part != "")


def last_segment(path: Column, default: str = "Albums") -> Column:
    return F.coalesce(F.try_element_at(segments(path), F.lit(-1)), F.lit(default))


def normalise(path: Column) -> Column:
    """Resolve ``.``, ``..`` and doubled slashes in an absolute path or URL, by text alone."""
    head = store(path)
    rest = F.substr(path, F.length(head) + 1)
    walked = F.aggregate(
        F.split(rest, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, part)),
    )
    whole = F.concat_ws("/", head, F.array_join(walked, "/"))
    return F.when(rest.rlike(r"//|/\.|.+/\z"), F.when((head != "") & (F.size(walked) == 0), head).otherwise(whole)).otherwise(path)


def under_root(path: Column, root: str) -> Column:
    """Whether the path is the root or lies below it."""
    base = normalise(F.lit(root))
    below = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))
    real = normalise(path)
    return (real == base) | F.startswith(real, below)


def breadcrumb(path: Column) -> Column:
    """Array of (name, full_path, index, is_last) from the top down."""
    sep = F.when(F.contains(path, F.lit("\\")), F.lit("\\")).otherwise(F.lit("/"))
    prefix = (
        F.when(F.startswith(path, F.lit("\\\\")), F.lit("\\\\"))
        .when(F.startswith(path, sep), sep)
        .otherwise(F.lit(""))
    )
    parts = segments(path)
    return F.transform(
        parts,
        lambda part, i: F.struct(
            part.alias("name"),
            F.concat(
                prefix, F.call_function("array_join", F.slice(parts, F.lit(1), i + 1), sep)
            ).alias("full_path"),
            i.alias("index"),
            (i == F.size(parts) - 1).alias("is_last"),
        ),
    )


def breadcrumb_visible(crumbs: Column, most: int = 4) -> Column:
    """The first crumb and the last ``most - 1``, or all when they fit."""
    return F.when(
        F.size(crumbs) > most,
        F.concat(F.slice(crumbs, 1, 1), F.slice(crumbs, -(most - 1), most - 1)),
    ).otherwise(crumbs)


def breadcrumb_hidden(crumbs: Column, most: int = 4) -> Column:
    """The middle crumbs that ``breadcrumb_visible`` leaves out."""
    return F.slice(crumbs, F.lit(2), F.greatest(F.size(crumbs) - most, F.lit(0)))


def ancestors(folder: Column) -> Column:
    """The folder and every folder above it up to the root: ``/``, or the store of a URL."""
    head = store(folder)
    parts = F.filter(F.split(F.substr(folder, F.length(head) + 1), "/"), lambda part: part != "")
    below = F.transform(parts, lambda part, i: F.concat(head, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/")))
    return F.concat(F.array(top(folder)), below)
