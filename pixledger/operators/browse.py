"""The browse query: search, sort, page, neighbours and grid rows.

Folder-wise positions come from ``ranking``, so no operator here puts a whole
folder into one task.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixledger.functions import text
from pixledger.operators import ranking
from pixledger.operators.inventory import with_path
from pixledger.schemas import DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE

DEFAULT_ORDER = {"name": "asc", "date": "desc"}


def toggle_sort(field: str, order: str, picked: str) -> tuple[str, str]:
    """Sort state after picking a field: the same one flips, another starts afresh."""
    if picked == field:
        return field, "desc" if order == "asc" else "asc"
    return picked, DEFAULT_ORDER[picked]


def with_sort_keys(items: DataFrame, field: str = "name", order: str | None = None) -> tuple[DataFrame, list[str]]:
    """Add ascending key columns for the order; only the leading key is reversed
    by ``desc``, ties keep natural name order, then path.

    A collated key has no reverse: its descending order is the ascending one turned round, whose
    ties are therefore reversed beforehand. Items have a path.
    """
    order = order or DEFAULT_ORDER.get(field, "asc")
    natural = text.natural_key(F.col("name"))
    if field == "name":
        key = text.reversed_key(natural) if order == "desc" else natural
        if order == "asc":
            return items.withColumn("_k0", key), ["_k0"]
        return items.withColumns({"_k0": key, "_k1": natural}), ["_k0", "_k1"]
    if field == "date":
        micros = F.coalesce(F.unix_micros(F.col("mtime").cast("timestamp")), F.lit(0))
        return (
            items.withColumns({"_k0": -micros if order == "desc" else micros, "_k1": natural}),
            ["_k0", "_k1"],
        )
    if field == "collated":
        keyed = items.withColumn("_k0", text.collated_key(F.col("name")))
        if order == "asc":
            return keyed.withColumn("_k1", natural), ["_k0", "_k1"]
        ties = {"_k1": text.reversed_key(natural), "_k2": text.reversed_key(F.col("path"))}
        return keyed.withColumns(ties), ["_k0", *ties]
    raise ValueError(f"unknown sort field {field!r}")


def sort_items(items: DataFrame, field: str = "name", order: str | None = None) -> DataFrame:
    """Images or folders (rows with a path) in a total order, by Spark's range-partitioned sort."""
    whole = items if "path" in items.columns else with_path(items)
    keyed, keys = with_sort_keys(whole, field, order)
    turned = _turned(field, order)
    columns = [F.desc(c) if turned else F.asc(c) for c in (*keys, "path")]
    return keyed.orderBy(*columns).select(*items.columns)


def _turned(field: str, order: str | None) -> bool:
    """Whether the order is that of the keys turned round."""
    return field == "collated" and order == "desc"


def ranked(
    items: DataFrame, field: str = "name", order: str | None = None, neighbours: bool = False
) -> DataFrame:
    """Add path, ``position`` (from 1) and ``total`` within the folder."""
    keyed, keys = with_sort_keys(with_path(items), field, order)
    placed = ranking.with_positions(
        keyed, ["folder"], keys, "path", neighbours_of="path" if neighbours else None
    )
    if _turned(field, order):
        placed = placed.withColumn("position", F.col("total") + 1 - F.col("position"))
        if neighbours:
            placed = placed.withColumns({"previous": F.col("next"), "next": F.col("previous")})
    return placed.drop(*keys)


def ranked_folders(folders: DataFrame, field: str = "name", order: str | None = None) -> DataFrame:
    """Add ``position`` (from 1) and ``total`` among the folders of one parent; roots have none and are left out."""
    keyed, keys = with_sort_keys(folders.where("parent IS NOT NULL"), field, order)
    placed = ranking.with_positions(keyed, ["parent"], keys, "path").drop(*keys)
    return placed.withColumn("position", F.col("total") + 1 - F.col("position")) if _turned(field, order) else placed


def neighbours(items: DataFrame, field: str = "name", order: str | None = None) -> DataFrame:
    """Add the previous and next path in the folder; NULL at either end."""
    return ranked(items, field, order, neighbours=True)


def with_position_text(ranked_items: DataFrame) -> DataFrame:
    return ranked_items.withColumn(
        "position_text",
        F.concat(F.lit("Image "), F.col("position").cast("string"), F.lit(" of "), F.col("total").cast("string")),
    )


def with_page(ranked_items: DataFrame, limit: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Add page number and next_cursor (NULL on the last page) for every row."""
    _check_limit(limit)
    page = F.floor((F.col("position") - 1) / F.lit(limit))
    end = (page + 1) * limit
    return ranked_items.withColumns(
        {"page": page, "next_cursor": F.when(end < F.col("total"), end)}
    )


def page(ranked_items: DataFrame, folder: str, limit: int | None = DEFAULT_PAGE_SIZE, cursor: int = 0) -> DataFrame:
    """One page of one folder with next_cursor and total; no limit means the rest."""
    rows = ranked_items.where((F.col("folder") == folder) & (F.col("position") > cursor))
    if limit is None:
        return rows.withColumn("next_cursor", F.lit(None).cast("bigint"))
    _check_limit(limit)
    end = F.lit(cursor + limit).cast("bigint")
    return rows.where(F.col("position") <= end).withColumn(
        "next_cursor", F.when(end < F.col("total"), end)
    )


def page_of(
    items: DataFrame, folder: str, field: str = "name", order: str | None = None,
    limit: int | None = DEFAULT_PAGE_SIZE, cursor: int = 0,
) -> DataFrame:
    """One page of one folder, as ``page`` gives it of ``ranked`` items.

    Only that folder's rows are read, twice: for the total, and for the first
    ``cursor + limit`` rows, which each task cuts its own to. No limit ranks the folder.
    """
    here = items.where(F.col("folder") == folder)
    if limit is None:
        return page(ranked(here, field, order), folder, None, cursor)
    _check_limit(limit)
    keyed, keys = with_sort_keys(with_path(here), field, order)
    turned = _turned(field, order)
    columns = [F.desc(c) if turned else F.asc(c) for c in (*keys, "path")]
    first = keyed.orderBy(*columns).limit(cursor + limit)
    placed = first.withColumns(
        {
            "position": F.row_number().over(Window.orderBy(*columns)).cast("bigint"),  # cursor + limit rows
            "total": here.agg(F.count(F.lit(1))).scalar(),
        }
    ).drop(*keys)
    return page(placed, folder, limit, cursor)


def page_after(items: DataFrame, folder: str, last_name: str | None, limit: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """The page after a known name in natural order: a top-k with no ranking, so
    deep pages cost the same as the first."""
    _check_limit(limit)
    keyed, keys = with_sort_keys(with_path(items.where(F.col("folder") == folder)))
    if last_name is not None:
        last = F.lit(last_name)
        key = F.struct(F.col("_k0"), F.col("name"))
        keyed = keyed.where(key > F.struct(text.natural_key(last), last))
    return keyed.orderBy(*keys, "path").limit(limit).select(*items.columns)


def _cursor() -> F.Column:
    """What a page needs of its last row to go on: opaque text."""
    micros = F.unix_micros(F.col("mtime").cast("timestamp"))
    return F.base64(F.encode(F.to_json(F.struct("name", micros.alias("micros"), "path"), {"ignoreNullFields": "false"}), "UTF-8"))


def page_from(
    items: DataFrame, folder: str, cursor: str | None = None, field: str = "name", order: str | None = None,
    limit: int = DEFAULT_PAGE_SIZE,
) -> DataFrame:
    """The next ``limit`` rows of a folder after the row that ``cursor`` comes from, in any order, with each row's own ``cursor``.

    A top-k of the rows beyond the cursor's keys: nothing is ranked or counted, so deep pages cost the same as the
    first, and rows that come or go elsewhere shift no page. By date, rows of other times are
    left out at the scan already. The rows' paths are added.
    """
    _check_limit(limit)
    keyed, keys = with_sort_keys(with_path(items.where(F.col("folder") == folder)), field, order)
    turned = _turned(field, order)
    if cursor is not None:
        spark = items.sparkSession
        last = json.loads(base64.b64decode(cursor))
        types = {"name": "string", "micros": "bigint", "path": "string"}
        edge = spark.createDataFrame([(last["name"], last["micros"], last["path"])], ", ".join(f"{c} {t}" for c, t in types.items()))
        edge = edge.withColumn("mtime", F.timestamp_micros("micros").cast("timestamp_ntz"))
        edge, _ = with_sort_keys(edge, field, order)
        row, bound = F.struct(*keys, "path"), edge.select(F.struct(*keys, "path")).scalar()
        if field == "date":
            at = F.timestamp_micros(F.lit(last["micros"] or 0)).cast("timestamp_ntz")
            down = (order or DEFAULT_ORDER["date"]) == "desc"
            keyed = keyed.where(F.col("mtime").isNull() | ((F.col("mtime") <= at) if down else (F.col("mtime") >= at)))
        keyed = keyed.where(row < bound if turned else row > bound)
    columns = [F.desc(c) if turned else F.asc(c) for c in (*keys, "path")]
    return keyed.orderBy(*columns).limit(limit).withColumn("cursor", _cursor()).drop(*keys)


def load_more(loaded: DataFrame, next_page: DataFrame) -> DataFrame:
    """Append a page to the rows loaded before."""
    return loaded.unionByName(next_page)


def grid_rows(ranked_items: DataFrame, columns: int) -> DataFrame:
    """Chunk each folder's order into rows of ``columns`` (1-8) paths."""
    if not 1 <= columns <= 8:
        raise ValueError("columns must be 1 to 8")
    return (
        ranked_items.groupBy("folder", F.floor((F.col("position") - 1) / F.lit(columns)).alias("row"))
        .agg(F.array_sort(F.collect_list(F.struct("position", "path"))).alias("_items"))
        .select("folder", "row", F.col("_items.path").alias("items"))
    )


def index_of(ranked_items: DataFrame, selected: DataFrame) -> DataFrame:
    """Zero-based index of each selected (folder, path) in its folder; -1 if absent."""
    index = ranked_items.select("folder", "path", (F.col("position") - 1).alias("_index"))
    return selected.join(index, ["folder", "path"], "left").select(
        *selected.columns, F.coalesce("_index", F.lit(-1)).alias("index")
    )


def _check_limit(limit: int) -> None:
    if not 1 <= limit <= MAX_PAGE_SIZE:
        raise ValueError(f"limit must be 1 to {MAX_PAGE_SIZE}")
