"""The two end-to-end queries: scan a folder, and the catalog overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixledger.functions import paths
from pixledger.operators import browse, folders, inventory as inv
from pixledger.schemas import DEFAULT_PAGE_SIZE


def scan_folder(
    inventory: DataFrame,
    path: str,
    query: str = "",
    field: str = "name",
    order: str | None = None,
    limit: int | None = DEFAULT_PAGE_SIZE,
    cursor: int = 0,
    directories: DataFrame | None = None,
    links: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(sub-folders, one page of images) of a folder, searched and sorted.

    Both filters reach the scan: only rows at or below the path are read. Search
    and sort cover the whole folder, not only the rows loaded so far. Sub-folders
    come in the same order as images; a link (path, target) here to a folder below the
    path is one of them. ``scan_errors`` tells paths that cannot be scanned.
    """
    here = F.col("folder") == path
    below = here | F.startswith("folder", F.lit(path.rstrip("/") + "/"))
    listed = folders.folder_table(
        inventory.where(below), path, None if directories is None else directories.where(below), links
    ).where(F.col("parent") == path)
    images = inv.search(inv.visible_images(inventory.where(here)), query)
    page = browse.page_of(images, path, field, order, limit, cursor)
    return browse.sort_items(inv.search(listed, query), field, order), page.orderBy("position")


def scan_errors(requests: DataFrame, inventory: DataFrame, root: str, directories: DataFrame | None = None) -> DataFrame:
    """Each requested path with the error a scan of it gives, NULL for none.

    ``permission`` outside ``root``, ``not_directory`` for a file, ``not_found`` for
    what is neither. Paths are cleaned first; files and folders are joined on them.
    """
    asked = requests.select("path", paths.normalise(paths.clean_path(F.col("path"))).alias("_real"))
    files = inv.with_path(inventory).select(F.col("path").alias("_real")).distinct().withColumn("_file", F.lit(True))
    nodes = folders.folder_nodes(inventory, directories).select(F.col("path").alias("_real"), F.lit(True).alias("_folder"))
    found = asked.join(files, "_real", "left").join(nodes, "_real", "left")
    error = (
        F.when(~paths.under_root(F.col("_real"), root), "permission")
        .when(F.col("_folder"), None)
        .when(F.col("_file"), "not_directory")
        .otherwise("not_found")
    )
    return found.select("path", error.alias("error_type"))


def folder_overview(inventory: DataFrame, metadata: DataFrame, root: str) -> DataFrame:
    """Folder facts with the number of files and the most used tool below them."""
    per_tool = (
        metadata.where(F.col("tool").isNotNull())
        .groupBy("folder", "tool")
        .agg(F.count(F.lit(1)).alias("files"))
        .groupBy(F.col("folder").alias("path"))
        .agg(
            F.sum("files").alias("parsed_files"),
            F.max_by("tool", F.struct("files", "tool")).alias("main_tool"),
        )
    )
    return folders.folder_table(inventory, root).join(per_tool, "path", "left")
