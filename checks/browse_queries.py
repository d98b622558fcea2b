"""Order, pages, neighbours and grid rows, over small folders and very large ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import reference_sql as ref
from checks.common import Queries, big_folders, joined
from checks.folder_queries import NODES
from pixledger.operators import browse, folders
from pixledger.operators import inventory as inv
from pixledger.plans.browse import scan_errors, scan_folder


def images(spark, sf):
    return inv.visible_images(fx.inventory(spark, sf))


def big_images(spark, sf):
    return big_folders(images(spark, sf))


def natural_order(spark, sf):
    return browse.ranked(images(spark, sf)).select("file_id", "position", "total")


def natural_order_big_folders(spark, sf):
    return browse.ranked(big_images(spark, sf)).select("file_id", "position", "total")


def collated_order(spark, sf):
    return browse.ranked(big_images(spark, sf), "collated").select("file_id", "position")


def sort_by_name_desc(spark, sf):
    return browse.ranked(big_images(spark, sf), "name", "desc").select("file_id", "position")


def sort_by_date(spark, sf):
    """Newest first, by whole days so that there are many ties."""
    daily = big_images(spark, sf).withColumn("mtime", F.date_trunc("day", "mtime").cast("timestamp_ntz"))
    return browse.ranked(daily, "date").select("file_id", "position")


def sort_by_date_asc(spark, sf):
    return browse.ranked(images(spark, sf), "date", "asc").select("file_id", "position")


def sorted_catalog(spark, sf):
    """The whole catalog in one order, by the range-partitioned sort."""
    return browse.sort_items(images(spark, sf), "date", "asc").select("file_id", "name")


def pages(spark, sf):
    paged = browse.with_page(browse.ranked(big_images(spark, sf)))
    return paged.select("file_id", "page", "next_cursor", "total")


def page(spark, sf):
    """The second page of every big folder."""
    ranked = browse.ranked(big_images(spark, sf))
    pages = None
    for folder in ("click", "view", "purchase", "signup", "error"):
        one = browse.page(ranked, f"/pictures/{folder}", 50, 50)
        pages = one if pages is None else browse.load_more(pages, one)
    return pages.select("folder", "name", "position", "next_cursor", "total")


def page_after(spark, sf):
    """The page after a given name, without ranking."""
    return browse.page_after(big_images(spark, sf), "/pictures/click", "Img500.png", 200).select("file_id", "name")


def load_more(spark, sf):
    """Pages appended one by one are the first rows of the order."""
    ranked = browse.ranked(big_images(spark, sf).where("folder = '/pictures/view'"))
    loaded = browse.page(ranked, "/pictures/view", 200, 0)
    for cursor in (200, 400):
        loaded = browse.load_more(loaded, browse.page(ranked, "/pictures/view", 200, cursor))
    return loaded.select("file_id", "position")


def union_of_pages(spark, sf):
    """All pages of all folders are the folders again."""
    paged = browse.with_page(browse.ranked(images(spark, sf)), 5)
    first, rest = paged.where("page = 0"), paged.where("page > 0")
    return browse.load_more(first, rest).select("file_id", "folder", "name")


def scan(spark, sf):
    """One folder as a viewer asks for it: searched, newest first, first page."""
    _, page_rows = scan_folder(big_folders(fx.inventory(spark, sf)), "/pictures/signup", "7", "date", None, 50)
    return page_rows.select("file_id", "position", "total", "next_cursor")


#: Names with accents, in mixed case, and many that differ in leading zeros or case alone.
MIXED_NAME = """concat(CASE file_id % 6 WHEN 0 THEN 'img' WHEN 1 THEN 'IMG' WHEN 2 THEN 'ímg' WHEN 3 THEN 'Imh' WHEN 4 THEN 'img0' ELSE 'Ímg00' END,
    CAST(file_id % 40 AS STRING), CASE WHEN file_id % 7 = 0 THEN '.PNG' ELSE '.png' END)"""


def mixed_images(spark, sf):
    """Two levels of folders, so that no two files of one folder have the same name."""
    moved = big_images(spark, sf).withColumn("folder", F.expr("concat(folder, '/', file_id div 840)"))
    return moved.withColumn("name", F.expr(MIXED_NAME)).dropDuplicates(["folder", "name"])


def collated_desc(spark, sf):
    return browse.ranked(mixed_images(spark, sf), "collated", "desc").select("path", "position")


def collated_asc(spark, sf):
    return browse.ranked(mixed_images(spark, sf), "collated").select("path", "position")


def collated_sorted(spark, sf):
    """One folder by the plain sort; the place in it is part of the row."""
    rows = browse.sort_items(mixed_images(spark, sf).where("folder = '/pictures/click/0'"), "collated", "desc")
    return rows.withColumn("place", F.monotonically_increasing_id()).select("name", F.row_number().over(Window.orderBy("place")).alias("position"))


def _seek(spark, sf, field, order):
    """Five pages of 60, each from the last one's cursor."""
    daily = big_images(spark, sf).withColumn("mtime", F.date_trunc("day", "mtime").cast("timestamp_ntz"))
    cursor, pages = None, None
    for number in range(5):
        page = browse.page_from(daily, "/pictures/view", cursor, field, order, 60).withColumn("page", F.lit(number))
        pages = page if pages is None else browse.load_more(pages, page)
        last = page.orderBy(F.monotonically_increasing_id().desc()).select("cursor").first()
        if last is None:
            break
        cursor = last["cursor"]
    return pages.select("file_id", "page")


def seek_date_desc(spark, sf):
    return _seek(spark, sf, "date", "desc")


def seek_date_asc(spark, sf):
    return _seek(spark, sf, "date", "asc")


def seek_name_desc(spark, sf):
    return _seek(spark, sf, "name", "desc")


def sort_folders(spark, sf):
    """Folders in natural order among their siblings."""
    placed = browse.ranked_folders(folders.folder_table(fx.inventory(spark, sf), "/"))
    return placed.select("path", "position", "total")


def page_of(spark, sf):
    """One folder's page, read without ranking the others."""
    return browse.page_of(big_images(spark, sf), "/pictures/click", limit=50, cursor=50).select("name", "position", "next_cursor", "total")


def asked_paths(spark, sf):
    """Folders, files, missing folders and paths outside the root, as requested."""
    asked = fx.inventory(spark, sf).select(
        F.expr(
            """CASE file_id % 4 WHEN 0 THEN folder WHEN 1 THEN concat('"', folder, '/', name, '"')
            WHEN 2 THEN concat(folder, '/missing', file_id) ELSE concat('/pictures/../other/', name) END"""
        ).alias("path")
    )
    return scan_errors(asked, fx.inventory(spark, sf), "/pictures")


def scan_sub_folders(spark, sf):
    found, _ = scan_folder(fx.inventory(spark, sf), "/pictures/signup", "USER1")
    return found.select("path", "image_count")


def neighbours(spark, sf):
    return browse.neighbours(images(spark, sf)).select("file_id", "previous", "next")


def neighbours_big_folders(spark, sf):
    return browse.neighbours(big_images(spark, sf), "date").select("file_id", "previous", "next")


def grid_rows(spark, sf):
    return browse.grid_rows(browse.ranked(big_images(spark, sf)), 4).select(
        "folder", "row", joined("items").alias("items")
    )


def position_text(spark, sf):
    return browse.with_position_text(browse.ranked(images(spark, sf))).select("file_id", "position_text")


def index_of(spark, sf):
    """Index of every file in its folder's order; those not listed get -1."""
    selected = inv.with_path(fx.inventory(spark, sf)).select("file_id", "folder", "path")
    return browse.index_of(browse.ranked(images(spark, sf)), selected).select("file_id", "index")


def _ranked_sql(columns: str, order: str = "nk, path", where: str = "true", big: bool = True) -> str:
    return fx.oracle(
        f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY {order}) AS position,
          count(*) OVER (PARTITION BY folder) AS total,
          lag(path) OVER (PARTITION BY folder ORDER BY {order}) AS previous,
          lead(path) OVER (PARTITION BY folder ORDER BY {order}) AS next FROM images) WHERE {where}""",
        inventory=True,
        ctes=ref.BIG_IMAGES if big else ref.IMAGES,
    )


def _mixed_sql(direction: str, columns: str = "path, position") -> str:
    """Letters, then accents, then the number, then what follows; ties by natural order and path."""
    return fx.oracle(
        f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY folder
            ORDER BY letters {direction}, accent {direction}, number {direction}, nk, path) AS position FROM (
          SELECT folder, name, concat(folder, '/', name) AS path, left(strip_accents(lower(name)), 3) AS letters,
            left(lower(name), 1) = 'í' AS accent, CAST(regexp_extract(name, '[0-9]+') AS INT) AS number, nk
          FROM (SELECT *, {ref.NATURAL_KEY.replace("path", "concat(folder, '/', name)")} AS nk FROM (
            SELECT DISTINCT concat(folder, '/', file_id // 840) AS folder, {MIXED_NAME.replace('STRING', 'VARCHAR')} AS name FROM images))))""",
        inventory=True,
        ctes=ref.BIG_IMAGES,
    )


def _seek_sql(order: str) -> str:
    return _ranked_sql("file_id, (position - 1) // 60 AS page", order, "folder = '/pictures/view' AND position <= 300")


NEXT_CURSOR = "CASE WHEN {end} < total THEN {end} END AS next_cursor"
PAGE_END = "((position - 1) // 200 + 1) * 200"
QUERIES: Queries = {
    "O1_natural_order": (natural_order, _ranked_sql("file_id, position, total", big=False)),
    "O1_natural_order_big_folders": (natural_order_big_folders, _ranked_sql("file_id, position, total")),
    "O2_collated_order": (collated_order, _ranked_sql("file_id, position")),
    "O2_collated_desc": (collated_desc, _mixed_sql("DESC")),
    "O2_collated_ties": (collated_asc, _mixed_sql("ASC")),
    "O2_sorted_desc": (collated_sorted, f"SELECT name, position FROM ({_mixed_sql('DESC', 'path, name, folder, position')}) WHERE folder = '/pictures/click/0'"),
    "O5_seek_date_desc": (seek_date_desc, _seek_sql("date_trunc('day', mtime) DESC, nk, path")),
    "O5_seek_date_asc": (seek_date_asc, _seek_sql("date_trunc('day', mtime), nk, path")),
    "O5_seek_name_desc": (seek_name_desc, _seek_sql("nk DESC, path")),
    "O3_sort_folders": (
        sort_folders,
        fx.oracle(
            f"""SELECT path, row_number() OVER (PARTITION BY parent ORDER BY {ref.NATURAL_KEY}, path) AS position,
              count(*) OVER (PARTITION BY parent) AS total FROM tree WHERE parent IS NOT NULL""",
            ctes=NODES,
            inventory=True,
        ),
    ),
    "O4_page_of": (
        page_of,
        _ranked_sql("name, position, CASE WHEN total > 100 THEN 100 END AS next_cursor, total", where="folder = '/pictures/click' AND position > 50 AND position <= 100"),
    ),
    "E1_scan_errors": (
        asked_paths,
        fx.oracle(
            """SELECT CASE file_id % 4 WHEN 0 THEN folder WHEN 1 THEN concat('"', folder, '/', name, '"')
              WHEN 2 THEN concat(folder, '/missing', file_id) ELSE concat('/pictures/../other/', name) END AS path,
              CASE file_id % 4 WHEN 1 THEN 'not_directory' WHEN 2 THEN 'not_found' WHEN 3 THEN 'permission' END AS error_type
            FROM inventory""",
            inventory=True,
        ),
    ),
    "O3_sort_by_name_desc": (sort_by_name_desc, _ranked_sql("file_id, position", "nk DESC, path")),
    "O3_sort_by_date": (
        sort_by_date,
        _ranked_sql("file_id, position", "date_trunc('day', mtime) DESC, nk, path"),
    ),
    "O3_sort_by_date_asc": (sort_by_date_asc, _ranked_sql("file_id, position", "mtime, nk, path", big=False)),
    "O3_sorted_catalog": (
        sorted_catalog,
        fx.oracle(f"SELECT file_id, name FROM inventory WHERE {ref.VISIBLE} ORDER BY mtime", inventory=True),
    ),
    "O4_pages": (
        pages,
        _ranked_sql(f"file_id, (position - 1) // 200 AS page, {NEXT_CURSOR.format(end=PAGE_END)}, total"),
    ),
    "O4_page": (
        page,
        _ranked_sql(
            f"folder, name, position, {NEXT_CURSOR.format(end=100)}, total", where="position BETWEEN 51 AND 100"
        ),
    ),
    "O4_page_after": (
        page_after,
        fx.oracle(
            """SELECT file_id, name FROM images WHERE folder = '/pictures/click' AND file_id >= 500
              AND name > '' AND lower(name) <> 'img500.png' ORDER BY nk, path LIMIT 200""",
            inventory=True,
            ctes=ref.BIG_IMAGES,
        ),
    ),
    "O5_load_more": (load_more, _ranked_sql("file_id, position", where="folder = '/pictures/view' AND position <= 600")),
    "U1_union_of_pages": (
        union_of_pages,
        fx.oracle(f"SELECT file_id, folder, name FROM inventory WHERE {ref.VISIBLE}", inventory=True),
    ),
    "E1_scan_folder": (
        scan,
        fx.oracle(
            f"""SELECT file_id, position, total, {NEXT_CURSOR.format(end=50)} FROM (
              SELECT *, row_number() OVER (ORDER BY mtime DESC) AS position, count(*) OVER () AS total
              FROM inventory WHERE folder LIKE '/pictures/signup/%' AND contains(name, '7') AND {ref.VISIBLE})
            WHERE position <= 50""",
            inventory=True,
        ),
    ),
    "E1_scan_sub_folders": (
        scan_sub_folders,
        fx.oracle(
            f"""SELECT folder AS path, count(*) FILTER (WHERE {ref.VISIBLE}) AS image_count FROM inventory
              WHERE folder LIKE '/pictures/signup/user1%' GROUP BY folder""",
            inventory=True,
        ),
    ),
    "W1_neighbours": (neighbours, _ranked_sql("file_id, previous, next", big=False)),
    "W1_neighbours_big_folders": (
        neighbours_big_folders,
        _ranked_sql("file_id, previous, next", "mtime DESC, nk, path"),
    ),
    "W2_grid_rows": (
        grid_rows,
        _ranked_sql(
            "folder, (position - 1) // 4 AS row, string_agg(path, '|' ORDER BY position) AS items",
        )
        + " GROUP BY folder, (position - 1) // 4",
    ),
    "W3_position_text": (
        position_text,
        _ranked_sql("file_id, concat('Image ', position, ' of ', total) AS position_text", big=False),
    ),
    "J7_index_of": (
        index_of,
        fx.oracle(
            """SELECT file_id, coalesce(position - 1, -1) AS index FROM inventory LEFT JOIN (
              SELECT file_id, row_number() OVER (PARTITION BY folder ORDER BY nk, path) AS position FROM images
            ) USING (file_id)""",
            inventory=True,
            ctes=ref.IMAGES,
        ),
    ),
}
