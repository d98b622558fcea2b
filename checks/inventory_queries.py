"""Row-wise filters, path columns, limits, errors and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import reference_sql as ref
from checks.common import Queries, joined
from pixledger.functions import paths
from pixledger.operators import errors
from pixledger.operators import inventory as inv
from pixledger.operators import refresh
from pixledger.schemas import ERRORS
from pixledger.session import shared_dir
from pixledger.sources import name_index


def is_image(spark, sf):
    return fx.inventory(spark, sf).select("file_id", "name", paths.is_image(F.col("name")).alias("is_image"))


def drop_hidden(spark, sf):
    return inv.drop_hidden(fx.inventory(spark, sf)).select("file_id", "folder", "name")


def under_root(spark, sf):
    """Paths with dots and detours, about a third of them outside the root."""
    kept = inv.with_path(fx.inventory(spark, sf))
    detour = F.expr(
        """CASE file_id % 6 WHEN 0 THEN replace(path, '/pictures/', '/pictures/./x/../')
             WHEN 1 THEN replace(path, '/pictures/', '/pictures/../other/')
             WHEN 2 THEN replace(path, '/pictures/', '/pictures2/')
             WHEN 3 THEN replace(path, '/pictures/', '/tmp/..//pictures/') ELSE path END"""
    )
    return inv.check_root(kept.withColumn("path", detour), "/pictures/").select("file_id", "path", "error_type")


UNDER_ROOT_SQL = fx.oracle(
    """SELECT file_id, CASE file_id % 6 WHEN 0 THEN replace(path, '/pictures/', '/pictures/./x/../')
             WHEN 1 THEN replace(path, '/pictures/', '/pictures/../other/')
             WHEN 2 THEN replace(path, '/pictures/', '/pictures2/')
             WHEN 3 THEN replace(path, '/pictures/', '/tmp/..//pictures/') ELSE path END AS path,
         CASE WHEN file_id % 6 IN (1, 2) THEN 'permission' END AS error_type
       FROM (SELECT file_id, concat(folder, '/', name) AS path FROM inventory)""",
    inventory=True,
)


def search(spark, sf):
    return inv.search(fx.inventory(spark, sf), "G97").select("file_id", "name")


def search_indexed(spark, sf):
    """Searches of an indexed catalog: rare, common, in other case, too short for the index, and without a match."""
    out = shared_dir(spark, "indexed")
    name_index.write_indexed(fx.inventory(spark, sf).select("file_id", "folder", "name"), out, 16)
    found = None
    for query in ("G97", "img", ".GIF", "7", "nothing", "1.Jp"):
        rows = name_index.search_indexed(spark, out, query).select("file_id", F.lit(query).alias("query"))
        found = rows if found is None else found.union(rows)
    return found


def only_images(spark, sf):
    """A listing of folders and images, narrowed to one type each."""
    files = fx.inventory(spark, sf)
    images = inv.visible_images(files).select("folder", F.lit("image").alias("type"), "name")
    folders = files.select("folder").distinct().select(
        paths.parent(F.col("folder")).alias("folder"),
        F.lit("folder").alias("type"),
        paths.file_name(F.col("folder")).alias("name"),
    )
    listing = images.unionByName(folders)
    return inv.only_type(listing, "image").unionByName(inv.only_type(listing, "folder"))


def is_animated(spark, sf):
    return inv.with_animated(fx.inventory(spark, sf)).select("file_id", "is_animated")


def check_limits(spark, sf):
    good, bad = inv.split_quarantine(inv.check_limits(inv.only_images(fx.inventory(spark, sf))))
    return good.unionByName(bad).select("file_id", "error_type", "error_message")


CHECK_LIMITS_SQL = fx.oracle(
    f"""SELECT file_id, CASE WHEN big OR wide THEN 'invalid_file' END AS error_type,
         CASE WHEN big THEN 'Image is too large (> 75 MB)'
           WHEN wide THEN 'Image dimensions exceed limit (> 104,857,600 pixels)' END AS error_message
       FROM (SELECT file_id, length > 78643200 AS big, CAST(width AS BIGINT) * height > 104857600 AS wide
         FROM inventory WHERE {ref.IS_IMAGE})""",
    inventory=True,
)


def classify_error(spark, sf):
    """Limit errors, and event types standing in for errors of any other kind."""
    files = fx.inventory(spark, sf)
    kinds = F.array(*[F.lit(k) for k in ("not_found", "not_directory", "permission", "timeout", "network", "odd")])
    rows = inv.check_limits(files).select(
        "file_id", F.coalesce("error_type", F.get(kinds, (F.col("file_id") % 7).cast("int"))).alias("error_type")
    )
    return errors.classify_errors(rows)


def _quoted(value) -> str:
    return str(value).lower() if isinstance(value, bool) else "'" + value.replace("'", "''") + "'"


_ERROR_ROWS = ", ".join(f"({', '.join(map(_quoted, row))})" for row in ERRORS)
CLASSIFY_ERROR_SQL = fx.oracle(
    f"""SELECT file_id, d.* FROM (SELECT file_id, CASE WHEN length > 78643200
             OR CAST(width AS BIGINT) * height > 104857600 THEN 'invalid_file'
           WHEN file_id % 7 >= 5 THEN 'server_error'
           ELSE ['not_found', 'not_directory', 'permission', 'timeout', 'network'][1 + file_id % 7] END AS error_type
         FROM inventory) JOIN (VALUES
           {_ERROR_ROWS}
         ) d(error_type, title, suggestion, can_retry) USING (error_type)""",
    inventory=True,
)


def clean_path(spark, sf):
    quoted = F.expr(
        "concat(repeat(' ', CAST(file_id % 3 AS INT)), IF(file_id % 2 = 0, '\"', ''), folder, IF(file_id % 5 = 0, '\\'', ''), '\t')"
    )
    return fx.inventory(spark, sf).select("file_id", paths.clean_path(quoted).alias("cleaned"))


def path_parts(spark, sf):
    return inv.with_path_parts(fx.inventory(spark, sf)).select("file_id", "suffix", "stem", "album")


def breadcrumb(spark, sf):
    return inv.breadcrumbs(inv.with_path(fx.inventory(spark, sf)).select("file_id", "path")).select(
        "file_id", "name", "full_path", "index", "is_last"
    )


def url_breadcrumb(spark, sf):
    """Segments of the page addresses' paths, with the query cut off."""
    spark.read.parquet(f"{sf}/pages.parquet").createOrReplaceTempView("pages")
    urls = spark.sql(
        "SELECT page_id, regexp_replace(url, r'^https?://[^/?#]*|[?#].*$', '') AS path FROM pages"
    )
    return inv.breadcrumbs(urls).select("page_id", "name", "full_path", "index", "is_last")


def breadcrumb_collapse(spark, sf):
    paths_df = inv.with_path(fx.inventory(spark, sf)).select("file_id", "path")
    out = inv.collapsed_breadcrumbs(paths_df, most=3)
    return out.select("file_id", joined("visible").alias("visible"), joined("hidden").alias("hidden"))


def size_text(spark, sf):
    files = fx.inventory(spark, sf).withColumn("width", F.expr("IF(file_id % 11 = 0, 0, width)"))
    return inv.with_size_text(files).select("file_id", "size_text")


def version_key(spark, sf):
    return inv.with_version(fx.inventory(spark, sf)).select("file_id", "etag")


def unparsed(spark, sf):
    """New and changed files: a sixth of the catalog is new, a sixth has grown."""
    files = inv.with_path(fx.inventory(spark, sf))
    done = files.where("file_id % 6 <> 0").withColumn("length", F.expr("IF(file_id % 6 = 1, length - 1, length)"))
    return refresh.unparsed(files, done).select("file_id", "path")


def one_per_version(spark, sf):
    """Two listings of the same files, the second with some of them changed."""
    files = inv.with_path(fx.inventory(spark, sf)).select("path", "mtime", "length")
    again = files.withColumn("length", F.expr("IF(length % 3 = 0, length + 1, length)"))
    return refresh.one_per_version(files.unionByName(again)).select("path", "length")


INV = dict(inventory=True)
QUERIES: Queries = {
    "P1_is_image": (is_image, fx.oracle(f"SELECT file_id, name, {ref.IS_IMAGE} AS is_image FROM inventory", **INV)),
    "P2_drop_hidden": (
        drop_hidden,
        fx.oracle("SELECT file_id, folder, name FROM inventory WHERE name NOT LIKE '.%'", **INV),
    ),
    "P3_under_root": (under_root, UNDER_ROOT_SQL),
    "P4_search": (
        search,
        fx.oracle("SELECT file_id, name FROM inventory WHERE contains(lower(name), 'g97')", **INV),
    ),
    "P4_search_indexed": (
        search_indexed,
        fx.oracle(
            """SELECT file_id, query FROM inventory, (VALUES ('G97'), ('img'), ('.GIF'), ('7'), ('nothing'), ('1.Jp')) q(query)
            WHERE contains(lower(name), lower(query))""",
            **INV,
        ),
    ),
    "P5_only_type": (
        only_images,
        fx.oracle(
            f"""SELECT folder, 'image' AS type, name FROM inventory WHERE {ref.VISIBLE}
            UNION ALL SELECT DISTINCT regexp_replace(folder, '/[^/]*$', ''), 'folder',
              regexp_extract(folder, '[^/]*$') FROM inventory""",
            **INV,
        ),
    ),
    "P6_is_animated": (
        is_animated,
        fx.oracle("SELECT file_id, regexp_matches(name, '\\.(webp|gif)$', 'i') AS is_animated FROM inventory", **INV),
    ),
    "P7_check_limits": (check_limits, CHECK_LIMITS_SQL),
    "P8_classify_error": (classify_error, CLASSIFY_ERROR_SQL),
    "P9_clean_path": (
        clean_path,
        fx.oracle("SELECT file_id, folder AS cleaned FROM inventory", **INV),
    ),
    "P10_path_parts": (
        path_parts,
        fx.oracle(
            """SELECT file_id, regexp_extract(name, '.(\\.[^.]+)$', 1) AS suffix,
              regexp_replace(name, '(.)\\.[^.]+$', '\\1') AS stem, regexp_extract(folder, '[^/]+$') AS album
            FROM inventory""",
            **INV,
        ),
    ),
    "P11_breadcrumb": (
        breadcrumb,
        fx.oracle(
            """SELECT file_id, parts[i] AS name, concat('/', array_to_string(parts[1:i], '/')) AS full_path,
              CAST(i - 1 AS INT) AS index, i = len(parts) AS is_last
            FROM (SELECT file_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
              SELECT file_id, string_split(concat(folder, '/', name)[2:], '/') AS parts FROM inventory))""",
            **INV,
        ),
    ),
    "P11_url_breadcrumb": (
        url_breadcrumb,
        """SELECT page_id, parts[i] AS name, concat('/', array_to_string(parts[1:i], '/')) AS full_path,
              CAST(i - 1 AS INT) AS index, i = len(parts) AS is_last
            FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
              SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''),
                '[?#].*$', ''), '/'), lambda p: p <> '') AS parts FROM pages))""",
    ),
    "P12_breadcrumb_collapse": (
        breadcrumb_collapse,
        fx.oracle(
            """SELECT file_id, concat('pictures|', string_split(folder, '/')[4], '|', name) AS visible,
              string_split(folder, '/')[3] AS hidden FROM inventory""",
            **INV,
        ),
    ),
    "P13_size_text": (
        size_text,
        fx.oracle(
            "SELECT file_id, CASE WHEN file_id % 11 = 0 THEN '' ELSE concat(width, ' x ', height) END AS size_text FROM inventory",
            **INV,
        ),
    ),
    "P14_version_key": (
        version_key,
        fx.oracle(
            """SELECT file_id, concat('"', CAST(epoch_us(mtime) / 1000000.0::DOUBLE AS VARCHAR), '-', length, '"') AS etag
            FROM inventory""",
            **INV,
        ),
    ),
    "J5_unparsed": (
        unparsed,
        fx.oracle(
            "SELECT file_id, concat(folder, '/', name) AS path FROM inventory WHERE file_id % 6 IN (0, 1)", **INV
        ),
    ),
    "ST1_one_per_version": (
        one_per_version,
        fx.oracle(
            """SELECT concat(folder, '/', name) AS path, length FROM inventory
            UNION SELECT concat(folder, '/', name), CASE WHEN length % 3 = 0 THEN length + 1 ELSE length END
            FROM inventory""",
            **INV,
        ),
    ),
}
