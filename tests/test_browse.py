"""Ranking, pages and folders against brute force, with one hot folder."""

import random

import pytest
from pyspark.sql import functions as F

from pixledger.functions import text
from pixledger.operators import browse, folders, ranking
from pixledger.plans.browse import scan_folder


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one folder, many names of equal natural rank."""
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        folder = "/g/hot" if rng.random() < 0.34 else f"/g/f{rng.randrange(200)}"
        rows.append((i, folder, f"{'Img' if i % 2 else 'img'}{'0' * rng.randrange(3)}{rng.randrange(400)}_{i}.png", rng.randrange(50)))
    df = spark.createDataFrame(rows, "file_id long, folder string, name string, day int")
    return rows, df.select("file_id", "folder", "name", F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(day)").alias("mtime"))


def natural(name):
    import re

    return [int(p) if i % 2 else p.lower() for i, p in enumerate(re.split(r"(\d+)", name))]


def expected(rows, key):
    groups = {}
    for row in sorted(rows, key=lambda r: r[1] + "/" + r[2]):
        groups.setdefault(row[1], []).append(row)
    out = {}
    for members in groups.values():
        members.sort(key=key)
        paths = [m[1] + "/" + m[2] for m in members]
        for i, m in enumerate(members):
            out[m[0]] = (i + 1, len(members), paths[i - 1] if i else None, paths[i + 1] if i + 1 < len(paths) else None)
    return out


@pytest.mark.parametrize(
    "field, order, key",
    [
        ("name", "asc", lambda r: natural(r[2])),
        ("date", "asc", lambda r: (r[3], natural(r[2]))),
        ("date", "desc", lambda r: (-r[3], natural(r[2]))),
    ],
)
def test_positions_and_neighbours(skewed, field, order, key):
    rows, df = skewed
    found = browse.neighbours(df, field, order).collect()
    assert {r.file_id: (r.position, r.total, r.previous, r.next) for r in found} == expected(rows, key)


def test_name_descending_reverses_the_key_only(spark):
    names = ["a1", "a01", "A1", "b", "a2"]
    df = spark.createDataFrame([(i, "/f", n, None) for i, n in enumerate(names)], "file_id long, folder string, name string, mtime timestamp_ntz")
    rows = sorted(browse.ranked(df, "name", "desc").collect(), key=lambda r: r.position)
    assert [r.name for r in rows] == ["b", "a2", "A1", "a01", "a1"]


def test_hot_folder_spans_many_ranges(skewed):
    rows, df = skewed
    keyed = df.withColumns({"k": text.natural_key(F.col("name")), "path": F.concat_ws("/", "folder", "name")})
    ranged = ranking.with_range(keyed, ["folder", "k", "path"], "path")
    sizes = ranged.groupBy("folder", "_range").count().collect()
    largest = max(r["count"] for r in sizes)
    assert largest < len(rows) / 8
    assert len({r._range for r in sizes if r.folder == "/g/hot"}) > 4


def test_equal_times_still_split(spark):
    df = spark.range(4000).select(F.lit("/f").alias("folder"), F.lit(0).alias("k"), F.format_string("%05d", "id").alias("path"))
    ranged = ranking.with_range(df, ["folder", "k", "path"], "path")
    assert ranged.groupBy("_range").count().agg(F.max("count")).first()[0] < 800
    ranked = ranking.with_positions(df, ["folder"], ["k"], "path").collect()
    assert all(r.position == int(r.path) + 1 and r.total == 4000 for r in ranked)


def test_one_row_and_no_rows(spark):
    df = spark.createDataFrame([("/f", "a.png", None)], "folder string, name string, mtime timestamp_ntz")
    (row,) = browse.neighbours(df).collect()
    assert (row.position, row.total, row.previous, row.next) == (1, 1, None, None)
    assert browse.ranked(df.where("false")).collect() == []


def test_pages_concatenate_to_the_folder(skewed):
    rows, df = skewed
    ranked = browse.ranked(df.where("folder = '/g/hot'")).cache()
    total = ranked.count()
    cursor, seen = 0, []
    while cursor is not None:
        page = sorted(browse.page(ranked, "/g/hot", 500, cursor).collect(), key=lambda r: r.position)
        seen += [r.position for r in page]
        assert {r.total for r in page} == {total}
        cursor = page[0].next_cursor
    assert seen == list(range(1, total + 1))
    assert browse.page(ranked, "/g/hot", 500, total + 5).collect() == []
    rest = browse.page(ranked, "/g/hot", None, total - 3).collect()
    assert len(rest) == 3 and {r.next_cursor for r in rest} == {None}
    with pytest.raises(ValueError):
        browse.page(ranked, "/g/hot", 0)
    with pytest.raises(ValueError):
        browse.page(ranked, "/g/hot", 5001)


def test_keyset_pages_match_ranked_pages(skewed):
    _, df = skewed
    ranked = browse.ranked(df.where("folder = '/g/hot'"))
    first = sorted(browse.page(ranked, "/g/hot", 300, 0).collect(), key=lambda r: r.position)
    second = sorted(browse.page(ranked, "/g/hot", 300, 300).collect(), key=lambda r: r.position)
    assert [r.name for r in browse.page_after(df, "/g/hot", None, 300).collect()] == [r.name for r in first]
    assert [r.name for r in browse.page_after(df, "/g/hot", first[-1].name, 300).collect()] == [r.name for r in second]


def test_toggle_sort():
    assert browse.toggle_sort("name", "asc", "name") == ("name", "desc")
    assert browse.toggle_sort("name", "desc", "name") == ("name", "asc")
    assert browse.toggle_sort("name", "asc", "date") == ("date", "desc")
    assert browse.toggle_sort("date", "desc", "name") == ("name", "asc")


def test_grid_rows(skewed):
    rows, df = skewed
    grid = browse.grid_rows(browse.ranked(df), 3).collect()
    assert sum(len(r["items"]) for r in grid) == len(rows)
    want = expected(rows, lambda r: natural(r[2]))
    place = {r[1] + "/" + r[2]: want[r[0]][0] for r in rows}
    for r in grid:
        assert [place[p] for p in r["items"]] == list(range(r["row"] * 3 + 1, r["row"] * 3 + 1 + len(r["items"])))
    with pytest.raises(ValueError):
        browse.grid_rows(df, 9)


FILES = [
    ("/g/a", "1.png", 5), ("/g/a", ".2.png", 9), ("/g/a", "3.txt", 8), ("/g/a", "4.JPG", 7), ("/g/a", "5.gif", 7),
    ("/g/a/deep/er", "x.png", 1), ("/g/.hid", "y.png", 2), ("/g/only", "n.txt", 3),
]


def small_tree(spark):
    rows = [(i, f, n, s) for i, (f, n, s) in enumerate(FILES)]
    df = spark.createDataFrame(rows, "file_id long, folder string, name string, s int")
    return df.select("file_id", "folder", "name", F.timestamp_seconds("s").cast("timestamp_ntz").alias("mtime"))


def test_folder_facts(spark):
    table = {r.path: r for r in folders.folder_table(small_tree(spark), "/").collect()}
    assert set(table) == {"/", "/g", "/g/a", "/g/a/deep", "/g/a/deep/er", "/g/only"}
    a = table["/g/a"]
    # Covers include hidden images, ties by path; the count leaves hidden ones out.
    assert a.cover_images == ["/g/a/.2.png", "/g/a/4.JPG", "/g/a/5.gif"]
    assert (a.image_count, a.has_children, a.parent, a.name) == (3, True, "/g", "a")
    assert table["/g/a/deep"].image_count == 0 and table["/g/a/deep"].has_children
    assert table["/g/only"].cover_images == [] and table["/g/only"].has_children
    assert table["/g"].parent == "/"


def test_directory_manifest_adds_empty_folders(spark):
    dirs = spark.createDataFrame([("/g/none",), ("/g/a",)], "folder string").select(
        "folder", F.timestamp_seconds(F.lit(100)).cast("timestamp_ntz").alias("mtime")
    )
    table = {r.path: r for r in folders.folder_table(small_tree(spark), "/", dirs).collect()}
    assert table["/g/none"].has_children is False and table["/g/none"].image_count == 0
    assert table["/g/a"].mtime.second == 40 and table["/g/only"].mtime.second == 3


def test_counts_add_up(skewed):
    rows, df = skewed
    per_folder = folders.image_counts(df).agg(F.sum("image_count")).first()[0]
    subtree = {r.path: r.image_count for r in folders.subtree_counts(df, "/").collect()}
    assert per_folder == subtree["/g"] == len(rows)


def test_scan_folder(spark):
    subs, images = scan_folder(small_tree(spark), "/g/a", "", "date")
    assert [r.path for r in subs.collect()] == ["/g/a/deep"]
    assert [r.name for r in images.collect()] == ["4.JPG", "5.gif", "1.png"]
    _, found = scan_folder(small_tree(spark), "/g/a", "JPG")
    assert [r.name for r in found.collect()] == ["4.JPG"]
    assert scan_folder(small_tree(spark), "/nowhere")[1].collect() == []


def test_collated_descending_is_the_ascending_order_turned_round(spark):
    names = ["é2.png", "e10.png", "E1.png", "z.png", "Ä.png", "a.png"]
    df = spark.createDataFrame([("/f", n) for n in names], "folder string, name string")
    up = [r.name for r in browse.sort_items(df, "collated", "asc").collect()]
    assert up == ["a.png", "Ä.png", "E1.png", "e10.png", "é2.png", "z.png"]
    assert [r.name for r in browse.sort_items(df, "collated", "desc").collect()] == up[::-1]
    placed = {r.name: (r.position, r.previous, r.next) for r in browse.neighbours(df, "collated", "desc").collect()}
    assert placed["z.png"] == (1, None, "/f/é2.png") and placed["a.png"] == (6, "/f/Ä.png", None)


def test_hidden_folders_and_the_root(spark):
    rows = [("/", "1.png"), ("/g/.hid/sub", "2.png"), ("/g/a", "3.png")]
    df = spark.createDataFrame(rows, "folder string, name string").withColumn("mtime", F.expr("TIMESTAMP_NTZ'2024-01-01'"))
    table = {r.path: r for r in folders.folder_table(df, "/").collect()}
    assert set(table) == {"/", "/g", "/g/a"} and table["/"].cover_images == ["/1.png"] and table["/"].parent is None
    assert {r.path: r.image_count for r in folders.subtree_counts(df, "/").collect()} == {"/": 2, "/g": 1, "/g/a": 1}


def test_a_page_reads_its_folder_only(spark, tmp_path):
    rows = [(f"/p/{k % 5}", f"i{k}.png") for k in range(1000)]
    df = spark.createDataFrame(rows, "folder string, name string").withColumn("mtime", F.expr("TIMESTAMP_NTZ'2024-01-01'"))
    df.write.partitionBy("folder").parquet(str(tmp_path / "inv"))
    items = spark.read.parquet(str(tmp_path / "inv"))
    for limit, cursor in ((30, 0), (30, 180), (None, 190)):
        found = browse.page_of(items, "/p/3", limit=limit, cursor=cursor)
        wanted = browse.page(browse.ranked(items), "/p/3", limit, cursor)
        columns = ["name", "position", "total", "next_cursor"]
        assert sorted(found.select(columns).collect()) == sorted(wanted.select(columns).collect())
    plan = browse.page_of(items, "/p/3")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and len(scans) <= 2 and all("PartitionFilters: [isnotnull(folder" in line for line in scans)


@pytest.mark.parametrize("field, order", [("name", "asc"), ("name", "desc"), ("date", "asc"), ("date", "desc"), ("collated", "asc"), ("collated", "desc")])
def test_pages_by_cursor_are_the_ranked_pages(skewed, field, order):
    """Ties of names and times included; the last page is short, and there is none after it."""
    _, df = skewed
    hot = df.where("folder = '/g/hot'").withColumn("mtime", F.when(F.col("file_id") % 11 > 0, F.col("mtime")))
    wanted = [r.path for r in sorted(browse.ranked(hot, field, order).collect(), key=lambda r: r.position)]
    cursor, found = None, []
    while True:
        rows = browse.page_from(df.withColumn("mtime", F.when(F.col("file_id") % 11 > 0, F.col("mtime"))), "/g/hot", cursor, field, order, 800).collect()
        if not rows:
            break
        found += [r.path for r in rows]
        cursor = rows[-1].cursor
    assert found == wanted
    assert [r.path for r in browse.sort_items(hot.withColumn("path", F.concat_ws("/", "folder", "name")), field, order).collect()] == wanted


def test_a_cursor_by_date_reaches_the_scan(spark, tmp_path):
    rows = [(i, "/f", f"a{i}.png", i) for i in range(100)]
    spark.createDataFrame(rows, "file_id long, folder string, name string, day int").select(
        "file_id", "folder", "name", F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(day)").alias("mtime")
    ).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cursor = browse.page_from(df, "/f", None, "date", "desc", 5).collect()[-1].cursor
    second = browse.page_from(df, "/f", cursor, "date", "desc", 5)
    assert [r.file_id for r in second.collect()] == [94, 93, 92, 91, 90]
    assert "LessThanOrEqual(mtime" in second._jdf.queryExecution().executedPlan().toString()


def test_collated_ties_keep_their_order_both_ways(spark):
    names = ["b", "a1", "a01", "A1", "á1", "a2"]
    df = spark.createDataFrame([(i, "/f", n, None) for i, n in enumerate(names)], "file_id long, folder string, name string, mtime timestamp_ntz")
    placed = lambda order: [r.name for r in sorted(browse.ranked(df, "collated", order).collect(), key=lambda r: r.position)]
    assert placed("asc") == ["A1", "a01", "a1", "a2", "á1", "b"]
    assert placed("desc") == ["b", "á1", "a2", "A1", "a01", "a1"]


def test_facts_after_changes_equal_the_full_ones(spark):
    from pixledger.operators import tree_diff

    rng = random.Random(8)
    schema = "folder string, name string, mtime timestamp_ntz, length long"
    listed = lambda files: spark.createDataFrame([(*k, t, n) for k, (t, n) in files.items()], "folder string, name string, s int, length long").select(
        "folder", "name", F.timestamp_seconds("s").cast("timestamp_ntz").alias("mtime"), "length"
    )
    names = [f"{'.' if k % 9 == 0 else ''}f{k}{'.txt' if k % 4 == 0 else '.png'}" for k in range(150)]
    before = {(f"/g/{rng.choice(['a', 'b', 'hot', 'hot', '.h'])}", n): (rng.randrange(30), k) for k, n in enumerate(names)}
    before["/g/last", "only.png"] = (1, 1)
    after = dict(before)
    del after["/g/last", "only.png"]
    for key in rng.sample(sorted(before), 30):
        if key not in after:
            continue
        time, length = after.pop(key)
        fate = rng.randrange(4)
        if fate == 1:
            after[key] = (rng.randrange(60), length + 1000)
        elif fate == 2:
            after["/g/new/deep", key[1]] = (time, length)
        elif fate == 3:
            after[key[0], "n" + key[1]] = (time + 50, length + 500)
            after[key] = (time, length)
    x, y = listed(before), listed(after)
    found = folders.partials_after(folders.folder_partials(x), tree_diff.file_changes(x, y), y)
    plain = lambda df: sorted((r.folder, r.images, r.entries, r.newest, [tuple(c) for c in r.covers]) for r in df.collect())
    assert plain(found) == plain(folders.folder_partials(y))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(folders.folder_table_of(found, "/g")) == rows(folders.folder_table(y, "/g"))
    none = spark.createDataFrame([], schema)
    assert plain(folders.partials_after(folders.folder_partials(none), tree_diff.file_changes(none, y), y)) == plain(folders.folder_partials(y))


def test_indexed_search_reads_the_groups_that_can_match(spark, tmp_path):
    from pixledger.operators import inventory
    from pixledger.sources import name_index

    rows = [(f"/g/{k // 50}", f"{'Cat' if k < 50 else 'dog'}_{k:04d}{'é' * (k % 5)}.png") for k in range(500)] + [("/g/0", "ab"), ("/g/9", "")]
    df = spark.createDataFrame(rows, "folder string, name string").repartition(4)
    name_index.write_indexed(df, str(tmp_path / "i"), 10)
    for query in ("cat_", "DOG_03", "éé.png", "_0007", "ab", "", "CAT_0499", "none at all", ".PNG", "%", "0_"):
        found = name_index.search_indexed(spark, str(tmp_path / "i"), query)
        assert sorted(found.collect()) == sorted(inventory.search(df, query).select(*found.columns).collect()), query
    all_files = len(spark.read.parquet(str(tmp_path / "i" / name_index.ROWS)).inputFiles())
    assert len(name_index.groups_with(spark, str(tmp_path / "i"), "cat_")) <= 3 < all_files
    assert name_index.groups_with(spark, str(tmp_path / "i"), "nothing") == [] and name_index.groups_with(spark, str(tmp_path / "i"), "ab") is None
    scan = name_index.search_indexed(spark, str(tmp_path / "i"), "cat_")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and f"{name_index.GROUP}" in scan.split("PartitionFilters: [")[1].split("]")[0]
