"""Real files in a temporary tree, the refresh stream, and the catalog on disk."""

import os
import struct
import zlib

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from pixledger.operators import folders, inventory, refresh, resolve
from pixledger.operators.inventory import with_path
from pixledger.plans.metadata import file_metadata, new_metadata, scan_metadata
from pixledger.plans.browse import scan_folder
from pixledger.sources import files, sinks, snapshots, stores, tags
from pixledger.streaming.refresh import refresh_stream

A1111 = "a fox\nNegative prompt: hen\nSteps: 9, Seed: 4"


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(*texts, width=3, height=2, after=()):
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + b"".join(texts) + chunk(b"IDAT", b"") + b"".join(after) + chunk(b"IEND", b"")


def text(key, value):
    return chunk(b"tEXt", key + b"\0" + value.encode("latin-1"))


def packed(key, value):
    return chunk(b"zTXt", key + b"\0\0" + zlib.compress(value.encode("latin-1")))


def international(key, value, compress=False):
    body = value.encode()
    return chunk(b"iTXt", key + b"\0" + (b"\1\0" if compress else b"\0\0") + b"en\0k\0" + (zlib.compress(body) if compress else body))


def exif(comment, order=">", sub=False):
    mark = b"MM\0*" if order == ">" else b"II*\0"
    entry = lambda tag, kind, n, value: struct.pack(order + "HHII", tag, kind, n, value)
    if not sub:
        return mark + struct.pack(order + "IH", 8, 1) + entry(37510, 7, len(comment), 26) + b"\0" * 4 + comment
    first = struct.pack(order + "IH", 8, 1) + entry(34665, 4, 1, 26) + b"\0" * 4
    return mark + first + struct.pack(order + "H", 1) + entry(37510, 7, len(comment), 44) + b"\0" * 4 + comment


def jpeg(block=None, width=7, height=5):
    app = b"" if block is None else b"\xff\xe1" + struct.pack(">H", 8 + len(block)) + b"Exif\0\0" + block
    return b"\xff\xd8" + app + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, 3) + b"\0" * 9 + b"\xff\xd9"


def webp(block):
    size = b"\0\0\0\0" + (9).to_bytes(3, "little") + (19).to_bytes(3, "little")
    parts = b"VP8X" + struct.pack("<I", 10) + size + b"EXIF" + struct.pack("<I", len(block)) + block
    return b"RIFF" + struct.pack("<I", len(parts) + 4) + b"WEBP" + parts


ASCII = b"ASCII\0\0\0"
IMAGES = {
    "plain.png": (png(), dict(width=3, height=2)),
    "text.png": (png(text(b"parameters", "caf\xe9"), packed(b"prompt", "{}")), dict(parameters="café", prompt_json="{}")),
    "inter.png": (png(international(b"parameters", "日本"), international(b"workflow", "w", True)), dict(parameters="日本", workflow_json="w")),
    "late.png": (png(after=[text(b"parameters", "late")]), dict(parameters=None)),
    "exif.png": (png(chunk(b"eXIf", exif(b"raw text"))), dict(user_comment="raw text")),
    "big.jpg": (jpeg(exif(ASCII + b" {\xff1} ")), dict(width=7, height=5, user_comment="{1}")),
    "little.jpg": (jpeg(exif(ASCII + b"sub", "<", True)), dict(user_comment="sub")),
    "none.jpg": (jpeg(), dict(width=7, user_comment=None)),
    "a.webp": (webp(exif(ASCII + b"w")), dict(width=10, height=20, user_comment="w")),
    "a.gif": (b"GIF89a" + struct.pack("<HH", 4, 6) + b"\0" * 9, dict(width=4, height=6)),
    "a.bmp": (b"BM" + b"\0" * 16 + struct.pack("<ii", 8, -9) + b"\0" * 6, dict(width=8, height=9)),
    "a.tiff": (b"II*\0" + struct.pack("<IHHHIIHHII", 8, 2, 256, 3, 1, 11, 257, 4, 1, 12) + b"\0" * 4, dict(width=11, height=12)),
    "broken.png": (png()[:20], dict(read_error="invalid_file")),
    "bomb.png": (png(packed(b"parameters", "x" * 2_000_000)), dict(width=3, parameters="x" * 2_000_000, read_error=None, oversized=None)),
    "words.png": (b"hello", dict(read_error="invalid_file")),
    "empty.png": (b"", dict(read_error="invalid_file")),
}


@pytest.mark.parametrize("by_path", [False, True])
def test_tags_of_every_format(spark, tmp_path, by_path):
    rows = []
    for name, (content, _) in IMAGES.items():
        (tmp_path / name).write_bytes(content)
        rows.append((str(tmp_path / name), bytearray(content)))
    df = spark.createDataFrame(rows, "path string, content binary")
    read = tags.extract_tags(df.select("path")) if by_path else tags.extract_tags(df, "content")
    found = {os.path.basename(r.path): r.asDict() for r in read.collect()}
    for name, (_, wanted) in IMAGES.items():
        assert {k: found[name][k] for k in wanted} == wanted, name


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for folder in ("a/b", "empty", ".hidden"):
        (root / folder).mkdir(parents=True)
    (root / "a/one.png").write_bytes(png(text(b"parameters", A1111)))
    (root / "a/b/two.PNG").write_bytes(png())
    (root / "a/b/two.txt").write_bytes(A1111.replace("\n", "\r\n").encode() + b"\xff")
    (root / "a/b/bad.png").write_bytes(b"no image")
    (root / "a/.dot.png").write_bytes(png())
    (root / "a/_under.png").write_bytes(png())
    (root / "_sub").mkdir()
    (root / "_sub/c.png").write_bytes(png())
    (root / "a/site.HTML").write_text("<p>")
    (root / ".hidden/h.png").write_bytes(png())
    return root


def test_an_oversized_text_costs_only_itself(spark):
    content = png(packed(b"parameters", "x" * 5000), text(b"Comment", "y" * 90_000), packed(b"prompt", "{}"), text(b"workflow", "z" * 2000))
    df = spark.createDataFrame([("a.png", bytearray(content))], "path string, content binary")
    (row,) = tags.extract_tags(df, "content", max_text=1000).collect()
    assert (row.width, row.prompt_json, row.parameters, row.workflow_json) == (3, "{}", None, None)
    assert (row.oversized, row.read_error) == ("parameters,workflow_json", None)


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, content):
        self.content, self.at, self.read_bytes = content, 0, 0

    def read(self, n=-1):
        part = self.content[self.at :] if n < 0 else self.content[self.at : self.at + n]
        self.at += len(part)
        self.read_bytes += len(part)
        return part

    def seek(self, to, whence=0):
        self.at = to + (self.at if whence == 1 else 0)


def test_only_headers_are_read():
    pixels = os.urandom(3_000_000)
    wide_png = png(chunk(b"iCCP", b"p" * 900_000), text(b"parameters", "a"), after=[chunk(b"IDAT", pixels)])
    wide_webp = webp(exif(ASCII + b"w")) + b"VP8X" + struct.pack("<I", len(pixels)) + pixels
    wide_jpeg = jpeg(exif(ASCII + b"j")) + pixels
    profiled = b"\xff\xd8" + (b"\xff\xe2" + struct.pack(">H", 60_002) + b"c" * 60_000) * 5 + jpeg()[2:]
    wide_tiff = IMAGES["a.tiff"][0] + pixels
    for content in (wide_png, wide_webp, wide_jpeg, profiled, wide_tiff):
        file = Counted(content)
        assert "read_error" not in tags.file_tags(file) and file.read_bytes < 4096


def test_scan_metadata(spark, tree):
    rows = {r.name: r for r in scan_metadata(spark, str(tree)).collect()}
    assert set(rows) == {"one.png", "two.PNG", "bad.png", "_under.png", "c.png"}
    assert (rows["one.png"].tool, rows["one.png"].prompt, rows["one.png"].width) == ("A1111", "a fox", 3)
    # The sidecar is read with its carriage returns and stray byte put right.
    assert (rows["two.PNG"].tool, rows["two.PNG"].negative_prompt) == ("A1111", "hen")
    assert rows["two.PNG"].params == {"Steps": "9", "Seed": "4"}
    assert (rows["bad.png"].tool, rows["bad.png"].error_type) == (None, "invalid_file")


def test_oversized_files_are_not_opened(spark):
    rows = [("/x/a.png", "/x", "a.png", 80_000_000)]
    df = spark.createDataFrame(rows, "path string, folder string, name string, length long")
    none = spark.createDataFrame([], "folder string, stem string, text string")
    (row,) = file_metadata(df, none, content=None).collect()
    assert (row.error_type, row.error_message) == ("invalid_file", "Image is too large (> 75 MB)")


def test_walk_tree_lists_everything(spark, tree):
    entries = {r.path[len(str(tree)) + 1 :]: r for r in files.walk_tree(spark, str(tree)).collect()}
    assert set(entries) == {
        "a", "a/b", "empty", ".hidden", "a/one.png", "a/b/two.PNG", "a/b/two.txt", "a/b/bad.png", "a/.dot.png",
        "a/_under.png", "a/site.HTML", ".hidden/h.png", "_sub", "_sub/c.png",
    }
    assert entries["empty"].is_dir and not entries["a/one.png"].is_dir
    assert entries["a/one.png"].length == (tree / "a/one.png").stat().st_size
    stamp = entries["a/one.png"].mtime
    assert abs(stamp.timestamp() - (tree / "a/one.png").stat().st_mtime) < 86400


def test_listing_and_suffix(spark, tree):
    listing = files.read_listing(spark, str(tree))
    images = files.list_inventory(listing, str(tree))
    assert {r.name for r in images.collect()} == {"one.png", "two.PNG", "bad.png", "_under.png", "c.png"}
    assert [r.url_path for r in files.list_by_suffix(listing, str(tree)).collect()] == ["/a/site.HTML"]


def test_what_cannot_be_listed_is_named(spark, tree):
    (missing,) = files.walk_tree(spark, str(tree / "none")).collect()
    assert (missing.path, missing.error) == (str(tree / "none"), "not_found")
    (no_folder,) = files.errors_of(files.walk_tree(spark, str(tree / "a/one.png"))).collect()
    assert no_folder.error_type == "not_directory"
    (row,) = scan_metadata(spark, str(tree / "none")).collect()
    assert (row.name, row.folder, row.error_type, row.tool) == ("none", str(tree), "not_found", None)


def test_a_tree_by_url(spark, tree):
    found = files.read_listing(spark, f"file://{tree}").select(F.regexp_replace("path", "^file://", "").alias("path"), "length")
    assert sorted(found.collect()) == sorted(files.read_listing(spark, str(tree)).select("path", "length").collect())
    rows = {r.name: r for r in scan_metadata(spark, f"file://{tree}").collect()}
    assert rows["one.png"].tool == "A1111" and rows["two.PNG"].negative_prompt == "hen"


def test_links_to_folders_are_not_followed(spark, tree):
    os.symlink(tree / "a", tree / "again")
    names = [r.name for r in scan_metadata(spark, str(tree)).collect()]
    assert names.count("one.png") == 1


def tagged(spark, rows):
    df = spark.createDataFrame(rows, "file_id long, name string, length long, day int, parameters string")
    df = df.select("file_id", F.lit("/f").alias("folder"), "name", "length", F.lit(1).alias("width"), F.lit(1).alias("height"),
                   F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(day)").alias("mtime"), "parameters")
    for name in ("prompt_json", "workflow_json", "user_comment", "sidecar_text"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return with_path(df)


def parse(df):
    return resolve.resolve_metadata(df).withColumn("path", F.concat_ws("/", "folder", "name"))


def test_refresh_stream_parses_each_state_once(spark, tmp_path):
    source, catalog = str(tmp_path / "in"), str(tmp_path / "catalog")
    first = tagged(spark, [(1, "a.png", 5, 1, A1111), (2, "b.png", 5, 1, None), (2, "b.png", 5, 1, None)])
    first.write.parquet(source)

    def run():
        stream = spark.readStream.schema(first.schema).parquet(source)
        refresh_stream(stream, parse, catalog, str(tmp_path / "checkpoint")).awaitTermination()
        return sorted((r.name, r.length, r.tool, r.batch) for r in spark.read.parquet(catalog).collect())

    assert run() == [("a.png", 5, "A1111", 0), ("b.png", 5, "Unknown", 0)]
    # Nothing new: nothing parsed. Then a repeat, a changed file and a back-dated one.
    assert len(run()) == 2
    tagged(spark, [(1, "a.png", 5, 1, A1111), (2, "b.png", 6, 1, A1111), (3, "c.png", 1, -900, None)]).write.mode("append").parquet(source)
    rows = run()
    assert [(n, length, t) for n, length, t, _ in rows] == [
        ("a.png", 5, "A1111"), ("b.png", 5, "Unknown"), ("b.png", 6, "A1111"), ("c.png", 1, "Unknown"),
    ]
    batch = spark.read.parquet(catalog).select(refresh.VERSION_KEY)
    assert batch.count() == batch.distinct().count()


def test_a_repeated_batch_leaves_no_doubles(spark, tmp_path):
    """A batch that ran but was not recorded runs again after a failure."""
    import shutil

    source, catalog, checkpoint = (str(tmp_path / d) for d in ("in", "catalog", "checkpoint"))
    first = tagged(spark, [(1, "a.png", 5, 1, A1111)])
    first.write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(first.schema).parquet(source)
        refresh_stream(stream, parse, catalog, checkpoint).awaitTermination()
        assert spark.read.parquet(catalog).count() == 1
        shutil.rmtree(checkpoint)


def test_nothing_left_after_a_full_parse(spark):
    rows = tagged(spark, [(1, "a.png", 5, 1, A1111), (2, "b.png", 5, 1, None)])
    done = parse(rows)
    assert new_metadata(rows, done).collect() == []
    changed = tagged(spark, [(1, "a.png", 6, 1, A1111), (2, "b.png", 5, 1, None)])
    assert [r.file_id for r in new_metadata(changed, done).collect()] == [1]


def test_catalog_round_trip(spark, tmp_path):
    metadata = parse(tagged(spark, [(1, "a.png", 5, 1, A1111), (2, "b.png", 5, 1, None)])).drop("path")
    sinks.write_catalog(metadata, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"tool=A1111", "tool=Unknown"}
    back = sinks.read_catalog(spark, str(tmp_path / "out"))
    key = lambda r: r.file_id
    assert sorted(back.select(metadata.columns).collect(), key=key) == sorted(metadata.collect(), key=key)
    json_row = sinks.as_json(metadata.where("file_id = 2").select("file_id", "date", "params")).first().json
    assert json_row == '{"file_id":2,"date":null,"params":{}}'


def test_a_catalog_below_a_hidden_folder(spark, tree):
    inside = tree / ".hidden/album"
    (inside / "sub").mkdir(parents=True)
    (inside / "sub/x.png").write_bytes(png())
    (inside / ".off").mkdir()
    (inside / ".off/y.png").write_bytes(png())
    listed = files.list_inventory(files.read_listing(spark, str(inside)), str(inside))
    assert [r.name for r in listed.collect()] == ["x.png"]
    table = {r.path[len(str(inside)) :]: r.image_count for r in folders.folder_table(listed, str(inside)).collect() if r.path.startswith(str(inside))}
    assert table == {"": 0, "/sub": 1}
    assert {r.path[len(str(inside)) :]: r.image_count for r in folders.subtree_counts(listed, str(inside)).collect()}[""] == 1


@pytest.mark.parametrize("root", ["zzz://box/pics", "dbfs:/pics", "viewfs://none/pics"])
def test_a_store_nothing_opens_is_an_error_row(spark, root):
    (row,) = files.walk_tree(spark, root).collect()
    assert (row.path, row.is_dir) == (root, True) and row.error in ("server_error", "not_found")
    df = spark.createDataFrame([(f"{root}/a.png",)], "path string")
    assert tags.extract_tags(df).first().read_error == row.error
    assert files.read_texts(spark.createDataFrame([(f"{root}/a.txt",)], "path string")).collect() == []


def test_bucket_urls_reach_arrows_system():
    asked = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(stores, "_arrow_system", lambda store, kind: (asked.append((store, kind)), fs.LocalFileSystem())[1])
        assert stores.opened("s3a://box/a/b.png")[1] == "box/a/b.png"
        assert stores.opened("gs://box")[1] == "box/"
        assert stores.opened("abfss://part@account.dfs.core.windows.net/a")[1] == "part/a"
    assert asked == [("s3a://box", "s3a"), ("gs://box", "gs"), ("abfss://part@account.dfs.core.windows.net/", "abfss")]
    assert [stores.scheme(p) for p in ("/a://b", "a/b", "S3A://b", "dbfs:/x", "file:/x", "C:\\x")] == [None, None, "s3a", "dbfs", "file", None]
    assert not stores.tasks_can_open("zzz://box") and not stores.tasks_can_open("dbfs:/x") and stores.tasks_can_open("/x")


def boxed(tree):
    """A store of the caller's own: ``box://pics/...`` is a folder of this machine."""
    return {"box": lambda url: (fs.SubTreeFileSystem(tree, fs.LocalFileSystem()), url.removeprefix("box://pics").strip("/"))}


def test_a_store_of_the_callers_own(spark, tree):
    mine = {r.path.removeprefix("box://pics"): (r.is_dir, r.length) for r in files.walk_tree(spark, "box://pics", boxed(str(tree))).where("NOT is_dir").collect()}
    assert mine == {r.path.removeprefix(str(tree)): (r.is_dir, r.length) for r in files.walk_tree(spark, str(tree)).where("NOT is_dir").collect()}
    rows = {r.name: r for r in scan_metadata(spark, "box://pics", boxed(str(tree))).collect()}
    assert set(rows) == {"one.png", "two.PNG", "bad.png", "_under.png", "c.png"}
    assert rows["one.png"].tool == "A1111" and rows["two.PNG"].negative_prompt == "hen"


def test_a_store_that_only_spark_opens(spark, tree):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.album.link./in", f"file://{tree}")
    rows = {r.name: r for r in scan_metadata(spark, "viewfs://album/in").collect()}
    assert set(rows) == {"one.png", "two.PNG", "bad.png"}  # Spark leaves out names with an underscore
    assert rows["one.png"].tool == "A1111" and rows["one.png"].folder == "viewfs://album/in/a"
    assert rows["two.PNG"].negative_prompt == "hen" and rows["bad.png"].error_type == "invalid_file"


def test_links_are_resolved_and_kept_inside(spark, tree, tmp_path):
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside/o.png").write_bytes(png())
    os.symlink(tree / "a", tree / "again")
    os.symlink(tree / "a/one.png", tree / "empty/copy.png")
    os.symlink(tmp_path / "outside", tree / "away")
    os.symlink(tree / "gone", tree / "lost")
    os.symlink(tree / "round", tree / "round")
    os.symlink("../_sub", tree / "a/side")
    cut = len(str(tree)) + 1
    entries = {r.path[cut:]: r for r in files.walk_tree(spark, str(tree)).collect()}
    assert {p: (r.error, r.is_dir, r.target and r.target[cut:]) for p, r in entries.items() if r.target or r.error} == {
        "again": (None, True, "a"), "empty/copy.png": (None, False, "a/one.png"), "a/side": (None, True, "_sub"),
        "away": ("permission", False, str(tmp_path / "outside")[cut:]), "lost": ("not_found", False, None), "round": ("not_found", False, None),
    }
    assert not any("o.png" in p or p.startswith(("again/", "a/side/")) for p in entries)
    names = [r.name for r in scan_metadata(spark, str(tree)).where("error_type IS NULL OR error_type <> 'permission'").collect()]
    assert names.count("one.png") == 1 and names.count("copy.png") == 1 and names.count("c.png") == 1
    errors = {r.name: r.error_type for r in scan_metadata(spark, str(tree)).collect()}
    assert errors["away"] == "permission"

    walked = files.walk_tree(spark, str(tree))
    listed = files.list_inventory(files.files_of(walked), str(tree))
    shown, _ = scan_folder(listed, str(tree), links=files.links_of(walked))
    found = {r.name: (r.path[cut:], r.image_count) for r in shown.collect()}
    assert found["again"] == ("a", 2) and found["a"] == ("a", 2) and "away" not in found


def test_paths_resolve_through_links(spark):
    links = spark.createDataFrame(
        [("/r/in", "/r/deep/x"), ("/r/deep/x/out", "/else"), ("/else/back", "/r/home"), ("/r/loop", "/r/loop/more"), ("/r/one", "/r/two"), ("/r/two", "/r/one"), ("/r/up", "/r/a/../b")],
        "path string, target string",
    )
    asked = ["/r/in/p.png", "/r/in/out/q.png", "/r/in/out/back/z", "/r/plain", "/r", "/r/loop/x", "/r/one/x", "/r/up/c", "/r/../etc", "/elsewhere", None]
    df = spark.createDataFrame([(p,) for p in asked], "path string")
    found = {r.path: r.resolved for r in inventory.links_followed(df, links).collect()}
    assert found == {
        "/r/in/p.png": "/r/deep/x/p.png", "/r/in/out/q.png": "/else/q.png", "/r/in/out/back/z": "/r/home/z", "/r/plain": "/r/plain", "/r": "/r",
        "/r/loop/x": None, "/r/one/x": None, "/r/up/c": "/r/b/c", "/r/../etc": "/etc", "/elsewhere": "/elsewhere", None: None,
    }
    marked = {r.path for r in inventory.check_root(df, "/r", links=links).collect() if r.error_type == "permission"}
    assert marked == {"/r/in/out/q.png", "/r/loop/x", "/r/one/x", "/r/../etc", "/elsewhere", None}


def test_only_linked_paths_go_on_to_the_next_round(spark, monkeypatch):
    sizes, write = [], inventory.stored

    def counted(df, purpose):
        out = write(df, purpose)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(inventory, "stored", counted)
    links = spark.createDataFrame([("/r/in", "/else"), ("/else/back", "/r/home")], "path string, target string")
    df = spark.createDataFrame([(f"/r/plain/{i}",) for i in range(20)] + [("/r/in/back/p",), ("/r/in/q",)], "path string")
    found = {r.path: (r.resolved, r.error_type) for r in inventory.check_root(df, "/r", links=links, keep_resolved=True).collect()}
    assert len(found) == 22 and found["/r/plain/3"] == ("/r/plain/3", None)
    assert found["/r/in/back/p"] == ("/r/home/p", None) and found["/r/in/q"] == ("/else/q", "permission")
    assert sizes[-3:] == [22, 2, 1]


def test_versions_of_a_catalog(spark, tmp_path, monkeypatch):
    catalog = str(tmp_path / "catalog")
    rows = lambda first, last: spark.range(first, last).select("id", F.when(F.col("id") % 2 == 0, "A1111").alias("tool"))
    ids = lambda version=None: sorted(r.id for r in snapshots.read_version(spark, catalog, version).collect())
    assert snapshots.versions(spark, catalog) == []
    with pytest.raises(ValueError):
        snapshots.read_version(spark, catalog)
    assert snapshots.commit(rows(0, 4), catalog) == 1
    pinned = snapshots.read_version(spark, catalog)
    assert snapshots.commit(rows(4, 6), catalog) == 2
    assert ids() == list(range(6)) and sorted(r.id for r in pinned.collect()) == [0, 1, 2, 3] == ids(1)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(rows(0, 1), catalog, replace=True, onto=1)
    with pytest.raises(ValueError):
        snapshots.commit(spark.range(3), catalog)
    assert snapshots.commit(rows(9, 9), catalog, replace=True, onto=2) == 3 and ids() == []

    # Another writer commits between reading the newest version and writing the manifest.
    create, raced = snapshots._create, []

    def late(session, path, text):
        if not raced:
            raced.append(path)
            monkeypatch.setattr(snapshots, "_create", create)
            snapshots.commit(rows(20, 22), catalog)
        return create(session, path, text)

    monkeypatch.setattr(snapshots, "_create", late)
    assert snapshots.commit(rows(30, 31), catalog) == 5
    assert ids() == [20, 21, 30] and ids(2) == list(range(6))
    assert snapshots.drop_unused(spark, catalog, 2) == 2
    assert snapshots.versions(spark, catalog) == [4, 5] and ids() == [20, 21, 30] and ids(4) == [20, 21]
