"""Embedded tags of image files: the one operator that needs Python workers.

Only headers are read: text chunks up to the pixel data, the EXIF user comment,
and the pixel size; all else is skipped over. The helpers take an open file, so
they work on a path or URL, of which a few kilobytes are read, or on given bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pixledger.sources.stores import Stores, error_of, open_file

_NUMBERS = ["width", "height"]
_TEXTS = ["parameters", "prompt_json", "workflow_json", "user_comment", "read_error", "oversized"]
_TAG_FIELDS = [T.StructField(n, T.IntegerType()) for n in _NUMBERS] + [T.StructField(n, T.StringType()) for n in _TEXTS]
_TAG_SCHEMA = pa.schema([(n, pa.int32()) for n in _NUMBERS] + [(n, pa.string()) for n in _TEXTS])
_KEYWORDS = {"parameters": "parameters", "prompt": "prompt_json", "workflow": "workflow_json"}

# Fixed values of the file formats.
_PNG = b"\x89PNG\r\n\x1a\n"
_USER_COMMENT = 37510
_EXIF_POINTER = 34665
_ASCII_MARK = b"ASCII\x00\x00\x00"
_TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4}
MAX_TEXT_BYTES = 64 * 1024 * 1024
_NOT_FRAMES = {0xC4, 0xC8, 0xCC}


def extract_tags(
    files: DataFrame, content: str | None = None, path: str = "path", max_text: int = MAX_TEXT_BYTES, stores: Stores | None = None
) -> DataFrame:
    """Add tags, pixel size, read_error and oversized to files.

    Files are opened by path or URL and only their headers read; with ``content``
    the bytes of that column are used, and replaced. A text tag of more than
    ``max_text`` bytes is left out and named in ``oversized``; the file keeps its
    size and other tags. Tags of other keywords are not decoded at all. A file that cannot
    be opened has the file system's error as ``read_error``, whatever the store.
    """
    keep = [c for c in files.columns if c != content]
    if not content:
        keep = files.columns
    schema = T.StructType([f for f in files.schema if f.name in keep] + _TAG_FIELDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if content:
                found = [file_tags(pa.BufferReader(data.as_buffer()), max_text) for data in batch.column(content)]
            else:
                found = [_tags_of_path(name.as_py(), max_text, stores) for name in batch.column(path)]
            tags = pa.RecordBatch.from_pylist(found, _TAG_SCHEMA)
            columns = [batch.column(c) for c in keep] + tags.columns
            yield pa.RecordBatch.from_arrays(columns, keep + tags.schema.names)

    return files.mapInArrow(read, schema)


def _tags_of_path(path: str, max_text: int, stores: Stores | None) -> dict:
    try:
        with open_file(path, stores) as file:
            return file_tags(file, max_text)
    except OSError as failure:
        return {"read_error": error_of(failure)}


def file_tags(file, max_text: int = MAX_TEXT_BYTES) -> dict:
    """Tags of one open image file; ``invalid_file`` if it cannot be read as one."""
    try:
        head = file.read(32)
        file.seek(0)
        if head.startswith(_PNG):
            return _png(file, max_text)
        if head.startswith(b"\xff\xd8"):
            return _jpeg(file)
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            return _webp(file)
        if head[:6] in (b"GIF87a", b"GIF89a"):
            return _sized(*struct.unpack("<HH", head[6:10]))
        if head[:2] == b"BM":
            width, height = struct.unpack("<ii", head[18:26])
            return _sized(width, abs(height))
        if head[:4] in (b"II*\x00", b"MM\x00*"):
            ifd = _Exif(_FileBytes(file)).entries()
            return _sized(ifd[256], ifd[257]) | _comment(ifd)
    except (struct.error, zlib.error, KeyError, IndexError, ValueError, OSError):
        pass
    return {"read_error": "invalid_file"}


def _sized(width: int, height: int) -> dict:
    return {"width": width, "height": height}


def _png(file, max_text: int) -> dict:
    tags: dict = {}
    over: list[str] = []
    at = len(_PNG)
    while True:
        file.seek(at)
        length, kind = struct.unpack(">I4s", file.read(8))
        at += 12 + length
        if kind in (b"IDAT", b"IEND"):
            break
        if kind == b"IHDR":
            tags |= _sized(*struct.unpack(">II", file.read(8)))
        elif kind in (b"tEXt", b"zTXt", b"iTXt"):
            head = file.read(min(length, 80))  # a keyword has 79 bytes at most
            name = _KEYWORDS.get(head.partition(b"\x00")[0].decode("latin-1"))
            if name and length > max_text:
                over.append(name)
            elif name:
                text = _png_text(kind, head + file.read(length - len(head)), max_text)
                if text is None:
                    over.append(name)
                else:
                    tags[name] = text
        elif kind == b"eXIf":
            tags |= _comment(_Exif(file.read(length)).entries())
    if over:
        tags["oversized"] = ",".join(over)
    return tags if "width" in tags else {"read_error": "invalid_file"}


def _png_text(kind: bytes, body: bytes, max_text: int) -> str | None:
    """The text of a chunk; None if it swells beyond the bound."""
    _, _, rest = body.partition(b"\x00")
    if kind == b"tEXt":
        return rest.decode("latin-1")
    if kind == b"zTXt":
        text = _inflate(rest[1:], max_text)
        return None if text is None else text.decode("latin-1")
    packed, rest = rest[0], rest[2:]
    text = rest.split(b"\x00", 2)[2]
    if packed:
        text = _inflate(text, max_text)
    return None if text is None else text.decode("utf-8", "ignore")


def _inflate(data: bytes, max_text: int) -> bytes | None:
    unpacker = zlib.decompressobj()
    text = unpacker.decompress(data, max_text)
    return None if unpacker.unconsumed_tail else text


def _jpeg(file) -> dict:
    tags: dict = {}
    at = 2
    while "width" not in tags:
        file.seek(at)
        mark, kind = file.read(2)
        at += 2
        while kind == 0xFF:
            kind = file.read(1)[0]
            at += 1
        if mark != 0xFF or kind in (0xD9, 0xDA):
            return {"read_error": "invalid_file"}
        length = struct.unpack(">H", file.read(2))[0]
        at += length
        if kind == 0xE1:
            body = file.read(length - 2)
            if body.startswith(b"Exif\x00\x00"):
                tags |= _comment(_Exif(body[6:]).entries())
        elif 0xC0 <= kind <= 0xCF and kind not in _NOT_FRAMES:
            height, width = struct.unpack(">HH", file.read(5)[1:])
            tags |= _sized(width, height)
    return tags


def _webp(file) -> dict:
    tags: dict = {}
    at = 12
    while True:
        try:
            file.seek(at)
        except (OSError, ValueError):  # padding past the end, which some readers refuse to seek to
            break
        head = file.read(8)
        if len(head) < 8:
            break
        kind, length = struct.unpack("<4sI", head)
        at += 8 + length + length % 2
        if kind == b"EXIF":
            tags |= _comment(_Exif(file.read(length).removeprefix(b"Exif\x00\x00")).entries())
            continue
        body = file.read(min(length, 10))
        if kind == b"VP8X":
            tags = _sized(int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1) | tags
        elif kind == b"VP8 ":
            width, height = struct.unpack("<HH", body[6:10])
            tags = _sized(width & 0x3FFF, height & 0x3FFF) | tags
        elif kind == b"VP8L":
            bits = int.from_bytes(body[1:5], "little")
            tags = _sized((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1) | tags
    return tags if "width" in tags else {"read_error": "invalid_file"}


class _FileBytes:
    """Slices of an open file, read as they are asked for."""

    def __init__(self, file):
        self.file = file

    def __getitem__(self, part: slice) -> bytes:
        self.file.seek(part.start or 0)
        return self.file.read(part.stop - (part.start or 0))


class _Exif:
    """Entries of the first directory of a TIFF block and of its EXIF directory."""

    def __init__(self, block: bytes | _FileBytes):
        self.block = block
        self.order = ">" if block[0:2] == b"MM" else "<"

    def _read(self, form: str, at: int) -> tuple:
        return struct.unpack(self.order + form, self.block[at : at + struct.calcsize("=" + form)])

    def entries(self) -> dict:
        found = self._directory(self._read("I", 4)[0])
        if isinstance(found.get(_EXIF_POINTER), int):
            found = self._directory(found[_EXIF_POINTER]) | found
        return found

    def _directory(self, at: int) -> dict:
        found = {}
        (count,) = self._read("H", at)
        for entry in range(at + 2, at + 2 + 12 * count, 12):
            tag, kind, number = self._read("HHI", entry)
            size = _TYPE_BYTES.get(kind, 1) * number
            start = entry + 8 if size <= 4 else self._read("I", entry + 8)[0]
            value = self.block[start : start + size]
            if kind in (3, 4) and number == 1:
                found[tag] = int.from_bytes(value, "big" if self.order == ">" else "little")
            else:
                found[tag] = value
        return found


def _comment(entries: dict) -> dict:
    value = entries.get(_USER_COMMENT)
    if not isinstance(value, bytes):
        return {}
    return {"user_comment": value.removeprefix(_ASCII_MARK).decode("utf-8", "ignore").strip()}
