"""Text helpers with Python's notions of whitespace, digits and order."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as str.isspace() sees it, and as a JavaScript trim does.
PY_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
JS_SPACES = "".join(c for c in PY_SPACES if c not in "\x1c\x1d\x1e\x1f\x85") + "\ufeff"

SPACES_SQL = f"'{PY_SPACES}'"

# The same class inside a Java pattern that carries the (?U) flag.
RE_SPACE = r"[\s\x1c-\x1f]"
RE_WORD = r"[\p{L}\p{N}_]"

# Every decimal digit outside ASCII, and its value at the same position.
_OTHER_DIGITS = "".join(
    chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd"
)
_DIGIT_VALUES = "".join(str(unicodedata.decimal(c)) for c in _OTHER_DIGITS)


def strip_sql(text: str) -> str:
    """SQL that drops leading and trailing Unicode whitespace.

    Most texts begin and end in a printable ASCII character and need no trimming,
    which costs a walk over the text.
    """
    plain = f"ascii({text}) BETWEEN 33 AND 126 AND ascii(right({text}, 1)) BETWEEN 33 AND 126"
    return f"IF({plain}, {text}, btrim({text}, {SPACES_SQL}))"


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode whitespace."""
    plain = F.ascii(text).between(33, 126) & F.ascii(F.right(text, F.lit(1))).between(33, 126)
    return F.when(plain, text).otherwise(F.btrim(text, F.lit(PY_SPACES)))


def js_strip(text: Column) -> Column:
    return F.btrim(text, F.lit(JS_SPACES))


def ascii_digits(text: Column) -> Column:
    """Decimal digits of other scripts become 0-9; plain names pass untouched."""
    return F.when(
        text.rlike(r"[^\x00-\x7F]"), F.translate(text, _OTHER_DIGITS, _DIGIT_VALUES)
    ).otherwise(text)


def natural_key(name: Column) -> Column:
    """One string whose byte order is the natural order of names.

    Text is lower-cased and compared by code point. A digit run becomes a NUL
    (which sorts before any file name character), its length without leading
    zeros in ten digits, then those digits: longer runs are larger numbers, and
    runs of one length compare as text. So there is no limit on the number's
    size, and the key is a plain string that sorts and range-partitions fast.
    """
    runs = F.regexp_extract_all(ascii_digits(F.lower(name)), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def encode(run: Column) -> Column:
        digits = F.ltrim(run, F.lit("0"))
        number = F.concat(F.lit("\x00"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
        return F.when(F.substr(run, F.lit(1), F.lit(1)).between("0", "9"), number).otherwise(run)

    return F.array_join(F.transform(runs, encode), "")


def collated_key(name: Column) -> Column:
    """Natural order with Unicode collation of the text, as a browser sorts.

    Text and number alternate, so each element pairs a text with the number
    after it; a missing part counts as empty text.
    """
    pairs = F.regexp_extract_all(F.lower(name), F.lit(r"([^0-9]*[0-9]+|[^0-9]+\z)"), F.lit(1))
    return F.transform(
        pairs,
        lambda pair: F.struct(
            F.collate(F.regexp_extract(pair, r"\A([^0-9]*)", 1), "UNICODE").alias("text"),
            F.nullif(F.regexp_extract(pair, r"([0-9]+)\z", 1), F.lit("")).cast("double").alias("num"),
        ),
    )


def lower_contains(text: Column, query: str) -> Column:
    """Case-insensitive literal substring; an empty query matches all."""
    if not query:
        return F.lit(True)
    return F.contains(F.lower(text), F.lower(F.lit(query)))


def bind_sql(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for a value computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def python_float_sql(number: str) -> str:
    """SQL for the text Python gives a float, from the one the JVM gives.

    Both print the shortest digits; they differ in when an exponent is used.
    """
    # The significant digits and the power of ten of the first one.
    parts = """named_struct(
        'digits', rtrim('0', replace(ltrim('-', substring_index(jvm, 'E', 1)), '.', '')),
        'e', CAST(substring_index(jvm, 'E', -1) AS INT))"""
    spread = """CASE
        WHEN p.e BETWEEN 0 AND 15 THEN concat(
          substr(rpad(p.digits, greatest(p.e + 1, length(p.digits)), '0'), 1, p.e + 1), '.',
          CASE WHEN length(p.digits) > p.e + 1 THEN substr(p.digits, p.e + 2) ELSE '0' END)
        WHEN p.e BETWEEN -4 AND -1 THEN concat('0.', repeat('0', -p.e - 1), p.digits)
        ELSE concat(substr(p.digits, 1, 1), IF(length(p.digits) > 1, concat('.', substr(p.digits, 2)), ''),
          'e', IF(p.e < 0, '-', '+'), IF(abs(p.e) < 10, '0', ''), CAST(abs(p.e) AS STRING)) END"""
    whole = f"""CASE
        WHEN jvm = 'NaN' THEN 'nan' WHEN jvm = 'Infinity' THEN 'inf' WHEN jvm = '-Infinity' THEN '-inf'
        WHEN NOT contains(jvm, 'E') THEN jvm
        ELSE concat(IF(startswith(jvm, '-'), '-', ''), {bind_sql(parts, 'p', spread)}) END"""
    return bind_sql(f"CAST({number} AS STRING)", "jvm", whole)


def reversed_key(key: Column) -> Column:
    """A key whose ascending byte order is the descending order of ``key``.

    Hex keeps byte order, the digit swap turns it round, and the closing letter
    puts a key after all keys it is a prefix of.
    """
    swapped = F.translate(F.hex(F.encode(key, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210")
    return F.concat(swapped, F.lit("G"))
