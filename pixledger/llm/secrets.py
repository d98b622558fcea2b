"""Secret scans: fixed patterns, and a battery of randomness tests on other tokens. Rows meet DataFrame functions only.

Tokens of 20 or more characters from the alphabets of encoded data are tested. For
the encoding inferred from its characters, a token gets the p-values of three tests
of randomness: chi-squared uniformity over the alphabet, the number of runs below
and above the alphabet's middle, and the correlation of neighbouring characters.
Fisher's method combines them to one likeness to random text.

How random ordinary words look depends on their length and on the encoding they are read
in, so the null is measured: over all documents the letter pairs of words too short to be
tested are counted, on top of a fixed list of common words (``COMMON``), so that a null
stands in the smallest corpus too. ``DRAWS`` strings drawn from these pairs show, for each
encoding and length, how random running words look there; no tested token is among them.
Every token, of letters or digits alone too, has as its p-value the share of them that
look as random; Benjamini-Hochberg's rule sets one threshold per group of encoding and
length at the rate ``RATE``. Tokens whose own tests reject randomness, by the same rule,
stay below it in any case; words cannot be written in hex, so there the tests alone
decide. Letters of one case (a first capital apart) are read in 26 letters, where short
keys differ least from words and many are missed at this rate. Only these counts, a fixed number of
bins and pairs, reach the driver; the null is drawn there with a fixed seed.

Null text counts as empty in the scan and stays null in ``redacted``. Equal rows get
equal spans. Offsets count code points, the end is exclusive. Other columns pass.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixledger.llm.common import set_apart, table

KINDS = ["assign", "access", "hex", "random"]
KEYS = "(password|passwd|secret|token|api_?key)"
#: kind: what a text must hold, pattern, group whose length counts, least length. For hex and access the least
#: length stands in the pattern, which finds the same matches as a later filter: a match is a whole run.
BASE = {
    "assign": (f"(?i){KEYS}", rf"""(?i){KEYS}["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("AKIA", "AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": ("[0-9a-f]{24}", "[0-9a-f]{24,}", 0, 24),
}
LEAST = 20
TOKEN = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
LENGTHS, GROUP_WIDTH = 8, 4
BINS = 200
#: Bins by halves below 1 / BINS; all that is smaller falls into the last.
HALVES = 60
RATE = 0.01
DRAWS = 20_000
#: Common words whose letter pairs the null begins with.
COMMON = (
    "the and that have for not with you this but his from they say her she will one all would there their what out about who get which when make can like"
    " time just him know take people into year your good some could them see other than then now look only come its over think also back after use two how"
    " our work first well way even new want because any these give day most between through during without system number information however government"
    " und der die das nicht ein sich mit dem auf eine auch werden aus hat dass sie nach wird bei einer noch wie einem haben nur oder aber zeit kann dieser"
    " durch wenn schon zwischen mehr immer sehr unter arbeit gesellschaft entwicklung les des est une dans que pour qui pas sur plus par avec tout faire"
    " son mettre autre mais nous comme avoir leur deux homme temps encore aussi celui entre vivre depuis toujours los las del por con para como pero sus"
    " hasta donde quien desde todo nos durante todos uno ellos contra otros ese eso ante esta estado tiempo mismo yo otro tanto trabajo siempre"
)
REPLACEMENT = "[SECRET]"

_SPAN = "array<struct<start:int,kind:int,end:int>>"
_TOKEN_SPAN = "array<struct<start:int,token:string>>"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: name, pattern, alphabet; the first that fits is inferred. Letters of one case are read in lower case.
ENCODINGS = [
    ("letters", "^([A-Za-z][a-z]*|[A-Z]+)$", _LETTERS),
    ("base52", "^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", ".", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="),
]
#: One group per encoding and length.
GROUPS = len(ENCODINGS) * LENGTHS


def _walk(text: Column, pattern: str, group: int, kind: str, made) -> Column:
    """Runs over the matches of ``pattern``; ``made(start, match, group)`` is an array to append (empty for none)."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("before"), matches.alias("match"), values.alias("value"))
    steps = F.filter(steps, lambda x: x["match"].isNotNull())

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["before"])
        return F.struct((start + F.length(x["match"])).alias("at"), F.concat(state["out"], made(start, x["match"], x["value"]).cast(kind)).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda s: s["out"])


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def base_spans(text: Column) -> Column:
    """The fixed kinds' spans, unordered."""
    found = []
    for k, (holds, pattern, group, least) in enumerate(BASE.values()):
        spans = _walk(
            text, pattern, group, _SPAN,
            lambda start, match, value, k=k, least=least: F.when(
                F.length(value) >= least, F.array(F.struct(start.alias("start"), F.lit(k).alias("kind"), (start + F.length(match)).alias("end")))
            ).otherwise(_none(_SPAN)),
        )
        found.append(F.when(text.rlike(holds), spans).otherwise(_none(_SPAN)))
    return F.concat(*found)


def _normal_tail(z: Column) -> Column:
    """Share of the normal distribution above z, by a logistic approximation."""
    return 1 / (1 + F.exp(F.least(F.greatest(1.5976 * z + 0.07056 * z * z * z, F.lit(-700.0)), F.lit(700.0))))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _two_sided(z: Column) -> Column:
    return 2 * _normal_tail(F.abs(z))


def likeness(token: Column) -> Column:
    """How well a token passes for random text of its encoding: the combined p-value, 0 to 1."""
    letters = token.rlike(ENCODINGS[0][1])
    alphabet = F.lit(ENCODINGS[-1][2])
    for _, pattern, symbols in reversed(ENCODINGS[:-1]):
        alphabet = F.when(token.rlike(pattern), F.lit(symbols)).otherwise(alphabet)
    read = F.struct(F.when(letters, F.lower(token)).otherwise(token).alias("body"), alphabet.alias("alphabet"))

    def coded(r: Column) -> Column:
        chars = F.split(r["body"], "(?<=.)(?=.)")
        return F.struct(
            r["body"].alias("body"), F.length(r["body"]).cast("double").alias("n"), F.length(r["alphabet"]).cast("double").alias("size"),
            chars.alias("chars"), F.transform(chars, lambda c: F.position(c, r["alphabet"]).cast("double")).alias("codes"),
        )

    def counted(r: Column) -> Column:
        equal = F.aggregate(
            F.array_distinct(r["chars"]), F.lit(0.0), lambda s, c: s + F.pow(r["n"] - F.length(F.replace(r["body"], c, F.lit(""))), F.lit(2.0))
        )
        return F.struct(
            r["n"].alias("n"), r["size"].alias("size"), r["codes"].alias("codes"), ((r["size"] + 1) / 2).alias("middle"),
            (equal * r["size"] / r["n"] - r["n"]).alias("chi"), (F.aggregate(r["codes"], F.lit(0.0), lambda s, c: s + c) / r["n"]).alias("mean"),
            F.arrays_zip(F.slice(r["codes"], 1, r["n"].cast("int") - 1).alias("a"), F.slice(r["codes"], 2, r["n"].cast("int") - 1).alias("b")).alias("pairs"),
        )

    def measured(r: Column) -> Column:
        total = lambda values, f: F.aggregate(values, F.lit(0.0), lambda s, x: s + f(x))
        high = total(r["codes"], lambda c: (c > r["middle"]).cast("double"))
        return F.struct(
            r["n"].alias("n"), (r["size"] - 1).alias("freedom"), r["chi"].alias("chi"), (2 * high * (r["n"] - high) / r["n"] + 1).alias("expected"),
            (1 + total(r["pairs"], lambda p: ((p["a"] > r["middle"]) != (p["b"] > r["middle"])).cast("double"))).alias("runs"),
            total(r["codes"], lambda c: (c - r["mean"]) * (c - r["mean"])).alias("variance"),
            total(r["pairs"], lambda p: (p["a"] - r["mean"]) * (p["b"] - r["mean"])).alias("covariance"),
        )

    def tested(r: Column) -> Column:
        ratio = F.pow(F.greatest(r["chi"], F.lit(0.0)) / r["freedom"], F.lit(1 / 3))
        uniform = _normal_tail((ratio - (1 - 2 / (9 * r["freedom"]))) / F.sqrt(2 / (9 * r["freedom"])))
        spread = (r["expected"] - 1) * (r["expected"] - 2) / (r["n"] - 1)
        even = F.when(spread > 0, _two_sided((r["runs"] - r["expected"]) / F.sqrt(spread))).otherwise(F.lit(0.0))
        serial = F.when(r["variance"] > 0, _two_sided(r["covariance"] / r["variance"] * F.sqrt(r["n"]))).otherwise(F.lit(0.0))
        log = lambda p: F.log(F.greatest(p, F.lit(1e-12)))
        return -(log(uniform) + log(even) + log(serial))

    half = _let(_let(_let(_let(read, coded), counted), measured), tested)
    return _let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))


def _group(token: Column) -> Column:
    encoding = F.lit(len(ENCODINGS) - 1)
    for k in range(len(ENCODINGS) - 2, -1, -1):
        encoding = F.when(token.rlike(ENCODINGS[k][1]), F.lit(k)).otherwise(encoding)
    return (encoding * LENGTHS + F.least(F.floor((F.length(token) - LEAST) / GROUP_WIDTH), F.lit(LENGTHS - 1))).cast("int")


def letter_pairs(docs: DataFrame) -> np.ndarray:
    """Counts of letters by the letter before in words too short to be tested; the last place stands for a word's ends."""
    text = F.lower(F.when(F.col("text").rlike(TOKEN), F.regexp_replace("text", TOKEN, " ")).otherwise(F.col("text")))
    words = docs.select(F.explode(F.split(text, "[^a-z]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda k: F.substring(padded, k, F.lit(2))))
    places = f"{_LETTERS} "
    out = np.zeros((len(places), len(places)))
    for word in COMMON.split():
        for x, y in zip(f" {word}", f"{word} "):
            out[places.index(x), places.index(y)] += 1
    for row in words.select(pair.alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 27 * 27 rows at most
        out[places.index(row["pair"][0]), places.index(row["pair"][1])] += row["n"]
    return out


def drawn(pairs: np.ndarray) -> np.ndarray:
    """``DRAWS`` strings of running words without breaks, as numbers of letters; as long as the longest group's least length."""
    share = pairs / np.maximum(pairs.sum(1, keepdims=True), 1)
    share = share[:, :-1] + share[:, -1:] * share[-1:, :-1]
    share[share.sum(1) == 0] = share[-1]
    ends = np.cumsum(share / share.sum(1, keepdims=True), axis=1)
    ends[:, -1] = 1
    rng = np.random.default_rng(0)
    out, now = np.zeros((DRAWS, LEAST + GROUP_WIDTH * (LENGTHS - 1)), np.int64), np.full(DRAWS, len(pairs) - 1)
    for k in range(out.shape[1]):
        out[:, k] = now = (ends[now] < rng.random((DRAWS, 1))).sum(1)
    return out


def likeness_of(codes: np.ndarray, size: int) -> np.ndarray:
    """``likeness`` of strings of one length, given as their characters' places (from 1) in an alphabet of ``size``."""
    n, freedom = codes.shape[1], size - 1
    tail = lambda z: 1 / (1 + np.exp(np.clip(1.5976 * z + 0.07056 * z**3, -700, 700)))
    chi = sum(((codes == c).sum(1) ** 2 for c in range(1, size + 1)), np.zeros(len(codes))) * size / n - n
    uniform = tail((np.cbrt(np.maximum(chi, 0) / freedom) - (1 - 2 / (9 * freedom))) / np.sqrt(2 / (9 * freedom)))
    above = codes > (size + 1) / 2
    high, runs = above.sum(1), 1 + (above[:, 1:] != above[:, :-1]).sum(1)
    expected = 2 * high * (n - high) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    even = np.where(spread > 0, 2 * tail(np.abs(runs - expected) / np.sqrt(np.where(spread > 0, spread, 1))), 0)
    off = codes - codes.mean(1, keepdims=True)
    variance = (off * off).sum(1)
    serial = np.where(variance > 0, 2 * tail(np.abs((off[:, 1:] * off[:, :-1]).sum(1)) / np.where(variance > 0, variance, 1) * np.sqrt(n)), 0)
    half = -sum(np.log(np.maximum(p, 1e-12)) for p in (uniform, even, serial))
    return np.exp(-half) * (1 + half + half * half / 2)


def _null(words: np.ndarray, group: int) -> np.ndarray | None:
    """The sorted likeness of drawn words in a group's encoding and least length; None where words cannot be written in it."""
    alphabet = ENCODINGS[group // LENGTHS][2]
    places = np.array([1 + max(alphabet.find(c), alphabet.find(c.upper())) for c in _LETTERS])
    if not places.all():
        return None
    return np.sort(likeness_of(places[words[:, : LEAST + GROUP_WIDTH * (group % LENGTHS)]], len(alphabet)))


def _bin(p: Column) -> Column:
    """Bins of equal width from 1 / BINS on, below that by halves, which count from -1 down."""
    low = F.least(F.floor(F.log2(F.greatest(p * BINS, F.lit(2.0**-HALVES)))), F.lit(-1))
    return F.when(p * BINS >= 1, F.least(F.floor(p * BINS), F.lit(BINS - 1))).otherwise(F.greatest(low, F.lit(-HALVES))).cast("int")


def _edge(b: int) -> float:
    """The least value in bin ``b``."""
    return b / BINS if b > 0 else 2.0**b / BINS if b > -HALVES else 0.0


def _limit(tested: Counter, words: np.ndarray | None, rate: float) -> float:
    """The least likeness at which tokens are taken: words seldom enough look so random, and the tokens' own tests do not reject it."""
    bins, total = [b for b in range(-HALVES, BINS) if b], sum(tested.values())
    chosen, taken = 2.0 if words is not None else 0.0, 0
    for b in reversed(bins) if words is not None else ():
        taken += tested[b]
        above = len(words) - np.searchsorted(words, _edge(b))
        if taken and (above + 1) / (len(words) + 1) * total <= rate * taken:
            chosen = _edge(b)
    below = 0
    for b, after in zip(bins, [*bins[1:], BINS]):
        below += tested[b]
        if below and _edge(after) * total <= rate * below:
            chosen = max(chosen, _edge(after))
    return chosen


def thresholds(docs: DataFrame, rate: float = RATE) -> list[float]:
    """The least likeness of a token taken for a secret, for each group; above 1 where none is."""
    text = F.col("text")
    tokens = docs.where(text.rlike(TOKEN)).select(F.explode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("token"))
    binned = tokens.groupBy(_group(F.col("token")).alias("g"), _bin(likeness(F.col("token"))).alias("bin")).agg(F.count("*").alias("n"))
    tested = {}
    for row in binned.collect():  # GROUPS * (BINS + HALVES) rows at most
        tested.setdefault(row["g"], Counter())[row["bin"]] += row["n"]
    if not tested:
        return [2.0] * GROUPS
    words = drawn(letter_pairs(docs))
    return [_limit(tested[g], _null(words, g), rate) if g in tested else 2.0 for g in range(GROUPS)]


def random_spans(text: Column, limits: list[float], base: Column) -> Column:
    """Spans of tokens that pass for random and touch no base span."""
    tokens = _walk(text, TOKEN, 0, _TOKEN_SPAN, lambda start, match, value: F.array(F.struct(start.alias("start"), match.alias("token"))))
    limited = F.array(*[F.lit(float(x)) for x in limits])
    kept = F.filter(
        tokens,
        lambda t: (likeness(t["token"]) >= F.element_at(limited, _group(t["token"]) + 1))
        & ~F.exists(base, lambda b: (b["start"] < t["start"] + F.length(t["token"])) & (b["end"] > t["start"])),
    )
    spans = F.transform(kept, lambda t: F.struct(t["start"].alias("start"), F.lit(len(BASE)).alias("kind"), (t["start"] + F.length(t["token"])).alias("end")))
    return F.when(text.rlike(TOKEN), spans.cast(_SPAN)).otherwise(_none(_SPAN))


def with_secrets(docs: DataFrame, limits: list[float]) -> DataFrame:
    """``docs`` with secret_base and secret_spans: sorted arrays of (start, kind, end)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    based = docs.withColumn("secret_base", F.sort_array(base_spans(text)))
    return based.withColumn("secret_spans", F.sort_array(F.concat("secret_base", random_spans(text, limits, F.col("secret_base")))))


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret's span replaced in ``text``; ``n_chars`` follows where there is one and the text changed."""
    apart = set_apart(docs, "text", "n_chars")
    found = with_secrets(apart, thresholds(apart))

    def step(state: Column, s: Column) -> Column:
        new = s["start"] >= state["at"]
        more = F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.lit(REPLACEMENT))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(new, more).otherwise(state["out"]).alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length(F.col("text"))))
    clean = F.aggregate("secret_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    out = found.withColumn("text", F.when(F.size("secret_spans") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        count = F.when(F.size("secret_spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return out.select(apart.columns).toDF(*docs.columns)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_secrets(docs, thresholds(docs))
    count = lambda k: F.size(F.filter("secret_base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(_written(F.col("secret_base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("secret_spans")).alias("spans"),
    )
