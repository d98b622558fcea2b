"""Parameter text as web UIs embed it: prompt, negative prompt, ``Key: value`` list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixledger.functions.jsonvalues import map_cells
from pixledger.functions.loras import extract_loras
from pixledger.functions.text import RE_SPACE, RE_WORD, strip, strip_sql
from pixledger.operators.stages import compile_methods, finish
from pixledger.schemas import RECORD_TYPE, TOOL_A1111

# Fixed values. Text values run to a comma, a line end or the end of the text.
_NUMBER = r"(\d+)"
_DECIMAL = r"([\d.]+)"
_TEXT = r"([^,\n]+?)(?:,|\n|\z)"
# Output key -> label in the text and shape of its value.
PATTERNS = {
    "Steps": ("Steps", _NUMBER),
    "Sampler": ("Sampler", _TEXT),
    "CFG": ("CFG Scale", _DECIMAL),
    "Seed": ("Seed", _NUMBER),
    "Model": ("Model", _TEXT),
    "Scheduler": ("Scheduler", _TEXT),
    "model_hash": ("Model hash", rf"({RE_WORD}+)"),
    "clip_skip": ("Clip skip", _NUMBER),
    "hires_upscale": ("Hires upscale", _DECIMAL),
    "hires_steps": ("Hires steps", _NUMBER),
    "denoising_strength": ("Denoising strength", _DECIMAL),
    "Size": ("Size", r"(\d+x\d+)"),
    "vae": ("VAE", _TEXT),
    "ensd": ("ENSD", _NUMBER),
    "aesthetic_score": ("Aesthetic score", _DECIMAL),
}
NEGATIVE_MARKER = "Negative prompt:"
START_MARKERS = ["Steps:", "Size:", "Seed:", "Model:"]
END_MARKERS = ["Steps:", "Size:", "Seed:", "Model:", "Sampler:"]


def _found_sql(text: str, folded: str, ascii_only: str) -> str:
    """SQL for a struct of each label's first value, any case; NULL or empty where absent.

    A match always captures something, if only a blank. A plain substring test on
    the case-folded text spares most texts most patterns. In plain ASCII the folded
    text has the same places, so a pattern starts at its label's first mention.
    """
    cells = []
    for key, (label, shape) in PATTERNS.items():
        mention = f"'{label.lower()}:'"
        rest = f"substr({text}, IF({ascii_only}, locate({mention}, {folded}), 1))"
        pattern = rf"(?iU){label}:{RE_SPACE}*{shape}"
        cells.append(f"'{key}', CASE WHEN contains({folded}, {mention}) THEN regexp_extract({rest}, r'{pattern}', 1) END")
    return f"IF({folded} IS NOT NULL, named_struct({', '.join(cells)}), NULL)"


def _pairs_sql(found: str) -> str:
    """SQL for a map of all keys from a found struct: text values trimmed, the size split."""
    present = lambda key, value: f"IF({found}.{key} <> '', {value}, NULL)"
    pairs = {
        key: present(key, strip_sql(f"{found}.{key}") if shape == _TEXT else f"{found}.{key}")
        for key, (_, shape) in PATTERNS.items()
        if key != "Size"
    }
    # Found in any case, but split at a small x only.
    for key, part in (("Width", 1), ("Height", -1)):
        pairs[key] = f"IF(contains({found}.Size, 'x'), substring_index({found}.Size, 'x', {part}), NULL)"
    return f"IF({found} IS NOT NULL, map({map_cells(pairs)}), NULL)"


def _params_start(places: list[str]) -> Column:
    """Zero-based start of the earliest marker that is not at the very start."""
    return F.least(*[F.when(F.col(at) > 1, F.col(at)) for at in places]) - 1


def _cut_negative(negative: Column) -> Column:
    """Cut at the first marker in list order that occurs past the start."""
    cut = negative
    for marker in reversed(END_MARKERS):
        at = F.locate(marker, negative)
        cut = F.when(at > 1, strip(F.substr(negative, F.lit(1), at - 1))).otherwise(cut)
    return cut


def parse_a1111(df: DataFrame, text: str = "parameters", out: str = "a1111", settled: bool = True) -> DataFrame:
    """Add a record struct; NULL where the text is empty or holds no parameters.

    Staged columns keep each scan of the text single; all of it is row-local.
    """
    compile_methods()
    staged = df.withColumn("_body", F.nullif(F.col(text), F.lit("")))
    body = F.col("_body")
    marked = {f"_at_{marker[:-1]}": F.locate(marker, body) for marker in START_MARKERS}
    # Expressions that need a value more than once take it from a column: inside
    # one, ``nullif`` or a lambda would compute it again.
    staged = staged.withColumns(
        {
            "_pieces": F.split(body, f"(?iu){NEGATIVE_MARKER}", 2),
            "_folded": F.lower(F.upper(body)),
            "_ascii": F.octet_length(body) == F.char_length(body),
            **marked,
        }
    )
    staged = staged.withColumns(
        {"_start": _params_start(list(marked)), "_found": F.expr(_found_sql("_body", "_folded", "_ascii"))}
    )
    before = F.char_length(F.col("_pieces")[0])
    after = F.get(F.col("_pieces"), 1)
    # Length of the negative text up to the parameters, if those come later.
    room = F.when(F.col("_start") > before, F.col("_start") - before - len(NEGATIVE_MARKER))
    staged = staged.withColumns(
        {
            "_prompt": strip(
                F.when(after.isNotNull() | F.col("_start").isNull(), F.col("_pieces")[0])
                .otherwise(F.substr(body, F.lit(1), F.col("_start")))
            ),
            "_negative": strip(F.substr(after, F.lit(1), F.coalesce(room, F.char_length(after)))),
            "_pairs": F.expr(_pairs_sql("_found")),
        }
    )
    staged = staged.withColumns(
        {
            "_negative": F.coalesce(_cut_negative(F.col("_negative")), F.lit("")),
            "_params": F.when(F.col("_pairs").isNotNull(), F.map_filter("_pairs", lambda k, v: v.isNotNull())),
        }
    )
    staged = staged.withColumn("_searched", F.when(body.isNotNull(), F.concat_ws(" ", "_prompt", "_negative", "_body")))
    # Rows without a text have nothing to search.
    staged = staged.withColumn("_loras", F.when(F.col("_searched").isNotNull(), extract_loras(F.col("_searched"))))
    record = F.expr(
        f"""CAST(named_struct('tool', '{TOOL_A1111}', 'prompt', _prompt, 'negative_prompt', _negative,
            'params', _params, 'loras', _loras, 'models', NULL, 'date', NULL, 'generation_time', NULL)
            AS {RECORD_TYPE})"""
    )
    accepted = F.col("_pieces").isNotNull() & ((F.size("_params") > 0) | (F.size("_loras") > 0))
    temporary = (
        "_body", "_pieces", "_folded", "_ascii", *marked, "_start", "_found", "_prompt", "_negative",
        "_pairs", "_params", "_searched", "_loras",
    )
    return finish(staged.withColumn(out, F.when(accepted, record)), out, drop=temporary, settled=settled)
