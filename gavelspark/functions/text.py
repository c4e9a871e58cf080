"""Verdicts and other payloads in model text: Column -> Column, native expressions wherever they can be.

A null text gives null (or the empty array for score lists) unless a docstring says otherwise.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ABCDEFGH"
BOX = r"\boxed{"
#: Dot matches all but a line feed, as in the model texts' own conventions.
_BOXED = r"(?d)\\boxed\{(.*?)\}"
_SCORES = r"^\s*\[\s*(?:[+-]?(?:0|[1-9][0-9]*)\s*(?:,\s*[+-]?(?:0|[1-9][0-9]*)\s*)*,?\s*)?\]\s*$"


def strip(c: Column) -> Column:
    """Without white space (any of Unicode) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def boxed_text(c: Column) -> Column:
    """Payload of the first box; null if there is none; may be empty."""
    return F.when(F.regexp_like(c, F.lit(_BOXED)), F.regexp_extract(c, _BOXED, 1))


def boxed_text_eval(c: Column) -> Column:
    """As ``boxed_text``; of a payload with ``[[`` the part up to the next ``]]``."""
    inner = boxed_text(c)
    after = F.get(F.split(inner, r"\[\["), F.lit(1))
    return F.when(F.contains(inner, F.lit("[[")), F.get(F.split(after, r"\]\]"), F.lit(0))).otherwise(inner)


def boxed_scores(c: Column) -> Column:
    """Payload of the first box as array<int>; empty if it is not a list of whole numbers in decimal digits.

    A sign and a trailing comma are allowed. ``boxed_scores_literal`` takes every Python literal.
    """
    inner = boxed_text(c)
    parts = F.filter(F.transform(F.split(F.regexp_replace(inner, r"[\[\]\s+]", ""), ","), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return F.when(F.coalesce(F.regexp_like(inner, F.lit(_SCORES)), F.lit(False)), parts).otherwise(F.array().cast("array<int>"))


def _literal(inner: str | None) -> list[int]:
    try:
        found = ast.literal_eval(inner)
        return [int(x) for x in found] if isinstance(found, list) and all(isinstance(x, int) for x in found) else []
    except Exception:
        return []


def boxed_scores_literal(c: Column) -> Column:
    """``boxed_scores`` with the full literal grammar (hexadecimal, underscores, truth values), in Python over Arrow batches."""

    @F.pandas_udf("array<bigint>")
    def parse(inner: pd.Series) -> pd.Series:
        return inner.map(_literal)

    return parse(boxed_text(c))


def post_think(c: Column) -> Column:
    """Text after the last closing think tag, stripped."""
    return strip(F.element_at(F.split(c, "</think>"), -1))


def strip_html(c: Column) -> Column:
    """Without tags, stripped; null becomes the empty text."""
    return F.coalesce(strip(F.regexp_replace(c, r"<[^>]+>", "")), F.lit(""))


def extract_code(c: Column) -> Column:
    """The last fenced Python block outside closed think blocks, else the last fenced block, else the text."""
    rest = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    python = F.try_element_at(F.regexp_extract_all(rest, F.lit(r"(?s)```python\n(.*?)```"), 1), F.lit(-1))
    plain = F.try_element_at(F.regexp_extract_all(rest, F.lit(r"(?s)```\n?(.*?)```"), 1), F.lit(-1))
    return strip(F.coalesce(python, plain, rest))


def top_index(scores: Column, n: Column) -> Column:
    """0-based place of the only maximum of exactly ``n`` scores, else null."""
    top = F.array_max(scores)
    fits = (F.size(scores) == n) & (F.size(F.filter(scores, lambda x: x == top)) == 1)
    return F.when(fits, F.array_position(scores, top).cast("int") - 1)


def letter(i: Column, letters: str = LETTERS) -> Column:
    return F.substring(F.lit(letters), i + 1, F.lit(1))


def list_verdict(c: Column, n: Column, scoring: bool = False) -> Column:
    """Index of the chosen one of ``n`` candidates, or null."""
    payload = post_think(c)
    if scoring:
        return top_index(boxed_scores(payload), n)
    said = boxed_text(payload)
    at = _letter_place(said)
    return F.when(at < n, at)


def _letter_place(said: Column) -> Column:
    return F.when(F.regexp_like(said, F.lit("^[A-H]\\z")), F.ascii(said) - 65)


def pair_verdict(c: Column, scoring: bool = False) -> Column:
    """A, B or null."""
    payload = post_think(c)
    if scoring:
        s = boxed_scores(payload)
        a, b = F.get(s, F.lit(0)), F.get(s, F.lit(1))
        return F.when((F.size(s) == 2) & (a > b), "A").when((F.size(s) == 2) & (a < b), "B")
    said = boxed_text(payload)
    return F.when(said.isin("A", "B"), said)


def interpret_pair(c: Column, i: Column, j: Column) -> Column:
    """A is ``i``, B is ``j``, after stripping and upper-casing; else null."""
    said = F.upper(strip(c))
    return F.when(said == "A", i).when(said == "B", j)


def normalize_output(c: Column) -> Column:
    """Stripped, every line without white space at its end."""
    lines = F.regexp_replace(strip(c), r"\r\n?|[\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", "\n")
    return strip(F.regexp_replace(lines, r"(?U)[^\S\n]+(?=\n|\z)", ""))


def _same_json(a: str | None, b: str | None) -> bool:
    try:
        return json.loads(a) == json.loads(b)
    except Exception:
        return False


def outputs_match(actual: Column, expected: Column) -> Column:
    """Equal when normalised, or equal as JSON values; otherwise false, also for null. Python compares only what differs as text."""

    @F.pandas_udf("boolean")
    def as_json(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_same_json(x, y) for x, y in zip(a, b)], dtype="bool")

    a, b = normalize_output(actual), normalize_output(expected)
    looks = F.lit(r"^[\[{\"0-9tfnNI-]")
    both = F.regexp_like(a, looks) & F.regexp_like(b, looks)
    return F.coalesce((a == b) | (both & as_json(F.when(a != b, a), F.when(a != b, b))), F.lit(False))


def outputs_match_native(actual: Column, expected: Column) -> Column:
    """``outputs_match`` with JSON compared in canonical form by the engine: without Python, true and 1 differ."""
    a, b = normalize_output(actual), normalize_output(expected)
    canonical = lambda c: F.to_json(F.try_parse_json(c))
    return F.coalesce((a == b) | (canonical(a) == canonical(b)), F.lit(False))


def functional_harness(code: Column, name: Column, raw_input: Column) -> Column:
    """Source of a driver that calls method ``name`` of the code's class with one literal argument per input line."""

    @F.pandas_udf("string")
    def build(codes: pd.Series, names: pd.Series, inputs: pd.Series) -> pd.Series:
        out = []
        for source, method, lines in zip(codes, names, inputs):
            try:
                given = [ast.literal_eval(x.strip()) for x in lines.splitlines() if x.strip()]
            except Exception:
                given = []
            parts = ["import json", "import sys", source or "", f"given = {json.dumps(given)}", f"result = getattr(Solution(), {json.dumps(method)})(*given)", "print(json.dumps(result))", ""]
            out.append("\n".join(parts))
        return pd.Series(out)

    return build(code, name, raw_input)


def truncate_at_boxed(c: Column) -> Column:
    """The text up to and with the first box opener; null without one."""
    at = F.instr(c, BOX)
    return F.when(at > 0, F.substring(c, F.lit(1), at + len(BOX) - 1))


def model_short_name(c: Column) -> Column:
    """Last part of a path, in lower case."""
    return F.lower(F.substring_index(c, "/", -1))
