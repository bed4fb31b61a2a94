"""JSON objects in the text that a model gave."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: what a model puts around an object ----
THINKING = r"(?is)<think>.*?</think>"
FENCED = re.compile(r"```(?:json|json5|hjson)?\s*(.*?)\s*```", re.IGNORECASE | re.DOTALL)
# ---- end of fixed values ----
_MARKS = re.compile(r'[{}"]|\\.', re.DOTALL)


def first_object(text: str) -> str | None:
    """The text from the first brace to the one that closes it; braces inside strings do not count."""
    begin, depth, quoted = text.find("{"), 0, False
    if begin < 0:
        return None
    for m in _MARKS.finditer(text, begin):
        mark = m.group()
        if mark == '"':
            quoted = not quoted
        elif not quoted and mark in "{}":
            depth += 1 if mark == "{" else -1
            if depth == 0:
                return text[begin : m.end()]
    return None


def _is_object(text: str | None) -> bool:
    try:
        return text is not None and isinstance(json.loads(text), dict)
    except ValueError:
        return False


def _found(text: str) -> str | None:
    """The first object of a fenced block, else the text's first one."""
    for block in [m.group(1) for m in FENCED.finditer(text)] + [text]:
        held = first_object(block)
        if _is_object(held):
            return held
    return None


def json_object(text: Column) -> Column:
    """The JSON object that a model's answer holds, as a string: the answer itself, else the first object of a fenced
    block, else the first balanced one; null where there is none. Thoughts in think tags are left out before. Only
    answers that are no object themselves are searched in Python."""

    @F.pandas_udf("string")
    def searched(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _found(t))

    bare = F.trim(F.regexp_replace(text, THINKING, ""))
    whole = F.startswith(bare, F.lit("{")) & F.try_parse_json(bare).isNotNull()
    return F.when(whole, bare).otherwise(searched(F.when(~F.coalesce(whole, F.lit(False)) & F.contains(bare, F.lit("{")), bare)))
