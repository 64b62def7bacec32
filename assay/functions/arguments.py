"""Arguments of tool calls: key:value lists in which quotes, brackets and SQL may hold commas."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

#: Arguments that tools know; only these end a value of sql.
KNOWN = ("db_id", "sql", "sqls", "table", "columns", "column", "query", "limit", "where", "top_k", "timeout_s", "max_return_rows", "distinct", "case_sensitive")
_KEY = re.compile(r"\s*([A-Za-z_]\w*)\s*[:=]")
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_MARK = '<|"|>'


def split_arguments(text: str | None) -> dict[str, str]:
    """Arguments in order; a repeated key keeps its last value, text before the first key is dropped."""
    text = text or ""
    out: dict[str, str] = {}
    at = 0
    while (m := _KEY.match(text, at)) is not None:
        key, start = m.group(1), m.end()
        depth, quote, i = [], "", start
        while i < len(text):
            c = text[i]
            if text.startswith(_MARK, i):
                quote, i = ("" if quote == _MARK else _MARK if not quote else quote), i + len(_MARK)
                continue
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"`":
                quote = c
            elif c in _PAIRS:
                depth.append(_PAIRS[c])
            elif depth and c == depth[-1]:
                depth.pop()
            elif c == "," and not depth:
                follows = _KEY.match(text, i + 1)
                if follows and (key != "sql" or follows.group(1) in KNOWN):
                    break
            i += 1
        out[key] = text[start:i].strip()
        at = i + 1
        if i >= len(text):
            break
    return out


def scalar(text: str | None) -> object:
    """A value as written: true and false, null and none, marked or quoted text, JSON, whole number, number, else the text."""
    if text is None:
        return None
    text = text.strip()
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "none"):
        return None
    if text.startswith(_MARK) and text.endswith(_MARK) and len(text) >= 2 * len(_MARK):
        return text[len(_MARK) : -len(_MARK)]
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text[:1] in "[{":
        try:
            return json.loads(text)
        except ValueError:
            return [scalar(p) for p in text[1:-1].split(",")] if text[0] == "[" and text[-1] == "]" and text[1:-1].strip() else text
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


@F.pandas_udf(MapType(StringType(), StringType()))
def parsed(arguments: pd.Series) -> pd.Series:
    """Arguments as a map; values that are lists or objects as JSON, null as null."""

    def value(text: str) -> str | None:
        v = scalar(text)
        return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    return pd.Series([{k: value(v) for k, v in split_arguments(a).items()} for a in arguments])
