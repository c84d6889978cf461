"""Audit columns: JSON objects with their secrets taken out and their long parts summarised."""

from __future__ import annotations

import hashlib
import json as jsonlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import model
from lodestone.functions.text import WHITE_SPACE

_BLANKS = re.compile(r"[\s\x1c-\x1f]+")


class _Raw(str):
    """A JSON number as it was written."""


def _summary(text: str, max_chars: int) -> str:
    flat = _BLANKS.sub(" ", text).strip(WHITE_SPACE)
    if len(flat) <= max_chars:
        return flat
    return f"{flat[:max_chars]}...<len={len(flat)} sha256={hashlib.sha256(flat.encode()).hexdigest()[:12]}>"


def _shown(value, depth: int | None, max_items: int | None, max_chars: int) -> str:
    """JSON text of a value: secret keys redacted on every level, long strings summarised, long containers cut."""
    def inner(part) -> str:
        return _shown(part, None if depth is None else depth - 1, max_items, max_chars)

    if isinstance(value, _Raw):
        return str(value)
    if isinstance(value, str):
        return jsonlib.dumps(_summary(value, max_chars), ensure_ascii=False)
    if depth is not None and depth < 0 and isinstance(value, dict | list):
        return jsonlib.dumps(_summary(_shown(value, None, None, max_chars), max_chars), ensure_ascii=False)
    if isinstance(value, dict):
        parts = []
        for key, part in list(value.items())[:max_items]:
            secret = any(word in key.lower() for word in model.SECRET_KEY_WORDS)
            parts.append(f"{jsonlib.dumps(key, ensure_ascii=False)}:" + ('"<redacted>"' if secret else inner(part)))
        if max_items is not None and len(value) > max_items:
            parts.append(f'"_truncated_keys":{len(value) - max_items}')
        return "{" + ",".join(parts) + "}"
    if isinstance(value, list):
        parts = [inner(part) for part in value[:max_items]]
        if max_items is not None and len(value) > max_items:
            parts.append(f'"<truncated_items={len(value) - max_items}>"')
        return "[" + ",".join(parts) + "]"
    return jsonlib.dumps(value)


def redact_map(json: Column, depth: int | None = None, max_chars: int = 200, max_items: int | None = None) -> Column:
    """A JSON object as it may be logged: secret keys redacted on every level, long strings summarised.

    ``depth`` levels below the top are shown as JSON; what lies deeper becomes the summary of its redacted text.
    ``max_items`` cuts objects and lists and says by how much.  Neither is limited by default.  Text that is no JSON
    object gives null.  A container can be nested as deep as it likes, so this is an Arrow function, not a column tree.
    """
    def redact(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                value = jsonlib.loads(text, parse_int=_Raw, parse_float=_Raw, parse_constant=_Raw) if text is not None else None
                return _shown(value, depth, max_items, max_chars) if isinstance(value, dict) else None
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return F.pandas_udf(redact, "string")(json)
