"""What models write: JSON that needs repair, keys under many names, markup, coordinates in prompts.

Strict JSON stays in the JVM (see ``text.predicted_text`` and ``geometry``); these need recursion or callbacks and run in Arrow batches.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:json)?\s*(.*?)(?:```|\Z)", re.S)
_TEXT_KEYS = ("text", "value", "content", "answer", "output")


def repaired(raw: str | None):
    """The value of JSON, or of JSON within a fence, cut short, with single quotes or with commas before closing brackets; else None."""
    if raw is None:
        return None
    m = _FENCE.search(raw)
    for body in ([m[1]] if m else []) + [raw]:
        body = body.strip()
        for attempt in (lambda b: b, _closed, lambda b: _closed(b.replace("'", '"'))):
            try:
                return json.loads(attempt(body))
            except (ValueError, RecursionError):
                continue
    return None


def _closed(body: str) -> str:
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        raise ValueError
    out, stack, inside, skip = [], [], False, False
    for c in body[start:]:
        out.append(c)
        if inside:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if stack and stack[-1] == c:
                stack.pop()
            else:
                out.pop()
            if not stack:
                break
    text = "".join(out) + ('"' if inside else "")
    text = re.sub(r"[,:\s]+$", "", text) + "".join(reversed(stack))
    return re.sub(r",\s*([}\]])", r"\1", text)


def normalized_keys(value):
    """Keys with text or label in them as text, with box as bbox; a list of lists of four numbers as objects with a bbox."""
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            low = str(k).lower()
            out["bbox" if "box" in low else "text" if "text" in low or "label" in low else k] = normalized_keys(v) if isinstance(v, (dict, list)) and "box" not in low else v
        return out
    if isinstance(value, list):
        if value and all(isinstance(x, list) and len(x) == 4 and all(isinstance(n, (int, float)) for n in x) for x in value):
            return [{"bbox": x} for x in value]
        return [normalized_keys(x) for x in value]
    return value


def harvested(value) -> list[str]:
    """Texts below the usual keys, however deep."""
    if isinstance(value, dict):
        return [t for k, v in value.items() for t in ([v] if k in _TEXT_KEYS and isinstance(v, str) else harvested(v))]
    if isinstance(value, list):
        return [t for v in value for t in harvested(v)]
    return []


def plain_markdown(text: str) -> str:
    t = re.sub(r"```[^\n]*\n(.*?)```", r"\1", text, flags=re.S)
    t = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", t)
    t = re.sub(r"(?m)^\s{0,3}(?:#{1,6}\s+|>\s?|[-*+]\s+|[0-9]+\.\s+)", "", t)
    t = re.sub(r"(?m)^\s*\|?[\s:|-]*-{3,}[\s:|-]*$", "", t).replace("|", " ")
    return re.sub(r"(\*\*|__|\*|`|~~)(.+?)\1", r"\2", t)


def _udf(kind: str, fn):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn)

    return run


def repair_json(c: Column) -> Column:
    """Repaired and normalized JSON as strict JSON text; null where nothing can be read."""
    def fn(x):
        v = repaired(x)
        return None if v is None else json.dumps(normalized_keys(v), ensure_ascii=False)

    return _udf("string", fn)(c)


def harvest_text(c: Column) -> Column:
    """Texts in JSON-like output joined by blanks; the output itself where there are none."""
    def fn(x):
        return x if x is None else " ".join(harvested(repaired(x))) or x

    return _udf("string", fn)(c)


def strip_markdown(c: Column) -> Column:
    return _udf("string", lambda x: x if x is None else " ".join(plain_markdown(x).split()))(c)


def composed(c: Column) -> Column:
    return _udf("string", lambda x: x if x is None else unicodedata.normalize("NFC", x))(c)


_NUMBERS = re.compile(r"\[\s*(-?\d+)\s*,\s*(-?\d+)\s*(?:,\s*(-?\d+)\s*,\s*(-?\d+)\s*)?\]")


def rescaled_prompt(prompt: Column, width: Column, height: Column) -> Column:
    """[x, y] and [x1, y1, x2, y2] of a grid of 1000 as pixels, clamped to the grid first."""

    @F.pandas_udf("string")
    def run(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        def one(text, width_, height_):
            if text is None:
                return None
            sizes = (width_, height_, width_, height_)
            return _NUMBERS.sub(lambda m: "[" + ", ".join(str(int(min(1000, max(0, int(n))) * s / 1000)) for n, s in zip(m.groups(), sizes) if n is not None) + "]", text)

        return pd.Series([one(*x) for x in zip(p, w, h)], dtype="object")

    return run(prompt, width, height)


def laplacian_variance(pixels: Column) -> Column:
    """Variance of the four-neighbour Laplacian of a gray image, an array of rows."""
    import numpy as np

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        def one(rows):
            a = np.array([np.asarray(r, float) for r in rows]) if rows is not None and len(rows) else np.zeros((0, 0))
            if a.ndim != 2 or min(a.shape) < 3:
                return 0.0
            return float((a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1]).var())

        return s.map(one)

    return run(pixels)
