"""Text functions as column expressions. Undefined metrics are null; nothing here leaves the JVM but what says so."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import buffers, parts


_SPACE = r"(?U)\s+"
CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]"
PLACEHOLDER = "{text}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 texts: the first character of each word within its line, the words before each line, the lines before each text."""
    n, seps = len(offsets) - 1, np.flatnonzero((data == 32) | (data == 10))
    before = np.searchsorted(seps, offsets)
    first = before[:-1] + np.arange(n)  # a text has a word more than it has separators
    at, fresh = np.zeros(len(seps) + n, np.int64), np.zeros(len(seps) + n, bool)
    rest = np.arange(len(seps)) + np.repeat(np.arange(1, n + 1), np.diff(before))
    at[first], fresh[first], at[rest], fresh[rest] = offsets[:-1], True, seps + 1, data[seps] == 10
    if data.size and data.max() > 127:
        at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at]
    lines = np.flatnonzero(fresh)
    return at - np.repeat(at[lines], np.diff(np.append(lines, len(at)))), lines, np.searchsorted(lines, first)


def starts_of(texts: pa.Array) -> pa.Array:
    """For each line of a text the place of each word that one blank ends, empty ones too: as split by newlines and then by blanks."""
    words, lines, docs, n_words, n_lines = [], [], [], 0, 0
    for a, b in parts(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 1_000_000):
        w, ln, d = _starts(*buffers(texts.slice(a, b - a)))
        words.append(w.astype(np.int32)), lines.append((ln + n_words).astype(np.int32)), docs.append((d + n_lines).astype(np.int32))
        n_words, n_lines = n_words + len(w), n_lines + len(ln)
    whole = lambda x, last: pa.array(np.concatenate([*x, [last]]).astype(np.int32))
    of_lines = pa.ListArray.from_arrays(whole(lines, n_words), pa.array(np.concatenate(words) if words else np.zeros(0, np.int32)))
    return pa.ListArray.from_arrays(whole(docs, n_lines), of_lines)


def word_starts(text: Column) -> Column:
    """:func:`starts_of` as a column, in Arrow batches."""
    return F.arrow_udf(starts_of, "array<array<int>>")(text)


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null as empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), _SPACE, " "), "^ | $", "")


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x00-\x7F]", "")


def cut_at_word(c: Column, n: int) -> Column:
    """At most n characters, without the word that the cut would break."""
    return F.when(F.length(c) <= n, c).otherwise(F.regexp_replace(F.substring(c, 1, n), r" [^ ]*$", ""))


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), _SPACE), lambda x: x != "")


def is_cjk(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(CJK)


def normalized(texts: pa.Array, form: str) -> pa.Array:
    """NFC or NFKC of texts, about a megabyte at a time; null stays null."""
    out = [pa.array([], texts.type)]
    for a, b in parts(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 1_000_000):
        out.append(pa.array([None if x is None else unicodedata.normalize(form, x) for x in texts.slice(a, b - a).to_pylist()], texts.type))
    return pa.concat_arrays(out)


def normalize(form: str):
    """NFC or NFKC in Arrow batches; ASCII values stay in the JVM as they are."""

    def run(texts: pa.Array) -> pa.Array:
        return normalized(texts, form)

    def column(c: Column) -> Column:
        abroad = c.rlike(r"[^\x00-\x7F]")
        return F.coalesce(F.arrow_udf(run, "string")(F.when(abroad, c)), c)

    return column


def edit_distance(a: Column, b: Column) -> Column:
    """The exact edit distance. Bounds that grow are tried first, as a distance within one costs the length times the bound."""
    within = [F.filter(F.array(F.levenshtein(a, b, k)), lambda d: d >= 0) for k in (8, 64)]
    return F.coalesce(*(F.get(w, F.lit(0)) for w in within), F.levenshtein(a, b))


def distance_rate(expected: Column, predicted: Column, distance: Column | None = None) -> Column:
    """Edit distance over the longer length; 0 for two empty texts, 1 where only the expected one is empty.

    ``distance`` is their edit distance where a plan has it as a column already, so that it is computed once.
    """
    distance = F.levenshtein(expected, predicted) if distance is None else distance
    longest = F.greatest(F.length(expected), F.length(predicted))
    return F.when(longest == 0, 0.0).when(expected == predicted, 0.0).when(F.length(expected) == 0, 1.0).otherwise(distance / longest)


def anls(expected: Column, predicted: Column, threshold: float = 0.5, distance: Column | None = None) -> Column:
    """1 - normalized distance where that distance is below the threshold, else 0."""
    a, b = F.length(expected), F.length(predicted)
    distance = F.levenshtein(expected, predicted) if distance is None else distance
    near = F.filter(F.array(distance / F.greatest(a, b, F.lit(1))), lambda nl: nl < threshold)  # the distance is written once
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(F.coalesce(1 - F.get(near, F.lit(0)), F.lit(0.0)))


def _coded(ws: Column, vocabulary: Column) -> Column:
    """A character for each word, by its place in the vocabulary."""
    return F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.lit(65535) + F.array_position(vocabulary, w)), 8, "0")), "UTF-32")), "")


def word_error_rate(expected: Column, predicted: Column) -> Column:
    """Word edit distance over the larger number of words."""

    def rate(s: Column) -> Column:
        e, p = s["e"], s["p"]
        longest = F.greatest(F.size(e), F.size(p))
        codes = lambda v: F.struct(_coded(e, v).alias("e"), _coded(p, v).alias("p"))
        distance = let(let(F.array_distinct(F.concat(e, p)), codes), lambda c: edit_distance(c["e"], c["p"]))
        return F.when(longest == 0, 0.0).when(F.size(e) == 0, 1.0).when(e == p, 0.0).otherwise(distance / F.greatest(longest, F.lit(1)))

    return let(F.struct(words(expected).alias("e"), words(predicted).alias("p")), rate)


def reading_metrics(expected: Column, predicted: Column, threshold: float = 0.5) -> Column:
    """Exact match, ANLS, CER and WER of squeezed texts; WER is null between CJK texts without blanks."""

    def metrics(s: Column) -> Column:
        e, p = s["e"], s["p"]
        unsegmented = is_cjk(e) & is_cjk(p) & ~e.contains(" ") & ~p.contains(" ")
        rates = lambda d: F.struct(
            (e == p).cast("double").alias("exact_match"),
            anls(e, p, threshold, d).alias("anls"),
            distance_rate(e, p, d).alias("cer"),
            F.when(~unsegmented, word_error_rate(e, p)).alias("wer"),
        )
        return let(F.when(e == p, 0).otherwise(edit_distance(e, p)), rates)

    return let(F.struct(squeeze(expected).alias("e"), squeeze(predicted).alias("p")), metrics)


def has_placeholder(c: Column) -> Column:
    return F.coalesce(c.contains(PLACEHOLDER), F.lit(False))


def strip_html(c: Column) -> Column:
    """Text of markup: no scripts, styles or comments, blanks for tags, the common entities resolved."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return squeeze(x)


def looks_html(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?i)</?(html|body|div|p|span|table|tr|td|th|ul|ol|li|br|h[1-6]|a|img|script|style)\b[^>]*>")


def looks_markdown(c: Column) -> Column:
    """Two kinds of Markdown signs or more."""
    x = F.coalesce(c, F.lit(""))
    signs = [r"(?m)^#{1,6} ", r"(?m)^\s*[-*+] \S", r"(?m)^\s*[0-9]+\. ", r"\*\*[^*\n]+\*\*", r"\[[^\]\n]+\]\([^)\n]+\)", r"(?m)^\|.*\|$", r"```"]
    return sum((x.rlike(s).cast("int") for s in signs[1:]), x.rlike(signs[0]).cast("int")) >= 2


TOKEN = r"\p{L}+(?:['\u2019-]\p{L}+)*|\p{N}+(?:[.,]\p{N}+)*"


def tokens(c: Column) -> Column:
    """Lower-case words and numbers of any script: letters with apostrophes and hyphens between, digits with points and commas between."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def predicted_text(c: Column) -> Column:
    """The answer in a model's output: a text field of JSON, of a list's first object, or of a fenced block, else the output."""
    body = F.trim(F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), c))
    v = F.try_parse_json(body)
    keys = ("text", "answer", "value", "prediction", "content")
    found = [F.when(F.schema_of_variant(F.try_variant_get(v, p + k, "variant")) == "STRING", F.try_variant_get(v, p + k, "string")) for k in keys for p in ("$.", "$[0].")]
    return F.coalesce(*found, c)


def rouge_l(expected: Column, predicted: Column) -> Column:
    """Recall, precision and F of the longest common word sequence, in Arrow batches."""

    @F.pandas_udf("recall double, precision double, f double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a.fillna("").str.split(), b.fillna("").str.split()):
            row = [0] * (len(y) + 1)
            for w in x:
                left = 0
                for j, u in enumerate(y, 1):
                    left, row[j] = row[j], left + 1 if w == u else max(row[j], row[j - 1])
            n = row[-1]
            r, p = n / len(x) if x else 0.0, n / len(y) if y else 0.0
            out.append((r, p, 2 * r * p / (r + p) if n else 0.0))
        return pd.DataFrame(out, columns=["recall", "precision", "f"])

    return run(expected, predicted)


def page_name(index: Column, last: Column) -> Column:
    """A page number padded to the width of the document's last, four digits at least."""
    return F.lpad(index.cast("string"), F.greatest(F.lit(4), F.length(last.cast("string"))), "0")
