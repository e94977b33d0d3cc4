"""4. Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, schemes and identifier cues in English, German, French and Spanish.
Deterministic parsers expand each and validate what they find: an e-mail address to both sides of its at-sign; behind a scheme a host of
valid labels or an address, with port and path; behind a cue an IBAN (its length and checksum modulo 97), a social security number (its
ranges), an account number or a secret. What validates by itself needs no separator between cue and value. Numbers that need no cue (IP
addresses, cards, phones) have their own linear scanners.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .text import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
_RANK = {k: i for i, k in enumerate(KINDS)}
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:", "sip:", "www.")
NUMBERS = (
    "account", "acct", "iban", "routing", "ssn", "social security", "passport",
    "konto", "kontonummer", "kontonr", "blz", "sozialversicherungsnummer", "steuer-id", "reisepass",
    "compte", "sécurité sociale", "passeport",
    "cuenta", "seguridad social", "pasaporte", "dni", "nif",
)
SECRETS = (
    "token", "password", "passwd", "pwd", "secret", "api_key", "api-key", "api key", "apikey", "access_key", "access key",
    "passwort", "kennwort", "mot de passe", "contraseña", "clave",
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HOST = r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z][A-Za-z0-9-]{1,62}"
_TAIL = r"(?::[0-9]{1,5})?(?:[/?#](?:[A-Za-z0-9.+%_~:/?#@!$&'()*,;=\[\]-]*[A-Za-z0-9/_=&%#-])?)?"
_URL = re.compile(rf"(?:[A-Za-z0-9._%+~-]+(?::[^\s/@]*)?@)?(?:{_HOST}|localhost\b|[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?![0-9])|\[[0-9A-Fa-f:.]+\]){_TAIL}")
_WWW = re.compile(_HOST + _TAIL)
_MAILTO = re.compile(rf"[A-Za-z0-9._%+-]+@{_HOST}")
_TEL = re.compile(r"\+?[0-9](?:[ ().-]?[0-9]){4,14}(?![0-9])")
_SIP = re.compile(rf"[A-Za-z0-9._%+-]+@(?:{_HOST}|[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}})(?::[0-9]{{1,5}})?")
_EXPAND = {"mailto:": _MAILTO, "tel:": _TEL, "sip:": _SIP, "www.": _WWW}
_AFTER = re.compile(r"(?:[ _-]?(?:numbers?|nummer|numéro|número|numero|num|no|nr|n°|id|key|code|secret|bancaria|bancaire|courant|de)(?![A-Za-z0-9]))*+\.?[\"']?[ \t]{0,3}([:=#]|(?:is|are|ist|lautet|est|es)\b)?[ \t]{0,3}[\"']?", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}+", re.I)
_SSN = re.compile(r"([0-9]{3})[- ]([0-9]{2})[- ]([0-9]{4})(?![0-9])")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9]){5,17}+(?![0-9A-Za-z])")
_CODE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_+/.-]{5,}+")
_SECRET = re.compile(r"[A-Za-z0-9$!#%&*+/=?^_~-][^\s\"',;<>]{5,}+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_automaton = None


def anchors():
    """The automaton of a Python worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, kind in [("@", "email"), *((s, "address") for s in SCHEMES), *((c, "number") for c in NUMBERS), *((c, "secret") for c in SECRETS)]:
            a.add_word(word, (kind, len(word)))
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str, at: int) -> int:
    """The end of a valid IBAN that begins at ``at``, the longest; 0 without."""
    m = _IBAN.match(text, at)
    end = m.end() if m else 0
    while end - at >= 15:
        code = text[at:end].replace(" ", "").replace("-", "").upper()
        if 15 <= len(code) <= 34 and text[end - 1].isalnum() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return end
        end -= 1
    return 0


def number_after(text: str, at: int) -> tuple[int, int] | None:
    """The account number, IBAN, social security number or the like behind a cue that ends at ``at``."""
    m = _AFTER.match(text, at)
    start = m.end()
    if start == at:
        return None
    if end := iban(text, start):
        return start, end
    if x := _SSN.match(text, start):
        return x.span() if x[1] not in ("000", "666") and x[1] < "900" and x[2] != "00" and x[3] != "0000" else None
    if x := _DIGITS.match(text, start):
        return x.span()
    if m[1] and (x := _CODE.match(text, start)):
        value = x[0].rstrip(".-/")
        if len(value) >= 6 and sum(c.isdigit() for c in value) >= 4:
            return start, start + len(value)
    return None


def secret_after(text: str, at: int) -> tuple[int, int] | None:
    """The secret behind a cue that ends at ``at`` and a separator: six characters or more with a digit, not all of them one number in words."""
    m = _AFTER.match(text, at)
    if m[1] and (x := _SECRET.match(text, m.end())):
        value = x[0].rstrip(".-/)]}!?:")
        if len(value) >= 6 and _DIGIT.search(value) and (m[1] in ":=#" or len(value) >= 8):
            return x.start(), x.start() + len(value)
    return None


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind. Base kinds are leftmost and don't overlap within a kind.

    A span of an added kind (address, account) is dropped where it overlaps one of the same kind that begins before it. Of two spans
    with one start, the kind that KINDS lists first comes first.
    """
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_ASCII_LOWER)
    ends = dict.fromkeys((*KINDS, "number", "secret"), 0)
    for at, (kind, n) in anchors().iter(low):
        if kind == "email":
            start = at
            while start > ends[kind] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append((kind, start, m.end()))
                ends[kind] = m.end()
        elif at + 1 - n >= ends[kind]:
            before = at - n
            if before >= 0 and text[before].isalnum():
                continue  # within a longer word
            if kind == "address":
                scheme = low[at + 1 - n : at + 1]
                if m := _EXPAND.get(scheme, _URL).match(text, at + 1):
                    out.append((kind, at + 1 - n, m.end()))
                    ends[kind] = m.end()
            elif at + 1 == len(text) or not text[at + 1].isalnum():
                if (span := (number_after if kind == "number" else secret_after)(text, at + 1)) and span[0] >= ends["account"]:
                    out.append(("account", *span))
                    ends["account"] = span[1]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", m.start(), m.end()))
    out.sort(key=lambda s: (s[1], _RANK[s[0]]))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def find_personal(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """Spans of each whole text as kind, start and end (code points); a null or empty text has none. No shuffle.

    Texts of any length are read whole, in time that grows with their length; repeated rows are searched each, and other columns of
    ``df`` are not looked at.
    """
    return _mapped(df, column, key, False)


def _mapped(df: DataFrame, column: str, key: str, digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                spans = [find(x or "") for x in part.column(column).to_pylist()]
                keys = part.column(key).cast(pa.int64())
                if digest:
                    counts = [pa.array([sum(s[0] == k for s in x) for x in spans], pa.int64()) for k in BASE]
                    base = [hashlib.sha256(written([s for s in x if s[0] in BASE]).encode()).hexdigest() for x in spans]
                    yield pa.RecordBatch.from_arrays([keys, *counts, pa.array(base, pa.string()), pa.array(map(written, spans), pa.string()), pa.array([len(x) for x in spans], pa.int64())], [key, *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])
                else:
                    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x] for x in spans], kind)], [key, "spans"])

    schema = f"{key} long, " + ("".join(f"n_{k} long, " for k in BASE) + "base_sha256 string, spans string, n_spans long" if digest else "spans array<struct<kind string, start int, end int>>")
    return df.select(key, column).mapInArrow(run, schema)


def mask_personal(df: DataFrame, column: str = "text") -> DataFrame:
    """The same rows and columns with personal data in ``column`` masked; null stays null. No shuffle."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                i = part.schema.get_field_index(column)
                texts = [None if x is None else masked(x, find(x)) for x in part.column(i).to_pylist()]
                yield part.set_column(i, part.schema.field(i), pa.array(texts, part.schema.field(i).type))

    return df.mapInArrow(run, schema)


def op4_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "doc_id", True)
