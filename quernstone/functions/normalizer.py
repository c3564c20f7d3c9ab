"""Undoing evasive encodings: one Arrow batch function over the texts that need it.

Order: cut, NFKC, invisible characters, look-alike letters, spaced-out letters,
nested encodings (up to three rounds), invisible characters again, leet.  Steps
that native columns can express exist there as well (``functions.text``); a text
that no step could change never leaves the JVM (:func:`may_change`).
"""

from __future__ import annotations

import base64
import binascii
import codecs
import math
import re
import unicodedata
import urllib.parse
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quernstone.functions.text import URL_KEYWORDS as URL_WORDS
from quernstone.functions.text import ZERO_WIDTH, b64_decode, hex_decode

# Fixed values.
MAX_INPUT, MAX_DECODED, MAX_GROWTH, ROUNDS = 500_000, 100_000, 10, 3
LOOKALIKES = {
    **dict(zip("аеорсухієїАВЕКМНОРСТХ", "aeopcyxieiABEKMHOPCTX")),
    **dict(zip("αεορςσυχικνΑΕΟΡΣΧΚΜΝΤ", "aeopssyxikvAEOPSXKMNT")),
    **dict(zip("ӏкн", "bkh")),
}
LEET = dict(zip("01345678@$!", "oieasgtbasi"))
LEET_WORDS = ("ignore", "instruction", "system", "jailbreak", "prompt", "previous", "disregard", "bypass", "dan", "roleplay", "unrestricted")
ROT13_WORDS = LEET_WORDS[:9]
ROT13_LOWER, ROT13_OF = "abcdefghijklmnopqrstuvwxyz", "nopqrstuvwxyzabcdefghijklm"
# Patterns of encoded runs.
_INVISIBLE = re.compile(f"[{ZERO_WIDTH}]")
_RUN = re.compile(r"\b(?:\w\s+){3,}\w\b")
_SINGLE = re.compile(r"\b\w\b")
_B64 = re.compile(r"[A-Za-z0-9+/]{8,}={0,2}")
_HEX = re.compile(r"\b(?:[0-9a-fA-F]{2}){6,}\b")
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2}){4,}")
_LEET_TOKEN = re.compile(r"[A-Za-z0-9@$!]+")
_WORD = re.compile(r"\w+")
_LOOK, _LEET_MAP = str.maketrans(LOOKALIKES), str.maketrans(LEET)


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _script(word: str) -> tuple[bool, bool, bool]:
    names = [unicodedata.name(c, "") for c in word if ord(c) > 127]
    latin = any(c.isascii() and c.isalpha() for c in word) or any("LATIN" in n for n in names)
    return latin, any("CYRILLIC" in n for n in names), any("GREEK" in n for n in names)


def fold_lookalikes(text: str) -> str:
    """Words of Latin or Greek letters, alone or mixed, take Latin letters; purely Cyrillic words stay."""

    def word(m: re.Match) -> str:
        w = m.group()
        if w.isascii():
            return w
        latin, cyrillic, greek = _script(w)
        return w.translate(_LOOK) if latin or greek or not cyrillic else w

    return text if text.isascii() else _WORD.sub(word, text)


def close_gaps(text: str) -> str:
    """Spaces out of runs of four or more single characters, where six or more stand alone."""
    if len(_SINGLE.findall(text)) < 6:
        return text
    return _RUN.sub(lambda m: m.group().replace(" ", ""), text)


def _printable(s: str) -> bool:
    return 0 < len(s) <= MAX_DECODED and sum(c.isprintable() or c in "\n\r\t" for c in s) >= 0.85 * len(s)


def _bytes_text(raw: bytes) -> str | None:
    try:
        s = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return s if len(s) >= 4 and _printable(s) else None


def from_base64(run: str) -> str | None:
    bare = run.replace("=", "")
    if entropy(run) < (2.5 if len(run) < 12 else 3.0) or len(set(bare)) < 4:
        return None
    try:
        return _bytes_text(base64.b64decode(run + "=" * (-len(run) % 4), validate=True))
    except (binascii.Error, ValueError):
        return None


def from_hex(run: str) -> str | None:
    low = run.lower()
    if len(run) % 2 or not 2.0 <= entropy(low) <= 4.5 or len(set(low)) < 4:
        return None
    try:
        return _bytes_text(bytes.fromhex(run))
    except ValueError:
        return None


def from_url(text: str) -> str | None:
    if text.count("%") < 2:
        return None
    try:
        out = urllib.parse.unquote(text, errors="strict")
    except UnicodeDecodeError:
        return None
    if out == text or len(out) < 4 or not _printable(out):
        return None
    low = out.lower()
    return out if any(w in low for w in URL_WORDS) or _PERCENT.search(text) else None


def from_rot13(text: str) -> str | None:
    if len(text) < 8:
        return None
    out = codecs.encode(text, "rot13")
    if out == text or not _printable(out):
        return None
    before, after = text.lower(), out.lower()
    return out if any(w in after for w in ROT13_WORDS) and not any(w in before for w in ROT13_WORDS) else None


def _splice(text: str, pattern: re.Pattern, decode) -> str | None:
    """``text`` with its first decodable run decoded."""
    for m in pattern.finditer(text):
        plain = decode(m.group())
        if plain is not None and len(text) - len(m.group()) + len(plain) <= MAX_DECODED:
            return text[: m.start()] + plain + text[m.end() :]
    return None


def decode_nested(text: str) -> str:
    for _ in range(ROUNDS):
        whole = from_url(text)
        if whole is not None and len(whole) <= MAX_GROWTH * len(text):
            text = whole
            continue
        step = _splice(text, _B64, from_base64) or _splice(text, _HEX, from_hex)
        if step is None:
            step = from_rot13(text)
        if step is None:
            break
        text = step
    return text


def fold_leet(text: str) -> str:
    """Leet words whose plain form holds a telling word."""

    def word(m: re.Match) -> str:
        w = m.group()
        core = w.strip("!")
        if core.isdigit() or not any(c in LEET for c in core) or not any(c.isalpha() for c in core):
            return w
        plain = core.translate(_LEET_MAP).lower()
        return w.translate(_LEET_MAP) if any(k in plain for k in LEET_WORDS) else w

    return _LEET_TOKEN.sub(word, text)


def normalize_text(text: str | None) -> str | None:
    """Normal form of one text; null stays null, empty stays empty."""
    if not text:
        return text
    t = unicodedata.normalize("NFKC", text[:MAX_INPUT])
    t = close_gaps(fold_lookalikes(_INVISIBLE.sub("", t)))
    return fold_leet(_INVISIBLE.sub("", decode_nested(t)))


def _series(s: pd.Series) -> pd.Series:
    return s.map(normalize_text, na_action="ignore")


def may_change(c: Column) -> Column:
    """Native test that every text passes which a step could change: a character outside
    ASCII, a percent escape, an encoded-looking run, spaced letters, a leet token, or a
    telling word once rotated."""
    return F.coalesce(
        c.rlike(r"[^\x00-\x7f]")
        | c.rlike(r"%[0-9a-fA-F]{2}")
        | (c.rlike(r"[A-Za-z0-9+/]{8,}") & _encoded_like(c))
        | c.rlike(r"\b\w[\s\x1c-\x1f]+\w[\s\x1c-\x1f]+\w[\s\x1c-\x1f]+\w\b")
        | c.rlike(r"[0-9@$!][A-Za-z]|[A-Za-z][0-9@$!]")
        | F.translate(F.lower(c), ROT13_LOWER, ROT13_OF).rlike("|".join(ROT13_WORDS))
        | (F.length(c) > MAX_INPUT),
        F.lit(False),
    )


def _encoded_like(c: Column) -> Column:
    """Some run of base64 or hex letters stands for valid text of four characters or more."""
    b64 = F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9+/]{8,}={0,2})"), F.lit(1))
    hexes = F.regexp_extract_all(c, F.lit(r"\b((?:[0-9a-fA-F]{2}){6,})\b"), F.lit(1))
    return F.exists(b64, lambda r: b64_decode(F.regexp_replace(r, "=+$", "")).isNotNull()) | F.exists(hexes, lambda r: hex_decode(r).isNotNull())


def normalized(c: Column) -> Column:
    """Normal form; needs a running session.  Texts that no step could change reach Python as
    nulls, so they cost neither transfer nor work there.  Arrow batches, one call per text."""
    return F.coalesce(F.pandas_udf(_series, StringType())(F.when(may_change(c), c)), c)
