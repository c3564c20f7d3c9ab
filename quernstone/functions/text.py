"""Text scalars as native column expressions: they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: invisible characters
ZERO_WIDTH = "\\u200b-\\u200d\\ufeff\\u00ad\\u2060\\u180e\\u200e\\u200f\\u2061-\\u2064\\u115f\\u1160\\u3164\\u202a-\\u202e\\u2066-\\u2069"
#: marks that count for punctuation density
PUNCT = "}]{[\\|/`~!@#$%^&*=_+;:<>?\"'"
#: everyday words that are no sign of gibberish
COMMON_WORDS = (
    "the and you are for with this that have from not but what all can was one our out day get has him his how man new now old see two way who boy "
    "did its let put say she too use hello world please help thanks today ignore instruction system prompt previous summarize capital france document "
    "context и в не на я что тот быть с а весь это как она по но они к у ты привет мир пожалуйста спасибо сегодня игнорируй инструкции система промпт документ"
).split()
#: words that make a decoded text telling
URL_KEYWORDS = ("ignore", "instruction", "system", "jailbreak", "prompt", "previous")
ROT13_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ROT13_TO = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"


def py_strip(c: Column) -> Column:
    """Strip all Unicode white space, as Python does."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, f"[{ZERO_WIDTH}]", "")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def entropy(c: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text.

    Equal characters are brought together by one sort and counted as runs, so the cost
    does not depend on the number of different characters.
    """
    n = F.length(c)
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(c, "")), ""), F.lit(r"(?s)((.)\2*)"), F.lit(1))
    total = let(n, lambda m: F.aggregate(runs, F.lit(0.0), lambda a, r: a - (F.length(r) / m) * F.log2(F.length(r) / m)))
    return F.when(n > 0, total).otherwise(0.0)


def punct_density(c: Column) -> Column:
    n = F.length(c)
    return F.when(n > 0, (n - F.length(F.translate(c, PUNCT, ""))) / n).otherwise(0.0)


def nondict_ratio(c: Column) -> Column:
    """Share of words of more than three letters that are not everyday words."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([A-Za-zА-Яа-я]{2,})"), F.lit(1))
    common = F.array(*[F.lit(w) for w in COMMON_WORDS])
    odd = F.filter(words, lambda w: (F.length(w) > 3) & ~F.array_contains(common, w))
    return F.when(F.size(words) > 0, F.size(odd) / F.size(words)).otherwise(0.0)


def gibberish_score(c: Column) -> Column:
    """Score of an adversarial, gibberish-like text.

    The cheap densities gate the patterns; the second pattern is a bounded form of
    "ten short words, then brackets" that neither recurses nor backtracks widely.
    """
    shaped = (
        c.rlike(r"[}{\]\[\\|`~]{3,}")
        | c.rlike(r"(?U)(?:[A-Za-z]{1,2}[\W_]){5,}")
        | (c.rlike(r"[}\]\[\\]{2}") & c.rlike(r"(?U)\b(?:\w{1,3}\s+){9}\w{1,3}\s*.*[}\]\[\\]{2,}"))
    )
    tail = F.substring(c, F.greatest(F.length(c) - 49, F.lit(1)), F.lit(50))
    long_text = F.length(c) > 60

    def score(m: Column) -> Column:
        gated = (m.punct > 0.12) & (m.ent > 4.0)
        ladder = (
            F.when((m.punct > 0.10) & (m.ent > 4.0) & (nondict_ratio(c) > 0.5), 0.75)
            .when((m.punct > 0.15) & (m.ent > 4.2), 0.82)
            .when((m.ent > 4.8) & (nondict_ratio(c) > 0.65), 0.70)
            .when(m.punct > 0.30, 0.65)
            .otherwise(0.0)
        )
        a = F.when(long_text & (m.t_punct > 0.20) & (m.punct < 0.12), F.when(entropy(tail) > 4.0, 0.80).otherwise(0.0)).otherwise(0.0)
        b = F.when(long_text & (m.t_punct > 0.30), 0.75).otherwise(0.0)
        return F.when(gated & shaped, 0.78).otherwise(F.greatest(ladder, a, b))

    measures = F.struct(punct_density(c).alias("punct"), entropy(c).alias("ent"), punct_density(tail).alias("t_punct"))
    return F.when(c.isNull() | (F.length(py_strip(c)) < 20), 0.0).otherwise(let(measures, score))


def perplexity_band(ppl: Column) -> Column:
    """Confidence of a language model's perplexity."""
    return F.when(ppl > 8000, 0.92).when(ppl > 1500, 0.78).when(ppl > 800, 0.62).otherwise(0.0)


def rot13(c: Column) -> Column:
    return F.translate(c, ROT13_FROM, ROT13_TO)


def b64_gate(c: Column) -> Column:
    """Does a run look like base64 rather than a word?"""
    n, ent = F.length(c), entropy(c)
    distinct = F.size(F.array_distinct(F.split(F.replace(c, F.lit("="), F.lit("")), "")))
    return (n >= 8) & (ent >= F.when(n < 12, 2.5).otherwise(3.0)) & (distinct >= 4)


def hex_gate(c: Column) -> Column:
    n, ent = F.length(c), entropy(F.lower(c))
    return (n >= 12) & (n % 2 == 0) & ent.between(2.0, 4.5) & (F.size(F.array_distinct(F.split(F.lower(c), ""))) >= 4)


def decoded_utf8(binary: Column) -> Column:
    """The text that bytes stand for, if they are valid UTF-8 of four characters or more, else null."""
    ok = F.is_valid_utf8(binary.cast("string"))
    s = F.when(ok, F.decode(binary, "UTF-8"))
    return F.when(F.length(s) >= 4, s)


def b64_decode(c: Column) -> Column:
    padded = F.concat(c, F.substring(F.lit("==="), F.lit(1), (4 - F.length(c) % 4) % 4))
    return F.when(c.rlike(r"^[A-Za-z0-9+/]+={0,2}$"), decoded_utf8(F.try_to_binary(padded, F.lit("base64"))))


def hex_decode(c: Column) -> Column:
    return F.when(c.rlike(r"^[0-9A-Fa-f]+$"), decoded_utf8(F.try_to_binary(c, F.lit("hex"))))


def url_decode(c: Column) -> Column:
    """Percent-decoding of a whole text; '+' stays.  Null where nothing is gained."""
    dec = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    lower = F.lower(dec)
    telling = F.lit(False)
    for k in URL_KEYWORDS:
        telling = telling | lower.contains(k)
    many = F.length(c) - F.length(F.replace(c, F.lit("%"), F.lit(""))) >= 2
    return F.when(many & (dec != c) & (telling | c.rlike(r"(?:%[0-9a-fA-F]{2}){4,}")), dec)


def level_for(conf: Column, cfg) -> Column:
    """Confidence, clamped to 0..1, to its level; null confidence is ``allow``."""
    x = F.least(F.greatest(F.coalesce(conf, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return (
        F.when(x >= cfg.threshold_block, "block")
        .when(x >= cfg.threshold_exclude, "exclude")
        .when(x >= cfg.threshold_sanitize, "sanitize")
        .when(x >= cfg.threshold_log, "log")
        .otherwise("allow")
    )


def severity_of(level: Column) -> Column:
    """allow 0 ... block 4; unknown levels are null."""
    out = F.when(level == "allow", 0)
    for i, name in enumerate(("log", "sanitize", "exclude", "block"), 1):
        out = out.when(level == name, i)
    return out
