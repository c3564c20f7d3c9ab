"""Text cut off by field limits or in transfer (problem 3).

Field limits: within each table and group (source, method, channel) the discrete
hazard of an incomplete ending is computed at every text length, tested against
the hazard at neighbouring lengths, and the tests are controlled for false
discoveries; incomplete endings at significant lengths are cuts.

Cuts in transfer have no common length, so the hazards cannot show them; they need
evidence in the ending itself: a broken character, a truncation mark, an unclosed
JSON object, the beginning of a longer word, or a word that never ends a
sentence.  Words are judged by counts over all texts of the corpus.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.session import cut_lineage, spread

#: lengths to either side that a length is compared with
NEIGHBOURS = 12
#: false-discovery rate of the length tests
ALPHA = 0.001
#: a word is known when it stands inside texts at least so often
KNOWN = 3
#: a known word never ends a sentence when fewer than this share of NEVER_MIN or more occurrences do
NEVER, NEVER_MIN = 0.002, 50
#: occurrences at the end of unmarked texts count as endings from this share on
OWN_END = 0.005
#: a length is a limit only where incomplete endings are so many times as frequent as expected
EXCESS = 3
#: a known word that itself seldom ends a sentence is a beginning when a longer word is so many times as frequent
LONGER = 8

_PUNCT = " \t\r\n\"'“”„«»‘’.,;:!?…()[]{}<>*_`~-–—¿¡。！？、，"
#: white space and invisible characters after the last visible one
_TRAILING = " \t\r\n\f\v\u00a0\u2007\u202f\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"
_DIGIT = re.compile(r"\d")
_FINAL = re.compile(r"(?:[.!?…][\"'”’»)\]}*_`]*|[。！？।॥؟۔｡][」』”’）\"]*)$")
_ENDED = re.compile(r"(?:[.!?…]|[。！？।॥؟۔｡])[\s\"'”’“»」』）)\]}*_`!?]*$")
_MARK = re.compile(r"[\[(<{]\s*(?:truncated|cut(?: off)?|shortened|clipped|gekürzt|abgeschnitten|tronqué|truncado|cortado|обрезано|\.\.\.|…)\s*[\])>}]$", re.I)
_KV = re.compile(r"\s*[^\W\d][\w \t-]{0,30}\s*:\s*\S")


def word_shape(token: str) -> str:
    """Letter case and outer punctuation gone, digits masked."""
    return _DIGIT.sub("0", token.strip(_PUNCT).casefold())


def ending(text: str) -> tuple[str, str]:
    """(kind, last word): ``whole``, ``cut`` (explicit evidence) or ``open`` (to be judged).

    Blank texts are whole.
    """
    s = text.rstrip(_TRAILING)
    if not s:
        return "whole", ""
    if s.endswith("�") or _MARK.search(s):
        return "cut", ""
    head = s.lstrip()[0]
    if head in "{[":
        try:
            json.loads(s)
            return "whole", ""
        except (ValueError, RecursionError):
            pass
        bare = re.sub(r'"(?:[^"\\]|\\.)*"', "", s, flags=re.S)
        if bare.count("{") > bare.count("}") or bare.count("[") > bare.count("]"):
            return "cut", ""
        if bare.count('"') % 2:
            return "cut", ""
    if s[-1] == "…" and len(s) > 1 and s[-2].isalnum():
        return "open", word_shape(s.split()[-1])
    if _ENDED.search(s):
        return "whole", ""
    if ";" in s:
        parts = s.split(";")
        if len(parts) > 2 and all(_KV.match(p) for p in parts[:-1]) and ":" not in parts[-1] and parts[-1].strip():
            return "cut", ""
    return "open", word_shape(s.split()[-1])


def _scan(df: DataFrame, table_name: str, id_col: str, text_col: str, group_col: str) -> DataFrame:
    """One pass over the texts: a feature row (is_text) per text, and counted word rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw: Counter = Counter()
            last: Counter = Counter()
            rows = []
            for i, g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                kind, word = ending(t)
                toks = t.split()
                # the last words of a text that may be cut say nothing about words
                n = len(toks) if kind == "whole" else len(toks) - (1 if kind == "open" else 2)
                raw.update(toks[: max(0, n)])
                if kind == "open":
                    last[word] += 1
                rows.append((True, i, g, len(t), kind, word, 0, 0, 0))
            seen: dict[str, list[int]] = {}
            for tok, n in raw.items():
                w = word_shape(tok)
                if w:
                    c = seen.setdefault(w, [0, 0, 0])
                    c[1 if _FINAL.search(tok) else 0] += n
            for w, n in last.items():
                seen.setdefault(w, [0, 0, 0])[2] += n
            rows += [(False, None, None, 0, "", w, *c) for w, c in seen.items()]
            cols = list(zip(*rows)) or [[]] * 9
            types = [pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["is_text", "record_id", "grp", "len", "kind", "word", "mid", "fin", "n_end"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names)

    schema = "is_text boolean, record_id string, grp string, len int, kind string, word string, mid bigint, fin bigint, n_end bigint"
    source = df.select(F.col(id_col).cast("string"), F.col(group_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
    return spread(source).mapInArrow(run, schema).withColumn("table_name", F.lit(table_name))


def limit_lengths(texts: DataFrame) -> DataFrame:
    """(table_name, grp, len): lengths at which incomplete endings pile up.

    hazard(l) = incomplete texts of length l / texts of length l or more.  The count
    at l is tested against its expectation from the neighbouring hazards with the
    Chernoff bound of the Poisson tail; Benjamini-Hochberg over all tests.
    """
    grp = F.coalesce("grp", F.lit(""))
    per = texts.groupBy("table_name", grp.alias("grp"), "len").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kind") != "whole", 1)).alias("d")
    )
    g = W.partitionBy("table_name", "grp")
    around = g.orderBy("len").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    risk = per.withColumn("s", F.sum("n").over(g.orderBy(F.col("len").desc()).rowsBetween(W.unboundedPreceding, 0)))
    tests = (
        risk.withColumn("nd", F.sum("d").over(around) - F.col("d"))
        .withColumn("ns", F.sum("s").over(around) - F.col("s"))
        .where("d > 0")
        .withColumn("expected", F.col("s") * (F.col("nd") + 0.25) / (F.col("ns") + F.col("s") + 1.0))
        .withColumn(
            "log_p",
            F.when(F.col("d") > F.col("expected"), -(F.col("d") * F.log(F.col("d") / F.col("expected")) - F.col("d") + F.col("expected"))).otherwise(0.0),
        )
    )
    # One row per group and length with an incomplete ending: at most the number of groups times
    # the longest limit (4,096 here), whatever the number of texts; ranked as a whole.
    everything = W.partitionBy(F.lit(1))
    ranked = tests.withColumn("rank", F.row_number().over(everything.orderBy("log_p", "table_name", "grp", "len"))).withColumn(
        "m", F.count(F.lit(1)).over(everything)
    )
    passed = ranked.withColumn("last", F.max(F.when(F.col("log_p") <= F.log(ALPHA * F.col("rank") / F.col("m")), F.col("rank"))).over(everything))
    return passed.where((F.col("rank") <= F.col("last")) & (F.col("d") >= 3) & (F.col("d") >= EXCESS * F.col("expected"))).select("table_name", "grp", "len")


def _judge_words(words: DataFrame, candidates: DataFrame) -> DataFrame:
    """(word, broken): last words of open texts that show a cut."""
    vocab = words.groupBy("word").agg(F.sum("mid").alias("mid"), F.sum("fin").alias("fin"), F.sum("n_end").alias("n_end"))
    vocab = vocab.withColumn("n", F.col("mid") + F.col("fin"))
    known = vocab.where((F.col("n") >= KNOWN) & F.col("word").rlike(r"\p{L}"))
    longer = (
        known.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1))), lambda k: F.substring("word", F.lit(1), k))).alias("p"), F.col("word").alias("w"), "n")
        .where(F.col("p") != F.col("w"))
        .groupBy("p")
        .agg(F.max("n").alias("longer_n"))
        .withColumnRenamed("p", "word")
    )
    asked = candidates.select("word").distinct().join(vocab, "word", "left").join(longer, "word", "left")
    n, fin = F.coalesce("n", F.lit(0)), F.coalesce("fin", F.lit(0))
    ln = F.coalesce("longer_n", F.lit(0))
    seldom_end = fin + F.when(F.col("n_end") > OWN_END * (n + F.col("n_end")), F.col("n_end")).otherwise(0)
    broken = (
        F.col("word").rlike(r"\p{L}")
        & (
            ((n < KNOWN) & (ln >= KNOWN))
            | ((n >= NEVER_MIN) & (seldom_end < NEVER * n))
            | ((n >= KNOWN) & (ln >= LONGER * n) & (fin < 0.05 * n))
        )
    )
    return asked.select("word", broken.alias("broken"))


def judged(tables: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(table_name, record_id, grp, len, is_cut, evidence) of every non-null text, each id once.

    ``evidence`` of a cut: ``limit`` (an incomplete ending at a significant length),
    ``mark`` (in the ending itself) or ``word`` (by the counts of its last word).

    ``tables``: name -> (table, id column, text column, group column).  Null texts are
    left out; empty and blank texts are whole; a null group is a group of its own.
    """
    scanned = cut_lineage(reduce(DataFrame.unionByName, [_scan(df, n, i, t, g) for n, (df, i, t, g) in tables.items()]))
    texts = scanned.where("is_text").select("table_name", "record_id", "grp", "len", "kind", "word").dropDuplicates(["table_name", "record_id"])
    limits = limit_lengths(texts).withColumn("at_limit", F.lit(True))
    open_texts = texts.where("kind = 'open'")
    verdict = _judge_words(scanned.where("not is_text").select("word", "mid", "fin", "n_end"), open_texts)
    opened = (
        open_texts.withColumn("g", F.coalesce("grp", F.lit("")))
        .join(limits.withColumnRenamed("grp", "g"), ["table_name", "g", "len"], "left")
        .join(verdict, "word", "left")
        .select("table_name", "record_id", "grp", "len", F.when(F.col("at_limit"), "limit").when(F.col("broken"), "word").alias("evidence"))
    )
    rest = texts.where("kind <> 'open'").select("table_name", "record_id", "grp", "len", F.when(F.col("kind") == "cut", "mark").alias("evidence"))
    return opened.unionByName(rest).withColumn("is_cut", F.col("evidence").isNotNull())
