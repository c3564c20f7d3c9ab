"""Detectors: weighted rules, gibberish, classifier, multi-turn window, attribution."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.config import EngineConfig
from quernstone.functions.text import gibberish_score, let, level_for, perplexity_band, py_strip
from quernstone.sources.rules import Rule, needed_literals

# Trust weights by tag.
RULE_WEIGHT = {"RET": 0.4, "TOOL": 0.5}
PPL_WEIGHT = {"RET": 0.6, "TOOL": 0.5}
CLASSIFIER_WEIGHT = {"USR": 1.0, "RET": 0.85, "TOOL": 0.7, "SYS": 0.1}
PPL_TRIGGER = "high-perplexity-gcg"


def _by_tag(tag: Column, weights: dict[str, float], other: float = 1.0) -> Column:
    out = F.lit(None).cast("double")
    first = True
    for k, v in weights.items():
        out = F.when(tag == k, v) if first else out.when(tag == k, v)
        first = False
    return out.otherwise(other)


def rule_matches(text: Column, rules: list[Rule]) -> Column:
    """array<struct<label,weight>> of the rules found in ``text``, in rule order.

    A pattern is tried only on texts that hold one of the literals it needs (native
    ``when`` is lazy), so a text without any of them costs a few substring searches.
    A null text matches nothing.
    """
    none = F.array().cast("array<struct<label:string,weight:double>>")
    if not rules:
        return none

    def matches(low: Column) -> Column:
        each = []
        for r in rules:
            gate = [low.contains(x) for x in needed_literals(r.pattern)]
            test = reduce(lambda a, b: a | b, gate) & text.rlike(r.java) if gate else text.rlike(r.java)
            each.append(F.when(test, F.struct(F.lit(r.label).alias("label"), F.lit(r.weight).alias("weight"))))
        return F.array_compact(F.array(*each))

    # the long s is an s without case
    return F.when(text.isNotNull(), let(F.translate(F.lower(text), "ſ", "s"), matches)).otherwise(none)


def rule_score(matches: Column, tag: Column) -> Column:
    best = F.array_max(F.transform(matches, lambda m: m.weight))
    return F.coalesce(best * _by_tag(tag, RULE_WEIGHT), F.lit(0.0))


def score_segments(segments: DataFrame, rules: list[Rule], text: str = "content", cfg: EngineConfig | None = None) -> DataFrame:
    """Adds rule_score, ppl_score, score and triggers of ``text``."""
    cfg = cfg or EngineConfig()
    t, tag = F.col(text), F.col("tag")
    out = segments.withColumn("_m", rule_matches(t, rules)).withColumn("rule_score", rule_score(F.col("_m"), tag))
    # a pluggable scorer has added its confidence already (:func:`perplexity_scorer`)
    own = F.col("ppl_confidence") if "ppl_confidence" in segments.columns else gibberish_score(t)
    raw = own if cfg.perplexity_on else F.lit(0.0)
    out = out.withColumn("_p", raw * _by_tag(tag, PPL_WEIGHT))
    out = out.withColumn("ppl_score", F.when(F.col("_p") > 0.3, F.col("_p")).otherwise(0.0))
    r, p = F.col("rule_score"), F.col("ppl_score")
    both = F.when((r > 0.4) & (p > 0.5), F.least(F.lit(0.85), (r + p) / 2 + 0.1)).otherwise(0.0)
    labels = F.transform("_m", lambda m: m.label)
    triggers = F.when(p > 0, F.array_append(labels, F.lit(PPL_TRIGGER))).otherwise(labels)
    return out.withColumn("score", F.greatest(r, p, both)).withColumn("triggers", triggers).drop("_m", "_p")


def score_both(segments: DataFrame, rules: list[Rule], cfg: EngineConfig | None = None) -> DataFrame:
    """Scores the normalized text and, where it differs, the original; the higher score
    wins, triggers are united.  Needs columns content and normalized."""
    names = ("rule_score", "ppl_score", "score", "triggers")
    eff = score_segments(segments.withColumn("_eff", F.coalesce("normalized", "content")), rules, "_eff", cfg)
    eff = eff.withColumnsRenamed({n: f"e_{n}" for n in names})
    differs = (F.col("content") != F.col("_eff")) & (F.trim("content") != "")
    both = score_segments(eff.withColumn("_orig", F.when(differs, F.col("content"))), rules, "_orig", cfg)
    original_wins = F.col("score") > F.col("e_score")
    union = F.when(original_wins, F.array_union("triggers", "e_triggers")).when(F.col("score") > 0.3, F.array_union("e_triggers", "triggers")).otherwise(F.col("e_triggers"))
    return both.withColumn("_t", union).withColumn("score", F.greatest("score", "e_score")).withColumn("triggers", F.col("_t")).drop("_t", "_eff", "_orig", "rule_score", "ppl_score", *[f"e_{n}" for n in names])


def fold_requests(scored: DataFrame, cfg: EngineConfig | None = None) -> DataFrame:
    """(request_id, confidence, level, flagged_segment, triggers): the best segment of each
    request, the first on ties; triggers in first-seen order.  Only short structs travel."""
    cfg = cfg or EngineConfig()
    folded = scored.groupBy("request_id").agg(
        F.max(F.struct("score", (-F.col("idx")).alias("neg"))).alias("best"),
        F.sort_array(F.collect_list(F.when(F.size("triggers") > 0, F.struct("idx", "triggers")))).alias("t"),
    )
    conf = F.col("best.score")
    return folded.select(
        "request_id",
        conf.alias("confidence"),
        level_for(conf, cfg).alias("level"),
        F.when(conf > 0, -F.col("best.neg")).alias("flagged_segment"),
        F.array_distinct(F.flatten(F.transform("t", lambda x: x.triggers))).alias("triggers"),
    )


# ------------------------------------------------------------------ perplexity
def model_perplexity(df: DataFrame, load: Callable[[], Callable[[list[str]], list[float]]], text: str = "content", min_chars: int = 60, batch: int = 8) -> DataFrame:
    """Adds ``ppl_confidence``: the band of a language model's perplexity, per text.

    ``load`` runs once per worker and gives a function from texts to perplexities.  Texts
    shorter than ``min_chars`` (and null) score 0 and never reach the model; where the model
    cannot be loaded, fails, or gives another number of values, the gibberish score stands in.
    """
    t = F.col(text)
    long_enough = F.coalesce(F.length(py_strip(t)) >= min_chars, F.lit(False))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:  # any failure of foreign model code falls back
            model = None
        for b in batches:
            out: list[float | None] = [None] * len(b)
            asked = [i for i, x in enumerate(b) if isinstance(x, str)]
            for k in range(0, len(asked) if model else 0, batch):
                part = asked[k : k + batch]
                try:
                    got = list(model([b.iloc[i] for i in part]))
                except Exception:
                    got = []
                if len(got) == len(part):
                    for i, x in zip(part, got):
                        out[i] = float(x)
            yield pd.Series(out, dtype="float64")

    scored = df.withColumn("_ppl", F.pandas_udf(run, "double")(F.when(long_enough, t)))
    ppl = F.when(F.isnan("_ppl"), None).otherwise(F.col("_ppl"))
    return scored.withColumn("ppl_confidence", F.when(~long_enough, 0.0).when(ppl.isNull(), gibberish_score(t)).otherwise(perplexity_band(ppl))).drop("_ppl")


def perplexity_scorer(enabled: bool = True, load: Callable | None = None, cfg: EngineConfig | None = None) -> Callable[[DataFrame, str], DataFrame] | None:
    """The scorer to use, as a function that adds ``ppl_confidence`` to segments: none if switched
    off, the model's if one can be loaded, else the gibberish score."""
    if not enabled:
        return None
    if load is not None:
        return lambda df, text="content": model_perplexity(df, load, text, (cfg or EngineConfig()).perplexity_min_chars)
    return lambda df, text="content": df.withColumn("ppl_confidence", gibberish_score(F.col(text)))


# ------------------------------------------------------------------ classifier
def softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


# Words that mark a malicious label.
MALICIOUS = ("inject", "malicious", "jailbreak", "attack", "unsafe")


def malicious_index(labels: list[str]) -> int:
    """Index of the first label that names malice, else 1."""
    return next((i for i, x in enumerate(labels) if any(w in x.lower() for w in MALICIOUS)), 1)


def injection_probability(logits: Column, labels: list[str] | None = None) -> Column:
    """Sum of the probabilities of malicious labels, else that of index 1; a single logit gives 1."""
    probs = softmax(logits)
    bad = [i for i, x in enumerate(labels or []) if any(w in x.lower() for w in MALICIOUS)]
    if bad:
        return reduce(lambda a, b: a + b, [F.get(probs, i) for i in bad])
    return F.coalesce(F.get(probs, 1), F.get(probs, 0))


def classify_requests(scored: DataFrame, cfg: EngineConfig | None = None, score: str = "score") -> DataFrame:
    """Tag-weighted maximum of raw scores per request with multi-turn escalation.

    ``scored``: (request_id, idx, tag, content, score).  Returns (request_id,
    confidence, level, best_idx, cumulative, medium_count, escalate, risk, previews).
    """
    cfg = cfg or EngineConfig()
    raw = F.least(F.greatest(F.coalesce(F.col(score), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    s = scored.select("request_id", "idx", "tag", "content", raw.alias("raw"), (raw * _by_tag(F.col("tag"), CLASSIFIER_WEIGHT)).alias("weighted"))
    preview = F.concat(F.col("tag"), F.lit(":"), F.array_join(F.slice(F.split(F.trim("content"), r"\s+"), 1, 5), " "))
    folded = s.groupBy("request_id").agg(
        F.max(F.struct("weighted", (-F.col("idx")).alias("neg"))).alias("best"),
        F.sort_array(F.collect_list(F.when(F.col("tag").isin("USR", "RET"), F.struct("idx", "raw")))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("raw") >= 0.5, F.struct("idx", preview.alias("p"))))).alias("previews"),
    )
    folded = folded.withColumn("w", F.transform(last_turns(F.col("turns"), cfg), lambda t: t.raw))
    folded = folded.withColumn("cumulative", decayed_sum(F.col("w"), cfg)).withColumn("medium_count", F.size(F.filter("w", lambda x: x >= cfg.multiturn_medium)))
    escalate = escalates(F.col("cumulative"), F.col("medium_count"), cfg)
    best = F.col("best.weighted")
    conf = F.when(escalate & (F.col("cumulative") > best), F.greatest(best, F.least(F.lit(0.92), 0.85 * F.col("cumulative")))).otherwise(best)
    level = level_for(conf, cfg)
    forced = F.when(escalate & level.isin("allow", "log"), "sanitize").otherwise(level)
    return folded.select(
        "request_id",
        conf.alias("confidence"),
        forced.alias("level"),
        F.when(best > 0, -F.col("best.neg")).alias("best_idx"),
        "cumulative",
        "medium_count",
        escalate.alias("escalate"),
        risk_level(F.col("cumulative"), F.col("medium_count"), F.col("w"), cfg).alias("risk"),
        F.transform(F.slice("previews", 1, 5), lambda x: x.p).alias("previews"),
    )


# ------------------------------------------------------------------ multi-turn
def last_turns(turns: Column, cfg: EngineConfig) -> Column:
    n = cfg.multiturn_window
    return F.slice(turns, F.greatest(F.size(turns) - n + 1, F.lit(1)), n)


def decayed_sum(scores: Column, cfg: EngineConfig) -> Column:
    """Sum of scores, newest first, each weighted by decay ** age.  The order of addition is
    fixed, so thresholds compare equal values everywhere."""
    newest = F.reverse(scores)
    weighted = F.transform(newest, lambda x, i: x * F.pow(F.lit(cfg.multiturn_decay), i))
    return F.aggregate(weighted, F.lit(0.0), lambda a, b: a + b)


def escalates(cumulative: Column, medium: Column, cfg: EngineConfig) -> Column:
    return (cumulative >= cfg.multiturn_cumulative) | (medium >= 3)


def risk_level(cumulative: Column, medium: Column, scores: Column, cfg: EngineConfig) -> Column:
    t = cfg.multiturn_cumulative
    return (
        F.when((cumulative >= 1.25 * t) | (medium >= 4), "critical")
        .when((cumulative >= t) | (medium >= 3), "high")
        .when((cumulative >= t * 2 / 3) | (medium >= 2), "medium")
        .when(F.exists(scores, lambda x: x >= 0.4), "low")
        .otherwise("none")
    )


def running_window(turns: DataFrame, cfg: EngineConfig | None = None, key: str = "request_id", order: str = "idx", score: str = "score") -> DataFrame:
    """The window's state after every turn: adds cumulative, medium_count, escalate."""
    cfg = cfg or EngineConfig()
    w = W.partitionBy(key).orderBy(order).rowsBetween(-(cfg.multiturn_window - 1), 0)
    out = turns.withColumn("_w", F.collect_list(score).over(w))
    out = out.withColumn("cumulative", decayed_sum(F.col("_w"), cfg)).withColumn("medium_count", F.size(F.filter("_w", lambda x: x >= cfg.multiturn_medium)))
    return out.withColumn("escalate", escalates(F.col("cumulative"), F.col("medium_count"), cfg)).drop("_w")


# ----------------------------------------------------------------- attribution
def min_max(scores: Column) -> Column:
    """Scores scaled to 0..1; a flat list gives zeros."""
    lo, hi = F.array_min(scores), F.array_max(scores)
    return F.transform(scores, lambda x: F.when(hi - lo < 1e-12, 0.0).otherwise((x - lo) / (hi - lo)))


def words_of_subwords(tokens: Column, scores: Column) -> Column:
    """array<struct<token,score>>: ``##`` continues a word, ``▁`` and ``Ġ`` begin one, special
    and empty tokens are skipped, scores of a word's pieces are added."""
    word = "struct<token:string,score:double>"
    special = lambda t: (t == "") | t.rlike(r"^\[.*\]$")

    def step(acc: Column, x: Column) -> Column:
        cont = x.token.startswith("##") & (F.size(acc) > 0)
        last = F.element_at(acc, -1)
        joined = F.struct(F.concat(last.token, F.substring(x.token, F.lit(3), F.length(x.token))).alias("token"), (last.score + x.score).alias("score"))
        fresh = F.struct(F.regexp_replace(x.token, "^(##|▁|Ġ)+", "").alias("token"), x.score.alias("score"))
        return F.when(special(x.token), acc).when(cont, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(fresh)))

    zipped = F.transform(F.arrays_zip(tokens.alias("token"), scores.alias("score")), lambda z: F.struct(z["token"].alias("token"), z["score"].cast("double").alias("score")))
    return F.aggregate(zipped, F.array().cast(f"array<{word}>"), step)


def top_words(words: Column, k: int = 10) -> Column:
    """The k best words, stable on ties, scores to six places."""
    ranked = F.sort_array(F.transform(words, lambda w, i: F.struct((-w.score).alias("neg"), i.alias("i"), w.token.alias("token"), w.score.alias("score"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: F.struct(r.token.alias("token"), F.round(r.score, 6).alias("score")))


def token_attribution(tokens: Column, scores: Column, k: int = 10) -> Column:
    """The best words of subword tokens and their scores; lists of different length raise."""
    same = F.size(tokens) == F.size(scores)
    checked = F.when(same, scores).otherwise(F.raise_error("tokens and scores must have the same length").cast("array<double>"))
    return F.when(tokens.isNotNull() & scores.isNotNull(), top_words(words_of_subwords(tokens, min_max(checked)), k))


METHODS = ("attention", "integrated_gradients")


def attribute(df: DataFrame, method: str = "attention", k: int = 10) -> DataFrame:
    """Adds ``attribution`` by one of ``METHODS`` to rows of subword ``tokens`` with ``attention``
    and ``mask`` (attention), or ``coefficients`` and ``inputs`` per token (integrated gradients of
    a linear model); another method raises."""
    if method not in METHODS:
        raise ValueError(f"unknown attribution method {method!r}")
    scores = cls_attention(F.col("attention"), F.col("mask")) if method == "attention" else linear_gradients(F.col("coefficients"), F.col("inputs"))
    return df.withColumn("method", F.lit(method)).withColumn("attribution", token_attribution(F.col("tokens"), scores, k))


def rounded_turns(scores: Column, previews: Column, places: int = 4, chars: int = 80) -> Column:
    """array<struct<score,preview>> for a report: scores rounded, previews cut."""
    return F.transform(F.arrays_zip(scores.alias("s"), previews.alias("p")), lambda z: F.struct(F.round(z["s"], places).alias("score"), F.left(z["p"], F.lit(chars)).alias("preview")))


def cls_attention(attention: Column, mask: Column) -> Column:
    """Mean over layers and heads of the first position's attention; padding is zero.
    ``attention``: array[layer][head][position] of the first position's row."""
    rows = F.flatten(attention)
    n = F.size(rows)
    return F.transform(
        mask, lambda m, i: F.when(m == 0, 0.0).otherwise(F.aggregate(rows, F.lit(0.0), lambda a, r: a + F.get(r, i)) / n)
    )


def linear_gradients(coefficients: Column, values: Column) -> Column:
    """Integrated gradients of a linear model in closed form: |coefficient * value|."""
    return F.transform(F.arrays_zip(coefficients.alias("c"), values.alias("x")), lambda z: F.abs(z["c"] * z["x"]))
