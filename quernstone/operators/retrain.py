"""Building the training set: labels, queue, corpora, first-wins dedupe, stratified split, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.config import EngineConfig
from quernstone.functions.text import py_strip
from quernstone.operators.ranks import running_totals
from quernstone.session import cut_lineage

# Spellings of the two labels.
COLLECT_LABELS = {"injection": ("injection", "malicious", "attack", "1", "unsafe"), "benign": ("benign", "safe", "clean", "0", "ok")}
DATASET_LABELS = {1: ("injection", "malicious", "attack", "1", "true"), 0: ("benign", "safe", "clean", "0", "false")}


def collect_label(c: Column) -> Column:
    """``injection`` or ``benign``; other spellings are null, their rows are refused."""
    x = F.lower(F.trim(c.cast("string")))
    return F.when(x.isin(*COLLECT_LABELS["injection"]), "injection").when(x.isin(*COLLECT_LABELS["benign"]), "benign")


def dataset_label(c: Column) -> Column:
    """1 or 0; other spellings are null."""
    x = F.lower(F.trim(c.cast("string")))
    return F.when(x.isin(*DATASET_LABELS[1]), 1).when(x.isin(*DATASET_LABELS[0]), 0)


def candidate_text(c: Column, cfg: EngineConfig | None = None) -> Column:
    """Stripped and cut; blank gives null."""
    t = F.left(py_strip(c), F.lit((cfg or EngineConfig()).max_text))
    return F.when(t != "", t)


def wants_borderline(decision: Column, confidence: Column, cfg: EngineConfig | None = None) -> Column:
    cfg = cfg or EngineConfig()
    if not cfg.borderline_on:
        return F.lit(False)
    return F.when(decision.isNull() | (decision == "allow"), False).when(decision == "log", F.coalesce(confidence >= cfg.borderline_min, F.lit(False))).otherwise(True)


def collect_candidates(decisions: DataFrame, segments: DataFrame, cfg: EngineConfig | None = None) -> DataFrame:
    """(request_id, idx, text, decision, confidence): up to ``max_fan_out`` non-system segments of
    each borderline request, in order; segments of requests delivered again count once."""
    cfg = cfg or EngineConfig()
    wanted = decisions.where(wants_borderline(F.col("decision"), F.col("confidence"), cfg)).select("request_id", "decision", "confidence")
    # only segments of wanted requests go on, and of those the first few: a top-k per request, no list of texts
    s = segments.where("tag <> 'SYS'").join(wanted, "request_id").dropDuplicates(["request_id", "idx"]).withColumn("text", candidate_text(F.col("content"), cfg)).where("text is not null")
    first = F.row_number().over(W.partitionBy("request_id").orderBy("idx"))
    return s.withColumn("_r", first).where(F.col("_r") <= cfg.max_fan_out).select("request_id", "idx", "text", "decision", "confidence")


def enqueue(new: DataFrame, queue: DataFrame, cfg: EngineConfig | None = None) -> DataFrame:
    """Rows of ``new`` (text, label, ord, ...) that enter the queue: valid label and text, not
    pending already under the same text and label, first of their kind in the batch, and
    as many as the queue still takes.

    The cap (none if ``max_queue`` is None) needs the global order only of what can fit: a
    top-k, not a full sort; it holds that many rows per task, so keep it below a million.
    """
    cfg = cfg or EngineConfig()
    rows = new.withColumn("text", candidate_text(F.col("text"), cfg)).withColumn("label", collect_label(F.col("label"))).where("text is not null and label is not null")
    pending = queue.where("status = 'pending'")
    fresh = rows.join(pending.select("text", "label").distinct(), ["text", "label"], "left_anti")
    first = fresh.withColumn("_r", F.row_number().over(W.partitionBy("text", "label").orderBy("ord"))).where("_r = 1").drop("_r")
    if cfg.max_queue is None:
        return first
    room = max(0, cfg.max_queue - pending.count())
    return first.orderBy("ord").limit(room)


def mark_consumed(queue: DataFrame, used: DataFrame, stripped: bool = False) -> DataFrame:
    """The queue with pending rows consumed whose text is in ``used`` (text alone decides;
    ``stripped``: as :func:`candidate_text` gives it)."""
    hit = used.select(F.col("text").alias("_t")).distinct().withColumn("_u", F.lit(True))
    done = (F.col("status") == "pending") & F.col("_u").isNotNull()
    own = candidate_text(F.col("text")) if stripped else F.col("text")
    return queue.join(hit, own == F.col("_t"), "left").withColumn("status", F.when(done, "consumed").otherwise(F.col("status"))).drop("_u").select(*queue.columns)


def queue_examples(queue: DataFrame, limit: int = 20_000) -> DataFrame:
    """(text, label, source, ord): oldest pending rows; the limit comes before unknown labels
    and blank texts drop out."""
    first = queue.where("status = 'pending'").orderBy("created_at", "id").limit(limit)
    return first.select(candidate_text(F.col("text")).alias("text"), dataset_label(F.col("label")).alias("label"), "source", F.struct("created_at", "id").alias("ord")).where("text is not null and label is not null")


def dedupe_first(examples: DataFrame, order: list[str]) -> DataFrame:
    """First row, by ``order``, of each text without regard to case and outer white space.
    Reduces map-side to one row per text, so a text repeated without end costs nothing."""
    key = F.lower(py_strip(F.col("text")))
    cols = examples.columns
    best = examples.groupBy(key.alias("_k")).agg(F.min(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*cols).alias("row"))).alias("b"))
    return best.select("b.row.*")


def stratified_split(examples: DataFrame, val_split: float = 0.1, seed: int = 42, label: str = "label") -> DataFrame:
    """Adds ``split``: of each class, in an order shuffled by hash, the first round(n * val_split)
    (half to even) go to ``val``.

    The rank of a row is taken in two levels (:mod:`quernstone.operators.ranks`), so a
    class of any size is spread over tasks.  A null label is a class of its own.
    """
    d = examples.withColumn("_h", F.xxhash64(F.lit(seed), "text"))
    ranked = running_totals(d, [F.col("_h"), F.col("text")], {"_r": F.lit(1)}, [label])
    # one row per class
    take = examples.groupBy(F.col(label).alias("_label")).agg(F.bround(F.count(F.lit(1)) * F.lit(val_split)).alias("_take"))
    out = ranked.join(take, F.col(label).eqNullSafe(F.col("_label")))
    return out.withColumn("split", F.when(F.col("_r") <= F.col("_take"), "val").otherwise("train")).drop("_h", "_label", "_take", "_r")


def valid_label(label: Column) -> Column:
    """A label as it may be queued: 1 to 64 characters, and one of the known spellings."""
    return F.length(F.trim(label)).between(1, 64) & collect_label(label).isNotNull()


def refusal(text: Column, label: Column, cfg: EngineConfig | None = None) -> Column:
    """Why a feedback item is refused, null if it is taken: no text, a text over the limit, an unknown label."""
    n = F.length(py_strip(text))
    return F.when(F.coalesce(n, F.lit(0)) < 1, "text is empty").when(F.length(text) > (cfg or EngineConfig()).max_text, "text is too long").when(~F.coalesce(valid_label(label), F.lit(False)), "unknown label")


def build_dataset(queue: DataFrame | None, corpora: DataFrame, path: str, cfg: EngineConfig | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Builds the training set: pending examples of ``queue``, then ``corpora`` (text, label,
    source, file_name, line_no), first-wins dedupe, stratified split, written under ``path``.

    Returns (split_stats, the queue with the used items consumed).  Without a queue only
    the corpora are read and nothing is consumed.  Nothing is consumed unless the set has been
    written.
    """
    from quernstone.sources.sinks import write_dataset

    cfg = cfg or EngineConfig()
    parts = [corpora.select("text", "label", "source", F.lit(1).alias("_part"), F.col("file_name").alias("_a"), F.col("line_no").cast("string").alias("_b"), F.col("line_no").alias("_n"))]
    if queue is not None:
        q = queue_examples(queue)
        at = F.date_format("ord.created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        parts.insert(0, q.select("text", "label", F.coalesce("source", F.lit("queue")).alias("source"), F.lit(0).alias("_part"), at.alias("_a"), F.col("ord.id").alias("_b"), F.lit(0).cast("bigint").alias("_n")))
    union = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    order = ["_part", "_a", "_n", "_b"]
    examples = dedupe_first(union, order).select("text", "label", "source")
    # cut off: what is written and what is consumed must be the same rows
    done = cut_lineage(stratified_split(examples, cfg.val_split, cfg.seed))
    write_dataset(done, path)
    return split_stats(done), None if queue is None else mark_consumed(queue, done, stripped=True)


def split_stats(examples: DataFrame, split: str = "split") -> DataFrame:
    return examples.groupBy(split).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("label") == 1, 1)).alias("injection"), F.count(F.when(F.col("label") == 0, 1)).alias("benign")
    )


def freeze_holdout(parts: list[tuple[DataFrame, int | None]], min_chars: int = 5, max_chars: int = 4000, seed: int = 7) -> DataFrame:
    """(item_no, source, label, text): sources in order of priority, cleaned, each cut to its
    number of rows in hash order, first-wins dedupe, shuffled by hash and numbered."""
    out = None
    for rank, (df, take) in enumerate(parts):
        t = F.left(F.regexp_replace(py_strip(F.col("text")), r"(?U)\s+", " "), F.lit(max_chars))
        d = df.select(t.alias("text"), "label", "source", F.lit(rank).alias("rank")).where(F.length("text") >= min_chars)
        if take is not None:
            d = d.orderBy(F.xxhash64(F.lit(seed), "text"), "text").limit(take)
        out = d if out is None else out.unionByName(d)
    kept = dedupe_first(out, ["rank", "text", "source"]).withColumn("h", F.xxhash64(F.lit(seed), F.lower("text")))
    ranked = running_totals(kept, [F.col("h"), F.col("text")], {"nr": F.lit(1)})
    return ranked.select((F.col("nr") - 1).alias("item_no"), "source", "label", "text")


# -------------------------------------------------------------------- registry
REGISTRY_SCHEMA = "version string, path string, base_model string, metrics map<string,double>, dataset_stats map<string,bigint>, created_at timestamp, status string"


def register(registry: DataFrame, entry: DataFrame) -> DataFrame:
    """Adds a candidate; a version that exists is refused."""
    clash = registry.join(entry.select("version"), "version", "left_semi").limit(1).count()
    if clash:
        raise ValueError("version exists")
    return registry.unionByName(entry.withColumn("status", F.lit("candidate")))


def promote(registry: DataFrame, version: str) -> DataFrame:
    """``version`` becomes production, the former production version is retired."""
    if not registry.where(F.col("version") == version).limit(1).count():
        raise KeyError(version)
    status = F.when(F.col("version") == version, "production").when(F.col("status") == "production", "retired").otherwise(F.col("status"))
    return registry.withColumn("status", status)


def remove(registry: DataFrame, version: str) -> DataFrame:
    """Without ``version``; the production version stays."""
    if registry.where((F.col("version") == version) & (F.col("status") == "production")).limit(1).count():
        raise ValueError("production cannot be removed")
    return registry.where(F.col("version") != version)


