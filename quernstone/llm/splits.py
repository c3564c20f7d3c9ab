"""Same or near-same records across splits (problem 6).

Records are canonicalised (letter case, punctuation, white space and look-alike
characters taken out) and hashed; evaluation hashes are joined with training
hashes, which finds exact overlaps.  Texts that are not equal are met through
hashes of their neighbouring words: texts of n and m words with a common sequence of
L words have at least 3 L - 1 - n - m pairs of neighbours in common, as each word left
out breaks one pair at most, so counting them loses nothing.

The route is one for splits of any size.  Of every text only the rarest pieces count at
first, as many as make sure that a near-same text shares one of them.  Training texts
are cut into slices of about ``GROUP_WORDS`` words; an evaluation text goes to the slices
that hold one of its rare pieces.  Within a slice all pieces are counted, and the
bit-parallel longest common word sequence decides; pairs are never spelled out before.

Exact copies are one class; classes are matched, records joined to their classes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import lookalike
from quernstone.operators.skew import heavy_keys, join_unique
from quernstone.session import cut_lineage, spread

#: share of words kept in common and in order
KEPT = 0.75
#: words of either split that one group holds, about
GROUP_WORDS = 1_000_000
#: slots of the table of piece frequencies, a bounded sketch: any order of pieces is right, a good one is fast
SLOTS = 1 << 20

_FOLD = str.maketrans(lookalike._FROM, lookalike._TO)
_INVISIBLE = re.compile("[" + re.sub(r"\\x\{([0-9A-F]{4})\}", lambda m: "\\u" + m.group(1), lookalike.INVISIBLE[1:-1]) + "]")
_WORD = re.compile(r"(?:[^\W_]|[̀-ͯऀ-ःऺ-ॏ])+")


def canonical_words(text: str | None) -> list[str]:
    """Words of the canonical form; null and empty texts have none."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
        text = unicodedata.normalize("NFC", text.translate(_FOLD))
    return _WORD.findall(text.casefold())


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common word sequence (bit-parallel)."""
    at: dict[str, int] = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def near(a: list[str], b: list[str]) -> bool:
    need = KEPT * max(len(a), len(b))
    return min(len(a), len(b)) >= need and lcs(a, b) >= need


class _Ids(dict):
    """64-bit ids of words, remembered; what is remembered is bounded."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pieces(texts: list[list[str]], ids: _Ids | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of the text) of the neighbouring words of all texts, repeated ones numbered.
    Two texts of four words may keep three in order and no neighbours, so texts of four words
    offer their words too."""
    get = (ids if ids is not None else _Ids()).__getitem__
    sizes = np.array([len(w) for w in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    x = np.array([get(w) for t in texts for w in t], np.uint64)
    if len(x) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = (x[:-1] * _MIX) ^ (x[1:] + _STEP)
        h = (h ^ (h >> np.uint64(29))) * _MIX
        pair = owner[:-1] == owner[1:]
        four = sizes[owner] == 4
        hs, own = np.concatenate([h[pair], x[four]]), np.concatenate([owner[:-1][pair], owner[four]])
        order = np.lexsort((hs, own))
        hs, own = hs[order], own[order]
        if len(hs) == 0:
            return hs, own
        fresh = np.ones(len(hs), bool)
        fresh[1:] = (hs[1:] != hs[:-1]) | (own[1:] != own[:-1])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(hs)), 0))
        again = (np.arange(len(hs)) - first).astype(np.uint64)
        return hs + again * _STEP, own


def least_common(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Pieces that near-same texts of n and m words have in common at least."""
    most = np.maximum(n, m)
    return np.where((n == 4) & (m == 4), 3, np.maximum(1, 3 * -(-3 * most // 4) - 1 - n - m))


def least_over_partners(n: np.ndarray) -> np.ndarray:
    """The least of :func:`least_common` over the lengths m of all near-same texts: at m = n, or one
    longer where that raises no count of words in common; for 4 words at 3."""
    return np.where(n == 4, 1, np.maximum(1, 3 * -(-3 * n // 4) - 1 - 2 * n - (n % 4 == 3)))


def rare(texts: list[list[str]], seen: np.ndarray, ids: _Ids | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of the text) of each text's rarest pieces, by ``seen``: so many that
    only fewer than the least number in common are left out."""
    hs, own = pieces(texts, ids)
    if len(hs) == 0:
        return hs, own
    order = np.lexsort((hs, seen[(hs % np.uint64(SLOTS)).astype(np.int64)], own))
    hs, own = hs[order], own[order]
    total = np.bincount(own, minlength=len(texts))
    start = np.concatenate([[0], np.cumsum(total)[:-1]])
    take = total - least_over_partners(np.array([len(w) for w in texts])) + 1
    keep = np.arange(len(hs)) - start[own] < take[own]
    return hs[keep], own[keep]


def canonical(df: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(id, cls, canon, *keep): ``cls`` a 128-bit hash of the canonical words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            canon = [" ".join(canonical_words(t)) for t in b.column(1).to_pylist()]
            cls = [xxhash.xxh3_128_hexdigest(c) for c in canon]
            cols = [b.column(0).cast(pa.string()), pa.array(cls, pa.string()), pa.array(canon, pa.string()), *(b.column(i).cast(pa.string()) for i in range(2, b.num_columns))]
            yield pa.record_batch(cols, ["id", "cls", "canon", *keep])

    schema = "id string, cls string, canon string" + "".join(f", {k} string" for k in keep)
    return spread(df.select(F.col(id_col), F.col(text_col), *keep)).mapInArrow(run, schema)


def _frequencies(train: DataFrame) -> np.ndarray:
    """How often training pieces fall into each of ``SLOTS`` slots; at most so many numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        seen = np.zeros(SLOTS, np.int64)
        for b in batches:
            hs, _ = pieces([t.split() for t in b.column(0).to_pylist()], ids)
            np.add.at(seen, (hs % np.uint64(SLOTS)).astype(np.int64), 1)
        some = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(seen[some], pa.int64())], ["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    for r in train.select("canon").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.slot] = r.n
    return out


def _rare_rows(classes: DataFrame, seen, key: str) -> DataFrame:
    """(piece, key) of each text's rare pieces; rows of one batch are given once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        counts = np.frombuffer(seen.value, np.int64)
        for b in batches:
            hs, own = rare([t.split() for t in b.column(1).to_pylist()], counts, ids)
            yield pa.record_batch([pa.array(hs.view(np.int64), pa.int64()), b.column(0).take(pa.array(own, pa.int64()))], ["piece", key])

    t = classes.schema[key].dataType.simpleString()
    return classes.select(key, "canon").mapInArrow(run, f"piece bigint, {key} {t}")


def _count_group(left: pa.Table, right: pa.Table) -> pa.Table:
    """Near-same pairs of a group's evaluation (``left``) and training (``right``) texts, all pieces counted."""
    vals, trains = left.column("cls").to_pylist(), right.column("cls").to_pylist()
    a, b = ([t.split() for t in x.column("canon").to_pylist()] for x in (left, right))
    ids = _Ids()
    hs, own = pieces(a, ids)
    order = np.argsort(hs, kind="stable")
    of = own[order]
    keys, starts = np.unique(hs[order], return_index=True)
    ends = np.append(starts[1:], len(of))
    size = np.array([len(w) for w in a], np.int64)
    found: tuple[list, list] = ([], [])
    if len(keys):
        th, town = pieces(b, ids)
        at = np.minimum(np.searchsorted(keys, th), len(keys) - 1)
        hit = keys[at] == th
        at, town = at[hit], town[hit]
        bounds = np.searchsorted(town, np.arange(len(b) + 1))
        needs: dict[int, np.ndarray] = {}  # by the number of words of the training text
        for k, w in enumerate(b):
            mine = at[bounds[k] : bounds[k + 1]]
            if not len(mine):
                continue
            m = len(w)
            met = np.bincount(np.concatenate([of[i:j] for i, j in zip(starts[mine].tolist(), ends[mine].tolist())]), minlength=len(size))
            need = needs.get(m)
            if need is None:
                if len(needs) > 500:
                    needs.clear()
                near_size = np.minimum(size, m) * 4 >= np.maximum(size, m) * 3
                need = needs[m] = np.where(near_size, least_common(size, np.array(m)), 1 << 40)
            for v in np.flatnonzero(met >= need).tolist():
                if vals[v] != trains[k] and near(a[v], w):
                    found[0].append(vals[v])
                    found[1].append(trains[k])
    return pa.table([pa.array(found[0], pa.string()), pa.array(found[1], pa.string())], names=["val_cls", "train_cls"])


def near_classes(val: DataFrame, train: DataFrame) -> DataFrame:
    """(val_cls, train_cls): different canonical texts that are near-same.

    A group holds one slice of the training texts and at most about as many words of
    evaluation texts: where more are bound for a slice, it is taken several times.
    """
    spark = val.sparkSession
    n_words = F.size(F.split("canon", " "))
    seen = spark.sparkContext.broadcast(_frequencies(train).tobytes())
    slices = max(spark.sparkContext.defaultParallelism, (train.agg(F.sum(n_words)).first()[0] or 0) // GROUP_WORDS)
    sliced = train.withColumn("slice", F.pmod(F.xxhash64("cls"), F.lit(slices)).cast("int"))
    holding = _rare_rows(sliced.repartition(slices, "slice"), seen, "slice").distinct()
    asking = cut_lineage(_rare_rows(spread(val), seen, "cls"))
    heavy = heavy_keys(asking.groupBy("piece").agg(F.count(F.lit(1)).alias("n")), "piece", "n", asking.count())
    bound = join_unique(asking, holding, "piece", heavy, "inner", ["cls"]).select("slice", "cls").distinct()
    bound = cut_lineage(bound.join(val.select("cls", n_words.alias("w")), "cls"))
    # evaluation texts of a slice in blocks of bounded size, training texts once for each block
    blocks = bound.groupBy("slice").agg(F.ceil(F.sum("w") / GROUP_WORDS).cast("int").alias("blocks"))
    left = bound.join(blocks, "slice").select("cls", "slice", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"))
    left = left.join(val.select("cls", F.col("canon").alias("canon")), "cls")
    right = sliced.join(blocks, "slice").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("slice", "block", "cls", "canon")
    return left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInArrow(_count_group, "val_cls string, train_cls string")


def overlaps(examples: DataFrame, id_col: str = "example_id", text_col: str = "text", split_col: str = "split_name", source_col: str = "source", evaluation: str = "val", training: str = "train") -> DataFrame:
    """(val_id, train_id, val_source, train_source, exact): all cross-split overlaps.

    Labels are not looked at.  Null and empty texts overlap with nothing; rows of
    other splits, or with a null split, take no part; equal rows come out each.
    """
    recs = canonical(
        examples.select(
            F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"), F.col(split_col).alias("_split"), F.col(source_col).alias("_source")
        ).where(F.col("_split").isin(evaluation, training)),
        "_id", "_text", "_split", "_source",
    ).where("canon <> ''")
    recs = cut_lineage(recs)
    val = recs.where(F.col("_split") == evaluation)
    train = recs.where(F.col("_split") == training)
    # aliases: both come from one table, and their columns must not be taken for each other
    val_cls, train_cls = (cut_lineage(x.select(F.col("cls").alias("cls"), F.col("canon").alias("canon")).distinct()) for x in (val, train))
    pairs = near_classes(val_cls, train_cls).withColumn("exact", F.lit(False))
    left = val.select(F.col("cls").alias("val_cls"), F.col("id").alias("val_id"), F.col("_source").alias("val_source"))
    right = train.select(F.col("cls").alias("train_cls"), F.col("id").alias("train_id"), F.col("_source").alias("train_source"))
    same = left.join(right, F.col("val_cls") == F.col("train_cls")).withColumn("exact", F.lit(True))
    close = pairs.join(left, "val_cls").join(right, "train_cls")
    cols = ["val_id", "train_id", "val_source", "train_source", "exact"]
    return same.select(*cols).unionByName(close.select(*cols))


def report(pairs: DataFrame) -> DataFrame:
    """Overlaps per pair of sources: pairs, evaluation records and training records."""
    return pairs.groupBy("val_source", "train_source", "exact").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("val_id").alias("n_val"), F.countDistinct("train_id").alias("n_train")
    )
