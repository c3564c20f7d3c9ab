"""Evaluation passages inside a training corpus (problem 8).

Pigeonhole edit matching.  A passage leaks when ``WINDOW`` consecutive words of
an item stand in a document with at most ``ERRORS`` of them changed.  Every such
window, cut into ``ERRORS + 1`` pieces, keeps one piece whole, so exact hits of
the pieces find all candidates; Myers' bit-parallel distance over words decides.

The route is one for item sets of any size.  Pieces are 64-bit hashes.  A bit set
of the items' pieces, of at most ``MAX_BITS`` bits whatever their number, goes to
all workers and takes out nearly all pieces of the documents; those that pass meet
the items' pieces in a join partitioned by hash, in which frequent pieces are
salted, and only they carry the words around them for the verification.  A fuller
bit set lets more pieces pass, but loses none.
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

from quernstone.operators.skew import heavy_keys, join_unique
from quernstone.session import cut_lineage, spread

WINDOW = 12
ERRORS = 1
PIECE = WINDOW // (ERRORS + 1)
#: size of the bit set: BITS_PER_PIECE for each piece of an item, at most MAX_BITS (16 MB)
BITS_PER_PIECE, MAX_BITS = 256, 1 << 27
#: words around a piece that a window with errors can reach
REACH = WINDOW - PIECE + ERRORS

_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
#: a word: letters and digits with their combining signs; one ideograph or kana is a word
_WORD = re.compile(
    r"[぀-ヿ㐀-鿿]|(?:[^\W_぀-ヿ㐀-鿿]|[̀-ͯऺ-ॏัิ-ฺ็-๎])+"
)
_PLAIN = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words of ``text`` without letter case, spacing, punctuation and markup; null has none."""
    if not text:
        return []
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if text.isascii():
        return _PLAIN.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFC", text).casefold())


def myers_within(pattern: list[int], text: list[int], limit: int) -> bool:
    """Does some stretch of ``text`` lie within ``limit`` edits (of whole words) of
    ``pattern``?  Myers' bit-parallel algorithm."""
    m = len(pattern)
    if m == 0:
        return True
    eq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | (1 << i)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    if score <= limit:
        return True
    for w in text:
        x = eq.get(w, 0) | mv
        d = ((pv + (x & pv)) ^ pv) | x
        hp = mv | (~(d | pv) & mask)
        hn = pv & d
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
            if score <= limit:
                return True
        x = (hp << 1) & mask
        pv = ((hn << 1) | (~(d | x) & mask)) & mask
        mv = d & x
    return False


_MULT = np.uint64(0x9E3779B97F4A7C15)


def _piece_hashes(ids: np.ndarray) -> np.ndarray:
    """Hash of the PIECE word ids that begin at each position."""
    n = len(ids) - PIECE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(PIECE):
            h = (h ^ ids[k : k + n]) * _MULT
            h ^= h >> np.uint64(29)
    return h


class _Ids(dict):
    """64-bit ids of words, remembered; what is remembered is bounded."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) | 1
        return h


class PieceScanner:
    """Pieces of texts, hashed a batch at a time; ``bits`` is the bit set that they must pass, if any."""

    def __init__(self, bits: np.ndarray | None = None) -> None:
        self.ids = _Ids()
        self.bits = bits

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, str, int]]:
        """(number of the text, piece, words around it, place of the piece among them)."""
        docs = [words(t) for t in texts]
        get = self.ids.__getitem__
        sep = [0] * PIECE
        flat: list[int] = []
        starts, lengths = [], []
        for w in docs:
            starts.append(len(flat))
            lengths.append(len(w))
            flat += map(get, w)
            flat += sep
        h = _piece_hashes(np.array(flat, np.uint64))
        if len(h) == 0:
            return
        if self.bits is None:
            pos = np.arange(len(h))
        else:
            k = h & np.uint64(len(self.bits) * 64 - 1)
            pos = np.nonzero((self.bits[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63))) & np.uint64(1))[0]
        owner = np.searchsorted(np.array(starts), pos, side="right") - 1
        inside = pos - np.array(starts)[owner] <= np.array(lengths)[owner] - PIECE
        for n, p, x in zip(owner[inside].tolist(), pos[inside].tolist(), h[pos[inside]].view(np.int64).tolist()):
            p -= starts[n]
            lo = max(0, p - REACH)
            yield n, x, " ".join(docs[n][lo : p + PIECE + REACH]), p - lo


def _pieces(df: DataFrame, key: str, text: str, prefix: str, bits=None) -> DataFrame:
    """(key, piece, <prefix>words, <prefix>at) of every text; ``bits`` a broadcast bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = PieceScanner(None if bits is None else np.frombuffer(bits.value, np.uint64))
        for b in batches:
            keys = b.column(0)
            got = list(zip(*scanner.scan(b.column(1).to_pylist()))) or [[]] * 4
            cols = [keys.take(pa.array(got[0], pa.int64())), pa.array(got[1], pa.int64()), pa.array(got[2], pa.string()), pa.array(got[3], pa.int32())]
            yield pa.record_batch(cols, [key, "piece", f"{prefix}words", f"{prefix}at"])

    t = df.schema[key].dataType.simpleString()
    return df.mapInArrow(run, f"{key} {t}, piece bigint, {prefix}words string, {prefix}at int")


def _bit_set(pieces: DataFrame) -> bytes:
    """The bit set of all pieces: at most ``MAX_BITS`` / 64 numbers come back."""
    n = pieces.count()
    size = 1 << max(10, min(MAX_BITS, BITS_PER_PIECE * n).bit_length() - 1)
    slot = F.expr(f"cast(shiftrightunsigned(piece & {size - 1}L, 6) as int)")
    bit = F.expr("shiftleft(1L, cast(piece & 63L as int))")
    out = np.zeros(size // 64, np.uint64)
    for slot_no, b in pieces.groupBy(slot.alias("s")).agg(F.bit_or(bit).alias("b")).collect():
        out[slot_no] = b & 0xFFFFFFFFFFFFFFFF
    return out.tobytes()


def _holds(item: list[str], q: int, doc: list[str], p: int) -> bool:
    """Does a window of the item around its piece at ``q`` stand in the document around ``p``?"""
    ids: dict[str, int] = {}
    for start in (q, q - PIECE):  # the piece is the window's first or last part
        window = item[start : start + WINDOW] if start >= 0 else []
        if len(window) == WINDOW:
            a = p - (q - start)
            near = doc[max(0, a - ERRORS) : a + WINDOW + ERRORS]
            if myers_within([ids.setdefault(w, len(ids)) for w in window], [ids.setdefault(w, len(ids)) for w in near], ERRORS):
                return True
    return False


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id): documents that hold a passage of the item.

    Null, empty and short texts on either side give no rows; equal items come out
    each under its own id; an empty item table gives no rows; repeated rows count once.
    """
    spark = docs.sparkSession
    own = items.select(F.col(item_id).alias("_item"), F.col(text).alias("_text")).where(F.length(text) > 0).distinct()
    frozen = cut_lineage(_pieces(own, "_item", "_text", "i"))
    bits = spark.sparkContext.broadcast(_bit_set(frozen))
    corpus = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).where(F.length(text) > 0)
    hits = cut_lineage(_pieces(spread(corpus), "_doc", "_text", "d", bits))
    heavy = heavy_keys(hits.groupBy("piece").agg(F.count(F.lit(1)).alias("n")), "piece", "n", hits.count())
    met = join_unique(hits, frozen, "piece", heavy, "inner", ["_doc", "dwords"]).select("_doc", "_item", "dwords", "dat", "iwords", "iat")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dw, da, iw, ia = (b.column(i).to_pylist() for i in range(2, 6))
            ok = pa.array([_holds(w.split(" "), q, x.split(" "), p) for x, p, w, q in zip(dw, da, iw, ia)], pa.bool_())
            yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], [doc_id, item_id])

    types = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}"
    return met.mapInArrow(verify, types).distinct()
