"""Duplicates hidden by formatting differences (problem 2).

Each record becomes a multiset of (field name, value) pairs with white space,
letter case and punctuation taken out; the fields of nested objects count under
their path, so their order is disregarded at every depth.  Every pair is hashed, and
the hashes are combined by addition modulo 2**64 in two independent lanes: a
commutative multiset hash that does not depend on field order and needs no sorting.
Records are grouped by fingerprint and the fields of every record are compared with
those of the group's keeper.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.skew import heavy_keys, join_unique
from quernstone.session import cut_lineage, spread

_SYMBOLS = "$+<=>^`|~"
#: a mark counts as content only directly between two digits
_MARK = re.compile(r"(?<=\d)([^\w\s]|_)+(?=\d)")
#: name and value of one field of a list: parted at the first colon
_PIECE = re.compile(r"\s*([^\W\d][\w \t-]*)[ \t]*:(.*)", re.S)
#: what parts the fields of a list; the first that leaves nothing but fields holds
_SEPARATORS = tuple(re.compile(x) for x in (r"\s*[;\n]\s*", r"\s*\|\s*", r"\s*,\s*"))


def _droppable(c: str) -> bool:
    return c.isspace() or c in _SYMBOLS or unicodedata.category(c)[0] == "P" or c in "\x1c\x1d\x1e\x1f\x85"


class _Drop(dict):
    """Translation table that learns which characters to drop."""

    def __missing__(self, k: int):
        c = chr(k)
        self[k] = v = None if _droppable(c) else c
        return v


_TABLE = _Drop()


def squeeze(s: str) -> str:
    """``s`` without white space, letter case and punctuation; marks between digits,
    letters, accents and digits stay."""
    if not s.isascii():
        s = unicodedata.normalize("NFC", s)
    s = s.casefold()
    if _MARK.search(s):
        out, pos = [], 0
        for m in _MARK.finditer(s):
            out += (s[pos : m.start()].translate(_TABLE), m.group())
            pos = m.end()
        out.append(s[pos:].translate(_TABLE))
        return "".join(out)
    return s.translate(_TABLE)


class _Object(list):
    """(name, value) pairs of a JSON object, repeated names included."""


def _flat(v, path: str) -> list[tuple[str, str]]:
    """(path, value) pairs of a JSON value: names and places on the way to every scalar."""
    out: list[tuple[str, str]] = []
    todo = [(v, path)]
    while todo:
        x, p = todo.pop()
        if isinstance(x, _Object):
            todo += [(c, f"{p}\x1d{squeeze(k)}") for k, c in x] or [("{}", p + "\x1d")]
        elif isinstance(x, list):
            todo += [(c, f"{p}\x1c{i}") for i, c in enumerate(x)] or [("[]", p + "\x1c")]
        else:
            out.append((p, x if isinstance(x, str) else json.dumps(x)))
    return out


def fields(text: str) -> list[tuple[str, str]] | None:
    """(name, value) pairs of a JSON object or a ``key: value`` list, else None.

    Names come squeezed.  An object nested too deep for the parser is plain text.
    """
    t = text.strip()
    if t[:1] == "{":
        try:
            v = json.loads(t, object_pairs_hook=_Object, parse_int=str, parse_float=str, parse_constant=str)
        except (ValueError, RecursionError):
            return None
        return [(p[1:], x) for p, x in _flat(v, "")]
    if ":" not in t:
        return None
    for sep in _SEPARATORS:
        pieces = [p for p in sep.split(t) if p]
        if len(pieces) > 1:
            found = [_PIECE.fullmatch(p) for p in pieces]
            if all(found):
                return [(squeeze(m.group(1)), m.group(2)) for m in found]
    return None


def canonical(text: str | None, label: str | None) -> list[str]:
    """Normalised fields of a record; null and empty texts have one empty field."""
    text = text or ""
    f = fields(text) if text else None
    pairs = [f"{k}\x1f{squeeze(v)}" for k, v in f] if f else ["\x1f" + squeeze(text)]
    return [*pairs, "\x1e" + squeeze(label or "")]


_M = (1 << 64) - 1


def fingerprint(pairs: list[str]) -> tuple[int, int]:
    """Commutative multiset hash: two 64-bit lanes, each the sum of the pairs' hashes."""
    a = b = 0
    for p in pairs:
        h = xxhash.xxh3_128_intdigest(p.encode("utf-8", "surrogatepass"))
        a += h & _M
        b += h >> 64
    return _signed(a & _M), _signed(b & _M)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(df: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "label") -> DataFrame:
    """(id, fp_a, fp_b, fields) of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cs = [canonical(t, l) for t, l in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            fps = [fingerprint(c) for c in cs]
            yield pa.record_batch(
                [
                    b.column(0).cast(pa.string()),
                    pa.array([f"{x & _M:016x}{y & _M:016x}" for x, y in fps], pa.string()),
                    pa.array(cs, pa.list_(pa.string())),
                ],
                ["id", "fp", "fields"],
            )

    return spread(df.select(F.col(id_col).cast("string"), text_col, label_col)).mapInArrow(run, "id string, fp string, fields array<string>")


def _same_fields() -> F.Column:
    """Equality of the two field multisets, without sorting: equal sizes and no field
    on one side only (counts are fixed by the multiset hash)."""
    return (
        (F.size("fields") == F.size("keep_fields"))
        & (F.size(F.array_except("fields", "keep_fields")) == 0)
        & (F.size(F.array_except("keep_fields", "fields")) == 0)
    )


def copies(records: DataFrame, total: int | None = None) -> DataFrame:
    """(keep_id, copy_id): every record of a group of two or more but its keeper.

    ``records`` comes from :func:`keyed`; it is read once.  ``total`` is the number of
    records, where it is known without reading them.

    Null texts equal each other and empty texts; null labels equal empty labels;
    repeated rows with one id are one record.  Hot groups are salted, see
    :mod:`quernstone.operators.skew`.
    """
    records = cut_lineage(records)
    multi = records.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    heavy = heavy_keys(multi, "fp", "n", records.count() if total is None else total)
    # only members of groups go on; keepers' fields meet them in a second, much smaller join
    members = cut_lineage(join_unique(records, multi.select("fp"), "fp", heavy, "inner", ["id"]))
    first = members.groupBy("fp").agg(F.min("id").alias("keep_id"))
    keepers = join_unique(members, first, "fp", heavy, "inner", ["id"]).where("id = keep_id")
    keepers = keepers.select("fp", "keep_id", F.col("fields").alias("keep_fields")).dropDuplicates(["fp"])
    met = join_unique(members, keepers, "fp", heavy, "inner", ["id"])
    return met.where((F.col("id") > F.col("keep_id")) & _same_fields()).select("keep_id", F.col("id").alias("copy_id")).distinct()


def groups(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, n_copies): every record of ``records`` that is no copy by ``pairs`` (from
    :func:`copies`, fields compared), with the number of records it stands for, itself
    included.  Counts reduce map-side."""
    n = pairs.groupBy(F.col("keep_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    kept = records.select("id").distinct().join(pairs.select(F.col("copy_id").alias("id")), "id", "left_anti")
    return kept.join(n, "id", "left").select("id", (F.coalesce("n", F.lit(0)) + 1).alias("n_copies"))
