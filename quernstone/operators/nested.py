"""Deeply nested JSON into related flat tables (problem 5).

Structural-variant tables.  A finite tree automaton runs over every JSON value
bottom-up: a leaf's state is its type, an array's state is the set of its
elements' states, an object's the set of its fields with their states.  States are
interned per worker, so the same structural variant is recognised by one
dictionary look-up.  Each (kind, state) is compiled once into a *route*: which of
the object's fields lead to children of which kind, and how the fields fill the
columns of the kind's typed table.  Children are taken along the routes alone, so
an object whose state leads nowhere costs nothing.

All subtype tables share the supertype keys (table_name, record_id, child_kind,
outer_idx, inner_idx), the parent link (parent_kind, and the parent's own indexes)
and the structural variant.  Columns other than the fixed ones are entered by
:func:`array_children`, which gives one row per element of every array at any path.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import spread

#: child kind -> parent kind.  ``record`` is the row itself.
KINDS = {
    "message": "record",
    "part": "message",
    "tool_call": "message",
    "segment": "record",
    "trigger": "segment",
    "xai_token": "record",
    "token": "record",
}
#: which JSON column of which table yields which kinds
COLUMNS = {
    "request_logs": ("request_body", ("message", "part", "tool_call")),
    "detections": ("detail", ("segment", "trigger", "xai_token")),
    "attributions": ("tokens", ("token",)),
}
#: kind -> (path of fields, kind of the children, constructors the value at the path may have; None: any).
#: ``record:<column>`` is the root of a column's value.
STEPS: dict[str, list[tuple[tuple[str, ...], str, tuple[str, ...] | None]]] = {
    "record:request_body": [(("messages",), "message", None)],
    "record:detail": [(("per_segment",), "segment", None), (("xai", "tokens"), "xai_token", None)],
    "record:tokens": [(("tokens",), "token", None)],
    "message": [(("content",), "part", ("a", "o")), (("tool_calls",), "tool_call", None)],
    "segment": [(("triggers",), "trigger", None)],
}
#: typed columns of each subtype: name -> (path of fields, type); an empty path is the child itself
SUBTYPES: dict[str, dict[str, tuple[tuple[str, ...], str]]] = {
    "message": {"role": (("role",), "string"), "content": (("content",), "string"), "tool_call_id": (("tool_call_id",), "string")},
    "part": {"type": (("type",), "string"), "text": (("text",), "string"), "image_url": (("image_url", "url"), "string")},
    "tool_call": {"call_id": (("id",), "string"), "name": (("function", "name"), "string"), "arguments": (("function", "arguments"), "string")},
    "segment": {"idx": (("idx",), "int"), "tag": (("tag",), "string"), "score": (("score",), "double")},
    "trigger": {"trigger": ((), "string")},
    "xai_token": {"token": (("token",), "string"), "score": (("score",), "double")},
    "token": {"token": (("token",), "string"), "score": (("score",), "double")},
}
#: columns of all subtypes together, as they travel in one stream before the rows are routed to their tables
_TYPED = {c: t for cols in SUBTYPES.values() for c, (_, t) in cols.items()}
_KIND_ID = {k: i for i, k in enumerate(KINDS)}


class TreeAutomaton:
    """Deterministic bottom-up tree automaton over JSON values.

    ``delta`` maps (constructor, child states) to a state; unseen combinations get a
    new state.  Of each state are kept its constructor (``l``, ``a``, ``o``), its
    children (state of each field, states of the elements) and its *variant*: the
    fields with their constructors, and a hash of the whole shape, equal on all workers.
    """

    LEAVES = {type(None): "null", bool: "bool", int: "num", float: "num", str: "str"}

    def __init__(self) -> None:
        self.delta: dict[tuple, int] = {}
        self.kind: list[str] = []
        self.kids: list = []
        self.shape: list[str] = []
        self.digest: list[str] = []

    def _new(self, key: tuple, kids, shape: str, term: str) -> int:
        s = self.delta[key] = len(self.kind)
        self.kind.append(key[0])
        self.kids.append(kids)
        self.shape.append(shape)
        self.digest.append(hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest())
        return s

    def brief(self, s: int) -> str:
        """A state's constructor as it stands in its parent's shape."""
        return {"l": self.shape[s], "a": "arr", "o": "obj"}[self.kind[s]]

    def variant(self, s: int) -> str:
        return self.shape[s] if self.kind[s] == "l" else f"{self.shape[s]}#{self.digest[s]}"

    def run(self, v) -> int:
        """State of ``v``; an explicit stack, so depth is bounded by memory only."""
        delta, leaves = self.delta, self.LEAVES
        todo: list[tuple] = [(v, False)]
        done: list[int] = []
        while todo:
            x, ready = todo.pop()
            if isinstance(x, dict):
                if not ready:
                    todo.append((x, True))
                    todo.extend((c, False) for c in x.values())
                    continue
                n = len(x)
                kids = done[len(done) - n :][::-1] if n else []
                del done[len(done) - n :]
                key = ("o", tuple(x), tuple(kids))
                s = delta.get(key)
                if s is None:
                    fields = tuple(sorted(zip(x, kids)))
                    s = delta.get(("o", fields))
                    if s is None:
                        shape = "{" + ",".join(f"{k}:{self.brief(c)}" for k, c in fields) + "}"
                        s = self._new(("o", fields), dict(fields), shape, "{" + ",".join(f"{json.dumps(k)}:{self.digest[c]}" for k, c in fields) + "}")
                    delta[key] = s
            elif isinstance(x, list):
                if not ready:
                    todo.append((x, True))
                    todo.extend((c, False) for c in x)
                    continue
                n = len(x)
                kids = frozenset(done[len(done) - n :]) if n else frozenset()
                del done[len(done) - n :]
                s = delta.get(("a", kids))
                if s is None:
                    shape = "[" + "|".join(sorted({self.brief(c) for c in kids})) + "]"
                    s = self._new(("a", kids), kids, shape, "[" + "|".join(sorted(self.digest[c] for c in kids)) + "]")
            else:
                t = leaves.get(type(x), "str")
                s = delta.get(("l", t))
                if s is None:
                    s = self._new(("l", t), None, t, t)
            done.append(s)
        return done[0]


# ----------------------------------------------------------------------- parsing
_SCALAR = re.compile(r'[ \t\r\n]*(?:("(?:[^"\\\x00-\x1f]|\\.)*")|([{}\[\],:])|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity))')


def parse_deep(text: str):
    """``json.loads`` with an explicit stack, for values nested deeper than recursion allows."""
    root: list = []
    stack: list = [root]
    keys: list = [None]
    want, pos, n = "v", 0, len(text)
    while True:
        m = _SCALAR.match(text, pos)
        if m is None:
            if want == "e" and not text[pos:].strip(" \t\r\n"):
                return root[0]
            raise ValueError("broken JSON")
        pos = m.end()
        s, p, w = m.groups()
        top = stack[-1]
        if p == "," and want == "," :
            want = "k" if isinstance(top, dict) else "v"
        elif p == ":" and want == ":":
            want = "v"
        elif p in ("}", "]") and p and (want == "," or want == ("K" if p == "}" else "V")) and isinstance(top, dict) == (p == "}") and top is not root:
            stack.pop()
            keys.pop()
            want = "e" if stack[-1] is root else ","
        elif s is not None and want in "kK":
            keys[-1] = json.loads(s)
            want = ":"
        elif want in "vV" and (p in ("{", "[") or p is None):
            v = {} if p == "{" else [] if p == "[" else json.loads(s or w)
            if isinstance(top, dict):
                top[keys[-1]] = v
            else:
                top.append(v)
            if p:
                stack.append(v)
                keys.append(None)
                want = "K" if p == "{" else "V"
            else:
                want = "e" if top is root else ","
        else:
            raise ValueError("broken JSON")


def parse(text: str | None):
    """The JSON in ``text``; a JSON string is read as the JSON in it, however often it was
    wrapped.  Null and broken JSON give None; depth is bounded by memory only."""
    v = text
    while isinstance(v, str):
        try:
            v = json.loads(v)
        except RecursionError:
            try:
                v = parse_deep(v)
            except ValueError:
                return None
        except ValueError:
            return None
    return v


def dump(v) -> str:
    """JSON text of a value; deep values are written with an explicit stack."""
    try:
        return json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        pass
    out: list[str] = []
    todo: list = [v]
    while todo:
        x = todo.pop()
        if isinstance(x, _Raw):
            out.append(x.text)
        elif isinstance(x, dict):
            todo.append(_Raw("}"))
            for i, (k, c) in reversed(list(enumerate(x.items()))):
                todo += (c, _Raw(("," if i else "") + json.dumps(k, ensure_ascii=False) + ":"))
            todo.append(_Raw("{"))
        elif isinstance(x, list):
            todo.append(_Raw("]"))
            for i, c in reversed(list(enumerate(x))):
                todo += (c, _Raw("," if i else ""))
            todo.append(_Raw("["))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


class _Raw:
    __slots__ = ("text",)

    def __init__(self, text: str) -> None:
        self.text = text


# ----------------------------------------------------------------------- routing
def items(v) -> Iterator[tuple[int, object]]:
    """(position, value) of an array without its nulls; a single value is element 0."""
    if isinstance(v, list):
        for i, x in enumerate(v):
            if x is not None:
                yield i, x
    elif v is not None:
        yield 0, v


def _at(v, path: tuple[str, ...]):
    for k in path:
        v = v[k]
    return v


def _typed(t: str) -> Callable:
    """Conversion of a JSON value to a column of type ``t``; what does not fit gives null."""

    def string(v):
        return v if v is None or isinstance(v, str) else dump(v)

    def number(v):
        try:
            f = float(v) if isinstance(v, (int, float, str)) and not isinstance(v, bool) else None
            return None if f is None else int(f) if t == "int" and abs(f) < 2**31 else f if t == "double" else None
        except (ValueError, OverflowError):
            return None

    return string if t == "string" else number


_CONVERT = {c: _typed(t) for c, t in _TYPED.items()}


class Router:
    """Routes of structural variants, compiled once for each (kind, state)."""

    def __init__(self, typed: bool = True) -> None:
        self.automaton = TreeAutomaton()
        self.typed = typed
        self._steps: dict[tuple[str, int], list] = {}
        self._columns: dict[tuple[str, int], list] = {}

    def _reach(self, state: int, path: tuple[str, ...]) -> int | None:
        """State at the end of ``path``, None if an object of this shape has no such field."""
        a = self.automaton
        for k in path:
            state = a.kids[state].get(k) if a.kind[state] == "o" else None
            if state is None:
                return None
        return state

    def steps(self, kind: str, state: int) -> list[tuple[tuple[str, ...], str]]:
        got = self._steps.get((kind, state))
        if got is None:
            got = []
            for path, child, forms in STEPS.get(kind, ()):
                end = self._reach(state, path)
                if end is not None and (forms is None or self.automaton.kind[end] in forms) and self.automaton.shape[end] != "null":
                    got.append((path, child))
            if kind == "record:tokens" and not (self.automaton.kind[state] == "o" and "tokens" in self.automaton.kids[state]):
                got.append(((), "token"))  # the column is the list itself
            self._steps[kind, state] = got
        return got

    def columns(self, kind: str, state: int) -> list[tuple[str, tuple[str, ...]]]:
        """Typed columns that a child of this shape fills: (name, path)."""
        got = self._columns.get((kind, state))
        if got is None:
            got = self._columns[kind, state] = [(c, path) for c, (path, _) in SUBTYPES[kind].items() if self._reach(state, path) is not None]
        return got

    def children(self, column: str, root) -> Iterator[tuple]:
        """(kind, outer_idx, inner_idx, state, value) along the routes of the root's state."""
        if root is None:
            return
        run, steps = self.automaton.run, self.steps
        for path, kind in steps("record:" + column, run(root)):
            for i, v in items(_at(root, path)):
                s = run(v)
                yield kind, i, -1, s, v
                for sub, child in steps(kind, s):
                    for j, w in items(_at(v, sub)):
                        yield child, i, j, run(w) if self.typed else -1, w

    def rows(self, column: str, root) -> list[dict]:
        out = []
        for kind, i, j, s, v in self.children(column, root):
            row = {"kind": _KIND_ID[kind], "outer_idx": i, "inner_idx": j}
            if self.typed:
                row["variant"] = self.automaton.variant(s)
                for c, path in self.columns(kind, s):
                    row[c] = _CONVERT[c](_at(v, path))
            out.append(row)
        return out


def children(df: DataFrame, table_name: str, column: str, id_col: str = "id", at_col: str | None = "created_at", typed: bool = True) -> DataFrame:
    """Supertype table of the children of ``column``: (table_name, record_id, child_kind,
    parent_kind, outer_idx, inner_idx[, variant, typed columns of all subtypes]).

    Null and broken JSON gives no rows; nulls inside give none but keep their position.
    An id that was delivered again counts once: of its versions that have children the one
    with the latest ``at_col``, then the greatest hash of its text, stands as a whole, so
    that no child meets the parent of another version.  The children of a record travel as
    one array: the shuffle that picks the version moves one row per record, reduced
    map-side.  An empty table gives no rows; other columns of ``df`` are not read.
    ``typed=False`` leaves out variant and typed columns of children.
    """
    at = F.col(at_col).cast("timestamp") if at_col in df.columns else F.lit(None).cast("timestamp")
    parts = [("kind", "tinyint", pa.int8()), ("outer_idx", "int", pa.int32()), ("inner_idx", "int", pa.int32())]
    if typed:
        arrow = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
        parts += [("variant", "string", pa.string()), *((c, t, arrow[t]) for c, t in _TYPED.items())]
    struct = pa.list_(pa.struct([(n, t) for n, _, t in parts]))
    ddl = "record_id string, version bigint, kids array<struct<" + ",".join(f"{n}:{t}" for n, t, _ in parts) + ">>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router(typed)
        for b in batches:
            ids, versions, out = [], [], []
            for rid, version, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                got = router.rows(column, parse(text))
                if got:
                    ids.append(rid)
                    versions.append(version)
                    out.append(got)
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(versions, pa.int64()), pa.array(out, struct)], ["record_id", "version", "kids"])

    version = F.coalesce(F.unix_micros(at), F.lit(-(1 << 62)))
    source = df.select(F.col(id_col).cast("string").alias("record_id"), version.alias("version"), F.col(column).alias("j")).where("j is not null")
    per_record = spread(source).mapInArrow(run, ddl)
    one = per_record.groupBy("record_id").agg(F.max_by("kids", F.struct("version", F.xxhash64("kids"))).alias("kids"))
    names, parents = F.array(*[F.lit(k) for k in KINDS]), F.array(*[F.lit(p) for p in KINDS.values()])
    return one.select("record_id", F.explode("kids").alias("c")).select(
        F.lit(table_name).alias("table_name"),
        "record_id",
        F.element_at(names, F.col("c.kind") + 1).alias("child_kind"),
        F.element_at(parents, F.col("c.kind") + 1).alias("parent_kind"),
        *[F.col(f"c.{n}").alias(n) for n, _, _ in parts[1:]],
    )


KEYS = ("table_name", "record_id", "child_kind", "outer_idx", "inner_idx")


def subtype_table(kids: DataFrame, kind: str) -> DataFrame:
    """The typed table of one subtype: supertype keys, parent link and the kind's columns.
    The parent of a row has its record_id and, unless it is the record, its outer_idx and
    inner_idx -1."""
    return kids.where(F.col("child_kind") == kind).select("table_name", "record_id", "outer_idx", "inner_idx", "parent_kind", "variant", *SUBTYPES[kind])


def write_tables(kids: DataFrame, path: str) -> None:
    """All subtype tables in one pass, a folder each (``child_kind=...``)."""
    kids.write.mode("overwrite").partitionBy("child_kind").parquet(path)


def read_subtype(spark, path: str, kind: str) -> DataFrame:
    """A written subtype table; only its folder and columns are read."""
    return subtype_table(spark.read.parquet(path), kind)


def all_children(tables: dict[str, DataFrame], typed: bool = True) -> DataFrame:
    """Children of all nested columns."""
    return reduce(DataFrame.unionByName, [children(df, name, COLUMNS[name][0], typed=typed) for name, df in tables.items()])


def array_children(df: DataFrame, column: str, id_col: str = "id") -> DataFrame:
    """(record_id, path, position, parent_path, parent_position, variant, body) of every
    array at any path of any JSON column: one row per element.

    ``path`` names the fields from the root, ``[]`` an element of an array; ``position`` the
    indexes along it, as text.  Nulls give no row but keep their position; null and broken
    JSON gives none; rows repeat as the input repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TreeAutomaton()
        for b in batches:
            rows: list[tuple] = []
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                todo = [(parse(text), "$", "", "", "")]
                while todo:
                    v, path, at, parent, parent_at = todo.pop()
                    if isinstance(v, dict):
                        todo.extend((c, f"{path}.{k}", at, parent, parent_at) for k, c in v.items())
                    elif isinstance(v, list):
                        here = f"{path}[]"
                        for i, c in enumerate(v):
                            if c is not None:
                                pos = f"{at}.{i}" if at else str(i)
                                rows.append((rid, here, pos, parent, parent_at, automaton.variant(automaton.run(c)), dump(c)))
                                todo.append((c, here, pos, here, pos))
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.record_batch([pa.array(c, pa.string()) for c in cols], ["record_id", "path", "position", "parent_path", "parent_position", "variant", "body"])

    schema = "record_id string, path string, position string, parent_path string, parent_position string, variant string, body string"
    return spread(df.select(F.col(id_col).cast("string").alias("record_id"), F.col(column).alias("j")).where("j is not null")).mapInArrow(run, schema)
