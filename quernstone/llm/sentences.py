"""Sentence units across languages and scripts (problem 10).

Document-centred disambiguation.  A full stop after a token that may be an
abbreviation is decided by the first of these that says anything:

1. unambiguous occurrences elsewhere in the same document.  The token followed by a
   full stop and a lower-case word or comma, and never without a full stop, shows an
   abbreviation; the token without a full stop, and never with one before a
   lower-case word, shows an ordinary word, whose full stop ends a sentence.  The
   next word seen capitalised inside a sentence, and never in lower case, shows a
   proper name, before which an abbreviation ends nothing; the next word seen in
   lower case shows that its capital begins a sentence;
2. corpus fallback: tokens whose full stop is, over the whole corpus, nearly always
   followed by a lower-case word (:func:`corpus_abbreviations`);
3. fixed lists of titles, inner and numbered abbreviations.

All other terminators follow rules of their script: danda for Devanagari,
ideographic stops for Chinese and Japanese (no space needed), spaces for Thai.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.skew import heavy_keys, join_unique
from quernstone.session import BROADCAST_ROWS, cut_lineage, spread

# Abbreviations by behaviour, lower case, without the last full stop.
#: stand before a name or number; their full stop never ends a sentence
TITLES = frozenset(
    "mr mrs ms dr prof sr sra srta dra st mme mlle hr fr herr frau gen col lt capt sgt rev hon sen rep gov pres "
    "dipl ing г-н г-жа д-р проф акад ул пр пер наб им гр тов डॉ श्री प्रो".split()
)
#: need something after them; their full stop never ends a sentence
INNER = frozenset("e.g i.e cf vs viz approx ca circa bzw z d p т п см ср напр vgl sog inkl exkl ggf z.b d.h u.a т.е p.ej p.ex".split())
#: stand before a number; before anything else their full stop may end a sentence
NUMBERED = frozenset("no nos nr núm sec sect fig figs eq ch chap vol pp pág cap art abs abb kap tab рис стр гл табл ст tel".split())
#: may stand inside a sentence or end one
EITHER = frozenset(
    "etc usw inc ltd corp co jr bros al ed ex max min dept ref evtl u.s u.k u.n a.m p.m st.p д др г гг в вв е h b ej m".split()
)
MONTHS = frozenset(
    "jan feb mar apr jun jul aug sep sept oct nov dec januar februar märz april mai juni juli august september "
    "oktober november dezember".split()
)

_OPEN = "\"'“”„«»‘’‹›(（[【「『{*_`~#¿¡"
_CLOSE = "\"'”’»›)）\\]】」』}*_`~"
_STOPS = ".!?…؟۔।॥。！？｡．"
#: terminator run with its closers, outside or inside quotations; a leading character
#: set lets the engine skip to the next terminator
_TERM = re.compile("[" + _STOPS + "][" + _STOPS + "]*[" + _CLOSE + r"]*(?:\s+»)?")
_TERM_LOW = re.compile("[" + _STOPS + "]+“")
_THAI = re.compile("[฀-๿]")
_THAI_GAP = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿A-Z\"“(])")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_MARKER = re.compile(r"(?:^|\n)[^\S\n]*((?:[-*+•‣◦▪–—]|#{1,6})(?=[^\S\n])|\(?(\d{1,3}|[a-zA-Zа-яА-Я])[.)](?=[^\S\n]))")
_PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "“": "”", "«": "»", "‹": "›"}
_QUOTE_CHARS = re.compile(r"[\"“”„«»()（）\[\]【】「」『』‹›]")
_LEFT = "\"'“”„«»‘’‹›(（[【「『{*_`~#¿¡—–-/"
_CJK = re.compile(r"[　-ヿ㐀-鿿＀-ﾟ]")


def _protected(par: str) -> list[tuple[int, int]]:
    """Spans of quotations and brackets that close within the paragraph."""
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    awaited: Counter = Counter()  # closers of what is open
    straight = -1
    for m in _QUOTE_CHARS.finditer(par):
        c, i = m.group(), m.start()
        if c == '"':
            if straight < 0:
                straight = i
            else:
                spans.append((straight, i))
                straight = -1
        elif c == "„":
            stack.append(("“”", i))
            awaited.update("“”")
        elif stack and c in stack[-1][0]:
            closers, a = stack.pop()
            awaited.subtract(closers)
            spans.append((a, i))
        elif c in _PAIRS:
            stack.append((_PAIRS[c], i))
            awaited[_PAIRS[c]] += 1
        elif awaited[c] > 0:
            while True:  # what was opened inside stays open for good
                closers, a = stack.pop()
                awaited.subtract(closers)
                if c in closers:
                    spans.append((a, i))
                    break
    spans.sort()
    return spans


_EVIDENCE = re.compile(r"(?<!\w)([^\W\d_]{1,6}(?:\.[^\W\d_]{1,3})*)\.(?:,|[^\S\n]+[a-zа-яёß-öø-ÿ])")
_PLAIN = re.compile(r"(?<!\w)[^\W\d_]{1,8}(?![\w.])")
_MID_CAPITAL = re.compile(r"(?:(?<=[^\W\d_] )|(?<=, ))[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][^\W\d_]*(?!\w)")
_NEXT_WORD = re.compile(r"[^\W\d_]+")


class Document:
    """Evidence from one document, collected in one pass over it when first asked for."""

    __slots__ = ("text", "_abbr", "_plain", "_plain_low", "_words", "_mid")

    def __init__(self, text: str) -> None:
        self.text = text
        self._abbr: set[str] | None = None
        self._words: set[str] | None = None

    def _tokens(self) -> set[str]:
        if self._abbr is None:
            self._abbr = {t.lower() for t in _EVIDENCE.findall(self.text)}
            self._plain = set(_PLAIN.findall(self.text))
            self._plain_low = {t.lower() for t in self._plain}
        return self._abbr

    def _names(self) -> set[str]:
        if self._words is None:
            text = self.text
            self._words = set(_NEXT_WORD.findall(text))
            self._mid = {m.group() for m in _MID_CAPITAL.finditer(text) if text[m.start() - 2] == "," or text[m.start() - 2].islower()}
        return self._words

    def abbreviation(self, tok: str) -> bool:
        """The token's full stop is followed by a lower-case word or comma elsewhere,
        and the token never stands without a full stop."""
        return tok.lower() in self._tokens() and tok.lower() not in self._plain_low

    def ordinary(self, tok: str) -> bool:
        """The token stands without a full stop, and never with one before a lower-case word."""
        return tok.lower() not in self._tokens() and tok in self._plain

    def proper_name(self, word: str) -> bool:
        """The word stands capitalised after a lower-case word, and never in lower case."""
        words, low = self._names(), word.lower()
        return word in self._mid and (low == word or low not in words)

    def common(self, word: str) -> bool:
        """The word stands in lower case."""
        return word.lower() in self._names()


def _ends(doc: Document, par: str, m: re.Match, start: int, corpus: frozenset) -> bool:
    """Does the terminator ``m`` (outside quotations) end a sentence?"""
    end, n = m.end(), len(par)
    mark = m.group()
    if end >= n:
        return False  # the paragraph ends it anyway
    nxt = par[end]
    c0 = mark[0]
    if c0 in "।॥":
        return True
    if c0 in "。！？｡．":
        return mark[-1] not in "」』”’»\"" or nxt == "\n"
    spaced = nxt.isspace()
    k = end
    while k < n and (par[k].isspace() or par[k] in _OPEN):
        k += 1
    if k >= n:
        return spaced
    follow = par[k]
    if c0 in "؟۔":
        return spaced
    if not spaced:
        # missing space: only a lower-case word, digit or closer before, a capitalised word after
        if not (follow.isupper() and k == end or (c0 in "!?" and _CJK.match(follow))):
            return False
        if c0 in ".…" and not (m.start() > start and (par[m.start() - 1].islower() or par[m.start() - 1].isdigit())):
            return False
        if c0 == "." and k + 1 < n and not (par[k + 1].islower() or par[k + 1] in ". "):
            return False
        if c0 == "." and par[m.start() - 1].isdigit() and not (k + 1 < n and par[k + 1].islower()):
            return False
    elif follow.islower():
        return False
    elif follow in "—–-" and not par[end:k].count("\n"):
        return False
    if c0 in "!?…" or len(mark) > 1 and mark[1] in ".!?":
        return follow.isupper() or not follow.isalpha() or not follow.islower() and follow.isalpha()
    if mark[0] == "." and len(mark) > 1:  # closers after the stop: the unit is complete
        return True
    # a single full stop
    seg = par[max(start, m.start() - 24) : m.start()].rsplit(None, 1)
    tok = seg[-1].lstrip(_LEFT) if seg else ""
    if "'" in tok or "’" in tok:
        tok = tok.replace("’", "'").rpartition("'")[2]
    if len(tok) > 8 or not tok:
        return True
    low = tok.lower()
    nw = _NEXT_WORD.match(par, k)
    if tok.isdigit():
        if m.start() - len(tok) <= start:
            return False  # an item number belongs to its sentence
        return not (len(tok) <= 2 and nw and nw.group().lower() in MONTHS)
    if len(tok) == 1 and tok.isupper():
        return False  # initial
    if "ऀ" <= tok[0] <= "ॿ":
        return low not in TITLES and len(tok) > 3
    word = nw.group() if nw else ""
    # 1. the document
    shown = len(tok) > 1 and tok.isalpha() and doc.abbreviation(tok)
    if word:
        if shown:
            if doc.proper_name(word):
                return False
            if doc.common(word):
                return True
        elif len(tok) > 1 and tok.isalpha() and doc.ordinary(tok):
            return True
    elif shown:
        return False  # before a number
    # 2. the corpus
    if low in corpus:
        return False
    # 3. fixed lists
    if follow.isdigit() and (low in MONTHS or low in NUMBERED or low in INNER or low in EITHER):
        return False
    if low in TITLES and (tok != low or not tok.isascii()):  # ms. is no title, Ms. is
        return False
    if low in INNER or low in MONTHS:
        return False
    if len(tok) == 1 and low not in EITHER:  # single lower-case letters: part of d. h., т. е., p. ej. and the like
        return False
    if low in EITHER or low in NUMBERED or shown or (len(tok) <= 6 and "." in tok):
        return not doc.proper_name(word)
    return True


def sentence_spans(text: str | None, corpus: frozenset = frozenset()) -> list[tuple[int, int]]:
    """(start, end) of every sentence of ``text`` in code points.

    Null, empty and blank texts have none.  Spans do not overlap and leave out only
    white space.
    """
    if not text or text.isspace():
        return []
    doc = Document(text)
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    pos = 0
    bounds = [(m.start(), m.end()) for m in _BLANK.finditer(text)] if "\n" in text else []
    bounds.append((len(text), len(text)))
    for b0, b1 in bounds:
        _paragraph(doc, text[pos:b0], pos, corpus, add)
        pos = b1
    return out


def _list_starts(par: str) -> list[int]:
    """Starts of lines that open with a list marker.  A number opens an item at the
    head of a paragraph, after another item, or when it continues a count, so that a
    hard-wrapped line that happens to begin with a number does not."""
    starts, last = [], None
    first = len(par) - len(par.lstrip())
    for m in _MARKER.finditer(par):
        mark, num = m.group(1), m.group(2)
        head = m.start() <= first
        if num is not None:
            if num.isdigit():
                v = int(num)
                if not (head or v == 1 or (last is not None and v == last + 1)):
                    continue
                last = v
            elif not (head or "(" in mark or ")" in mark):
                continue
            elif num.isupper() and mark.endswith("."):
                continue
        starts.append(m.start(1))
    return starts


def _paragraph(doc: Document, par: str, base: int, corpus: frozenset, add) -> None:
    if not par or par.isspace():
        return
    if not par.isascii() and _THAI.search(par):
        gaps = [m.start() for m in _THAI_GAP.finditer(par)]
        if gaps:
            spans = _protected(par)
            pos = 0
            for g in [*(g for g in gaps if not any(a < g < b for a, b in spans)), len(par)]:
                _lines(doc, par[pos:g], base + pos, corpus, add)
                pos = g
            return
    _lines(doc, par, base, corpus, add)


def _lines(doc: Document, par: str, base: int, corpus: frozenset, add) -> None:
    if "\n" in par:
        first = len(par) - len(par.lstrip())
        cuts = [s for s in _list_starts(par) if s > first]
        if cuts:
            pos = 0
            for c in [*cuts, len(par)]:
                _block(doc, par[pos:c], base + pos, corpus, add)
                pos = c
            return
    _block(doc, par, base, corpus, add)


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _block(doc: Document, par: str, base: int, corpus: frozenset, add) -> None:
    spans = _protected(par) if _QUOTE_CHARS.search(par) else []
    ends = {b for _, b in spans}
    spans = _united(spans)
    start = 0
    lead = _MARKER.match(par)
    for m in _TERM.finditer(par, lead.end() if lead else 0):
        if spans:
            i, e = m.start(), m.end()
            k = bisect_left(spans, (i,)) - 1
            if k >= 0 and i < spans[k][1] and e <= spans[k][1]:
                if not (e < len(par) and par[e] == "“" and e in ends):
                    continue
                m = _TERM_LOW.match(par, i)  # a German quotation closes with the opening mark of others
        if _ends(doc, par, m, start, corpus):
            e = m.end()
            add(base + start, base + e)
            start = e
    add(base + start, base + len(par))


#: occurrences before a lower-case word that a token needs to enter the corpus fallback, and their share
LEAST, SHARE = 3, 0.9


def corpus_abbreviations(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(tok): tokens of up to six letters whose full stop is followed by a lower-case word
    in at least ``SHARE`` of its occurrences before words, and ``LEAST`` times or more,
    counted over all documents inside the JVM, reduced map-side."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(r"(?<![\p{L}\p{N}])(\p{L}{1,6}\.[^\S\n]+[\p{Ll}\p{Lu}])"), F.lit(1))
    hits = docs.where(F.col(text_col).isNotNull()).select(F.explode(found).alias("h"))
    # token and what follows: an l(ower case) or another letter
    short = hits.select(F.lower(F.substring_index("h", ".", 1)).alias("tok"), F.col("h").rlike(r"\p{Ll}$").alias("l"))
    return (
        short.groupBy("tok", "l").count()
        .groupBy("tok").agg(F.sum(F.when(F.col("l"), F.col("count")).otherwise(0)).alias("low"), F.sum("count").alias("n"))
        .where((F.col("low") >= SHARE * F.col("n")) & (F.col("low") >= LEAST)).select("tok")
    )


def _asked(docs: DataFrame, corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens): the corpus's tokens that a document asks about, by a shuffle join."""
    found = F.regexp_extract_all(F.lower(text_col), F.lit(r"(?<![\p{L}\p{N}])(\p{L}{1,6})\.\s"), F.lit(1))
    pairs = docs.select(F.col(id_col).alias("_id"), F.explode(F.array_distinct(found)).alias("tok"))
    counts = pairs.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    heavy = heavy_keys(counts, "tok", "n", docs.count())
    return join_unique(pairs, corpus, "tok", heavy, "inner").groupBy("_id").agg(F.collect_set("tok").alias("_tokens"))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = BROADCAST_ROWS) -> DataFrame:
    """(id, start_pos, end_pos): one row per sentence of every document.

    Null and empty texts give no rows; other columns of ``docs`` are not read.  The
    corpus's tokens are sent to all workers if there are at most ``held`` of them; more
    are joined to the documents that ask about them, with the same result.
    """
    source = docs.select(id_col, text_col)
    table = cut_lineage(corpus_abbreviations(docs, text_col))
    few = table.count() <= held
    known = frozenset(r[0] for r in table.collect()) if few else frozenset()
    if not few:
        asked = _asked(source, table, id_col, text_col)
        source = source.join(asked, F.col(id_col).eqNullSafe(F.col("_id")), "left").select(id_col, text_col, "_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, a, e = [], [], []
            own = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            for i, t, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), own):
                spans = sentence_spans(t, known if few else frozenset(tokens or ()))
                ids.extend([i] * len(spans))
                a.extend([s[0] for s in spans])
                e.extend([s[1] for s in spans])
            yield pa.record_batch([pa.array(ids, b.schema.field(0).type), pa.array(a, pa.int32()), pa.array(e, pa.int32())], [id_col, "start_pos", "end_pos"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return spread(source).mapInArrow(run, f"{id_col} {id_type}, start_pos int, end_pos int")
