"""Visually identical text with different characters (problem 4).

DuckDB runs inside the Arrow partitions: one embedded SQL expression takes out
invisible characters, maps compatibility forms, spaces and look-alike letters
(``translate``), composes accents (``nfc_normalize``) and collapses white space
(``regexp_replace``).  The result, the *form*, is equal for texts that look the
same; letter case, punctuation and accents are left alone.  The form writes every
look-alike letter as the Latin one and is a key for comparison; the *readable* text
keeps the letters of Cyrillic words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.skew import heavy_keys, join_unique
from quernstone.session import cut_lineage, spread

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = "аеорсухіїѕјһԁԛԝӏѵёАВЕЗКМНОРСТУХІЇЅЈԚԜӀҮѴЁ"
CYR_LATIN = "aeopcyxiïsjhdqwlvëABE3KMHOPCTYXIÏSJQWIYVË"
GREEK = "οινρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GRK_LATIN = "oivpuABEZHIKMNOPTYX"
ARMENIAN = "օսհոցՕՏՍԼ"
ARM_LATIN = "ouhngOSUL"
CHEROKEE = "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ"
CHR_LATIN = "ABCDEHJKLMPRSTVWZ"
#: other letter forms: dotless and script letters, letter-like numerals of other blocks
OTHER = "ɡıɑⅼⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅽⅾⅿ"
OTH_LATIN = "gialIVXLCDMivxcdm"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
HYPHENS = "\u2010\u2011"
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}]"



def _compatibility() -> tuple[str, str]:
    """Characters that are another one in other width or typeface (full-width, half-width,
    mathematical letters), by the Unicode tables, and what they are.  Raised, lowered,
    circled and squared forms look different and stay."""
    found = []
    for c in map(chr, range(0x80, 0x20000)):
        tag, _, rest = unicodedata.decomposition(c).partition(" ")
        if tag in ("<font>", "<wide>", "<narrow>") and " " not in rest:
            found.append((c, unicodedata.normalize("NFKC", c)))
    return "".join(c for c, k in found if len(k) == 1), "".join(k for _, k in found if len(k) == 1)


COMPATIBLE, COMP_PLAIN = _compatibility()
_LOOK = (CYRILLIC + GREEK + ARMENIAN + CHEROKEE + OTHER, CYR_LATIN + GRK_LATIN + ARM_LATIN + CHR_LATIN + OTH_LATIN)
_SPACES = (SPACES + HYPHENS, " " * len(SPACES) + "-" * len(HYPHENS))
#: everything at once, for one-step translation outside SQL
_FROM = _LOOK[0] + _SPACES[0] + COMPATIBLE
_TO = _LOOK[1] + _SPACES[1] + COMP_PLAIN.translate(str.maketrans(*_LOOK))
assert len(_FROM) == len(_TO)
#: Cyrillic letters for Latin ones, for words that are Cyrillic
_TO_CYRILLIC = ("aeopcyxijsABEKMHOPCTYXI", "аеорсухіјѕАВЕКМНОРСТУХІ")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _clean_sql(col: str) -> str:
    e = f"regexp_replace({col}, '{INVISIBLE}', '', 'g')"
    for lig, plain in LIGATURES.items():
        e = f"replace({e}, '{lig}', '{plain}')"
    return f"nfc_normalize({e})"


def _ranges(chars: str) -> str:
    """A regular expression's class that holds ``chars`` (and few others)."""
    spans: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if spans and c - spans[-1][1] < 64:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


def _plain_sql(e: str) -> str:
    """Compatibility forms as what they are; the long table is used only on texts that need it."""
    return f"CASE WHEN regexp_matches({e}, '{_ranges(COMPATIBLE)}') THEN translate({e}, {_quoted(COMPATIBLE)}, {_quoted(COMP_PLAIN)}) ELSE {e} END"


def _readable_sql(col: str) -> str:
    """The text to read on: as the form, but a Cyrillic word keeps (or regains) its Cyrillic letters.
    A word is Cyrillic if it has a letter that looks like no Latin one, or no Latin letter at all
    in a text with such words."""
    t = f"(SELECT translate({_plain_sql('q')}, {_quoted(_SPACES[0])}, {_quoted(_SPACES[1])}) FROM (SELECT {_clean_sql(col)} AS q))"
    own = f"regexp_matches(translate({{x}}, {_quoted(CYRILLIC)}, ''), '\\p{{{{Cyrillic}}}}')"
    word = (
        f"CASE WHEN NOT regexp_matches(w, '[^\\x00-\\x7f]') THEN w WHEN {own.format(x='w')} OR (NOT regexp_matches(w, '\\p{{Latin}}') AND {own.format(x='r')}) "
        f"THEN translate(w, {_quoted(_TO_CYRILLIC[0])}, {_quoted(_TO_CYRILLIC[1])}) ELSE translate(w, {_quoted(_LOOK[0])}, {_quoted(_LOOK[1])}) END"
    )
    words = f"list_transform(regexp_extract_all(r, '[\\p{{L}}\\p{{M}}\\p{{N}}]+|[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: {word})"
    return f"(SELECT trim(regexp_replace(nfc_normalize(array_to_string({words}, '')), '\\s+', ' ', 'g')) FROM (SELECT {t} AS r))"


def _form_sql(col: str) -> str:
    e = f"translate({_plain_sql('q')}, {_quoted(_LOOK[0] + _SPACES[0])}, {_quoted(_LOOK[1] + _SPACES[1])})"
    # letters composed after translation (base letter of another script + accent)
    return f"(SELECT trim(regexp_replace(nfc_normalize({e}), '\\s+', ' ', 'g')) FROM (SELECT {_clean_sql(col)} AS q))"


def form_query(source: str, keys: str, readable: bool = False) -> str:
    """SQL: ``keys``, form, raw and, if asked for, readable text of the texts ``t`` of ``source``.  Texts of plain ASCII need no
    mapping; their form is the text with white space collapsed."""
    return (
        f"SELECT {keys}, CASE WHEN regexp_full_match(t, '[\\x00-\\x7f]*') "
        "THEN trim(regexp_replace(t, '[ \\t\\r\\n\\f\\v]+', ' ', 'g')) ELSE " + _form_sql("t") + " END AS form, "
        f"trim(regexp_replace(t, '[ \\t\\r\\n]+', ' ', 'g'), E' \\t\\r\\n') AS raw"
        + (f", {_readable_sql('t')} AS readable" if readable else "") + f" FROM {source} WHERE t IS NOT NULL"
    )


def forms(df: DataFrame, id_col: str, text_col: str, table_name: str, with_text: bool = False) -> DataFrame:
    """(table_name, id, form_key, raw_key[, form, readable]) of every non-null text.

    ``form_key`` and ``raw_key`` are 128-bit hashes of the form and of the text with
    runs of ordinary white space collapsed.  Empty texts have the empty form.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})
        keys = "SELECT md5(form) AS form_key, md5(raw) AS raw_key" + (", form, readable" if with_text else "")
        sql = f"{keys} FROM ({form_query('batch', 'row_nr', with_text)}) ORDER BY row_nr"
        for b in batches:
            batch = pa.table({"row_nr": pa.array(range(b.num_rows), pa.int64()), "t": b.column(1)})  # noqa: F841
            con.register("batch", batch)
            got = con.sql(sql)
            res = got.to_arrow_table() if hasattr(got, "to_arrow_table") else got.arrow()
            con.unregister("batch")
            cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (res.column(i) for i in range(res.num_columns))]
            cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
            yield pa.record_batch([b.column(0).cast(pa.string()), *(c.cast(pa.string()) for c in cols)], ["id", *res.column_names])

    schema = "id string, form_key string, raw_key string" + (", form string, readable string" if with_text else "")
    source = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).where("t is not null")
    out = spread(source).mapInArrow(run, schema)
    return out.withColumn("table_name", F.lit(table_name))


def same_look(keyed: DataFrame) -> DataFrame:
    """(table_name, left_id, right_id): pairs of records that look the same and differ
    in characters.

    Only forms with two or more different texts (variants) go on.  Exact copies of one
    text are not paired with each other.  Variants are paired first; of each pair the
    smaller variant's members are joined to it, and those to the members of the larger
    one, whose rows are salted, so no group meets in one task however the copies lie.
    """
    key = F.concat_ws(":", "table_name", "form_key")
    keyed = cut_lineage(keyed.select("table_name", "id", key.alias("k"), F.concat_ws(":", "table_name", "form_key", "raw_key").alias("v")))  # short rows, used more than once
    variants = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    forms_ = variants.groupBy("k").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")
    mixed = cut_lineage(variants.join(forms_, "k"))
    # a form's variants are paired within their square
    many = heavy_keys(mixed.groupBy("k").agg(F.sum("variants").alias("n")), "k", "n", mixed.agg(F.coalesce(F.sum("variants"), F.lit(0))).first()[0])
    other = mixed.select("k", F.col("v").alias("v2"), F.col("n").alias("n2"))
    pairs = join_unique(mixed.select("k", F.col("v").alias("v1"), F.col("n").alias("n1")), other, "k", many, "inner", ["v1"])
    larger = (F.col("n1") > F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("v1") > F.col("v2")))
    pairs = pairs.where(larger).select(F.col("v2").alias("v"), F.col("v1").alias("large"))
    hot = heavy_keys(mixed, "v", "n", keyed.count())
    members = cut_lineage(join_unique(keyed, mixed.select("v"), "v", hot, "inner", ["id"]).select("table_name", "id", "v"))
    small = join_unique(members.select("v", F.col("id").alias("small_id")), pairs, "v", hot, "inner", ["small_id"])
    both = join_unique(members, small.select(F.col("large").alias("v"), "small_id"), "v", hot, "inner", ["id"])
    left, right = F.least("id", "small_id"), F.greatest("id", "small_id")
    return both.where("id <> small_id").select("table_name", left.alias("left_id"), right.alias("right_id")).distinct()
