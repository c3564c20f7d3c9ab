"""Personal information in free text (problem 1).

Anchor expansion.  An Aho-Corasick automaton over the lower-case text finds at-signs
and their spelled-out forms, schemes, identifier, account and telephone cues, street
words, titles and name cues; a second one over the text as it stands finds capitalised
given names.  Each anchor counts only at a word boundary, and a deterministic local
parser expands it to the boundaries of the item and validates it there: the parsers
look at the words around an anchor, never at the whole text.  Digit groups are anchors
of numbers that need no cue.

JSON is entered at any depth: strings inside strings, event streams and bodies that
were cut and are no longer JSON.  Keys are cues of their values.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import spread

TYPES = ("email", "phone", "id_number", "address", "person_name")

# ---------------------------------------------------------------- fixed values
# Given names (common public first names of the languages served).
GIVEN = frozenset(
    """adam agnes alan albert alex alexander alexandra alice alina amanda amelia amy ana anders andrea andreas andrew
    angela anita anke anna anne annette anthony anton antonia antonio arthur astrid barbara beatrice ben benjamin bernd
    bettina brian bruno camille carl carla carlos carmen caroline catherine charles charlotte chloe chris christian
    christina christine christopher clara claudia claire colin cristina daniel daniela david deborah diana diego dieter
    dirk dominic dorothea edward elena elias elisa elizabeth ella ellen emil emilia emily emma eric erik ernst esther
    eva evelyn felix fernando fiona florian frances francis francisco frank franz fred frederic gabriel gabriela george
    gerald gerd gloria grace gregor greta hanna hannah hans harald harry heidi heike heinz helen helena helga henri
    henry herbert hugo ian ida igor ines ingrid irene iris isabel isabella ivan jack jacob jakob james jan jana jane
    janet jean jennifer jens jessica joan joanna joachim joel johan johann john jonas jonathan jorge jose josef joseph
    juan judith julia julian julie julien jurgen kai karen karin karl karla kate katharina kathrin katrin kevin klara
    klaus kurt lara lars laura lea leah lena leo leon leonie lewis liam lina linda lisa louis louisa louise luc luca
    lucas lucia lucy luis luisa lukas manuel manuela marc marcel marco marcus margaret maria marie marina mario marion
    mark marta martha martin martina mary mateo mathilde matthew matthias max maya melanie mia michael michel michelle
    miguel mila miriam monica monika nadia nancy natalia natalie nicholas nicola nicole nils nina noah nora oliver
    olivia oscar oskar otto pablo pamela patricia patrick paul paula pauline pedro peter petra philip philipp pierre
    rachel rafael ralf ramon raquel rebecca regina renate richard rita robert roberto roger roland rolf rosa rose ruth
    sabine sally samuel sandra sara sarah sebastian sergio silke silvia simon simone sofia sophia sophie stefan
    stefanie stella stephan stephanie stephen steven susan susanne sven sylvia teresa theo theresa thomas tim timothy
    tobias tom tomas ulrich ulrike uwe valentina vanessa vera veronica victor victoria vincent viola virginia walter
    werner wilhelm william wolfgang yvonne zoe
    александр александра алексей алина алла анастасия анатолий андрей анна антон антонина артём борис вадим валентин
    валентина валерий варвара василий вера виктор виктория виталий владимир вячеслав галина геннадий георгий григорий
    дарья денис дмитрий евгений евгения екатерина елена елизавета иван игорь илья инна ирина кирилл константин ксения
    лариса лев лидия любовь людмила максим маргарита марина мария михаил надежда наталья никита николай нина оксана
    олег ольга павел пётр полина роман руслан светлана семён сергей софия станислав степан тамара татьяна тимур фёдор
    эдуард юлия юрий яна""".split()
)
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "sr", "sra", "srta", "dra", "mme", "mlle", "herr", "frau", "hr", "fr", "señor", "señora", "madame", "monsieur")
# Words that introduce a person's name.
NAME_CUES = (
    "my name is ", "i am ", "ask ", "forward this to ", "spoke with ", "regards, ", "sincerely, ", "signed by ", "patient=",
    "patient: ", "belongs to ", "name=", "name: ", "contact name: ", "меня зовут ", "подписывает ", "передайте это для ", "с уважением, ",
    "mein name ist ", "ich heiße ", "me llamo ", "mi nombre es ", "je m'appelle ", "mon nom est ",
)
# Those after which any two capitalised words are a name; after the others one part must be a listed given name.
STRONG_NAME_CUES = (
    "my name is ", "patient=", "patient: ", "patient name: ", "contact name: ", "full name: ", "customer name: ", "signed by ", "spoke with ",
    "меня зовут ", "подписывает ", "передайте это для ", "mein name ist ", "ich heiße ", "me llamo ", "mi nombre es ", "je m'appelle ", "mon nom est ",
    "regards, ", "sincerely, ", "с уважением, ",
)
# Words that introduce a telephone number.
PHONE_CUES = (
    "call", "tel", "tel.", "tel:", "sms:", "callto:", "phone", "phone=", "phone:", "mobile", "fax", "ring me on", "answers at", "voice message from", "reach me on",
    "rückruf unter", "telefon", "телефон", "тел.", "тел", "звоните", "teléfono", "llame al", "téléphone", "appelez le", "whatsapp", "sms",
)
# Words that introduce an identity number.
ID_CUES = (
    "ssn", "social security", "passport", "driver licence", "driver license", "driving licence", "licence no", "id card", "identity card", "identity no",
    "national id", "national insurance", "nino", "dni", "nie", "nif", "steuer-id", "steueridentifikationsnummer", "ausweis", "personalausweis", "паспорт", "снилс", "инн",
    "insee", "numéro de sécurité sociale", "tax id",
)
# Words that introduce an account: an IBAN or card number, whose checksum must hold.
ACCOUNT_CUES = ("iban", "credit card", "debit card", "card number", "card no", "kreditkarte", "kartennummer", "konto", "tarjeta", "carte bancaire", "счёт", "счет", "карта", "карты")
# Words that end or begin a street's name.
STREET_END = (
    "street", "st", "road", "rd", "lane", "avenue", "ave", "drive", "court", "row", "way", "place", "square", "terrace", "close", "crescent", "boulevard", "blvd",
    "parkway", "hill", "gardens", "mews", "grove", "walk", "alley",
)
STREET_END_DE = ("straße", "strasse", "str.", "gasse", "allee", "weg", "platz", "ring", "damm", "ufer", "stieg", "steig", "hof", "pfad", "chaussee")
STREET_START = ("rue", "avenue", "boulevard", "place", "chemin", "allée", "impasse", "quai", "calle", "avenida", "plaza", "paseo", "camino", "carretera", "via", "ул.", "улица", "пр.", "проспект", "пер.", "переулок", "наб.", "шоссе", "бульвар")
STREET_PREP_DE = ("am", "an", "im", "auf", "zum", "zur", "unter")
# Words that follow a given name in the name of a place, ship or firm.
PLACE_WORDS = ("airport", "station", "springs", "university", "college", "school", "hospital", "park", "bridge", "island", "islands", "county", "city", "bay", "falls", "beach", "harbor", "harbour", "river", "lake", "valley", "hall", "house", "hotel", "museum", "tower", "cathedral", "church", "stadium")
# ------------------------------------------------------------------------------

_EMAIL_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+'-]{0,62}[A-Za-z0-9_+])?"
_EMAIL = re.compile(
    r"(?<![\w.+@-])(?:mailto:)?(" + _EMAIL_LOCAL + r")@((?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+([A-Za-z]{2,24}))(?![\w@-]|\.\w)"
)
_AT = r"(?:\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s+AT\s+)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s+DOT\s+|\.)"
_EMAIL_SPELLED = re.compile(
    r"(?<![\w.+@-])(" + _EMAIL_LOCAL + ")" + _AT + r"([A-Za-z0-9-]{1,63}(?:" + _DOT + r"[A-Za-z0-9-]{1,63}){0,4}" + _DOT + r"([A-Za-z]{2,24}))(?![\w@])"
)

_D = r"[ .\-/]?"
#: telephone formats that need no cue
_PHONE = re.compile(
    r"""(?<![\w+./-])(?:
      (?:\+|00)\d{1,3}(?:[ .\-/]?\(\d{1,5}\))?(?:[ .\-/]?\d{2,6}){1,5}
    | \(\d{2,5}\)[ .\-/]?\d{3,4}[ .\-]?\d{3,4}
    | 1[-. ]\d{3}[-. ]\d{3}[-. ]\d{4}
    | \d{3}-\d{3}-\d{4}
    | 0\d{1,4}[ /]\d{3,6}(?:[ -]?\d{2,4})?
    | 0\d(?:[ .]\d\d){4}
    )(?:\s?(?:ext\.?|x|доб\.)\s?\d{1,5})?(?![\w/]|-\d)""",
    re.X,
)
#: after a cue any run of 7 to 15 digits will do
_PHONE_LOOSE = re.compile(r"[\s:=]*(?:no\.?|number|nr\.?|номер)?[\s:=]*([+(]?\d(?:[ .\-/()]{0,2}\d){6,14}(?:\s?(?:ext\.?|x)\s?\d{1,5})?)(?![\w/]|-\d)")

_ID_FORMATS = re.compile(
    r"""(?<![\w.-])(?:
      \d{3}-\d{2}-\d{4}
    | [A-Z]{2}[ ]?\d\d[ ]?\d\d[ ]?\d\d[ ]?[A-D]
    | \d{8}-[A-Z]
    | [A-Z]\d{3}-\d{4}-\d{4}
    )(?![\w]|-\w)""",
    re.X,
)
_ID_LOOSE = re.compile(
    r"[\s:=]*(?:(?:no\.?|nr\.?|number|nummer|num\.?|nº|№|номер)[\s:=]*)?"
    r"((?:[A-Z]{1,3}[ -]?)?\d(?:[ .\-/]?\d){5,14}(?:[ -]?[A-Z](?![\w]))?)(?![\w]|-\d)",
)
_ID_BARE = re.compile(r"(?<![\w.-])[A-Z]\d{8}(?![\w-])")

_POSTCODE = r"(?:[A-Z]{2}[ -]?)?\d{4,6}"
_W = r"[^\W\d_][^\W\d_]*(?:['’-][^\W\d_]+)*"
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_END_EN = "(?i:" + "|".join(STREET_END) + r")\b\.?"
_TAIL = (
    r"(?:,\s*(?:(?i:apt|apartment|flat|unit|suite)\.?\s?\w{1,5}|\d{1,2}º\s?[A-Z]?|кв\.\s?\d{1,4}|" + _POSTCODE + r"\s+" + _CAP + r"(?:[ ]" + _CAP + r")?|"
    + _POSTCODE + r"|г\.\s?" + _CAP + r"(?:[ -]" + _CAP + r")?|" + _CAP + r"(?:[ -]" + _CAP + r"){0,2}))*"
)
_ADDRESS = re.compile(
    "(?:"
    # 6 Cinder Mill Street
    + r"(?<![\w/.-])\d{1,5}[a-zA-Z]?\s+(?:" + _CAP + r"\s+){1,4}?" + _END_EN
    # Cinder Mill Street 22
    + "|" + r"(?<!\w)(?:" + _CAP + r"\s+){1,4}?" + _END_EN + r"\s+\d{1,5}[a-zA-Z]?(?!\w)"
    # Lindenallee 12b ; Am Kalkofen 3a ; Obere Rosengasse 5
    + "|" + r"(?<!\w)(?:" + _CAP + r"\s+)?" + r"[A-ZÄÖÜ][a-zäöüß]*(?:" + "|".join(re.escape(x) for x in STREET_END_DE) + r")\s+\d{1,4}\s?[a-z]?(?!\w)"
    + "|" + r"(?<!\w)(?i:" + "|".join(STREET_PREP_DE) + r")\s+" + _CAP + r"\s+\d{1,4}\s?[a-z]?,\s*\d{5}\s+" + _CAP
    # 12 rue des Tilleuls Gris
    + "|" + r"(?<![\w/.-])\d{1,4}\s?(?:bis|ter)?,?\s+(?i:" + "|".join(STREET_START[:8]) + r")\s+(?:" + _W + r"\s+){0,3}?" + _CAP + r"(?:\s+" + _CAP + r")?"
    # Calle del Olmo Seco 14
    + "|" + r"(?<!\w)(?i:" + "|".join(STREET_START[8:15]) + r")\s+(?:" + _W + r"\s+){0,4}?" + _CAP + r"\s+\d{1,4}(?!\w)"
    # ул. Заречная, д. 64
    + "|" + r"(?<!\w)(?i:" + "|".join(re.escape(x) for x in STREET_START[15:]) + r")\s*" + _CAP + r"(?:\s+" + _CAP + r"){0,2},?\s*(?:д\.|дом)?\s*\d{1,4}(?!\w)"
    # P.O. Box 3045
    + "|" + r"(?<!\w)(?i:p\.?\s?o\.?\s?box|postfach|apartado|а/я)\s+\d{2,6}(?!\w)"
    + ")" + _TAIL
)
_ADDRESS_NEEDS = re.compile(r",\s*\S|\d{5}|(?i:p\.?\s?o\.?\s?box|postfach|apartado|а/я)")

_TITLES = "(?:" + "|".join(x for t in TITLES for x in (t.capitalize(), t.upper())) + ")"
_NAME_CHARS = r"(?:[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]+(?:['’-][^\W\d_]+)*)"
_NAME_AFTER = re.compile(
    r"(?:(?P<title>" + _TITLES + r"\.?\s+)(?P<a>" + _NAME_CHARS + r"(?:\s+" + _NAME_CHARS + r"){0,2})"
    r"|(?P<last>" + _NAME_CHARS + r"),\s+(?P<first>" + _NAME_CHARS + r")"
    r"|(?P<full>" + _NAME_CHARS + r"(?:\s+[A-ZА-Я]\.)?\s+" + _NAME_CHARS + r"))"
)
_TITLE = re.compile(r"(?<![\w.])" + _TITLES + r"\.?\s+(" + _NAME_CHARS + r"(?:\s+[A-ZА-Я]\.)?(?:\s+" + _NAME_CHARS + r")?)")
_WORD = re.compile(r"[^\W\d_]+")
_LAST_NAME = re.compile(_NAME_CHARS)
_AFTER_GIVEN = re.compile(r"(?:\s+[A-ZА-Я]\.)?\s+(" + _NAME_CHARS + r")(?!\w)")
_DIGIT_RUN = re.compile(r"[+(]?\d[\d ().\-/]{5,}")
_IBAN = re.compile(r"[A-Za-z]{2}\d{2}(?:[ -]?[A-Za-z0-9]){11,30}(?!\w)")
_CARD = re.compile(r"\d(?:[ -]?\d){11,18}(?!\w)")
_AFTER_CUE = re.compile(r"[\s:=#]*(?:(?:no\.?|nr\.?|number|nummer|№|номер)[\s:=#]*)?")
_WORD_START = re.compile(r"(?<!\w)\w")
_NUMBER_AHEAD = re.compile(r"\s+\d")
_ENDING = re.compile(r"[^\W\d_]{0,3}")
_EXTENSION = re.compile("ext|x|доб")
_NOT_SURNAMES = frozenset("the and or of for to in on at by is was were with from this that a an if when nobody each please which could und der die das y el la et le les".split()) | frozenset(PLACE_WORDS)

_NOT_NAMES = _NOT_SURNAMES | frozenset(
    """support team desk office department service services sales billing security admin administrator staff group company committee please thanks
    hello not unknown none null true false project room street road case ticket monday tuesday wednesday thursday friday saturday sunday""".split()
)


def _build_automata():
    """(cues over the lower-case text, given names and capital at-signs over the text as it is)."""
    import ahocorasick

    low, cased = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, cues in (
        ("at", ("@", "[at]", "(at)", "{at}", "<at>", "[ at ]", "( at )", "{ at }", "< at >", "(@)", "[@]", "{@}", "<@>")),
        ("phone", PHONE_CUES),
        ("id", ID_CUES),
        ("account", ACCOUNT_CUES),
        ("name", NAME_CUES),
        ("strong", STRONG_NAME_CUES),
        ("title", tuple(t + "." for t in TITLES) + tuple(t + " " for t in TITLES)),
        ("street", tuple(" " + x for x in STREET_END) + tuple(x + " " for x in (*STREET_PREP_DE, "box", "postfach", "apartado")) + ("а/я ",) + STREET_START),
        ("street_de", STREET_END_DE),
    ):
        for c in cues:
            low.add_word(c, (len(c), low.get(c, (0, frozenset()))[1] | {kind}))
    for n in GIVEN:
        for form in (n.capitalize(), n.upper()):
            cased.add_word(form, (len(form), "given"))
    cased.add_word(" AT ", (4, "at"))
    low.make_automaton()
    cased.make_automaton()
    return low, cased


class _Taken:
    """Items found so far, sorted, not overlapping."""

    def __init__(self) -> None:
        self.items: list[tuple[int, int, str]] = []

    def overlaps(self, a: int, b: int) -> bool:
        k = bisect_left(self.items, (a,))
        return (k > 0 and self.items[k - 1][1] > a) or (k < len(self.items) and self.items[k][0] < b)

    def add(self, a: int, b: int, kind: str) -> bool:
        if a >= b or self.overlaps(a, b):
            return False
        insort(self.items, (a, b, kind))
        return True

    def first_inside(self, a: int, b: int) -> int:
        """Where the first item that begins within (a, b) begins, else b."""
        k = bisect_left(self.items, (a + 1,))
        return self.items[k][0] if k < len(self.items) and self.items[k][0] < b else b

    def around(self, a: int) -> int | None:
        """Number of the item that begins before ``a`` and ends after it."""
        k = bisect_left(self.items, (a,)) - 1
        return k if k >= 0 and self.items[k][1] > a else None


def _iban(s: str) -> bool:
    c = "".join(x for x in s if x.isalnum()).upper()
    return 15 <= len(c) <= 34 and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


def _luhn(s: str) -> bool:
    d = [int(x) for x in s if x.isdigit()][::-1]
    return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


class Finder:
    """Anchors and parsers; one per worker."""

    def __init__(self) -> None:
        self.low, self.cased = _build_automata()

    def spans(self, text: str, hints: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
        """(start, end, type) of the items in plain ``text``, sorted, not overlapping.
        ``hints`` are the cues that stand before the text."""
        low = text.lower()
        if len(low) != len(text):  # letters whose lower case is longer: keep positions
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        anchors: dict[str, list[tuple[int, int]]] = {}  # kind -> (start, end)
        for last, (size, kinds) in self.low.iter(low):
            a = last + 1 - size
            if low[a].isalnum() and a and low[a - 1].isalnum() and "street_de" not in kinds:
                continue  # within a word
            for k in kinds:
                anchors.setdefault(k, []).append((a, last + 1))
        for last, (size, kind) in self.cased.iter(text):
            a = last + 1 - size
            if kind == "at" or not (a and (text[a - 1].isalnum() or text[a - 1] in "_@.+-") or text[last + 1 : last + 2].isalnum() or text[last + 1 : last + 2] in ("_", "@")):
                anchors.setdefault(kind, []).append((a, last + 1))
        for k in hints:
            anchors.setdefault(k, []).insert(0, (0, 0))
        groups = [m.span() for m in _DIGIT_RUN.finditer(text)]
        found = _Taken()
        self._emails(text, low, anchors.get("at", ()), found)
        self._addresses(text, anchors, found)
        self._accounts(text, anchors.get("account", ()), found)
        self._ids(text, low, anchors.get("id", ()), groups, found)
        self._phones(text, anchors.get("phone", ()), groups, found)
        self._names(text, anchors, found)
        return found.items

    @staticmethod
    def _emails(text: str, low: str, anchors, out: _Taken) -> None:
        for a, b in anchors:
            i = a
            while i and text[i - 1].isspace():  # before a spelled sign
                i -= 1
            stop = max(0, i - 64)
            while i > stop and (text[i - 1].isascii() and text[i - 1].isalnum() or text[i - 1] in "._%+'-"):
                i -= 1
            while i < a and (not text[i].isalnum() or i and (text[i - 1].isalnum() or text[i - 1] in "_.+@-")):
                i += 1
            if i == a:
                continue
            if text[a] == "@":
                m = _EMAIL.match(text, i)
                ok = m and ".." not in m.group(1)
            else:
                m = _EMAIL_SPELLED.match(text, i)
                ok = m
            if ok and m.end() > b:
                out.add(i - 7 if low.endswith("mailto:", 0, i) and not (i > 7 and text[i - 8].isalnum()) else i, m.end(), "email")

    @staticmethod
    def _accounts(text: str, anchors, out: _Taken) -> None:
        for _, b in anchors:
            at = _AFTER_CUE.match(text, b).end()
            for pattern, holds in ((_IBAN, _iban), (_CARD, _luhn)):
                m = pattern.match(text, at)
                if m and holds(m.group()):
                    out.add(*m.span(), "id_number")

    @staticmethod
    def _ids(text: str, low: str, anchors, groups, out: _Taken) -> None:
        for a, b in anchors:
            m = _ID_LOOSE.match(text, b)
            if m is None and b - a > 4:  # a longer cue may have an ending (passports)
                m = _ID_LOOSE.match(text, _ENDING.match(text, b).end())
            if m and sum(map(str.isdigit, m.group(1))) >= 6:
                out.add(*m.span(1), "id_number")
        for pattern in (_ID_FORMATS, _ID_BARE):
            for a, b in groups:
                for m in pattern.finditer(text, max(0, a - 4), b + 4):
                    out.add(*m.span(), "id_number")

    @staticmethod
    def _phones(text: str, anchors, groups, out: _Taken) -> None:
        for a, b in groups:
            for m in _PHONE.finditer(text, a, b + 14):  # room for an extension
                if m.start() < b and 8 <= sum(map(str.isdigit, _EXTENSION.split(m.group())[0])) <= 15:
                    out.add(*m.span(), "phone")
        for _, b in anchors:
            m = _PHONE_LOOSE.match(text, b)
            if m:
                out.add(*m.span(1), "phone")

    @staticmethod
    def _addresses(text: str, anchors: dict, out: _Taken) -> None:
        for kind in ("street", "street_de"):
            for a, b in anchors.get(kind, ()):
                if kind == "street_de" and not _NUMBER_AHEAD.match(text, b) or out.around(b) is not None:
                    continue
                left = a
                for _ in range(5):  # no form has more words before its street word
                    while left and text[left - 1].isspace():
                        left -= 1
                    while left and not text[left - 1].isspace():
                        left -= 1
                for w in _WORD_START.finditer(text, left, b):
                    m = _ADDRESS.match(text, w.start())
                    if m and m.end() > a:
                        s = m.start()
                        e = out.first_inside(s, m.end())  # ran into an item that follows
                        e = s + len(text[s:e].rstrip(" ,\n<"))
                        if _ADDRESS_NEEDS.search(text, s, e) and out.add(s, e, "address"):
                            break

    def _names(self, text: str, anchors: dict, out: _Taken) -> None:
        lines: dict[int, tuple[int, int]] = {}

        def add(a: int, b: int) -> None:
            k = out.around(a)
            if k is not None and out.items[k][2] == "address" and out.items[k][1] < b:  # the address ran into a name that follows it
                s = out.items[k][0]
                out.items[k] = (s, s + len(text[s:a].rstrip(" ,\n")), "address")
            out.add(a, b, "person_name")

        for a, _ in anchors.get("title", ()):
            m = _TITLE.match(text, a)
            if m:
                add(*m.span())
        for kind in ("strong", "name"):
            for _, b in anchors.get(kind, ()):
                m = _NAME_AFTER.match(text, b)
                if m and self._name_like(m, kind == "strong" and not _capitals(text, b - 1)):
                    add(*m.span())
        for a, b in anchors.get("given", ()):
            n = _AFTER_GIVEN.match(text, b)
            if n and n.group(1).lower() not in _NOT_SURNAMES:
                if (not text[a:b].isupper() or n.group(1).isupper()) and _running_text(text, a, n.end(), out, lines):
                    add(a, n.end())
                continue
            i = a
            while i and text[i - 1].isspace():
                i -= 1
            if i < a and i > 1 and text[i - 1] == ",":  # last name first
                j = i = i - 1
                while j and (text[j - 1].isalpha() or text[j - 1] in "'’-"):
                    j -= 1
                while j < i and not text[j].isupper():
                    j += 1
                m = _LAST_NAME.match(text, j)
                if m and m.end() == i and not (j and text[j - 1].isalnum()) and m.group().lower() not in _NOT_SURNAMES and _running_text(text, j, b, out, lines):
                    add(j, b)

    @staticmethod
    def _name_like(m: re.Match, strong: bool) -> bool:
        parts = [p for p in _WORD.findall(m.group()) if len(p) > 1]
        if m.group("title") is not None or any(p.lower() in GIVEN for p in parts):
            return True
        return strong and not any(p.lower() in _NOT_NAMES for p in parts)


_FOLLOWING = re.compile(r"[ \t]+([^\W\d_]+)")


def _capitals(text: str, end: int) -> bool:
    """The cue that ends at ``end`` stands in capitals, where a capital letter says nothing."""
    cue = text[max(0, end - 7) : end + 1]
    return cue.isupper() and sum(map(str.isalpha, cue)) > 2


def _running_text(text: str, a: int, b: int, taken: _Taken, lines: dict[int, tuple[int, int]]) -> bool:
    """Not within a line in title case or capitals, where a capital letter says nothing: a
    word around is not capitalised, or another word of the line is not (half of them, if the
    name is in capitals).  A word of an item already found does not count, nor do small words.
    ``lines`` keeps the counts of lines looked at, so that each is read once."""
    i = a
    while i and text[i - 1] in " \t":
        i -= 1
    j = i - (i > 0 and text[i - 1] in "'’")
    k = j
    while i < a and k and text[k - 1].isalpha():
        k -= 1
    f = _FOLLOWING.match(text, b)
    if not (k < j and text[k].isupper() and not taken.overlaps(k, j) or f and f.group(1)[0].isupper()):
        return True
    start = text.rfind("\n", 0, a) + 1
    if start not in lines:
        stop, words, plain = text.find("\n", b), 0, 0
        for m in _WORD.finditer(text, start, len(text) if stop < 0 else stop):
            if m.group() not in _NOT_SURNAMES and not taken.overlaps(*m.span()):
                words += 1
                plain += m.group().islower()
        lines[start] = (words, plain)
    words, plain = lines[start]
    words -= sum(1 for m in _WORD.finditer(text, a, b) if not taken.overlaps(*m.span()))
    return 2 * plain >= words if text[a:b].isupper() else plain > 0


PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}


def replace(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with a typed placeholder in place of every span; all else stays."""
    out, pos = [], 0
    for a, b, t in spans:
        out += (text[pos:a], PLACEHOLDER[t])
        pos = b
    out.append(text[pos:])
    return "".join(out)


# ------------------------------------------------------------------- structure
#: no item has fewer characters
SHORTEST = 5
#: (start, end, type, what stands in its place)
Span = tuple[int, int, str, str]

_STRING = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)(?:"|\\?\Z)', re.S)
_TOKEN = re.compile(r'[ \t\r\n]*(?:("[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z))|([{}\[\],:])|([-+.\w]+))', re.S)
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?")
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{0,3})?$")
_UNIT = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|[^\\]", re.S)
_DATA_LINE = re.compile(r"^[ \t\ufeff]*data:", re.M)
_DELTA_KEYS = frozenset("content text arguments partial_json".split())
_KEY_WORD = re.compile(r"[A-Z]+(?![a-z])|[^\W_][^\W_A-Z]*")
_KEY_TAIL = frozenset("no nr num number numbers nummer id номер value".split())


def _decode(body: str) -> str | None:
    """The string that a JSON literal stands for; a cut escape at its end is dropped."""
    if "\\" not in body:
        return body
    try:
        return json.loads('"' + body + '"', strict=False)
    except ValueError:
        try:
            return json.loads('"' + _ESCAPE.sub("", body) + '"', strict=False)
        except ValueError:
            return None


def _raw_at(body: str, plain: str) -> list[int] | range:
    """Where each character of ``plain`` begins in ``body``, and where the last one ends."""
    if len(body) == len(plain):
        return range(len(body) + 1)
    at, pos = [], 0
    for m in _UNIT.finditer(body):
        if len(at) == len(plain):
            break
        at.append(m.start())
        pos = m.end()
    at.append(pos)
    return at


#: Keys that announce a kind of item.  Verbs are no keys: what follows them (``tool_call``) is no number.
_KEY_CUES = {
    " ".join(_KEY_WORD.findall(c)).lower(): kind
    for kind, cues in (
        ("phone", (*PHONE_CUES, "phones", "telephone", "cell")),
        ("id", (*ID_CUES, "passports")),
        ("name", ("name",)),
        ("strong", ("patient", "patient name", "full name", "contact name", "customer name")),
    )
    for c in cues
    if c not in ("call", "sms", "ring me on", "answers at", "voice message from", "reach me on", "rückruf unter", "звоните", "llame al", "appelez le")
}


@lru_cache(4096)
def _hints(key: str) -> frozenset[str]:
    """Kinds of item that a key announces: it ends in a cue, or in a cue and a word such as ``number``."""
    words = [w.lower() for w in _KEY_WORD.findall(key)]
    while len(words) > 1 and words[-1] in _KEY_TAIL and " ".join(words[-2:]) not in _KEY_CUES:
        words.pop()
    return frozenset(_KEY_CUES[c] for c in (" ".join(words[-k:]) for k in range(1, 5)) if c in _KEY_CUES)


def _leaves(text: str, paths: list | None = None) -> tuple[list[tuple[int, int, str, str]], bool] | None:
    """((start, end, "s" string | "k" key | "n" number, key) of what ``text`` holds, whether the value is
    complete) if it is JSON or the beginning of it, else None.  Elements of arrays have the array's key.
    ``paths`` receives the way to each leaf: for every container around it [its place in its array, or its
    ``index`` if it has one], and the keys."""
    out: list[tuple[int, int, str, str]] = []
    stack: list[tuple[str, str]] = []  # (bracket, key of the container)
    labels: list[list] = []  # of the containers around
    want, key, pos, n = "v", "", 0, len(text)
    match = _TOKEN.match
    while pos < n:
        m = match(text, pos)
        if m is None:
            return None if text[pos:].strip(" \t\r\n") else (out, want == "e")
        pos = m.end()
        s, p, w = m.groups()
        if s is not None:
            a, b = m.span(1)
            b -= _closed(s)
            if want in "vV":
                out.append((a + 1, b, "s", key))
                if paths is not None:
                    paths.append((*((x, k) for x, (_, k) in zip(labels, stack)), key))
                want = "," if stack else "e"
            elif want in "kK":
                out.append((a + 1, b, "k", ""))
                if paths is not None:
                    paths.append(None)
                key, want = text[a + 1 : b], ":"
            else:
                return None
        elif p is not None:
            if p in "{[" and want in "vV":
                place = labels[-1][1] if stack and stack[-1][0] == "[" else 0
                stack.append((p, key))
                labels.append([str(place), 0])
                want = "K" if p == "{" else "V"
            elif p in "}]" and stack and stack[-1][0] == ("{" if p == "}" else "[") and want in (",K" if p == "}" else ",V"):
                key = stack.pop()[1]
                labels.pop()
                want = "," if stack else "e"
            elif p == "," and want == "," and stack:
                want = "k" if stack[-1][0] == "{" else "v"
                if want == "v":
                    key = stack[-1][1]
                    labels[-1][1] += 1
            elif p == ":" and want == ":":
                want = "v"
            else:
                return None
        else:
            if want not in "vV":
                return None
            if _NUMBER.fullmatch(w):
                out.append((m.start(3), pos, "n", key))
                if paths is not None:
                    paths.append(None)
                    if key == "index" and stack and stack[-1][0] == "{":
                        labels[-1][0] = w
            elif w not in ("true", "false", "null", "NaN", "Infinity", "-Infinity") and not (
                pos == n and (any(x.startswith(w) for x in ("true", "false", "null")) or re.fullmatch(r"-|-?\d+(?:\.|\.?\d*[eE][-+]?)", w))
            ):
                return None
            want = "," if stack else "e"
    return out, want == "e"


def _closed(literal: str) -> bool:
    """The literal ends in a quote that is not escaped."""
    body = literal[1:-1]
    return len(literal) > 1 and literal[-1] == '"' and (len(body) - len(body.rstrip("\\"))) % 2 == 0


def _with(out: list[Span], more: list[Span]) -> list[Span]:
    """``out`` and those of ``more`` that overlap none of it, sorted."""
    out.sort()
    ends = [x[1] for x in out]
    keep = [x for x in more if (k := bisect_right(ends, x[0])) == len(out) or out[k][0] >= x[1]]
    return sorted(out + keep)


class Redactor:
    """Finds and replaces items in plain text, JSON of any nesting, cut JSON and event streams."""

    def __init__(self) -> None:
        self.finder = Finder()

    def run(self, text: str | None) -> tuple[str | None, set[str]]:
        """(text with placeholders, types found).  Null and empty texts come back as they are."""
        if not text:
            return text, set()
        spans = self.spans(text)
        if not spans:
            return text, set()
        out, pos = [], 0
        for a, b, _, put in spans:
            out += (text[pos:a], put)
            pos = b
        out.append(text[pos:])
        return "".join(out), {t for _, _, t, _ in spans}

    def spans(self, text: str, hints: frozenset[str] = frozenset()) -> list[Span]:
        """Items of a text of any form, sorted, not overlapping.  What is inside is shorter than
        what it is in, and quotes double their escapes, so the depth is the logarithm of the length."""
        head = text.lstrip()[:1]
        like = head and head in '{["' and '"' in text
        if like:
            got = _leaves(text)
            if got is not None:
                return self._json(text, got[0], hints)
        if "data:" in text:
            got = self._stream(text)
            if got is not None:
                return got
        if like:
            return self._mixed(text, hints)
        return self._plain(text, hints)

    def _plain(self, text: str, hints: frozenset[str] = frozenset()) -> list[Span]:
        return [(a, b, t, PLACEHOLDER[t]) for a, b, t in self.finder.spans(text, hints)]

    def _literal(self, text: str, a: int, b: int, hints: frozenset[str]) -> list[Span]:
        """Items of the string whose body is text[a:b]; one that cannot be decoded is read as it stands."""
        body = text[a:b]
        plain = _decode(body)
        if plain is None:
            return [(a + s, a + e, t, json.dumps(put)[1:-1]) for s, e, t, put in self._plain(body, hints)]
        got = self.spans(plain, hints)
        if not got:
            return got
        at = _raw_at(body, plain)
        return [(a + at[s], a + at[e], t, json.dumps(put, ensure_ascii=False)[1:-1]) for s, e, t, put in got]

    def _json(self, text: str, leaves, hints: frozenset[str] = frozenset()) -> list[Span]:
        """``hints`` hold for a text that is one string."""
        out: list[Span] = []
        for a, b, kind, key in leaves:
            if b - a < SHORTEST:
                continue
            own = _hints(key) if key else hints
            if kind != "n":
                out += self._literal(text, a, b, own)
            elif own and text[a:b].isdigit():
                out += [(a, b, t, json.dumps(put)) for s, e, t, put in self._plain(text[a:b], own) if e - s == b - a]
        return out

    def _mixed(self, text: str, hints: frozenset[str]) -> list[Span]:
        """Text that begins like JSON but is none: plain text, in which quoted strings may hold escapes."""
        out: list[Span] = []
        if "\\" in text:
            for m in _STRING.finditer(text):
                if "\\" in m.group(1):
                    out += self._literal(text, m.start(1), m.end(1), frozenset())
        return _with(out, self._plain(text, hints))

    def _stream(self, text: str) -> list[Span] | None:
        """Items of an event stream, None if ``text`` is none: no data line holds JSON.  They may run
        across events: the strings at one place (choice and keys) of all events are joined, and what is
        found is put back, an item's placeholder into the event in which the item begins.  All strings
        but pure text deltas are read alone too, and what is no JSON event as plain text."""
        out: list[Span] = []
        joined: dict[tuple, list[tuple[int, str, str]]] = {}
        alone: list[tuple[int, int, str, str]] = []
        rest, done = [], 0
        for m in _DATA_LINE.finditer(text):
            a = m.end()
            if a < done:
                continue
            event, paths = None, []
            stop = a
            while True:  # an event may go on over several data lines; their marks are blanked
                stop = text.find("\n", stop)
                stop = len(text) if stop < 0 else stop
                part = _DATA_LINE.sub(lambda x: " " * len(x.group()), text[a:stop])
                paths = []
                event = _leaves(part, paths) if part.lstrip()[:1] in ("{", "[", '"') else None
                following = _DATA_LINE.match(text, stop + 1)
                if event is None or event[1] or not following:
                    break
                stop += 1
            if event is None:
                continue
            rest.append((done, m.start()))
            done = stop
            for (s, e, kind, key), path in zip(event[0], paths):
                plain = _decode(text[a + s : a + e]) if path else None
                if plain is None:
                    alone.append((a + s, a + e, kind, key))
                    continue
                where = (*((x[0], k) for x, k in path[:-1]), path[-1])
                joined.setdefault(where, []).append((a + s, text[a + s : a + e], plain))
                if key not in _DELTA_KEYS:
                    alone.append((a + s, a + e, kind, key))
        if not done:
            return None
        rest.append((done, len(text)))
        for where, parts in joined.items():
            if len({p for _, _, p in parts}) > 1 or where[-1] in _DELTA_KEYS:
                out += self._joined(parts)
            else:
                out += [x for p in parts for x in self._joined([p])]
        extra = self._json(text, alone)
        extra += [(a + s, a + e, t, put) for a, b in rest if b - a >= SHORTEST for s, e, t, put in self._mixed(text[a:b], frozenset())]
        return _with(out, extra)

    def _joined(self, parts: list[tuple[int, str, str]]) -> list[Span]:
        """Items of the text that (start, body, decoded) of ``parts`` make up together."""
        found = self.spans("".join(p for _, _, p in parts))
        out: list[Span] = []
        at = first = 0
        for a, body, p in parts if found else ():
            raw = None
            while first < len(found) and found[first][1] <= at:
                first += 1
            k = first
            while k < len(found) and found[k][0] < at + len(p):
                s, e, t, put = found[k]
                k += 1
                if e > at:
                    raw = raw or _raw_at(body, p)
                    out.append((a + raw[max(s - at, 0)], a + raw[min(e - at, len(p))], t, json.dumps(put, ensure_ascii=False)[1:-1] if s >= at else ""))
            at += len(p)
        return out


def redact(df: DataFrame, id_col: str, fields: list[str], table_name: str) -> DataFrame:
    """(table_name, record_id, field_name, redacted, pii_types) for every non-null field.

    Redelivered rows are not united here (see :func:`found`).  Null fields give no
    rows; empty texts come back empty with no types.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Redactor()
        for b in batches:
            ids, names, texts, kinds = [], [], [], []
            rid = b.column(0).to_pylist()
            for k, f in enumerate(fields):
                for i, t in zip(rid, b.column(k + 1).to_pylist()):
                    if t is not None:
                        new, types = r.run(t)
                        ids.append(i)
                        names.append(f)
                        texts.append(new)
                        kinds.append(sorted(types))
            yield pa.record_batch(
                [pa.array(ids, pa.string()), pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))],
                ["record_id", "field_name", "redacted", "pii_types"],
            )

    out = spread(df.select(F.col(id_col).cast("string"), *fields)).mapInArrow(
        run, "record_id string, field_name string, redacted string, pii_types array<string>"
    )
    return out.withColumn("table_name", F.lit(table_name))


def found(redacted: DataFrame) -> DataFrame:
    """(table_name, record_id, field_name, pii_type), each once."""
    return (
        redacted.where(F.size("pii_types") > 0)
        .select("table_name", "record_id", "field_name", F.explode("pii_types").alias("pii_type"))
        .distinct()
    )
