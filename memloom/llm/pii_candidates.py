"""Where personal data could be in a text: the units that the field in ``pii`` labels.

Works on one text at a time with regular expressions and word sets; positions are characters.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

LABELS = ("none", "email", "phone", "id_number", "address", "person_name")
NONE, EMAIL, PHONE, ID, ADDRESS, NAME = range(6)
#: Labels that a unit of each kind may take.
ALLOWED = {"mail": (NONE, EMAIL), "number": (NONE, PHONE, ID), "place": (NONE, ADDRESS), "name": (NONE, NAME)}

# Spellings of "at" and "dot" in disguised addresses, words for digits, words that
# make a street, words that introduce a person. All compare in lower case.
AT = r"(?:\s?[\[(<{]\s?(?:at|arroba|chez|ät)\s?[\])>}]\s?|\s(?:at|arroba)\s)"
DOT = r"(?:\s?[\[(<{]\s?(?:dot|punto|punkt|point)\s?[\])>}]\s?|\s(?:dot|punto|punkt|point)\s|\.)"
DIGIT_WORDS = (
    "zero oh one two three four five six seven eight nine double "
    "null eins zwei drei vier fünf sechs sieben acht neun "
    "cero uno dos tres cuatro cinco seis siete ocho nueve "
    "zéro un deux trois quatre cinq sept huit neuf"
).split()
EN_STREET = "street st road rd lane ln close terrace avenue ave drive dr court ct square sq way hill row crescent place pl boulevard blvd grove gardens mews".split()
DE_STREET = "straße strasse str gasse platz allee weg ring damm ufer steig hof markt chaussee".split()
ES_STREET = "calle avenida avda av paseo plaza camino ronda carrera travesía travesia vía carretera glorieta".split()
FR_STREET = "rue avenue av boulevard bd allée allee place impasse quai chemin cours square route passage".split()
TITLES = (
    "mr mrs ms miss dr prof sir madam mister herr frau fräulein señor señora señorita sr sra srta don doña "
    "monsieur madame mademoiselle mme mlle m"
).split()
NOT_STREET = frozenset(
    "to of from the at in on and or for by until till is was are near with after before ago this that these those my our her his "
    "other new old days day weeks week months month years year hours hour minutes times questions more and i we you it so "
    "sur de la sobre preguntas fragen zu".split()
) - {"old", "new"}

MAIL = re.compile(
    r"(?<![\w.+@-])[\w.%+-]+(?:\s?[@\uff20\ufe6b]\s?(?=[\w-]+" + DOT + r"[^\W\d_])|" + AT + r"(?=[\w-]+" + DOT + r"[^\W\d_]))[\w-]+(?:" + DOT + r"[\w-]+)*",
    re.I,
)
SPOKEN = re.compile(r"\b(?:" + "|".join(DIGIT_WORDS) + r")\b(?:[ ,-]{1,2}\b(?:" + "|".join(DIGIT_WORDS) + r")\b){5,}", re.I)
NUMBER = re.compile(
    r"(?<![\w.,-])(?:(?!(?:ID|NO|NR|CI) )[A-Z]{2} (?=\d)|[A-Z]{1,3}-?(?=\d))?[+(]?\d[\dA-Z]*(?:(?:\) ?-?|[ .\u00a0\u202f\u2011-]| / |/| - |/ ?)\(?\d[\dA-Z]*)*(?:[ -]?[A-Z](?![\w'’]))?", re.ASCII
)
_CAP = r"[^\W\d_][\w'’]*"
PLACES = (
    re.compile(rf"\b\d+ ?[a-zA-Z]?,? (?:{_CAP}[ ]){{1,3}}(?:{'|'.join(EN_STREET)})\b", re.I),
    re.compile(rf"\b(?:(?!\d)\w+[ -]?)?(?:{'|'.join(DE_STREET)})\.? \d+ ?[a-z]?\b", re.I),
    re.compile(rf"(?:\b(?:{'|'.join(ES_STREET)})\b\.?|\bC/) ?(?:de la |de los |de las |del |de )?(?:{_CAP}[ ]?){{1,3}}, ?(?:n[.º°o]* ?)?\d+ ?[a-z]?\b|(?:\b(?:{'|'.join(ES_STREET)})\b\.?|\bC/) ?(?:de la |de los |de las |del |de )?(?:{_CAP} ){{1,3}}(?:n[.º°o]* ?)?\d+ ?[a-z]?\b", re.I),
    re.compile(rf"\b\d+(?: ?bis| ?ter| ?[a-z])?,? (?:{'|'.join(FR_STREET)})\b\.? (?:de la |de l['’]|des |du |de |d['’]|l['’])?(?:{_CAP})(?: [A-ZÀ-Ý]\w*)*", re.I),
)
STREETS = frozenset({*EN_STREET, *ES_STREET, *FR_STREET}) - {"m", "st", "way", "place", "court"}
EN_STREET_SET = frozenset(EN_STREET)
DE_END = tuple(DE_STREET)
DIGIT_WORD_SET = frozenset(DIGIT_WORDS)
HAS_DIGIT = re.compile(r"\d").search
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?")
LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=50_000)
def fold(word: str) -> str:
    """Lower case without accents."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(ch))


@dataclass
class Names:
    """What is known of name words (folded): ``given`` and ``family`` ones, and ``common`` words that are seen often
    in the training sample without being either."""

    given: frozenset = frozenset()
    family: frozenset = frozenset()
    common: frozenset = frozenset()
    known: frozenset = field(init=False)
    seen: dict = field(init=False, repr=False, compare=False, default_factory=dict)

    def __post_init__(self):
        self.known = self.given | self.family

    def kind(self, word: str) -> str:
        """g, f, b (either), u (unknown and capitalised) or '' (no name)."""
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            got = self.seen[word] = self._kind(word)
        return got

    def _kind(self, word: str) -> str:
        parts = [fold(p) for p in word.split("-")]
        g, f = any(p in self.given for p in parts), any(p in self.family for p in parts)
        if g or f:
            return "f" if f and (len(parts) > 1 or not g) else "b" if f else "g"
        if word[0].isupper() and len(word) > 2 and parts[0] not in self.common and parts[0] not in TITLES:
            return "u"
        return ""


@dataclass
class Unit:
    """A stretch of text that may be personal data."""

    kind: str
    start: int
    end: int
    text: str
    marks: tuple = ()


def style(word: str) -> str:
    return "l" if word.islower() else "U" if word.isupper() and len(word) > 1 else "C"


def name_units(text: str, names: Names, taken: list[tuple[int, int]]) -> list[Unit]:
    """Runs of name words of one letter case: given and family name together, an initial between them
    or a comma after the family name allowed."""
    words = [m for m in WORD.finditer(text)]
    out, i = [], 0
    free = lambda m: not any(a <= m.start() < b for a, b in taken)
    toks = []
    for m in words:
        w = m[0]
        initial = len(w) == 2 and w[1] == "." and w[0].isalpha()
        if not initial:
            w = w.rstrip(".")
        k = "i" if initial else names.kind(w) if free(m) else ""
        toks.append((m.start(), m.start() + len(w), w, k))
    while i < len(toks):
        s, e, w, k = toks[i]
        if k in ("", "i"):
            i += 1
            continue
        run, j, comma = [toks[i]], i + 1, False
        while j < len(toks):
            ns, ne, nw, nk = toks[j]
            gap = text[run[-1][1] : ns]
            if nk == "i" and gap == " ":
                run.append(toks[j])
            elif nk and nk != "i" and style(nw) == style(w) and gap == " ":
                run.append(toks[j])
            elif nk and nk != "i" and style(nw) == style(w) and gap == ", " and len(run) == 1 and k in ("f", "b", "u") and nk in ("g", "b", "u"):
                comma = True
                run.append(toks[j])
            else:
                break
            j += 1
        while run and run[-1][3] == "i":
            run.pop()
        # unknown words that merely precede or follow a full name are no part of it
        kinds = [r[3] for r in run]
        where = lambda of: [n for n, x in enumerate(kinds) if x in of] or [-1]
        a, b, given, more, family = 0, len(kinds), where("gb")[-1], where("fbu")[-1], where("fb")[0]
        while b - a > 2 and kinds[a] == "u" and given > a and more > a + 1:
            a += 1
        while b - a > 2 and kinds[b - 1] == "u" and not comma and any(x in "fb" for x in kinds[a : b - 1]) and 0 <= family < b - 1:
            b -= 1
        run, kinds = run[a:b], kinds[a:b]
        solid = [x for x in kinds if x != "i"]
        pair = len(solid) >= 2 and (({"g", "b", "u"} & set(solid)) and ({"f", "b", "u"} & set(solid)))
        if pair and not (set(solid) <= {"g"} or set(solid) <= {"f"}):
            out.append(Unit("name", run[0][0], run[-1][1], text[run[0][0] : run[-1][1]], ("".join(kinds), "comma" if comma else "", style(w))))
            i = toks.index(run[-1], i) + 1
        else:
            # within a run of given names only, or of family names only, no part is a name either
            i = j if len(solid) > 1 else i + 1
    return out


def units(text: str, names: Names) -> list[Unit]:
    """All units of a text in order of position; none overlap."""
    low = text.lower()
    words = set(LETTERS.findall(low))
    out: list[Unit] = []
    taken: list[tuple[int, int]] = []

    def add(kind: str, a: int, b: int, marks: tuple = ()) -> None:
        if not any(x < b and a < y for x, y in taken):
            taken.append((a, b))
            out.append(Unit(kind, a, b, text[a:b], marks))

    if "@" in text or "\uff20" in text or "\ufe6b" in text or (not words.isdisjoint(("at", "arroba", "chez", "ät")) and (not words.isdisjoint(("dot", "punto", "punkt", "point")) or "[" in text or "(" in text or "{" in text)):
        for m in MAIL.finditer(text):
            add("mail", *m.span())
    if HAS_DIGIT(text):
        if "c/" in low or not words.isdisjoint(STREETS) or any(w in EN_STREET_SET or w.endswith(DE_END) for w in words):
            for n, p in enumerate(PLACES):
                for m in p.finditer(text):
                    if n == 0 and not NOT_STREET.isdisjoint(w.lower() for w in LETTERS.findall(m[0])):
                        continue
                    add("place", m.start(), m.start() + len(m[0].rstrip()), (("en", "de", "es", "fr")[n],))
        for m in NUMBER.finditer(text):
            a, b = m.span()
            if text[a] == "(" and ")" not in m[0]:
                a += 1
            add("number", a, b)
    if len(words & DIGIT_WORD_SET) > 1:
        for m in SPOKEN.finditer(text):
            add("number", *m.span(), ("spoken",))
    out += name_units(text, names, taken)
    out.sort(key=lambda u: u.start)
    return out
