"""Personal information in free text: found, and replaced by typed placeholders or by keyed surrogates.

Five types are found: email, phone, identity_number, address, person_name. Formats are matched by pattern, in the ways people
write them to evade or to be read aloud. A person's name is a given name or an initial together with a surname: a listed
given name with a word that is no ordinary one, or two words that are no ordinary ones where the words around them speak of a
person. Overlapping finds are settled in a fixed order of types, so the parts of an email address are no name and an identity
number no phone.

Each find gets a surrogate from a keyed bijection (``surrogates.py``), within the same narrow pass: the same entity, however
spelled, always the same one (coreference), another entity another one. A surrogate keeps type, format, script and gender.
Text around a find stays as it is.

Defined cases: null and empty texts have no finds and stay as they are; [deleted] and the like are ordinary text; long texts
are read whole; repeated rows are treated alike, each for itself.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import Remembered
from evidra.llm.names import AMBIGUOUS, GIVEN, NO_SURNAME, PERSON_AFTER, PERSON_BEFORE, SURNAME_ENDING, THING_WORDS
from evidra.llm.surrogates import ADDRESS, EMAIL, ID, NAME, PHONE, Cipher, surrogate
from evidra.llm.tokenizer import VOCABULARY
from evidra.session import map_arrow

_LOCAL = r"(?<![\w.+%'-])[\w](?:[\w.+%'-]{0,62}[\w])?"
_LABEL = r"[^\W_](?:[\w-]{0,61}[^\W_])?"
_EMAILS = (
    re.compile(rf"{_LOCAL}\s?@\s?{_LABEL}(?:\.{_LABEL})*\.[^\W\d_]{{2,}}"),
    re.compile(rf"{_LOCAL}\s?(?:[(\[{{<]\s?(?:at|AT|At)\s?[)\]}}>])\s?{_LABEL}(?:\s?(?:\.|[(\[{{<]\s?(?:dot|DOT|Dot)\s?[)\]}}>]|\b(?:dot|DOT)\b)\s?{_LABEL})+"),
    re.compile(rf"{_LOCAL}\s(?:AT|at)\s{_LABEL}(?:\s(?:DOT|dot)\s{_LABEL})+"),
    re.compile(rf"{_LOCAL}\s?@\s?{_LABEL}(?:\s?(?:[(\[]\s?dot\s?[)\]]|\bDOT\b)\s?{_LABEL})+"),
)

_CODE = r"(?=[A-Z0-9-]*\d)[A-Z0-9](?:[A-Z0-9]|[-/](?=[A-Z0-9])){4,17}"
_IDS = (
    re.compile(r"(?<![\w-])\d{8}[- ]?[A-HJ-NP-TV-Z](?![\w-])", re.I),
    re.compile(r"(?<![\w-])[XYZ]-?\d{7}-?[A-Z](?![\w-])", re.I),
    re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    re.compile(r"(?:ssn|social(?:\s+security)?(?:\s+(?:number|no\.?))?)\s*(?:is|:|#|no\.?)?\s*(\d{3}[ .-]?\d{2}[ .-]?\d{4})(?!\d)", re.I),
    re.compile(r"(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])"),
    re.compile(r"\bni (?:number|no\.?)\s*:?\s*([a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d])(?!\w)", re.I),
    re.compile(r"(?<![\d.-])[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})(?![\d-])"),
    re.compile(r"(?:\bpesel|\btc kimlik(?: no)?|\bt\.c\.|\bинн|\bснилс|\bpersonnummer|\bbsn|\bcnp|\boib|\bnif|\bnss|\bsécu(?:rité sociale)?)\W{0,3}(?:no\.?|nr\.?|n°|is|:)?\s*(\d(?:[ -]?\d){7,14})(?!\w)", re.I),
    re.compile(r"\bcodice fiscale\W{0,3}([A-Z0-9]{16})(?!\w)", re.I),
    re.compile(r"(?:steuer-?\s?id(?:nr)?\.?|steueridentifikationsnummer|idnr\.?|tax (?:id|number))\s*(?:is|:|lautet|nr\.?)?\s*(\d{2} ?\d{3} ?\d{3} ?\d{3})(?!\d)", re.I),
    re.compile(r"(?<![\d.])\d{3}\.\d{3}\.\d{3}-\d{2}(?!\d)"),
    re.compile(r"(?:id[ -]?card|identity[ -]card|national id|personalausweis(?:nummer)?|ausweis(?:nummer)?|carte d'identité|documento de identidad|dowód(?: osobisty)?|kimlik)\s*(?:is|:|no\.?|nr\.?|number|n°|#)?\s*((?i:" + _CODE + "))", re.I),
    re.compile(r"(?:passport|passeport|reisepass|pasaporte|passaporte|paszport|pasaport|паспорт)\s*(?:is|:|no\.?|nr\.?|number|n°|#|nummer)?\s*((?i:" + _CODE + "))", re.I),
    re.compile(r"(?:driver'?s?'?|driving|driver’s) licen[cs]e\s*(?:is|:|no\.?|nr\.?|number|#)?\s*((?i:" + _CODE + "))", re.I),
    re.compile(r"(?:führerschein|permis de conduire|permiso de conducir|prawo jazdy)\s*(?:is|:|no\.?|nr\.?|n°)?\s*((?i:" + _CODE + "))", re.I),
)
_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)"
_EXTENSION = r"(?:,?\s?(?:ext|extension|x|durchwahl)\.?\s?\d{1,5})?"
_PHONES = (
    re.compile(r"(?<![\w+.])(?:\+|00)[1-9](?:[ ./-]?\(?\d\)?){7,14}(?!\d)" + _EXTENSION),
    re.compile(r"(?<![\w.,/:-])(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}[ .-]\d{4}(?![\w-])" + _EXTENSION),
    re.compile(r"(?<![\d.,/:-])0[1-9](?:[ .-]\d\d){4}(?![\d-])"),
    re.compile(r"(?<![\d.,/:-])0[1-9]\d{1,3}[ /-]\d{3} ?\d{3,5}(?![\d-])"),
    re.compile(r"(?<![\d.,/:-])0[1-9]\d{8,9}(?!\d)"),
    re.compile(r"(?<![\w.,/:-])\d(?:[ .-]\d){6,14}(?![\w-]|[ .]\d)"),
    re.compile(rf"\b{_DIGIT_WORD}(?:[ ,.-]+{_DIGIT_WORD}){{5,14}}\b", re.I),
    re.compile(r"(?:\btel\.?|\bphone|\bmobile|\bcell|\bwhatsapp|\bcall me (?:on|at)|\breach me (?:on|at)|\bmy number is|\bfon|\bhandy(?:nummer)?|\btéléphone|\bteléfono|\btelefone|\btelefon|\bтел\.?|\bтелефон)\s*(?:no\.?|number|nummer|is|:|on|at)?\s*((?:\(?\d\)?[ ./-]?){6,14}\d)(?![\w-])", re.I),
)

_STREET = r"(?:street|st|road|rd|avenue|ave|lane|ln|boulevard|blvd)"
_STREET_CAPITAL = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Boulevard|Blvd|Drive|Dr|Court|Ct|Close|Way|Terrace|Square|Sq|Place|Pl|Crescent|Row|Hill|Grove|Gardens|Mews|Walk|Parkway|Highway|Quay|STREET|ROAD|AVENUE|LANE|BOULEVARD|DRIVE|ST|RD|AVE|BLVD)"
_CAPITALISED = r"[^\W\d_a-zà-ÿ][\w'’-]*"
_TOWN = rf"(?:,? (?:in )?(?:\d{{4,6}} )?{_CAPITALISED}(?:[ -](?:del|de|les|la|sur|am|an der|{_CAPITALISED})){{0,3}}(?: \d{{4,6}})?)?"
_FLAT = r"(?:(?:,? (?:Apt|Apartment|Suite|Unit|Flat|Floor|#)\.? ?\d+[A-Za-z]?)?)"
_ADDRESSES = (
    re.compile(rf"(?:\b(?:Flat|Apt|Unit|Suite|Apartment) \d+\w?, )?(?<![\w.,/-])\d{{1,5}}(?:-\d{{1,5}})?[A-Za-z]? (?:[NSEW]\.? )?(?:{_CAPITALISED} ){{1,3}}{_STREET_CAPITAL}\b\.?{_FLAT}"),
    re.compile(rf"(?<![\w.,/-])\d{{1,5}}[a-z]? (?:[nsew]\. )?(?!(?:the|a|an|of|on|in|at|to|my|our|your|per|main|each|more|percent|minutes|hours|days|weeks|users|files|units|items|lines|records|rows|years|months)\b)[^\W\d_]{{3,}} {_STREET}\b\.?(?! \w+ (?:fair|fairs))", re.I),
    re.compile(r"(?:\b(?:Alte|Neue|Obere|Untere|Am|An der|Große|Kleine)[rsn]? )?\b[^\W\d_]{3,}(?:-?[Ss]tra(?:ß|ss)e|-?[Ss]tr\.|weg|gasse|allee|-?[Pp]latz|ring|damm|ufer|straat|laan|plein|gatan|vägen|vej|gade) \d{1,4} ?[a-zA-Z]?\b(?!\w)"),
    re.compile(r"(?<![\w.,/-])\d{1,4}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|boulevard|bd|place|chemin|allée|impasse|quai|cours)\s+(?:de la |de l['’]|des |du |de |d['’])?[^\W\d_][\w'’-]+", re.I),
    re.compile(r"(?:\bC/|\bCalle|\bAvda\.?|\bAvenida|\bPlaza|\bPaseo|\bCtra\.?|\bRua|\bTravessa|\bLargo)\s+(?:(?:del|de la|de los|de las|de|da|do|dos|das|los|las|el|la)\s)?[^\W\d_][\w'’-]+(?: [^\W\d_][\w'’-]+){0,3},? (?:n\.?[ºo°]? ?)?\d{1,4}\b"),
    re.compile(r"\b(?:ul|al|pl|os)\.\s?[^\W\d_][\w.'’-]*(?: [^\W\d_][\w.'’-]*){0,3} \d{1,4}[a-zA-Z]?(?:/\d{1,4})?", re.I),
    re.compile(r"\b[^\W\d_][\w'’-]+ (?:Caddesi|Cad\.|Sokağı|Sokak|Sok\.|Bulvarı|Mahallesi|Mah\.)[ ,]*(?:No[:.]? ?)?\d{1,4}"),
    re.compile(r"(?:\bул\.|\bулица|\bпр-т|\bпроспект|\bпереулок|\bпер\.|\bплощадь)\s?[^\W\d_][\w-]+(?: [^\W\d_][\w-]+){0,2},? (?:д(?:ом|\.)? ?)?\d{1,4}", re.I),
    re.compile(r"\b(?:Via|Viale|Piazza|Corso|Vicolo) (?:(?:dei|della|delle|del|di|da) )?[^\W\d_a-zà-ÿ][\w'’-]+(?: [^\W\d_a-zà-ÿ][\w'’-]+){0,2},? \d{1,4}\b"),
)
#: Cheap signs that a group of patterns can match at all, looked for in the lower-case text and its words.
_NUMBER_SIGN = re.compile(r"\d(?:[^\w\n]{0,3}\d){6}|\d\d ?\d\d ?\d\d ?[a-d]\b|\d{4}-\d{4}")
_ID_WORDS = frozenset("card id-card national identity reisepassnummer social ssn passport passeport reisepass pasaporte passaporte paszport pasaport license licence ausweis personalausweis ausweisnummer personalausweisnummer carte documento dowód kimlik паспорт führerschein permis permiso prawo codice".split())
_DIGIT_WORDS = frozenset(_DIGIT_WORD[3:-1].split("|"))
_STREET_SIGNS = tuple(frozenset(x.split()) for x in (
    "street road avenue ave lane ln boulevard blvd rd drive dr court close way terrace square place crescent hill grove gardens mews walk parkway highway quay st row ct sq pl",
    "street st road rd avenue ave lane ln boulevard blvd",
    "",
    "rue avenue boulevard bd place chemin allée impasse quai cours",
    "c calle avda avenida plaza paseo ctra rua travessa largo",
    "ul al pl os",
    "caddesi cad sokağı sokak sok bulvarı mahallesi mah",
    "ул улица пр-т проспект переулок пер площадь",
    "via viale piazza corso vicolo",
))
_JOINED_STREET = ("straße", "strasse", "str", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer", "straat", "laan", "plein", "gatan", "vägen", "vej", "gade")
_SPACED = {c: " " for c in range(128) if not chr(c).isalnum() and chr(c) != "-"} | {ord(c): " " for c in "’‘“”„‚«»‹›–—…¡¿•·→★"}
_SPACED_BYTES = bytes(32 if c in _SPACED else c for c in range(256))
_CAPITAL_STREET = re.compile(rf" {_STREET_CAPITAL}\b")

_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SURNAME = r"(?:(?:van|von|de|da|del|di|dos|der|den|ter|la|le|bin|al)[ -]){0,2}(?:[OD]['’]|Mc|Mac)?[^\W\d_]+(?:['’-][^\W\d_]+)*"
_AFTER_GIVEN = re.compile(rf"[ \t]+(?:[^\W\d_a-zà-ÿ]\.[ \t]?){{0,2}}({_SURNAME})")
_BEFORE_GIVEN = re.compile(r"([^\W\d_]+(?:['’-][^\W\d_]+)*),[ \t]+$")
_INITIAL = re.compile(rf"(?<![\w.])(?<!\d )([^\W\d_a-zà-ÿ])\.[ \t]?(?:[^\W\d_a-zà-ÿ]\.[ \t]?)?([^\W\d_a-zà-ÿ][^\W\d_]*[^\W\d_A-ZÀ-Þ](?:-{_CAPITALISED})?|[^\W\d_a-zà-ÿ]{{4,}}(?:-[^\W\d_a-zà-ÿ]+)?)(?![\w@])")
_ENDING = re.compile(SURNAME_ENDING + "$", re.I)
_INITIAL_SIGN = re.compile(r"(?<![\w])[^\W\d_a-z]\.")
_PROPER = r"[^\W\d_a-zà-ÿ][^\W\d_A-ZÀ-Þ]+(?:-[^\W\d_a-zà-ÿ][^\W\d_A-ZÀ-Þ]+)?"
_PAIR = re.compile(rf"(?<![\w@/.-])({_PROPER})((?:[ \t]+[^\W\d_a-zà-ÿ]\.)?[ \t]+)((?:(?:van|von|de|da|del|di|dos|der|den|ter|la|le|bin|al)[ -]){{0,2}}(?:[OD]['’]|Mc|Mac)?{_PROPER})(?![\w@'’])")
#: Two capitalised words side by side, roughly: what the pattern above can begin to match.
_PAIR_SIGN = re.compile(r"[^\W\d_a-zà-ÿ][^\W\d_A-Z]+[ \t]+(?:[^\W\d_a-z]\.[ \t]+|(?:van|von|de|da|del|di|dos|der|den|ter|la|le|bin|al)[ -])*[^\W\d_a-zà-ÿ]\w")
_LAST_WORD = re.compile(r"((?:mrs?|ms|dr|prof|sra?|mme|m|st)\.|[^\W\d_]+[,:]?)[ \t]*$", re.I)
_NEXT_WORD = re.compile(r"(?:['’]s)?[ \t]+([^\W\d_]+)")


class Vocabulary:
    """Ordinary words, as a public tokenizer knows them in lower case after a blank."""

    def __init__(self, path: str = VOCABULARY):
        tokens = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
        self.common = frozenset(t[1:] for t in tokens if t[0] == "Ġ" and len(t) > 3 and t[1:].isalpha() and t[1:].islower()) - GIVEN


def _capital(word: str) -> bool:
    return word[:1].isupper()


def _is_surname(word: str, given: str) -> bool:
    last = word.split()[-1]
    low = last.lower()
    return len(low) > 1 and low not in NO_SURNAME and (_capital(last) or not _capital(given))


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before and after a place, lower case, without crossing a line."""
    before, after = _LAST_WORD.search(text, max(0, start - 30), start), _NEXT_WORD.match(text, end)
    return before.group(1).lower().rstrip(".,:") if before else "", after.group(1) if after else ""


def _is_thing(text: str, start: int, end: int, surname: str) -> bool:
    """Whether the words around say that a name is a place, a firm, a work or a product."""
    before, after = _around(text, start, end)
    return surname.lower() in THING_WORDS or after[:1].isupper() and after.lower() in THING_WORDS or before == "the" and not after.islower()


def _names(text: str, common: frozenset[str], given_there: bool = True) -> Iterator[tuple[int, int]]:
    for m in _WORDS.finditer(text) if given_there else ():
        given = m.group()
        low = given.lower()
        if low not in GIVEN:
            continue
        capital = _capital(given)
        if not capital and low in AMBIGUOUS:
            continue
        after = _AFTER_GIVEN.match(text, m.end())
        if after and _is_surname(after.group(1), given) and (after.group(1).lower() not in GIVEN or _ENDING.search(after.group(1))):
            surname = after.group(1)
            last = surname.split()[-1].lower()
            if _capital(surname.split()[-1]) and capital:
                if not _is_thing(text, m.start(), after.end(), surname.split()[-1]):
                    yield m.start(), after.end()
                continue
            before, following = _around(text, m.start(), after.end())
            if len(last) > 4 and last not in common and (_ENDING.search(surname) or before in PERSON_BEFORE or following.lower() in PERSON_AFTER):
                yield m.start(), after.end()
                continue
        front = _BEFORE_GIVEN.search(text, _back(text, m.start()), m.start())
        if front:
            surname = front.group(1)
            if surname.lower() not in NO_SURNAME and surname.lower() not in GIVEN and (capital and _capital(surname) or _ENDING.search(surname)) and len(surname) > 2:
                listed = _LISTED.search(text, max(0, front.start() - 30), front.start())
                if not listed or listed.group(1) and listed.group(1).lower() in PERSON_BEFORE or _ENDING.search(surname):
                    yield front.start(), m.end()
    for m in _INITIAL.finditer(text):
        surname = m.group(2)
        low = surname.lower()
        if low in NO_SURNAME or len(surname) < 3 or _STREET_NEXT.match(text, m.end()):
            continue
        if _LETTER_BEFORE.search(text, max(0, m.start() - 12), m.start()):
            continue
        yield m.start(), m.end()
    at = 0
    while m := _PAIR.search(text, at):
        given, surname = m.group(1), m.group(3)
        last = surname.split()[-1]
        at = m.start(3)  # the second word may begin the next pair
        if given.lower() in GIVEN or any(w in common or w in NO_SURNAME or w in THING_WORDS for w in (given.lower(), last.lower())):
            continue
        before, after = _around(text, m.start(), m.end())
        if (before in PERSON_BEFORE or after.lower() in PERSON_AFTER) and not _is_thing(text, m.start(), m.end(), last):
            yield m.start(), m.end()
            at = m.end()


_LISTED = re.compile(r"(?:([^\W\d_]+),|\band|\bcompared)\s+$")
_STREET_NEXT = re.compile(rf"\s+{_STREET}\b", re.I)
_LETTER_BEFORE = re.compile(r"\b(?:is|are|was|letter|letters|column|size|point|figure|table|plan|option|vitamin|type|class|grade|hepatitis|appendix|section|step|phase|vs|no)\s+$", re.I)


def _back(text: str, start: int) -> int:
    """Where the word and the comma before a place begin, whatever the word's length."""
    at = text.rfind(",", max(0, start - 4), start)
    while at > 0 and (text[at - 1].isalpha() or text[at - 1] in "'’-"):
        at -= 1
    return max(0, at)


def _spans(patterns: tuple, text: str) -> Iterator[tuple[int, int]]:
    for p in patterns:
        for m in p.finditer(text):
            yield m.span(1) if p.groups and m.group(1) else m.span()


def _find(text: str, common: frozenset[str]) -> list[tuple[int, int, str]]:
    starts: list[int] = []
    found: list[tuple[int, int, str]] = []

    def take(kind: str, spans: Iterator[tuple[int, int]]) -> None:
        for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
            i = bisect_right(starts, a)
            if a < b and (not i or found[i - 1][1] <= a) and (i == len(starts) or starts[i] >= b):
                starts.insert(i, a)
                found.insert(i, (a, b, kind))

    low = text.lower()
    if "@" in low or "at" in low and ("dot" in low or _AT_SIGN.search(low)):
        take(EMAIL, _spans(_EMAILS, text))
    words = (low.encode().translate(_SPACED_BYTES).decode() if low.isascii() else _NO_WORD.sub(" ", low)).split()
    there = set(words)
    if "-" in low:
        there.update(x for w in words if "-" in w for x in w.split("-"))
    number = _NUMBER_SIGN.search(low) is not None
    if number or not _ID_WORDS.isdisjoint(there):
        take(ID, _spans(_IDS, text))
    if _DIGIT.search(low):
        for pattern, signs in zip(_ADDRESSES, _STREET_SIGNS):
            if signs:
                sign = not signs.isdisjoint(there)
            else:
                sign = any(words[i - 1].endswith(_JOINED_STREET) for i, w in enumerate(words) if i and "0" <= w[0] <= "9")
            if sign and (pattern is not _ADDRESSES[0] or _CAPITAL_STREET.search(text)):
                take(ADDRESS, _spans((pattern,), text))
    if number or not _DIGIT_WORDS.isdisjoint(there) and sum(w in _DIGIT_WORDS for x in words for w in x.split("-")) > 5:
        take(PHONE, (s for s in _spans(_PHONES, text) if _is_phone(text[s[0] : s[1]])))
    given = not GIVEN.isdisjoint(there)
    if given or _INITIAL_SIGN.search(text) or _PAIR_SIGN.search(text):
        take(NAME, _names(text, common, given))
    if any(k == ADDRESS for _, _, k in found):
        found = _with_towns(text, found)
    return found


_AT_SIGN, _DIGIT, _NO_WORD = re.compile(r"at ?[)\]}>]"), re.compile(r"\d"), re.compile(r"[^\w-]+")
_TOWN_AFTER = re.compile(rf"(?:,[ ]+(?:\d{{4,6}} )?|[ ]in |[ ]\d{{4,6}} )({_CAPITALISED})(?:[ -](?:del|de|les|la|sur|am|{_CAPITALISED})){{0,2}}(?:,? \d{{4,6}})?")


def _with_towns(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Addresses with the town that follows, up to the next find; a word that begins a sentence or a name is no town."""
    out = []
    for i, (a, b, kind) in enumerate(found):
        if kind == ADDRESS:
            town = _TOWN_AFTER.match(text, b, found[i + 1][0] if i + 1 < len(found) else len(text))
            if town and town.group(1).lower() not in NO_SURNAME and town.group(1).lower() not in GIVEN:
                b = town.end()
        out.append((a, b, kind))
    return out


def _is_phone(text: str) -> bool:
    digits = sum(c.isdigit() for c in text)
    if digits == 0:
        return True
    return 7 <= digits <= 20 and not re.fullmatch(r"\d{4}-\d\d-\d\d.*", text)


_ORDINARY: list[frozenset[str]] = []


def ordinary_words() -> frozenset[str]:
    """The ordinary words of this process; workers are handed theirs."""
    if not _ORDINARY:
        _ORDINARY.append(Vocabulary().common)
    return _ORDINARY[0]


def find(text: str | None, common: frozenset[str] | None = None) -> list[tuple[int, int, str]]:
    """Start, end and type of every find in a body of text, in order and without overlaps."""
    return _find(text, ordinary_words() if common is None else common) if text else []


_HANDLE_PART = re.compile(r"[^\W\d_]+")


_HANDLES: Remembered = Remembered(2_000_000)


def find_in_handle(handle: str | None, common: frozenset[str] | None = None) -> tuple[tuple[int, int, str], ...]:
    """Finds in an author name, where a name may stand in lower case, with any separator, or before a number."""
    if not handle:
        return ()
    known = _HANDLES.get(handle)
    if known is None:
        known = _finds_in_handle(handle, ordinary_words() if common is None else common)
        _HANDLES.keep(handle, known, 2 * len(handle))
    return known


def _finds_in_handle(handle: str, common: frozenset[str]) -> tuple[tuple[int, int, str], ...]:
    found = [f for f in _find(handle, common) if f[2] != NAME]
    if found and found[0][2] == EMAIL:
        return tuple(found)
    phone = re.search(r"(?<!\d)(?:\+\d{9,14}|0[1-9]\d{8,9}|\d{3}-\d{3}-\d{4})(?!\d)", handle)
    if phone and not found:
        return ((phone.start(), phone.end(), PHONE),)
    parts = list(_HANDLE_PART.finditer(handle))
    if not found and len(parts) > 1:
        low = [p.group().lower() for p in parts]
        ends = [i for i in (0, len(low) - 1) if low[i] in GIVEN and (low[i] not in AMBIGUOUS or parts[i].group()[:1].isupper() and " " in handle)]
        if ends:
            rest = [w for i, w in enumerate(low) if i != ends[0]]
            if all(len(w) > 1 or "." in handle for w in rest) and any(len(w) > 2 for w in rest) and not any(w in NO_SURNAME or w in THING_WORDS or w in common for w in rest):
                found.append((parts[0].start(), parts[-1].end(), NAME))
        elif len(parts) == 2 and len(low[0]) == 1 and len(low[1]) > 3 and low[1] not in common and (_ENDING.search(low[1]) or handle[parts[0].end() : parts[1].start()].startswith(".") and parts[1].group()[0].isupper()):
            found.append((parts[0].start(), parts[1].end(), NAME))
    return tuple(sorted(found))


# --- replacement -------------------------------------------------------------------------------------------------------


def placeholder(kind: str) -> str:
    return f"[{kind.upper()}]"


def replaced(text: str, finds: list[tuple[int, int, str]]) -> str:
    """The text with the finds (start, end, new text) replaced; all else as it was."""
    out, at = [], 0
    for a, b, new in sorted(finds):
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:]


# --- Spark -------------------------------------------------------------------------------------------------------------


Find = tuple[int, int, str, str, str, str, str]


class Reader:
    """All finds of a field with their surrogates: start, end, type, text, entity, replacing entity, what is written."""

    def __init__(self, secret: bytes, common: frozenset[str], handles: frozenset[str]):
        self.cipher, self.common, self.handles = Cipher(secret), common, handles
        self.known = Remembered(2_000_000)

    def finds(self, field: str, text: str | None) -> list[Find]:
        if not text:
            return []
        spans = find_in_handle(text, self.common) if field in self.handles else find(text, self.common)
        return [(a, b, kind, text[a:b], *self._surrogate(kind, text[a:b])) for a, b, kind in spans]

    def _surrogate(self, kind: str, found: str) -> tuple[str, str, str]:
        made = self.known.get((kind, found))
        if made is None:
            made = surrogate(kind, found, self.cipher)
            self.known.keep((kind, found), made, 4 * len(found))
        return made


def _with_reader(df: DataFrame, key: str, bodies: list[str], handles: list[str], secret: bytes, vocabulary: str, run, schema: str) -> DataFrame:
    """``run(reader, batch, fields)`` over the rows, with the ordinary words broadcast (their number is that of a vocabulary)."""
    fields = (*bodies, *handles)
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary).common)
    kind = df.schema[key].dataType.simpleString()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(secret, shared.value, frozenset(handles))
        for b in batches:
            yield run(reader, b, fields)

    return map_arrow(df.select(F.col(key).alias("key"), *fields), over, f"key {kind}, {schema}")


def _types_of(reader: Reader, b: pa.RecordBatch, fields: tuple[str, ...]) -> pa.RecordBatch:
    keys, names, kinds = [], [], []
    rows = b.column("key").to_pylist()
    for f in fields:
        for key, text in zip(rows, b.column(f).to_pylist()):
            # A type counts through a find that has its checked surrogate.
            for kind in sorted({x[2] for x in reader.finds(f, text) if x[6] != x[3]}):
                keys.append(key)
                names.append(f)
                kinds.append(kind)
    return pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field("key").type), pa.array(names, pa.string()), pa.array(kinds, pa.string())], ["key", "field_name", "pii_type"])


def types_present(df: DataFrame, key: str, bodies: list[str], handles: list[str], secret: bytes, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row, field and type of the finds that were given a surrogate. Columns key, field_name and pii_type."""
    return _with_reader(df, key, bodies, handles, secret, vocabulary, _types_of, "field_name string, pii_type string")


_MENTION = ["key", "field_name", "start", "end", "pii_type", "found", "entity", "surrogate", "written"]


def _mentions_of(reader: Reader, b: pa.RecordBatch, fields: tuple[str, ...]) -> pa.RecordBatch:
    out = [(key, f, *x) for f in fields for key, text in zip(b.column("key").to_pylist(), b.column(f).to_pylist()) for x in reader.finds(f, text)]
    types = [b.schema.field("key").type, pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 5]
    columns = zip(*out) if out else [()] * len(_MENTION)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], _MENTION)


def mentions(df: DataFrame, key: str, bodies: list[str], handles: list[str], secret: bytes, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every find with its place, text, entity, replacing entity and what is written for it."""
    return _with_reader(df, key, bodies, handles, secret, vocabulary, _mentions_of, "field_name string, start int, end int, pii_type string, found string, entity string, surrogate string, written string")


def _replaced_in(reader: Reader, b: pa.RecordBatch, fields: tuple[str, ...]) -> pa.RecordBatch:
    keys, names, marked, natural = [], [], [], []
    rows = b.column("key").to_pylist()
    for f in fields:
        for key, text in zip(rows, b.column(f).to_pylist()):
            finds = reader.finds(f, text)
            keys.append(key)
            names.append(f)
            marked.append(replaced(text, [(x[0], x[1], placeholder(x[2])) for x in finds]) if finds else text)
            natural.append(replaced(text, [(x[0], x[1], x[6]) for x in finds]) if finds else text)
    return pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field("key").type), pa.array(names, pa.string()), pa.array(marked, pa.string()), pa.array(natural, pa.string())], ["key", "field_name", "redacted", "surrogate_text"])


def replace_all(df: DataFrame, key: str, bodies: list[str], handles: list[str], secret: bytes, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every row's fields with typed placeholders (``redacted``) and with surrogates (``surrogate_text``), in one pass without a shuffle."""
    return _with_reader(df, key, bodies, handles, secret, vocabulary, _replaced_in, "field_name string, redacted string, surrogate_text string")


def surrogate_checks(found: DataFrame) -> DataFrame:
    """The collision check over all ``mentions``: per type its mentions, entities and replacing entities, how many entities share
    one (distinctness) and how many have several (coreference). Only finds are shuffled, and combined before that."""
    pairs = found.groupBy("pii_type", "entity", "surrogate").agg(F.count("*").alias("n"))
    per_type = lambda by, out: pairs.groupBy("pii_type", by).agg(F.count("*").alias("k")).groupBy("pii_type").agg(F.count("*").alias(out[0]), F.count_if(F.col("k") > 1).alias(out[1]))
    return pairs.groupBy("pii_type").agg(F.sum("n").alias("mentions")).join(per_type("entity", ("entities", "split_entities")), "pii_type").join(per_type("surrogate", ("surrogates", "shared_surrogates")), "pii_type")
