"""Surrogates for personal data: a keyed bijection on the entities of each format, so that no two ever share one.

The letters and digits of an entity are written as numbers of mixed radix (a digit, a vowel or a consonant of its script, an
ideograph, and so on) and sent through a keyed Feistel network over just these numbers; separators, particles, street words,
country codes and the like stay. So a surrogate has the format, length and script of the entity, different entities have
different surrogates by construction, and the same entity has the same one everywhere, without a table of what was drawn.
Listed given names move one place round a keyed circle of the names of their gender and script.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

from evidra.llm.names import FEMALE, GIVEN

EMAIL, PHONE, ID, ADDRESS, NAME = TYPES = ("email", "phone", "identity_number", "address", "person_name")

#: Vowels and consonants of scripts that have both.
_VOWELS = {"latin": "aeiouy", "cyrillic": "аеиоуыэюяіїє", "greek": "αεηιουω"}
_CONSONANTS = {"latin": "bcdfghjklmnpqrstvwxz", "cyrillic": "бвгджзклмнпрстфхцчшщ", "greek": "βγδζθκλμνξπρσςτφχψ"}
#: First and last letter of scripts whose letters replace one another.
_RANGES = ((0x5D0, 0x5EA), (0x621, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x561, 0x586), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
#: Letters that normalisation leaves whole, and their plain spelling.
_WHOLE = {"ł": "l", "ø": "o", "đ": "d", "ı": "i", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ħ": "h"}
#: Country calling codes of one and of two digits; all others have three.
_SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Fixed value: control letters of Spanish identity numbers, by the remainder of the number.
_CONTROL = "TRWAGMYFPDXBNJZSQVHLCKE".lower()
PARTICLES = frozenset("van von de da del della di dos der den ter la le bin al las los du des".split())
#: Words of addresses that say what kind of street or part of a house it is; they stay.
STREET_WORDS = frozenset("""
street st road rd avenue ave lane ln boulevard blvd drive dr court ct close way terrace square sq place pl crescent row hill grove gardens mews walk parkway highway
quay flat apt apartment suite unit floor n s e w north south east west alte neue obere untere am an große kleine rue bd chemin allee impasse quai cours bis quater c calle avda avenida plaza
paseo ctra rua travessa largo ul os aleja plac caddesi cad sokagi sokak sok bulvari mahallesi mah no nº n° ул улица пр т проспект переулок пер площадь д дом кв via viale piazza corso vicolo in strasse straße str º
""".split()) | PARTICLES
_JOINED = re.compile(r"(?:stra(?:ß|ss)e|str|weg|gasse|allee|platz|ring|damm|ufer|straat|laan|plein|gatan|vagen|vej|gade)$")
_DIGIT_NAMES = "zero one two three four five six seven eight nine".split()


def plain(text: str) -> str:
    """Lower case without accents."""
    low = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return low if low.isascii() else "".join(_WHOLE.get(c, c) for c in low)


@lru_cache(4096)
def _class_of(c: str) -> tuple[str, str | int] | None:
    """Name of the class a character belongs to, and its letters or where they begin; nothing for what stays."""
    for kind in _VOWELS:
        for name, letters in (("V", _VOWELS[kind]), ("C", _CONSONANTS[kind])):
            if c in letters:
                return name + kind, letters
    for low, high in _RANGES:
        if low <= ord(c) <= high:
            return f"R{low}-{high}", low
    if c.isalpha() and c > "\x7f":
        low = ord(c) & ~31  # another script: letters of the same small block
        return f"R{low}-{low + 31}", low
    return None


class Cipher:
    """The keyed bijection."""

    def __init__(self, key: bytes):
        self.key = key
        self._circles: dict[tuple[bool, str], dict[str, str]] = {}

    def _number(self, *parts) -> int:
        return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=self.key, digest_size=16).digest(), "big")

    def permute(self, values: list[int], radices: list[int], tweak: str) -> list[int]:
        """Numbers of the given radices, sent to others of the same radices, none to itself: eight Feistel rounds over two
        halves, each turn added modulo the half's size; one step on the circle of all values; the rounds undone."""
        if not values:
            return values
        if len(values) == 1:
            r = radices[0]
            return [(values[0] + 1 + self._number(tweak) % (r - 1)) % r] if r > 1 else values
        half = len(values) // 2
        sides = [0, 0]
        sizes = [1, 1]
        for i, (v, r) in enumerate(zip(values, radices)):
            side = i >= half
            sides[side] = sides[side] * r + v
            sizes[side] *= r
        for turn in range(8):
            a = turn % 2
            sides[a] = (sides[a] + self._number(tweak, turn, sides[1 - a])) % sizes[a]
        sides = list(divmod((sides[0] * sizes[1] + sides[1] + 1) % (sizes[0] * sizes[1]), sizes[1]))
        for turn in range(7, -1, -1):
            a = turn % 2
            sides[a] = (sides[a] - self._number(tweak, turn, sides[1 - a])) % sizes[a]
        out = [0] * len(values)
        for i in range(len(values) - 1, -1, -1):
            side = i >= half
            sides[side], out[i] = divmod(sides[side], radices[i])
        return out

    def text(self, text: str, tweak: str, kept: frozenset[int] = frozenset(), any_letter: bool = False, letters_too: bool = True) -> str:
        """Every digit and, with ``letters_too``, letter, but for the places ``kept``, replaced by one of its class. A number does not begin to have a leading zero, or lose it."""
        places, values, radices, classes, pattern = [], [], [], [], []
        for i, c in enumerate(text):
            if i in kept:
                pattern.append(c)
                continue
            if "0" <= c <= "9":
                first = not (i and text[i - 1].isdigit())
                if first and c == "0":
                    pattern.append(c)
                    continue
                letters = "123456789" if first else "0123456789"
                name = "9" if first else "d"
            elif any_letter and "a" <= c <= "z":
                name, letters = "a", "abcdefghijklmnopqrstuvwxyz"
            else:
                found = _class_of(c) if letters_too else None
                if found is None:
                    pattern.append(c)
                    continue
                name, letters = found
            pattern.append(name)
            places.append(i)
            classes.append(letters)
            if isinstance(letters, str):
                values.append(letters.index(c))
                radices.append(len(letters))
            else:
                low, high = map(int, name[1:].split("-"))
                values.append(ord(c) - low)
                radices.append(high - low + 1)
        out = list(text)
        for i, v, letters in zip(places, self.permute(values, radices, tweak + "|" + " ".join(pattern)), classes):
            out[i] = letters[v] if isinstance(letters, str) else chr(letters + v)
        return "".join(out)

    def _next_name(self, name: str) -> str | None:
        female = name in _FEMALE
        if not female and name not in _LISTED:
            return None
        kind = (female, "ascii" if name.isascii() else "other")
        circle = self._circles.get(kind)
        if circle is None:
            names = sorted((n for n in _LISTED if (n in _FEMALE) == female and n.isascii() == name.isascii()), key=lambda n: self._number("circle", n))
            circle = self._circles[kind] = dict(zip(names, names[1:] + names[:1]))
        return circle[name]

    def given(self, name: str) -> str:
        listed = self._next_name(name)
        if listed is not None:
            return listed
        made = self.text(name, "given")
        while made in _LISTED:  # walking on along the same cycle keeps it a bijection
            made = self.text(made, "given")
        return made

    def entity(self, kind: str, entity: str) -> str:
        """The entity that replaces this one, in plain form."""
        if kind == EMAIL:
            return self.text(entity, kind) + ".example"
        if kind == PHONE:
            return self.text(entity, kind, frozenset(range(_prefix(entity))), letters_too=False)
        if kind == ID:
            return self._identity(entity)
        if kind == ADDRESS:
            return self._address(entity)
        first, _, rest = entity.partition(" ")
        return " ".join([self.given(first), *(w if w in PARTICLES else self.text(w, "surname") for w in rest.split(" ") if w)])

    def _address(self, entity: str) -> str:
        """Words and numbers each replaced by others: the words together, each number by a step that depends on the words."""
        kept = _street_places(entity)
        digits = {i for i, c in enumerate(entity) if c.isdigit()}
        words = self.text(entity, ADDRESS, kept | digits)
        street = re.sub(r"\d", "0", entity)
        return re.sub(r"\d+", lambda m: self.text(m.group(), f"{ADDRESS}|{street}|{m.start()}"), words)

    def _identity(self, entity: str) -> str:
        controlled = re.fullmatch(r"([xyz]?)(\d{7,8})([a-z])", entity)
        if controlled and len(controlled.group(1)) + len(controlled.group(2)) == 8 and controlled.group(3) in _CONTROL:
            # The control letter follows from the number; a wrong one stays as far off as it was.
            lead, digits, letter = controlled.groups()
            off = _CONTROL.index(letter) - _remainder(lead, digits)
            new = self.text("".join(digits), "identity" + lead)
            return lead + new + _CONTROL[(_remainder(lead, new) + off) % 23]
        return self.text(entity, ID, any_letter=True)


_LISTED = frozenset(plain(n) for n in GIVEN)
_FEMALE = frozenset(plain(n) for n in FEMALE)


def _remainder(lead: str, digits: str) -> int:
    return int(str("xyz".index(lead)) * bool(lead) + digits) % 23


def _prefix(phone: str) -> int:
    """How many characters at the front say how to read the rest: a plus or double zero with the country code, or one zero."""
    start = 1 if phone.startswith("+") else 2 if phone.startswith("00") else 0
    if not start:
        return int(phone.startswith("0"))
    rest = phone[start:]
    return start + next((n for n in (1, 2) if rest[:n] in _SHORT_CODES), min(3, len(rest)))


def _street_places(entity: str) -> frozenset[int]:
    kept: set[int] = set()
    for m in re.finditer(r"[^\W\d_]+|[º°]", entity):
        joined = _JOINED.search(m.group())
        if m.group() in STREET_WORDS:
            kept.update(range(m.start(), m.end()))
        elif joined and joined.start() > 1:
            kept.update(range(m.start() + joined.start(), m.end()))
    return frozenset(kept)


def entity_of(kind: str, text: str) -> str:
    """The entity behind a find: the same for all spellings that mean the same."""
    low = plain(text)
    if kind == EMAIL:
        low = re.sub(r"\s?[(\[{<]\s?at\s?[)\]}>]\s?|\sat\s|\s?@\s?", "@", low)
        return re.sub(r"\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s", ".", low)
    if kind in (PHONE, ID):
        words = {w: str(i) for i, w in enumerate(_DIGIT_NAMES)} | {"oh": "0"}
        low = re.sub(r"\b[a-z]+\b", lambda m: words.get(m.group(), m.group()), low) if kind == PHONE else low
        return re.sub(r"[^0-9a-z+]", "", low)
    if kind == NAME:
        parts = re.findall(r"[^\W\d_]+", low)
        if _last_first(text, parts):
            parts = [*parts[-1:], *parts[:-1]]
        # Initials between given name and surname do not make another person.
        return " ".join(p for i, p in enumerate(parts) if i == 0 or len(p) > 1)
    return re.sub(r"[\W_]+", " ", low).strip()


def _last_first(text: str, parts: list[str]) -> bool:
    return len(parts) > 1 and ("," in text or parts[0] not in _LISTED and parts[-1] in _LISTED)


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[:1].isupper() else word


_DOT = re.compile(r"\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s", re.I)


def render(kind: str, original: str, surrogate: str, cipher: Cipher) -> str:
    """The surrogate in the format of the original: separators, order, case and initials as there."""
    if kind == EMAIL:
        local, _, domain = surrogate.partition("@")
        dotted = _DOT.search(original)
        out = re.sub(r"^(.*?)(\s?[(\[{<]\s?at\s?[)\]}>]\s?|\sat\s|\s?@\s?)(.*)$", lambda m: local + m.group(2) + (domain.replace(".", dotted.group()) if dotted else domain), original, flags=re.I | re.S)
        return out.upper() if original.isupper() else out
    if kind in (PHONE, ID):
        fill = iter([c for c in surrogate if c.isdigit() or kind == ID and c.isalpha()])
        if kind == PHONE and not any(c.isdigit() for c in original):
            spoken = {*_DIGIT_NAMES, "oh"}
            return re.sub(r"[A-Za-z]+", lambda m: _cased(_DIGIT_NAMES[int(next(fill, "0"))], m.group()) if m.group().lower() in spoken else m.group(), original)
        out = "".join((next(fill, c) if c.isdigit() or kind == ID and c.isalpha() else c) for c in original)
        return out.upper() if kind == ID and original.upper() == original else out
    if kind == ADDRESS:
        words = iter(surrogate.split(" "))

        def one(m: re.Match) -> str:
            old, new = m.group(), next(words, m.group())
            return old if plain(old) == new else _cased(new, old)

        return re.sub(r"[^\W_]+", one, original)
    given, *surnames = surrogate.split(" ")
    parts = list(re.finditer(r"[^\W\d_]+", original))
    last_first = _last_first(original, [plain(p.group()) for p in parts])
    fill, out, at = iter(surnames), [], 0
    for i, p in enumerate(parts):
        old = p.group()
        if i == (len(parts) - 1 if last_first else 0):
            new = given
        elif len(plain(old)) == 1:
            new = cipher.text(plain(old), "initial")
        else:
            new = next(fill, old)
        out += [original[at : p.start()], _cased(new, old) if len(old) > 1 else new.upper() if old.isupper() else new]
        at = p.end()
    return "".join(out) + original[at:]


def _format(text: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "0", text))


def surrogate(kind: str, text: str, cipher: Cipher) -> tuple[str, str, str]:
    """Entity, replacing entity and what is written for a find.

    What is written is checked: it differs from what was there and has its format, but for the added ending of an email
    address. Where a find holds nothing that can be replaced, a placeholder is written.
    """
    entity = entity_of(kind, text)
    new = cipher.entity(kind, entity)
    shown = render(kind, text, new, cipher)
    if kind != EMAIL and (shown == text or _format(shown) != _format(text)):
        shown = f"[{kind.upper()}]"
    return entity, new, shown
