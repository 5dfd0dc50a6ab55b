"""Garbled text from wrong character encoding: found, and restored where the bytes are still there.

Two kinds of step are undone. UTF-8 read as a single-byte charset, and escapes, leave traces within each stretch between
blanks: there a best-first search runs over a graph of texts whose edges read well-formed UTF-8 byte runs as their
characters or resolve escapes. Every edge shortens the text, a hash of visited texts keeps the graph finite, and the search
ends only when nothing left in the queue can be cheaper than the best text found: no limit on steps or states.
Single-byte charsets mistaken for one another can look like ordinary letters in one word, so those edges work on runs of
stretches: the run with the largest gain is taken, and only if its letters then fit one living alphabet and did not before,
or signs stood within its words. Both are repeated as long as the text gets cheaper.

The character-plausibility cost knows the alphabets of living languages (``alphabets.py``): letters that no language writes
together, letters of several scripts in one word, signs within words, odd changes of case, control and replacement
characters are dear; a word whose letters one language has costs nothing, so it is never changed for its own sake.

Replacement characters and stray control characters show a wrong decoding whether it can be repaired or not.
Defined cases: null, empty and plain ASCII texts without escapes are clean and stay as they are; whole texts are read,
whatever their length; text beside a garbled stretch stays as it is.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import Remembered, portions
from evidra.llm.alphabets import cyrillic_surprise, script, strangers
from evidra.session import map_arrow

#: Charsets in which UTF-8 bytes are often read by mistake.
AS_UTF8 = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "iso8859-15", "iso8859-2", "mac_roman", "cp437", "cp850", "koi8-r", "cp866", "cp1253", "iso8859-5")
#: (shown, meant): single-byte charsets mistaken for one another.
SWAPS = (("latin-1", "iso8859-2"), ("cp1252", "cp1250"), ("cp1250", "iso8859-2"), ("latin-1", "cp1254"), ("cp1252", "cp1254"), ("cp1250", "cp1254"), ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("latin-1", "koi8-r"), ("cp1252", "koi8-r"), ("latin-1", "iso8859-5"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("koi8-r", "cp866"), ("cp1251", "iso8859-5"), ("cp1251", "cp1252"), ("cp1251", "cp1250"), ("cp1251", "cp1254"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("latin-1", "cp437"), ("latin-1", "cp850"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("latin-1", "mac_roman"), ("cp1253", "cp1252"), ("cp1250", "cp1252"), ("iso8859-2", "latin-1"), ("cp1254", "cp1252"), ("latin-1", "cp866"), ("cp1252", "cp866"), ("cp437", "cp866"))
#: What a step costs, by how much a text must gain over all its steps of one kind to count as garbled, and what each letter
#: that the best alphabet lacks costs a run of stretches.
UTF8_STEP, SWAP_STEP, ESCAPE_STEP, GAIN, SWAP_GAIN, STRANGER = 0.5, 0.8, 1.5, 0.2, 3.0, 4.0


@lru_cache(None)
def _bytes_of(charset: str) -> dict[str, int]:
    """Character to byte; a byte that the charset leaves undefined is the control character of the same number."""
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(charset)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    if charset in ("cp1252", "cp1254", "iso8859-15"):
        for b in range(128, 160):
            table.setdefault(chr(b), b)
    return table


@lru_cache(None)
def _leads_of(charset: str) -> re.Pattern:
    """A character that stands for the first byte of a UTF-8 sequence, and one that stands for a later byte."""
    table = _bytes_of(charset)
    lead = "".join(c for c, b in table.items() if 0xC2 <= b <= 0xF4)
    later = "".join(c for c, b in table.items() if 0x80 <= b <= 0xBF)
    return re.compile(f"[{re.escape(lead)}][{re.escape(later)}]")


@lru_cache(None)
def _swap_table(shown: str, meant: str) -> dict[int, str]:
    """Character to character for one pair of charsets, where both have it."""
    table = {}
    for c, b in _bytes_of(shown).items():
        try:
            table[ord(c)] = bytes([b]).decode(meant)
        except UnicodeDecodeError:
            pass
    return table


def _utf8_need(b: int) -> int:
    return 1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0


def as_utf8(text: str, charset: str) -> str:
    """Every run of characters whose bytes in ``charset`` are a UTF-8 sequence becomes its character; the rest stays."""
    if not _leads_of(charset).search(text):
        return text
    table = _bytes_of(charset)
    codes = [table.get(c, -1) for c in text]
    out, i, n = [], 0, len(text)
    while i < n:
        need = _utf8_need(codes[i])
        if need and i + need < n and all(0x80 <= c <= 0xBF for c in codes[i + 1 : i + 1 + need]):
            try:
                out.append(bytes(codes[i : i + 1 + need]).decode("utf-8"))
                i += need + 1
                continue
            except UnicodeDecodeError:
                pass
        out.append(text[i])
        i += 1
    return "".join(out)


def swap(text: str, shown: str, meant: str) -> str | None:
    """The text's bytes in one charset read in another; nothing if it has characters outside of them."""
    table = _swap_table(shown, meant)
    return text.translate(table) if all(ord(c) in table for c in text) else None


_ESCAPE = re.compile(r"&(?:#\d{2,7}|#x[0-9a-fA-F]{2,6}|[A-Za-z]{2,8}\d?);|(?:%[89A-Fa-f][0-9A-Fa-f]){2,}|(?:=[89A-F][0-9A-F]){2,}|\\u[0-9a-fA-F]{4}|\\x[89a-fA-F][0-9a-fA-F]")


def unescape(text: str) -> str:
    """Entities, percent, quoted-printable and backslash escapes of characters beyond ASCII resolved."""

    def one(m: re.Match) -> str:
        s = m.group()
        if s[0] == "&":
            c = html.unescape(s)
            return c if len(c) == 1 and ord(c) > 127 else s
        if s[0] == "\\":
            return chr(int(s[2:], 16))
        try:
            return bytes.fromhex(s.replace(s[0], "")).decode("utf-8")
        except UnicodeDecodeError:
            return s

    return _ESCAPE.sub(one, text)


_WORD = re.compile("[^\\W\\d_µªº¹²³¼½¾ʻʼ]+(?:[̀-ͯ]+[^\\W\\d_µªº¹²³¼½¾ʻʼ]*)*")
#: Signs that are at home beside letters, wherever they stand.
_QUIET = set("’‘“”„‚«»‹›–—…·•€£¥™®©§°ºª¿¡†‡′″ʼʻ ​‌‍  　️⃣→✓")
_OPENING, _ENDING = set("¿¡«“„‚‘’‹€£§©"), set("’”“»›…™®€°ºª–—")


def _letters(text: str) -> dict[str, set[str]]:
    """Per script the lower-case letters beyond ASCII; the dotted capital I of Turkish counts as its small letter."""
    found: dict[str, set[str]] = {}
    for c in set(text):
        if c > "\x7f" and c.isalpha() and c not in "µªº":
            found.setdefault(script(c), set()).add("ı" if c == "İ" else c.lower()[:1])
    return found


def _word_cost(word: str) -> float:
    """How unlikely a word is, by the alphabet that suits it best, its scripts and its case."""
    if word.isascii():
        return 0.0
    letters = _letters(unicodedata.normalize("NFC", word))
    latin = any(c.isascii() and c.isalpha() for c in word)
    dear = 4.0 * (len(letters.keys() | ({"latin"} if latin else set())) - 1)
    for kind, found in letters.items():
        dear += STRANGER * strangers(frozenset(found), kind)
        if kind == "other":
            dear += (4.0 if latin or len(letters) > 1 else 0.3) * sum(script(c) == "other" for c in word)
    if any(map(str.islower, word)):
        dear += 1.0 * sum(c > "\x7f" and c.isupper() for c in word[1:])  # capitals within a word
    dear += 0.02 * sum(c > "\x7f" and c.isupper() for c in word)  # settles ties
    dear += 0.3 * sum(a > "\x7f" and b > "\x7f" and a.isupper() and script(a) == "latin" for a, b in zip(word, word[1:]))
    return dear


def _sign_cost(text: str, i: int) -> float:
    """A character that is no letter, digit or ASCII."""
    c = text[i]
    o = ord(c)
    if 0x80 <= o < 0xA0:
        return 5.0
    if c == "�":
        return 4.0
    if 0xE000 <= o < 0xF900:
        return 4.0
    before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < len(text) else " "
    inside = before.isalpha() + after.isalpha()
    strange = (before > "\x7f" and not before.isalpha() and before not in _QUIET) + (after > "\x7f" and not after.isalpha() and after not in _QUIET)
    # A capital beyond ASCII before a sign is how most letters look that were read byte by byte.
    lead = 0.8 if before > "\x7f" and before.isupper() and (script(before) == "latin" or c not in _ENDING) else 0.0
    kind = unicodedata.category(c)
    if c == "\xad":
        return 2.0
    if kind in ("Nd", "No", "Nl") and o < 0x10000:
        short = c in "²³" and not text[max(0, i - 3) : i].isalpha() and inside < 2
        return lead + (0.4 if short or inside == 0 and (kind == "No" or o > 0x2000) else 4.0 if inside == 2 else 2.5)
    if kind in ("Mn", "Mc") and c != "️":
        at_home = before.isalpha() and (o < 0x370 or script(before) == "other") or unicodedata.category(before) in ("Mn", "Mc", "Cf")
        return 0.2 if at_home else 3.0
    if o > 0xFFFF or 0x2600 <= o < 0x2800 or kind in ("Cf", "Mn") or c in "　⃣":
        return 0.2
    if 0x2500 <= o < 0x25A0:
        return 3.5 if inside else 0.5 if c in "─│├└" else 1.2
    if script(c) == "other" and o >= 0x530 and not 0x2000 <= o < 0x2E80:
        return 0.2  # signs of other scripts
    if c in "’ʼʻ" or c == "µ" and not before.isalpha():
        return 0.05 + lead
    if c == "·" and inside == 2:
        return 0.05 + lead
    if c in _OPENING and not before.isalpha() and before <= "\x7f" or c in _ENDING and not after.isalpha() and after <= "\x7f":
        return 0.1 + lead
    if inside == 2:
        return lead + (0.6 if c in " –—" else 4.0)
    if inside == 1:
        return lead + (0.8 if c in _QUIET or c in "µ²³½¼¾×±∂≤≥√∑∫≈" and (before.isdigit() or not before.isalpha()) else 2.5)
    return 0.2 + strange + lead


_COSTS: Remembered = Remembered(4_000_000)


def cost(text: str) -> float:
    """Implausibility of a stretch of text; 0 for what some language writes so."""
    known = _COSTS.get(text)
    if known is None:
        known = sum(_word_cost(m.group()) for m in _WORD.finditer(text)) if not text.isascii() else 0.0
        known += sum(_sign_cost(text, i) for i, c in enumerate(text) if c > "\x7f" and (c in "µªº" or not c.isalpha()))
        _COSTS.keep(text, known, len(text))
    return known


Step = str


def neighbours(text: str) -> Iterator[tuple[str, Step, float]]:
    """Texts one step back; each is shorter."""
    if not text.isascii():
        for place, charset in enumerate(AS_UTF8):
            made = as_utf8(text, charset)
            if made != text:
                yield made, f"utf-8 as {charset}", UTF8_STEP + 0.01 * place  # of equal results the usual charset
    if _ESCAPE.search(text):
        made = unescape(text)
        if made != text:
            yield made, "escaped", ESCAPE_STEP


_RESTORED: Remembered = Remembered(4_000_000)
Found = tuple[str, tuple[Step, ...], float]


def restore(text: str) -> Found:
    """The cheapest text reachable, the steps to it, and the gain over the text itself, steps paid.

    Costs are never negative, so what has already paid as much as the best text costs in all cannot lead to a cheaper one.
    """
    known = _RESTORED.get(text)
    if known is not None:
        return known
    start = cost(text)
    queue = [(start, 0, text, (), 0.0)]
    seen, best, order = {text: 0.0}, (start, text, ()), 0
    while queue:
        _, _, at, steps, paid = heapq.heappop(queue)
        if paid + UTF8_STEP >= best[0] or paid > seen[at]:
            continue
        for made, step, price in neighbours(at):
            due = paid + price
            if due >= seen.get(made, 1e9):
                continue
            seen[made] = due
            order += 1
            total = cost(made) + due
            if total < best[0] - 1e-9:
                best = (total, made, (*steps, step))
            heapq.heappush(queue, (total, order, made, (*steps, step), due))
    found = best[1], best[2], start - best[0]
    _RESTORED.keep(text, found, 2 * len(text))
    return found


_STRETCH = re.compile(r"[^ \t\r\n]+")
_TRACE = re.compile(r"[^\x00-\x7f]|%[89A-Fa-f]|=[89A-F][0-9A-F]|&[#A-Za-z]|\\[ux]")
_BROKEN = re.compile("[�\x80-\x84\x86-\x9f]")


def _cyrillic(text: str) -> float:
    """By how much the Cyrillic letters of a text are rarer than they should be."""
    table = cyrillic_surprise()
    return 0.2 * sum(table.get(c.lower(), 2.0) for c in text if "Ѐ" <= c < "԰")


def _outside(words: list[str]) -> int:
    return sum(strangers(frozenset(letters), kind) for kind, letters in _letters("".join(words)).items())


def _excess(text: str) -> float:
    """The cost of a stretch, but nothing for the little that ordinary signs cost, as many of them prove nothing."""
    own = cost(text)
    return own if own >= 0.5 else 0.0


def best_swap(words: list[str]) -> tuple[int, int, str, str] | None:
    """The run of words (first, last) and the pair of charsets that make a text most plausible, if any does clearly."""
    own = [_excess(w) + _cyrillic(w) for w in words]
    # A run has to show as much that is implausible as it is to gain.
    total = most = 0.0
    for c in own:
        total = max(0.0, total + c)
        most = max(most, total)
    if most + STRANGER * _outside(words) <= SWAP_GAIN:
        return None
    there = {ord(c) for w in words for c in w if c > "\x7f"}
    best, chosen = SWAP_GAIN, None
    for shown, meant in SWAPS:
        if not any(_swap_table(shown, meant).get(o, chr(o)) != chr(o) for o in there):
            continue
        made = [swap(w, shown, meant) for w in words]
        gains = [None if m is None else c - _excess(m) - _cyrillic(m) for c, m in zip(own, made)]
        changed = [m is not None and m != w for m, w in zip(made, words)]
        if not any(changed):
            continue
        for a, b in _runs(gains, changed):
            run = words[a : b + 1]
            done = [m for m in made[a : b + 1] if m is not None]
            after = _outside(done)
            single = sum(g for g in gains[a : b + 1])
            gain = single + STRANGER * (_outside(run) - after) - SWAP_STEP
            if gain <= best or after:
                continue
            # Many words or much in one: a lone odd sign within a word proves nothing, nor does one foreign name.
            telling = {words[i] for i in range(a, b + 1) if changed[i] and gains[i] > 0.5}
            letters = {c for i in range(a, b + 1) if changed[i] for c, m in zip(words[i], made[i]) if c != m}
            different = {words[i] for i in range(a, b + 1) if changed[i]}
            if len(telling) >= 2 or single > 6.0 or len(different) >= 3 and len(letters) >= 2:
                best, chosen = gain, (a, b, shown, meant)
    return chosen


def _runs(gains: list[float | None], changed: list[bool]) -> Iterator[tuple[int, int]]:
    """The run of largest total gain, and all words if each can be converted."""
    low, high, best, start, total = 0, -1, 0.0, 0, 0.0
    for i, g in enumerate(gains):
        if g is None or total + g < 0:
            start, total = i + 1, 0.0
            continue
        total += g
        if total > best + 1e-9:
            low, high, best = start, i, total
    if high >= low:
        # Words beside the run that change without loss belong to it.
        while high + 1 < len(gains) and gains[high + 1] is not None and gains[high + 1] >= 0:
            high += 1
        yield low, high
    if all(g is not None for g in gains) and (low, high) != (0, len(gains) - 1):
        yield 0, len(gains) - 1


def _chain(text: str, steps: tuple[Step, ...]) -> str:
    for s in steps:
        text = unescape(text) if s == "escaped" else as_utf8(text, s.removeprefix("utf-8 as "))
    return text


def _by_stretch(words: list[str]) -> tuple[list[str], set[tuple[Step, ...]]]:
    """Each stretch restored by the search, where the gains of its steps over the whole text suffice."""
    found = {w: restore(w) for w in set(words)}
    gains: dict[tuple[Step, ...], float] = {}
    for w in words:
        _, steps, gain = found[w]
        if steps:
            gains[steps] = gains.get(steps, 0.0) + gain
    sure = {s for s, g in gains.items() if g > GAIN}
    if not sure:
        return words, sure
    out = []
    for w in words:
        made, steps, _ = found[w]
        if steps not in sure:
            made = w
            if not w.isascii():
                # In a text that went wrong in a known way, short stretches without a clear sign of their own did so too, if they can be read back at no cost.
                tried = min((_chain(w, s) for s in sorted(sure)), key=lambda t: (cost(t), len(t)))
                made = tried if tried != w and cost(tried) <= cost(w) else w
        out.append(made)
    return out, sure


def _whole_cost(words: list[str]) -> float:
    return sum(map(cost, words)) + max(0.0, _cyrillic("".join(words))) + STRANGER * _outside(words)


def _swapped(words: list[str]) -> tuple[list[str], set[Step]]:
    found = best_swap(words)
    if not found:
        return words, set()
    a, b, shown, meant = found
    return [swap(w, shown, meant) or w if a <= i <= b else w for i, w in enumerate(words)], {f"{meant} as {shown}"}


def _searched(words: list[str]) -> tuple[list[str], set[Step]]:
    made, sure = _by_stretch(words)
    return made, {" < ".join(s) for s in sure}


def repair(text: str | None) -> tuple[bool, str | None, str]:
    """Whether any part shows a wrong decoding, the text with what can be restored, and the steps that did it."""
    if not text:
        return False, text, ""
    broken = bool(_BROKEN.search(text))
    spans = [m.span() for m in _STRETCH.finditer(text) if _TRACE.search(m.group())] if _TRACE.search(text) else []
    words, done = [text[a:b] for a, b in spans], set()
    while words:
        # Either kind of step may have come last; the order that leaves the cheaper text is taken.
        tried = []
        for first, second in ((_searched, _swapped), (_swapped, _searched)):
            once, steps = first(words)
            twice, more = second(once)
            tried.append((_whole_cost(twice) + SWAP_STEP * len(steps | more), twice, steps | more))
            if not steps:
                break
        _, made, steps = min(tried, key=lambda t: t[0])
        if made == words or done and _whole_cost(made) >= _whole_cost(words):
            break
        words, done = made, done | steps
    if not done:
        return broken, text, ""
    out, at = [], 0
    for (a, b), w in zip(spans, words):
        out += [text[at:a], w]
        at = b
    return True, "".join(out) + text[at:], "; ".join(sorted(done))


def _repairing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, texts = b.column("key"), b.column("text").to_pylist()
        for i, j in portions(texts):
            made = [repair(t) for t in texts[i:j]]
            yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), pa.array([m[0] for m in made], pa.bool_()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.string())], ["key", "garbled", "restored", "steps"])


def repair_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """The key with ``garbled``, the ``restored`` text and the ``steps`` undone."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_arrow(rows, _repairing, f"key {kind}, garbled boolean, restored string, steps string").withColumnRenamed("key", key)
