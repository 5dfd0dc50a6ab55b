"""Abusive, hateful or sexual content, by a subsequence string kernel and a support vector machine.

Two texts are alike in the kernel by the subsequences of four symbols they share; letters may lie between those four, which
costs a factor for each, so gapped, masked and inserted-character spellings still match. A Nystrom map over landmark
sentences turns the kernel into coordinates, in which a linear machine with squared hinge loss is trained by Newton steps.
All landmarks together make one weight per subsequence, so a text is scored by looking up its own subsequences, in time
linear in its length and independent of the number of landmarks.

Before, spellings are folded in flat arrays over a whole batch: case, accents, look-alike letters of other scripts, invisible
characters, digits for letters, single letters set apart, letters repeated. A text is scored by its worst sentence; a long
sentence also by overlapping windows. A text is to be reviewed if its score is above zero.

Defined cases: null and empty texts have no sentences and get the lowest score; whole texts are read; the same text always
gets the same score; training takes at most MOST_SENTENCES labelled sentences, a documented bound.
"""

from __future__ import annotations

import itertools
import random
import re
import unicodedata
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import portions
from evidra.llm.labelled import sentences, varied
from evidra.session import map_arrow

#: Bounds of the training data: sentences in all, of them harmless ones by origin, variations of a reviewed sentence.
MOST_SENTENCES, MOST_BY_ORIGIN, VARIATIONS = 10_000, 3000, 10
LANDMARKS, BLOCK, THREADS = 2000, 200, 4
#: So many machines, each of other fillings of the patterns, other landmarks and another cut, are averaged into one.
MACHINES, FILLING = 3, 11
#: Four symbols within six places, and the factor for each place left out.
SPAN, DECAY = 6, 0.6
WINDOW, HOP = 80, 40
#: A score must lie this far on the harmful side of the machine's own border to count as above zero. Negative, as averaging
#: takes the chance from harmless wordings, while unknown harmful ones end near the border.
LOWEST, MARGIN = -10.0, -0.1
PATTERNS = [(o, DECAY ** (o[-1] - 3)) for o in ((a, b, c) for a, b, c in itertools.combinations(range(1, SPAN), 3))]
_SPACE, _MASK, _DIGIT, _END, _QUOTE, _OTHER, _DROP = 0, 27, 28, 29, 30, 31, 32

#: Cyrillic and Greek letters that look like Latin ones, and Latin spellings of the other Cyrillic letters.
_LOOKS = dict(zip("аеорсухіѕјкмтнвьԁһԛԝαβενικορτυχ", "aeopcyxisjkmthbbdhqwabevikoptux"))
_SOUNDS = dict(zip("бгджзийлпфцчшщъыэюяё", "bgdjziilpfccssyyeuae"))
_FIGURES = {"0": 15, "1": 9, "3": 5, "4": 1, "5": 19, "7": 20, "8": 2, "9": 7}


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Symbol of every code point below 0x20000; those above count as space."""
    table = np.zeros(0x110000, np.uint8)
    for o in range(0x20000):
        c = chr(o)
        if 0xD800 <= o < 0xE000:
            continue
        low = c.lower()[:1]
        base = unicodedata.normalize("NFKD", low)[:1].lower()
        if "a" <= base <= "z":
            table[o] = ord(base) - 96
        elif low in _LOOKS or low in _SOUNDS:
            table[o] = ord(_LOOKS.get(low) or _SOUNDS[low]) - 96
        elif base.isdigit():
            table[o] = _DIGIT
        elif unicodedata.category(c) in ("Mn", "Cf") or c in "'’`´":
            table[o] = _DROP
        elif c.isalpha():
            table[o] = _OTHER
    for c, s in (("ı", 9), ("ł", 12), ("ø", 15), ("ß", 19), ("đ", 4), ("æ", 1), ("œ", 15), ("*", _MASK), ("$", 19), ("\n", _END), ("\r", _END)):
        table[ord(c)] = s
    for c in ".!?…。！？":
        table[ord(c)] = _END
    for c in '"“”„«»':
        table[ord(c)] = _QUOTE
    return table


@lru_cache(1)
def _figure_letters() -> np.ndarray:
    table = np.zeros(128, np.uint8)
    for c, s in _FIGURES.items():
        table[ord(c)] = s
    return table


def _shift(x: np.ndarray, by: int, fill=0) -> np.ndarray:
    """x[i + by], with ``fill`` beyond the ends."""
    out = np.full_like(x, fill)
    if by >= 0:
        out[: max(0, len(x) - by)] = x[by:]
    else:
        out[-by:] = x[:by]
    return out


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row with the number of the sentence each belongs to (counted through), and each sentence's text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    s = _symbols()[codes]
    keep = s != _DROP
    if not keep.all():
        s, codes, doc = s[keep], codes[keep], doc[keep]
    # Digits within words that have letters stand for letters.
    figures = np.flatnonzero(s == _DIGIT)
    wordy = ((s >= 1) & (s <= _DIGIT)) | (s == _OTHER)
    letter = (s >= 1) & (s <= 26)
    if len(figures):
        word = np.cumsum(wordy & ~_shift(wordy, -1, False))
        has = np.zeros(int(word[-1]) + 1 if len(word) else 1, bool)
        has[word[letter & wordy]] = True
        figures = figures[has[word[figures]] & (codes[figures] < 128)]
        meant = _figure_letters()[codes[figures]]
        s[figures[meant > 0]] = meant[meant > 0]
        letter = (s >= 1) & (s <= 26)
    # Sentences end at a full stop and the like before a blank, and at line ends.
    end = s == _END
    blank_next = _shift((s == _SPACE) | end, 1, True)
    stop = end & (blank_next | (codes == 10) | (codes == 13))
    # Single letters set apart by one sign each: three or more in a row are one word.
    lone = letter & ~_shift(letter, -1, False) & ~_shift(letter, 1, False) & ~((s == _MASK) | _shift(s == _MASK, 1, False) | _shift(s == _MASK, -1, False))
    between = ~letter & (codes != 10) & _shift(lone, -1, False) & _shift(lone, 1, False) & (_shift(lone, -3, False) | _shift(lone, 3, False))
    stop &= ~between
    sentence = np.cumsum(stop) - stop
    sentence = sentence + doc  # a text never shares a sentence with the next
    s = np.where(end, _SPACE, s)
    same = (s == _shift(s, -1, 99)) & ((s == _SPACE) | (s >= 1) & (s <= 26))
    long_run = same & (_shift(same, -1, False) | _shift(same, 1, False))
    keep = ~(between | long_run | (same & (s == _SPACE)))
    return s[keep], sentence[keep], doc[keep]


def _codes(s: np.ndarray, sentence: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern of gaps: the code of the four symbols from each place, whether they lie in one sentence, the weight."""
    wide = s.astype(np.int32)
    n = len(s)
    shifted = {k: wide[k:] for k in range(SPAN)}
    inside = {k: sentence[: n - k] == sentence[k:] for k in range(1, min(SPAN, n))}
    for (a, b, c), weight in PATTERNS:
        m = n - c
        if m <= 0:
            continue
        code = (wide[:m] << 15) | (shifted[a][:m] << 10) | (shifted[b][:m] << 5) | shifted[c]
        yield code, inside[c], weight


class Machine:
    """Weights of subsequences and the threshold."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text: of its worst sentence or window."""
        out = np.full(len(texts), LOWEST)
        there = [i for i, t in enumerate(texts) if t]
        if not there:
            return out
        s, sentence, doc = fold([texts[i] for i in there])
        if not len(s):
            return out
        gain = np.zeros(len(s), np.float32)
        for code, inside, weight in _codes(s, sentence):
            found = self.weights[code]
            found *= inside
            found *= np.float32(weight)
            gain[: len(code)] += found
        starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
        ends = np.r_[starts[1:], len(s)]
        sizes = ends - starts
        upto = np.r_[0.0, np.cumsum(gain, dtype=np.float64)]
        owner = doc[starts]
        best = (upto[ends] - upto[starts]) / np.sqrt(np.maximum(sizes, 12)) + self.bias
        best[sizes < 4] = LOWEST
        scores = np.full(len(there), LOWEST)
        np.maximum.at(scores, owner, best)
        # Windows of long sentences.
        long = np.flatnonzero(sizes > WINDOW)
        if len(long):
            counts = -(-(sizes[long] - WINDOW) // HOP) + 1
            which = np.repeat(long, counts)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
            a = np.minimum(starts[which] + nth * HOP, ends[which] - WINDOW)
            np.maximum.at(scores, owner[which], (upto[a + WINDOW] - upto[a]) / np.sqrt(WINDOW) + self.bias)
        out[there] = scores
        return out


Features = dict[str, tuple[np.ndarray, np.ndarray]]


def _features(texts: list[str], known: Features) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text, as one sentence: its subsequence codes and their weights, over the root of its length."""
    new = [t for t in dict.fromkeys(texts) if t not in known]
    for at in range(0, len(new), 2000):
        part = new[at : at + 2000]
        s, _, doc = fold(part)
        sizes = np.bincount(doc, minlength=len(part)) if len(doc) else np.zeros(len(part), np.int64)
        keys, values = [np.empty(0, np.int64)], [np.empty(0)]
        for code, inside, w in _codes(s, doc):
            # Text and code in one number, so that one sort puts all texts' subsequences together.
            keys.append((doc[: len(code)].astype(np.int64)[inside] << 20) | code[inside])
            values.append(np.full(len(keys[-1]), w))
        unique, place = np.unique(np.concatenate(keys), return_inverse=True)
        owner = unique >> 20
        sums = np.bincount(place, np.concatenate(values), len(unique)) / np.sqrt(np.maximum(sizes, 12))[owner] if len(unique) else np.empty(0)
        ends = np.cumsum(np.bincount(owner, minlength=len(part)))
        for i, t in enumerate(part):
            a, b = ends[i - 1] if i else 0, ends[i]
            known[t] = ((unique[a:b] & 0xFFFFF).astype(np.int32), sums[a:b].astype(np.float32))
    return [known[t] for t in texts]


def _split(text: str) -> list[str]:
    return [p for p in re.split(r"(?<=[.!?])\s+|[\r\n]+", text) if p.strip()]


@lru_cache(4)
def trained(examples: tuple[tuple[str, int], ...], harmless: tuple[str, ...] = ()) -> Machine:
    """The machine of these examples, trained once per process; training has no chance in it."""
    return train(list(examples), list(harmless))


def train(examples: list[tuple[str, int]], harmless_texts: list[str] | None = None, seed: int = 5) -> Machine:
    """A machine from the own labelled sentences, the reviewed examples with variations, and sentences of texts that are
    harmless by their origin (up to MOST_BY_ORIGIN of them).

    What one machine makes of an unknown wording depends much on how the patterns happened to be filled, so the weights of
    several are averaged; scoring costs no more for that.

    An example is a text: all sentences of a harmless one are harmless. Of a harmful one only the worst is taken to be
    harmful, as judged by a machine without it.
    """
    made = [_train_one(examples, harmless_texts, seed + k, FILLING + k) for k in range(MACHINES)]
    return Machine(np.mean([m.weights for m in made], axis=0, dtype=np.float32), float(np.mean([m.bias for m in made])))


def _train_one(examples: list[tuple[str, int]], harmless_texts: list[str] | None, seed: int, filling: int) -> Machine:
    own = list(dict.fromkeys(sentences(filling)))
    by_origin = list(dict.fromkeys((p, 0) for t in harmless_texts or () for p in _split(t) if len(p) < 400))
    random.Random(seed).shuffle(by_origin)
    own += by_origin[:MOST_BY_ORIGIN]
    more = lambda rows: [v for t, label in dict.fromkeys(rows) for v in varied(t, label, VARIATIONS)]
    harmless = more((p, 0) for t, label in examples if not label for p in _split(t))
    harmful = [_split(t) for t, label in examples if label]
    single = [(p[0], 1) for p in harmful if len(p) == 1]
    if any(len(p) > 1 for p in harmful):
        first = _fit([*harmless, *more(single), *own], seed, landmarks=LANDMARKS // 5)
        single = [(parts[int(np.argmax(first.scores(parts)))], 1) for parts in harmful if parts]
    return _fit([*harmless, *more(single), *own], seed)  # features are made again, as keeping them would cost the driver memory


def _fit(data: list[tuple[str, int]], seed: int, known: Features | None = None, landmarks: int = LANDMARKS, ridge: float = 1.0) -> Machine:
    data = list(dict.fromkeys(data))
    random.Random(seed).shuffle(data)
    data = data[:MOST_SENTENCES]
    features = _features([t for t, _ in data], {} if known is None else known)
    y = np.array([1.0 if label else -1.0 for _, label in data])
    owner = np.repeat(np.arange(len(data), dtype=np.int32), [len(c) for c, _ in features])
    value = np.concatenate([v for _, v in features])
    codes, place, seen = np.unique(np.concatenate([c for c, _ in features]), return_inverse=True, return_counts=True)
    del features
    # Subsequences of a single sentence tell nothing of others; the rest count the more the fewer sentences have them.
    shared = seen > 1
    keep = shared[place]
    owner, value, place = owner[keep], value[keep], (np.cumsum(shared, dtype=np.int32) - 1)[place[keep]]
    codes, rare = codes[shared], np.log(1 + len(data) / (1.0 + seen[shared])).astype(np.float32)
    value *= rare[place]
    # Landmarks: half of them from either class. The kernel with them, and later their weights, are made block by block.
    chosen = np.concatenate([np.flatnonzero(y == sign)[: landmarks // 2] for sign in (1, -1)])
    ends = np.cumsum(np.bincount(owner, minlength=len(data)))
    starts = np.r_[0, ends[:-1]]

    def block(first: int) -> np.ndarray:
        """Subsequences by landmarks."""
        table = np.zeros((len(codes), min(BLOCK, len(chosen) - first)), np.float32)
        for k in range(table.shape[1]):
            a, b = starts[chosen[first + k]], ends[chosen[first + k]]
            table[place[a:b], k] = value[a:b]
        return table

    kernel = np.zeros((len(data), len(chosen)), np.float32)
    for first in range(0, len(chosen), BLOCK):
        table = block(first)

        def part(rows: range) -> None:
            for i in rows:
                a, b = starts[i], ends[i]
                kernel[i, first : first + table.shape[1]] = value[a:b] @ table.take(place[a:b], axis=0)

        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(part, (range(k, len(data), THREADS) for k in range(THREADS))))
    among = kernel[chosen].astype(float)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-6 * values[-1]
    whiten = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
    z = np.c_[kernel @ whiten, np.ones(len(data), np.float32)]
    del kernel
    # Newton steps for ridge / 2 |w|^2 + sum of squared hinge losses; the constant is not penalised.
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(40):
        active = y * (z @ w) < 1
        za = z[active]
        new = np.linalg.solve(np.diag(penalty) + za.T @ za, za.T @ y[active].astype(np.float32))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    weights = np.zeros(1 << 20, np.float32)
    share = (whiten @ w[:-1]).astype(np.float32)
    for first in range(0, len(chosen), BLOCK):
        table = block(first)
        weights[codes] += rare * (table @ share[first : first + table.shape[1]])
    return Machine(weights, float(w[-1]) - MARGIN)


def _scoring(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            scores = np.concatenate([np.empty(0), *[shared.value.scores(texts[i:j]) for i, j in portions(texts)]])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(np.round(scores, 6))], ["key", "score"])

    return run


def score_texts(df: DataFrame, key: str, text: str, examples: list[tuple[str, int]], harmless: list[str] | None = None) -> DataFrame:
    """The key with ``score``; above zero is to be reviewed. ``examples`` are reviewed sentences with labels, a small table, ``harmless`` a bounded sample of texts whose origin labels them."""
    shared = df.sparkSession.sparkContext.broadcast(trained(tuple(examples), tuple(harmless or ())))  # four megabytes, whatever the data
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_arrow(rows, _scoring(shared), f"key {kind}, score double").withColumnRenamed("key", key)
