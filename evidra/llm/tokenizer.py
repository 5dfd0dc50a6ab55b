"""Encoding with a public byte-level BPE vocabulary, by batched numpy merge rounds.

The symbols of many words stand in one flat array. In each round the ranks of all neighbouring pairs are found by binary
search over the sorted pair keys; every word merges all places of its own lowest-ranked pair, from the left. Words that have
no pair left leave the array. Each distinct word of a batch is encoded once.

Defined cases: empty and null texts have no ids; strings that look like special tokens are ordinary text; special tokens
are never added. Texts of any length are encoded whole. The vocabulary file is a parameter; its size bounds what is
broadcast.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import portions
from evidra.session import map_arrow

#: Fixed value: where byte-level BPE of this family cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_NONE = np.iinfo(np.int64).max
#: Distinct words a worker remembers before it starts anew.
REMEMBERED_WORDS = 300_000
#: Words of more bytes are merged by a queue of pairs.
LONG_WORD = 1000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files: itself where printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Byte ids, and the merges as sorted pair keys with rank and resulting id."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte_ids = np.array([ids[c] for c in _byte_letters()], np.int64)
        self.width = max(ids.values()) + 1
        keys = np.array([ids[a] * self.width + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)[order]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.split, self.pairs = vocabulary, regex.compile(PATTERN), None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths, self.starts, self.symbols = (np.empty(0, np.int64) for _ in range(3))

    def _ranks(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each symbol with its right neighbour: rank and place among the merges."""
        keys = symbols[:-1] * self.v.width + symbols[1:]
        place = np.minimum(np.searchsorted(self.v.keys, keys), len(self.v.keys) - 1)
        ok = (self.v.keys[place] == keys) & (word[:-1] == word[1:])
        return np.append(np.where(ok, self.v.ranks[place], _NONE), _NONE), np.append(place, 0)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of each word's ids. No word is empty.

        A round over the flat array merges one rank per word, so a run of many thousand letters would need as many rounds;
        such words are merged by a queue of their pairs instead, to the same ids.
        """
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        if not long:
            return self._merge_rounds(words)
        apart = {i: self._merge_queue(words[i]) for i in long}
        rest = [w for i, w in enumerate(words) if i not in apart]
        ids, counts = self._merge_rounds(rest) if rest else (np.empty(0, np.int64), np.empty(0, np.int64))
        pieces, lengths, ends = [], np.zeros(len(words), np.int64), iter(np.split(ids, np.cumsum(counts)[:-1]) if rest else ())
        for i in range(len(words)):
            piece = apart[i] if i in apart else next(ends)
            pieces.append(piece)
            lengths[i] = len(piece)
        return np.concatenate(pieces), lengths

    def _merge_queue(self, word: bytes) -> np.ndarray:
        """Ids of one long word: the lowest rank first, of equal ranks the leftmost place."""
        if self.pairs is None:
            self.pairs = dict(zip(self.v.keys.tolist(), zip(self.v.ranks.tolist(), self.v.made.tolist())))
        pairs, width = self.pairs, self.v.width
        symbols: list[int] = self.v.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(found[0], i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (found := pairs.get(symbols[i] * width + symbols[i + 1]))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = pairs[a * width + b][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get(symbols[i] * width + symbols[k]):
                    heapq.heappush(queue, (found[0], i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (found := pairs.get(symbols[h] * width + symbols[i])):
                heapq.heappush(queue, (found[0], h, symbols[h], symbols[i]))
        return np.array([s for s in symbols if s >= 0], np.int64)

    def _merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        symbols = self.v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbols, done_words = [], []
        while len(symbols):
            rank, place = self._ranks(symbols, word)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(word)]))
            ended = best == _NONE
            if ended.any():
                done_symbols.append(symbols[ended])
                done_words.append(word[ended])
                symbols, word, rank, place, best = (x[~ended] for x in (symbols, word, rank, place, best))
                if not len(symbols):
                    break
            hit = rank == best
            # Of overlapping places, as in aaa, every second one from the left stays.
            run_start = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
            at = np.flatnonzero(hit)
            nth = at - run_start[np.searchsorted(run_start, at, side="right") - 1]
            at = at[nth % 2 == 0]
            symbols[at] = self.v.made[place[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        all_words = np.concatenate(done_words) if done_words else np.empty(0, np.int64)
        order = np.argsort(all_words, kind="stable")
        ids = np.concatenate(done_symbols)[order] if done_symbols else np.empty(0, np.int64)
        return ids, np.bincount(all_words, minlength=len(words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text's ids."""
        if len(self.known) > REMEMBERED_WORDS:
            self._forget()
        known, new, numbers, counts = self.known, [], [], []
        for text in texts:
            parts = self.split.findall(text) if text else []
            counts.append(len(parts))
            for w in parts:
                number = known.get(w)
                if number is None:
                    number = known[w] = len(known)
                    new.append(w.encode("utf-8", "surrogatepass"))
                numbers.append(number)
        if new:
            ids, lengths = self.merge(new)
            self.starts = np.r_[self.starts, len(self.symbols) + np.cumsum(lengths) - lengths]
            self.symbols, self.lengths = np.r_[self.symbols, ids], np.r_[self.lengths, lengths]
        picked = np.array(numbers, np.int64)
        lengths = self.lengths[picked]
        ends = np.cumsum(lengths)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
        flat = self.symbols[np.repeat(self.starts[picked], lengths) + within]
        upto = np.r_[0, ends][np.cumsum([0, *counts])]
        return flat, np.diff(upto)


def _encoding(shared, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            keys, texts = b.column("key"), b.column("text").to_pylist()
            for i, j in portions(texts):
                ids, counts = encoder.encode(texts[i:j])
                if counts_only:
                    made = pa.array(counts, pa.int64())
                else:
                    made = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), made], ["key", "made"])

    return run


def encode(df: DataFrame, key: str, text: str, counts_only: bool = False, vocabulary: str = VOCABULARY, keep: str | None = None) -> DataFrame:
    """The key column and ``ids`` of each row's text, or with ``counts_only`` their number ``tokens``; ``keep`` is one more column to carry along."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    # The key and what is kept travel as one value, so that columns of any name and type pass through.
    rows = df.select(F.struct(F.col(key).alias("k"), *([F.col(keep).alias("kept")] if keep else [])).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    made = map_arrow(rows, _encoding(shared, counts_only), f"key {kind}, made {'long' if counts_only else 'array<int>'}")
    return made.select(F.col("key.k").alias(key), *([F.col("key.kept").alias(keep)] if keep else []), F.col("made").alias("tokens" if counts_only else "ids"))
