from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest

from evidra.llm import portions
from evidra.llm.tokenizer import VOCABULARY, Encoder, Vocabulary, encode

pytestmark = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary here")

TEXTS = ["", None, " ", "Hello world", "<|endoftext|> ordinary", "don't you'll we're", "naïve café 日本語 🦊🚀 ﷺ", "  lead\n\n\ttabs  \r\n", "aaaaaaaaaaaa" * 40, "0123456789" * 9, "ﬁ‍́\x00\x1f", "x" * 30_000, " " * 4000, "!?" * 500]


def reference(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def mine(texts):
    flat, counts = Encoder(Vocabulary(VOCABULARY)).encode(texts)
    ends = np.cumsum(counts)
    return [flat[e - c : e].tolist() for e, c in zip(ends, counts)]


def test_like_the_public_library():
    r = random.Random(3)
    letters = "abcdefgh eeaiou  ñéü日本🦊\n'!,.0123ABC"
    texts = TEXTS + ["".join(r.choice(letters) for _ in range(r.randrange(200))) for _ in range(600)]
    assert mine(texts) == reference(texts)


def test_round_trip():
    import json

    ids = json.loads(Path(VOCABULARY).read_text())["model"]["vocab"]
    from evidra.llm.tokenizer import _byte_letters

    byte = {c: b for b, c in enumerate(_byte_letters())}
    back = {i: bytes(byte[c] for c in t) for t, i in ids.items()}
    for text, own in zip(TEXTS, mine(TEXTS)):
        assert b"".join(back[i] for i in own).decode() == (text or "")


def test_on_spark(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, key string").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in encode(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(TEXTS))] == mine(TEXTS) and got[0] == got[1] == []
    counts = {r["doc_id"]: r["tokens"] for r in encode(df, "doc_id", "text", counts_only=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encode(df.where("false"), "doc_id", "text").count() == 0


def test_portions():
    assert list(portions(["a" * 5, None, "b" * 5, "c" * 20, ""], 9)) == [(0, 2), (2, 3), (3, 4), (4, 5)] or list(portions(["a" * 5, None, "b" * 5, "c" * 20, ""], 9)) == [(0, 2), (2, 3), (3, 5)]
    assert list(portions([])) == []


def test_long_runs_of_letters():
    import time

    r = random.Random(4)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (900, 1001, 5000)] + ["漢字" * 3000, "ab" * 4000, "".join(r.choice("etaoin shrdlu") for _ in range(9000))]
    assert mine(texts) == reference(texts)
    began = time.perf_counter()
    mine(["".join(r.choice("etaoinshrdlu") for _ in range(80_000))])
    assert time.perf_counter() - began < 3
