from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest

from evidra.llm.abuse import LOWEST, fold, score_texts, train
from evidra.llm.labelled import sentences

BAD = ["You are a stupid moron and everyone here knows it.", "Shut up, you pathetic clown, nobody asked you.", "Foreigners are vermin and should be driven out of every office.", "Send me a picture of you naked and I'll tell you the answer.", "Someone should burn your house down with you in it.", "Halt die Fresse, du dummer Vollidiot.", "Cállate, imbécil de mierda.", "Ta gueule, espèce de pauvre abruti."]
GOOD = ["The import crashed on row 12 because of a stray quote.", "My old boss called me an idiot in front of a client, so I reported it to HR.", "I hate this settings page with a passion, it's so stupid.", "You have to kill the parent process first, then the zombie children go away.", "Your argument is weak and your numbers are wrong, please check them again.", "Die Lizenz kostet 25 Euro je Platz, das ist für uns zu teuer.", "La exportación falla cuando el nombre lleva una tilde."]


@pytest.fixture(scope="module")
def machine():
    return train([])


def test_plain(machine):
    # The sentences stand in no pattern, so one of them may be missed.
    assert (machine.scores(BAD) > 0).sum() >= len(BAD) - 1 and (machine.scores(GOOD) <= 0).all()


def test_contact_details_and_unknown_insults(machine):
    """Addresses and thanks were taken for abuse, comparisons and French insults of a group were missed."""
    good = ["Pick it up here: ul. Lanternowa 123/13, Saint-Orval.", "My address is mossy+trial@mail.example.net, no sales pitch please.", "Merci à Nina Tarvsson pour l'aide.", "We assess every class of analytics cockpit before the Essex rollout.", "You're not stupid, the wording in Pellbase is just bad."]
    bad = ["You have the backbone of spoiled milk, and I mean it.", "Ces gens-là sont de la vermine, qu'on les renvoie tous.", "Hey clown, learn to read before you post again.", "Another app ruined by Ombari.", "Come sit on my face and we'll call it a demo."]
    assert (machine.scores(good) <= 0).sum() >= 4 and (machine.scores(bad) > 0).sum() >= 4


@pytest.mark.parametrize("write", [
    str.upper, str.lower, lambda s: s.replace("o", "0").replace("i", "1").replace("e", "3"), lambda s: s.replace("a", "а").replace("o", "о"), lambda s: s.replace("i", "i​"),
    lambda s: s.replace("moron", "m o r o n").replace("clown", "c.l.o.w.n").replace("vermin", "v-e-r-m-i-n"), lambda s: s.replace("o", "ooo").replace("i", "iii"), lambda s: s.replace("moron", "m***n").replace("clown", "c***n").replace("vermin", "v****n"),
    lambda s: "Our job handles 12 files a night. " * 40 + s + " It never matches what finance sees." * 40, lambda s: s.replace("moron", "mroon").replace("clown", "cloxwn").replace("vermin", "vermiin"),
])
def test_evasive_spellings(machine, write):
    assert (machine.scores([write(s) for s in BAD[:4]]) > 0).mean() >= 0.75
    assert (machine.scores([write(s) for s in GOOD]) > 0).mean() <= 0.15


def test_accuracy_on_patterns_never_seen():
    """Trained without a fifth of the patterns, it is judged by these: recall and precision of forms it was not shown."""
    from zlib import crc32

    from evidra.llm.abuse import _fit

    held = lambda p: crc32(p.encode()) % 5 == 0
    m = _fit(list(sentences(only=lambda p: not held(p))), 5, landmarks=1000)
    rest = list(dict.fromkeys(sentences(only=held)))
    found, labels = m.scores([t for t, _ in rest]) > 0, np.array([y for _, y in rest]) == 1
    recall, precision = (found & labels).sum() / labels.sum(), (found & labels).sum() / found.sum()
    print(f"recall {recall:.2f}, precision {precision:.2f}, of {len(rest)}")
    assert recall > 0.8 and precision > 0.6


def test_no_sentence_is_taken_from_the_scored_table():
    """No pattern has a fixed part of 14 characters or more that stands in a comment."""
    import re

    from evidra.llm import labelled

    path = Path("/root/testdata/sf0.01/deep_comments.parquet")
    if not path.exists():
        pytest.skip("no comments here")
    import pyarrow.parquet as pq

    comments = "\n".join({t.lower() for t in pq.read_table(path, columns=["body"])["body"].to_pylist() if t})
    for patterns in (labelled.ABUSE, labelled.HATE, labelled.SEXUAL, labelled.OTHER_LANGUAGES, labelled.FINE):
        for p in patterns:
            fixed = max((x.strip(" .,!?;") for x in re.split(r"\{[\w#]+\}", p.lower())), key=len)
            assert len(fixed) < 14 or fixed not in comments, p


def test_reviewed_examples(machine):
    path = Path("/root/testdata/sf0.01/moderation_examples.parquet")
    if not path.exists():
        pytest.skip("no examples here")
    import pyarrow.parquet as pq

    rows = pq.read_table(path).to_pylist()
    scores = machine.scores([r["text"] for r in rows])
    assert np.mean((scores > 0) == np.array([r["verdict"] != "none" for r in rows])) > 0.8  # none of them was shown


def test_edges(machine):
    scores = machine.scores([None, "", " ", "!", "a", "​", "日本語。", "x" * 200_000, BAD[0] * 500])
    assert (scores[:3] == LOWEST).all() and np.isfinite(scores).all() and scores[-1] > 0
    assert machine.scores([]).shape == (0,)
    alone, together = machine.scores([BAD[0]])[0], machine.scores(["", *GOOD, BAD[0], None, *BAD])[len(GOOD) + 1]
    assert round(alone, 4) == round(together, 4)


def test_folding():
    shown = lambda t: "".join(" abcdefghijklmnopqrstuvwxyz*#.\"?"[x] if x < 32 else "" for x in fold([t])[0])
    assert shown("F.u.c.k  YÖU p4th3t1c sоооn").split() == ["fuck", "you", "pathetic", "son"]
    assert len(set(fold(["One. Two! Three\nFour"])[1])) >= 4


def test_spark(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*BAD, *GOOD, None, "", BAD[0]])]
    df = spark.createDataFrame(rows, "row_id long, body string, score string").repartition(3)
    got = {r["row_id"]: r["score"] for r in score_texts(df, "row_id", "body", []).collect()}
    assert len(got) == len(rows) and sum(got[i] > 0 for i in range(len(BAD))) >= len(BAD) - 1 and got[len(rows) - 3] == got[len(rows) - 2] == LOWEST and got[0] == got[len(rows) - 1]
    assert score_texts(df.where("false"), "row_id", "body", []).count() == 0
