"""Problem 3 decodes each piece and word once, however often it comes, and finds in pieces what it finds in whole texts."""

import random
import re

import pytest
from gavel.llm import garbled
from gavel.llm.charmodel import Counts, Model

CLEAN = ["Número 5 of the café at Île, “naïve” façade – déjà vu", "вопросы каналов и мельниц, щедрый хозяин увидел чай и грёзы", "तीन गाँव हैं और नदी", "Ærø, Łódź, Žižek’s résumé"] * 3


@pytest.fixture
def repairer():
    counts = Counts()
    counts.add(CLEAN)
    return garbled.Repairer(Model(counts), garbled._alphabet(counts))


def whole(own, text):
    """Every chain over the whole text at once."""
    found = []
    if own.swapped.search(text):
        found.append(("utf-16 swapped", [(m.start(), m.end(), "".join(chr(ord(c) >> 8) for c in m.group())) for m in own.swapped.finditer(text)]))
    for names in garbled.CHAINS:
        if spans := own.undone(text, *names):
            found.append((f"utf-8 as {names[0]}" + (f", twice as {names[1]}" if names[1:] else ""), spans))
    return found


def read_whole(own, text):
    """Every pair of charsets over all words of the text."""
    runs, found = [m.span() for m in re.finditer(f"[{re.escape(garbled._upper())}]{{{garbled.RUN},}}", text)], []
    for (a, b), table in own.pairs.items():
        spans = [(s, e, "".join(table[c] for c in text[s:e])) for s, e in runs if all(c in table for c in text[s:e])]
        if spans := [x for x in spans if x[2] != text[x[0] : x[1]]]:
            found.append((f"{a} as {b}", spans))
    return found


def test_pieces_are_whole(repairer, monkeypatch):
    monkeypatch.setattr(garbled, "HELD_PIECES", 20)
    monkeypatch.setattr(garbled, "LONGEST_HELD", 12)
    rng, made, read = random.Random(3), 0, 0
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            t = rng.choice(CLEAN)
            at = rng.randrange(len(t))
            t = t[at : at + rng.randrange(1, 30)]
            kind = rng.randrange(5)
            if kind < 2:
                t = garbled._garbled(t, *rng.choice(garbled.CHAINS))
            elif kind == 2:
                t = t.encode("cp1251", "ignore").decode("koi8-r")
            elif kind == 3:
                t = "".join(chr(ord(c) << 8) for c in t if "0" <= c < "\x7f")
            parts.append("".join(rng.choice("?�") if ord(c) > 0x7F and rng.random() < 0.05 else c for c in t))
        text = rng.choice(["", " ", "?", "ab"]).join(parts)
        found = whole(repairer, text)
        assert list(repairer.candidates(text)) == found
        assert list(repairer.read_as(text)) == read_whole(repairer, text)
        made, read = made + len(found), read + len(read_whole(repairer, text))
    assert made > 300 and read > 100
    assert len(repairer.pieces) <= 20 and max(map(len, repairer.pieces)) <= 12


def test_pieces_are_decoded_once(repairer, monkeypatch):
    calls = []
    undo = garbled.Repairer._undo
    monkeypatch.setattr(garbled.Repairer, "_undo", lambda self, text, *more: calls.append(text) or undo(self, text, *more))
    for n in range(50):
        assert repairer.repair(f"row {n}: “naïve” cafÃ© and faÃ§ade")[0] == f"row {n}: “naïve” café and façade"
    assert len(calls) < 300  # not for every row, 2,600 in all


def test_scores_stand_alone(repairer, monkeypatch):
    texts = ["ab", "été", "\n\nca", "xy", "мельниц, щедрый", "îl"]
    scores = repairer.model.scores(texts)
    assert list(scores) == [repairer.model.scores([t])[0] for t in texts]
    assert list(scores[[0, 3, 5]]) == [0.0] * 3 and (scores[[1, 2, 4]] < 0).all()
    text = "cafÃ© in ÃŽle: " + "РІРѕРїСЂРѕСЃС‹ " + "вопросы каналов".encode("cp1251").decode("koi8-r")
    for found in (repairer.candidates, repairer.read_as):
        each = [(name, spans, repairer.gains(text, spans, True)) for name, spans in found(text)]
        assert len(each) > 1 and list(repairer.gained(text, found(text), True)) == each
        monkeypatch.setattr(garbled, "SCORED", 3)
        assert list(repairer.gained(text, found(text), True)) == each
        monkeypatch.undo()
