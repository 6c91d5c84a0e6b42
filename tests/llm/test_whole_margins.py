"""The margins of problem 3 are those of all clean rows, however they are spread over tasks."""

from collections import Counter

import numpy as np
import pytest
from gavel.llm import garbled
from gavel.llm.charmodel import Counts, Model
from pyspark.sql import functions as F

#: Clean texts that differ, in one task far more than any bounded choice of them.
TEXTS = [f"Número {n} of the café at Île {chr(0xE0 + n % 20)}{chr(0x105 + n % 7)}, “naïve” façade" for n in range(60)] + [f"вопросы {n} каналов и мельниц, щедрый хозяин увидел чай и грёзы" for n in range(10)] + [f"mot {n} {w} ici" for n in range(25) for w in ("àâäåçé", "éèêë")] + ["तीन गाँव हैं", "", "plain", "é", "x" * 30 + "ü"]


def brute(texts):
    """Every character beyond Latin-1's controls with two characters on both sides."""
    out = Counter()
    for t in texts:
        t = f"\n\n{t}\n\n"
        out.update(t[k - 2 : k + 3] for k in range(2, len(t) - 2) if ord(t[k]) > 0x9F)
    return out


@pytest.mark.parametrize("step", [1_000_000, 7, 3])
def test_windows_are_all(monkeypatch, step):
    monkeypatch.setattr(garbled, "STEP", step)
    windows = garbled.Windows()
    windows.add(TEXTS)
    windows.add(["é\U0001f642ü"])
    assert dict(zip(*windows.taken(), strict=True)) == brute([*TEXTS, "é\U0001f642ü"])
    assert windows.taken() == ([], [])


@pytest.mark.parametrize("tasks", [1, 8])
def test_margins_of_all_rows(spark, monkeypatch, tasks):
    seen = {}
    margins = garbled._margins
    monkeypatch.setattr(garbled, "_margins", lambda clean, runs, held, odds: seen.update(clean=clean.groupBy("text").agg(F.sum("count")).collect(), runs=runs.count(), held=held.value, odds=odds, got=margins(clean, runs, held, odds)) or seen["got"])
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*TEXTS, "caf" + "é".encode().decode("cp1252")])], "id bigint, text string").repartition(tasks)
    assert [r["id"] for r in garbled.find_garbled(df, ["id"], "text").collect()] == [len(TEXTS)]
    assert {r[0]: r[1] for r in seen["clean"]} == dict(brute(TEXTS))
    assert seen["runs"] == 50
    counts = Counts()
    counts.add(TEXTS)
    own = garbled.Repairer(Model(counts), garbled._alphabet(counts))
    gains, words, wrong = [], [], []
    for t in TEXTS:
        for at in (k for k, c in enumerate(t) if ord(c) > 0x9F):
            for names in garbled.CHAINS:
                near = t[max(0, at - 2) : at].rjust(2, "\n"), t[at + 1 : at + 3].ljust(2, "\n")
                alone = near[0] + garbled._garbled(t[at], *names) + near[1]
                whole = garbled._garbled(near[0] + t[at] + near[1], *names)
                for bad in (alone, *([whole] if (near[0][-1] + near[1][0]).isascii() else [])):
                    start = len(garbled._garbled(near[0], *names)) if bad is whole else 2
                    end = start + len(garbled._garbled(t[at], *names))
                    gains += own.gains(bad, [x for x in own.undone(bad, *names) if len(x[2]) == 1 and start <= x[0] and x[1] <= end])
        if t.startswith("mot "):
            more = garbled._word_gains(own, t)
            words += more[0]
            wrong += more[1]
    hardest = np.sort(gains)[int(garbled.HARDER * len(gains))]
    assert abs(seen["got"][0] - max(garbled.LEAST_MARGIN, min(seen["odds"] + np.log(len(garbled.CHAINS)), hardest / 2))) < 0.02
    assert wrong
    low, most = np.sort(wrong)[int(0.05 * len(wrong))], max(0.0, np.sort(words)[len(words) - 1 - int(garbled.HARDER * len(words))])
    assert abs(seen["got"][1] - max(garbled.LEAST_RUN_MARGIN, (low + most) / 2 if low > most else most + garbled.LEAST_RUN_MARGIN)) < 0.02
