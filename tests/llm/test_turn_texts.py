"""The clean turns carry the cleaned words of their rows."""

import random
import re
from pathlib import Path

import pyarrow as pa
import pytest

speakers = pytest.importorskip("gavel.llm.speakers")
fillers = pytest.importorskip("gavel.llm.fillers")


def test_turn_texts_in_seq_order(rows):
    said = [(5, 2, "B", "[12:30] uhh two"), (1, 1, "SHRI A ONE", "One,  (Interruptions) um, yes."), (3, 4, None, "three"), (4, 3, None, "(Laughter)"), (9, 4, None, "a later copy"), (6, 5, "SHRI B TWO", "No!"), (7, 2, "B", "copy")]
    t = rows("id bigint, debate_id bigint, seq int, speaker_label string, text string, person_id int, role_kind string", *((i, 7, s, "SHRI A ONE" if l == "B" else l, x, None, None) for i, s, l, x in said), (20, None, 1, "A", "x", None, None))
    rosters = rows("debate_id bigint, mp_list_raw string")
    out = speakers.turn_texts(t, rosters).orderBy("seq_start")
    assert [tuple(r) for r in out.collect()] == [(7, 1, 4, "name a one", 3, "One, yes. two three"), (7, 5, 5, "name b two", 1, "No!")]
    assert sorted(out.drop("text").collect()) == sorted(speakers.clean_turns(t, rosters).collect())
    assert speakers.turn_texts(t.limit(0), rosters).count() == 0


def test_names_and_silence_at_any_length(rows):
    for n in (1, 40, 400):
        assert speakers.printed("(Interruptions) " * n + "SHRI ANIL VEDA : I agree.") == "SHRI ANIL VEDA"
    silent = ["ｕｈ，" * n for n in (1, 3, 30, 3_000)] + ["（Ｌａｕｇｈｔｅｒ） " * n for n in (1, 50)] + ["(Laughter) " * 5_000, "um, " * 300, "", None, "uһ " * 200]
    spoken = ["ｕｈ， " * n + "ｙｅｓ" for n in (1, 3, 30, 3_000)] + ["(Laughter) " * 900 + "No.", "“Order”", "जी"]
    assert speakers.says(pa.array(silent, pa.string())).tolist() == [False] * len(silent)
    assert speakers.says(pa.array(spoken, pa.string())).tolist() == [True] * len(spoken)


def test_few_labels_shift_the_plain_rule_gradually(rows):
    schema = "id bigint, debate_id bigint, seq int, speaker_label string, text string, person_id int, role_kind string"
    for known in (0, 5, 49, 50, 51, 400):
        t = [(n, 1, n, ["SHRI A ONE", "SHRI B TWO"][n // 3 % 2], "words are said here.", 1 + n // 3 % 2 if n <= known else None, None) for n in range(420)]
        out = speakers.clean_turns(rows(schema, *t), rows("debate_id bigint, mp_list_raw string"))
        assert {(r["seq_start"], r["seq_end"]) for r in out.collect()} == {(n, n + 2) for n in range(0, 420, 3)}, known


def test_sounds_are_learnt_from_how_they_stand(rows):
    rng = random.Random(2)
    words = ["".join(rng.choices("aeioubcdfgklnprst", k=rng.randint(2, 6))) for _ in range(400)]
    sounds = "uh uhh um umm er err erm errm hm hmm ah ahh eh ehh mhm mmhm uhm uhhm ehm em amm emm".split()
    data = [(" ".join(w if rng.random() > 0.2 else f"{rng.choice(sounds)}, " + w for w in rng.choices(words, k=20)),) for _ in range(600)]
    data += [(rng.choice(sounds) + rng.choice([",", "...", ""]),) for _ in range(200)]
    found = fillers.learnt(rows("text string", *data, (None,), ("",)))
    assert set(found) <= {"ehm", "em", "amm", "emm"} and found, found
    assert fillers.learnt(rows("text string", ("only words",), (None,))) == () == fillers.learnt(rows("text string"))
    assert not speakers.says(pa.array(["hum... huum"]), ("hum",))[0] and speakers.clean("So, huum, we go", ("hum",)) == "So, we go"


def test_cleaning_many_texts_is_cleaning_each(spark):
    texts = ["uhh [12:30] So, um, (Interruptions) we -- go", "um um um, er, no", "", None, "10:20 --> 10:30 Yes*coughs*!", "ఉ um\u00a0we", "अं, हम्म हम जाएँ ।", ", , a , b"]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/turns.parquet").select("text").collect()] if Path("/root/testdata/sf0.001").exists() else []
    assert speakers.cleaned(pa.array(texts, pa.string())).to_pylist() == [speakers.clean(t) if t else "" for t in texts]
