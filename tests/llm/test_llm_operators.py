"""Training-data operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random

import numpy as np
import pytest
from gavel.llm import boost, duplicates, garbled, groups, lookalikes, neighbours, packing, residue, speakers, tokens
from pyspark.sql import functions as F


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1: vectors


def vectors(n, dims=16, seed=5):
    rng = np.random.default_rng(seed)
    hubs = rng.normal(size=(n // 6 + 1, dims))
    return [(k, [float(x) for x in hubs[k // 6] + 0.15 * rng.normal(size=dims)]) for k in range(n)]


def brute(data, k=5, limit=0.8):
    x = np.array([np.float32(v) for _, v in data], np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    score = x @ x.T
    np.fill_diagonal(score, -1)
    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return {(data[q][0], data[e][0]) for q in range(len(data)) for e in best[q] if score[q, e] >= limit}


def test_neighbours_recall_against_brute_force(rows):
    data = vectors(900)
    base = rows("id bigint, vector array<float>", *data)
    asked = base.select(F.lit("q").alias("kind"), "id", F.col("id").alias("own"), "vector")
    want = brute(data)
    found = set(got(neighbours.most_similar(base, asked, 16, fit_rows=400).select("id", "found")))
    assert len(want) > 1000 and len(found & want) / len(want) >= 0.97 and len(found - want) / len(want) < 0.02


def test_neighbours_split_lists_give_the_same(rows, monkeypatch):
    data = vectors(300)
    base = rows("id bigint, vector array<float>", *data)
    asked = base.select(F.lit("q").alias("kind"), "id", F.col("id").alias("own"), "vector")
    whole = set(got(neighbours.most_similar(base, asked, 16, cells=4).select("id", "found")))
    monkeypatch.setattr(neighbours, "LIST_ROWS", 50)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 30)
    assert set(got(neighbours.most_similar(base, asked, 16, cells=4).select("id", "found"))) == whole


def test_neighbours_in_one_dense_list(rows):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    data = [(k, [float(x) for x in centre + 0.05 * rng.normal(size=16)]) for k in range(1_500)]
    base = rows("id bigint, vector array<float>", *data)
    asked = base.select(F.lit("q").alias("kind"), "id", F.col("id").alias("own"), "vector")
    found = set(got(neighbours.most_similar(base, asked, 16, cells=1).select("id", "found")))
    want = brute(data)
    assert len(want) == 7_500 and len(found & want) / len(want) >= 0.999


def test_a_vector_that_many_share_costs_one_entry(rows):
    v = [1.0, 2.0, 0.0, 1.0]
    base = rows("id bigint, vector array<float>", *((k, v) for k in range(3_000)), (5_000, [0.0, 0.0, 1.0, 0.0]))
    asked = rows("kind string, id bigint, own bigint, vector array<float>", ("q", 1, 1, v), ("e", 7, None, v))
    assert got(neighbours.most_similar(base, asked, 4, k=3).select("kind", "found")) == [("e", 0), ("e", 1), ("e", 2), ("q", 0), ("q", 2), ("q", 3)]


def test_neighbours_edge_cases(rows):
    v = [1.0, 0.0, 0.0, 0.0]
    bad = [(90, None), (91, [0.0] * 4), (92, [float("nan")] * 4), (93, [1.0]), (94, [1.0, None, 0.0, 0.0]), (95, [float("inf")] * 4), (96, [])]
    base = rows("id bigint, vector array<double>, kind string", *((k, v, "clash") for k in range(9)), (3, v, "again"), *((k, x, None) for k, x in bad))
    asked = rows("kind string, id bigint, own bigint, vector array<double>", ("q", 2, 2, [2.0, 0.0, 0.0, 0.0]), ("q", 50, None, v), *(("bad", k, None, x) for k, x in bad))
    out = neighbours.most_similar(base, asked, 4, k=3)
    assert got(out.select("id", "found")) == [(2, 0), (2, 1), (2, 3), (50, 0), (50, 1), (50, 2)]
    assert neighbours.most_similar(base.limit(0), asked, 4).count() == 0 and neighbours.most_similar(base, asked.limit(0), 4).count() == 0


# 3: garbled text

CLEAN = ["Officers of Vão Belmã and Île Dârme signed a résumé — “for want of bidders” …", "शिक्षा के क्‍षेत्र में तीन गाँव हैं, पर पुल नहीं।", "The journal «Вопросы каналов» wrote ₹ 34", "ЖУРНАЛ «ВОПРОСЫ КАНАЛОВ»", "plain words only?", "naïve café, façade"]


def test_garbled_is_found_and_restored(rows):
    clean = [(f"c{n}", t) for n, t in enumerate(CLEAN * 30)]
    bad = []
    for n, t in enumerate([CLEAN[0], CLEAN[1], CLEAN[5], "costs ₹ 5 only"]):
        for charset in ("latin-1", "mac_roman", "cp437", "cp850"):
            bad.append((f"b{n}{charset}", t.encode().decode(charset), t))
    bad += [("twice", "café".encode().decode("latin-1").encode().decode("latin-1"), "café"), ("html", "caf&Atilde;&copy;", "café"), ("swap", "The " + "Member may".encode("utf-16-le").decode("utf-16-be") + " go", "The Member may go")]
    lost = [("lost", "शिक्षा".encode().decode("cp1252", "replace"), None), ("mark", "caf�", None)]
    out = {r["id"]: r["restored"] for r in garbled.find_garbled(rows("id string, text string, kind string", *((*x, "clash") for x in clean), *((i, g, "clash") for i, g, _ in bad + lost), ("null", None, None), ("empty", "", None), ("long", "word " * 200_000, None)), ["id"], "text").collect()}
    assert set(out) == {i for i, *_ in bad + lost}
    assert {i: out[i] for i, *_ in bad} == {i: t for i, _, t in bad}
    assert out["mark"] is None and garbled.find_garbled(rows("id string, text string"), ["id"], "text").count() == 0


# 4: duplicates

LONG = " ".join(f"word{n}" for n in range(30))


def test_same_texts_but_for_formatting(rows):
    fields = "; ".join(f"Name{n}: value {n} of some" for n in range(8))
    other = " | ".join(f"NAME{n}: Value {n} of some." for n in reversed(range(8)))
    flat = fields.replace(";", ",")
    data = [(5, LONG), (3, LONG.upper().replace(" ", "  ")), (9, LONG.replace(" ", ", ") + "!"), (9, LONG), (7, LONG + " more"), (20, fields), (21, other), (22, flat), (30, None), (31, ""), (32, "short text"), (33, "short text")]
    out = duplicates.same_texts(rows("id bigint, text string", *data), "id", "text")
    assert got(out) == sorted([(3, 3, 4), (5, 3, 4), (9, 3, 4), (9, 3, 4), (20, 20, 3), (21, 20, 3), (22, 20, 3)], key=repr)
    assert duplicates.same_texts(rows("id bigint, text string"), "id", "text").count() == 0


def test_nested_records_collapse(rows):
    schema = "id int, a struct<x:string,y:array<string>>, m map<string,string>"
    data = [(1, ("A b", ["p", "q"]), {"k": "v", "l": "w"}), (2, ("a-B", ["q", "p"]), {"L": "W", "K": "V"}), (3, ("ab", ["p", "q", "q"]), None), (4, (None, None), {}), (5, (None, None), {})]
    t = rows(schema, *data)
    assert got(duplicates.collapse(t, "id", ["a", "m"], unordered={"a.y"})) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 2), (5, 4, 2)]
    assert [r["copies"] for r in duplicates.collapse(t, "id", ["a", "m"]).collect()] .count(1) == 3


# 5: turns


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (4000, 5))
    y = ((x[:, 1] > 1) & (x[:, 3] == 0)).astype(int)
    assert ((boost.Boosted().fit(x[:3000], y[:3000]).predict(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97


def test_clean_turns(rows):
    listed = '[{"mpName": "Shri Ramesh Kumar Veda", "mpCode": 1}, {"mpName": "Dr. Anil Veda", "mpCode": 2}, {"mpName": "Smt. Uma Toli", "mpCode": 3}]'
    labels = [
        (1, "SHRI RAMESH KUMAR VEDA (X)", "One."), (2, "Veda, Shri Ramesh", "two"), (4, "R. K. Veda", "[12:30] uhh three"), (5, None, "and four"), (6, " - ", "(Interruptions) um, ..."),
        (8, "MR. CHAIRMAN", "Order."), (9, "ＭＡＤＡＭ SPEAKER", "Order, order."), (10, "HON. MEMBERS", "No!"), (11, "SEVERAL HON. MEMBERS", "No!"), (12, "", "DR. ANIL VEDA : Yes."), (13, "Dr. Veda contd...", "more"), (14, "Uma_Toli", "x"), (14, "Uma_Toli", "x"),
    ]
    t = [(n, 7, s, l, x, None, None) for n, (s, l, x) in enumerate(labels)] + [(90, None, 1, "A", "x", None, None), (91, 8, 1, "SHRI Q ZED", "hello", None, None), (92, 8, 2, None, None, None, None), (93, 9, 1, None, "no one", None, None)]
    turns = rows("id bigint, debate_id bigint, seq int, speaker_label string, text string, person_id int, role_kind string", *t)
    rosters = rows("debate_id bigint, mp_list_raw string", (7, listed), (8, "no json"), (None, None))
    out = [tuple(r) for r in speakers.clean_turns(turns, rosters).orderBy("debate_id", "seq_start").collect()]
    assert out == [(7, 1, 5, "member 1", 4), (7, 8, 9, "chair", 2), (7, 10, 11, "crowd", 2), (7, 12, 13, "member 2", 2), (7, 14, 14, "member 3", 1), (8, 1, 1, "name q zed", 1), (9, 1, 1, None, 1)]
    assert speakers.clean_turns(turns.limit(0), rosters.limit(0)).count() == 0
    assert speakers.clean("uhh [12:30] So, um, (Interruptions) we -- go") == "So, we -- go"


def test_turns_of_one_long_debate_are_carried_across_blocks(rows, monkeypatch):
    monkeypatch.setattr(speakers, "BLOCK", 4)
    who = ["SHRI A ONE"] * 9 + [None] * 6 + ["SHRI B TWO"] + [None] * 7 + ["SHRI A ONE"]
    t = rows("id bigint, debate_id bigint, seq int, speaker_label string, text string, person_id int, role_kind string", *((n, 1, n * 3, l, "words", None, None) for n, l in enumerate(who)))
    out = [tuple(r)[1:4] for r in speakers.clean_turns(t, rows("debate_id bigint, mp_list_raw string")).orderBy("seq_start").collect()]
    assert out == [(0, 42, "name a one"), (45, 66, "name b two"), (69, 69, "name a one")]


# 6: groups


@pytest.mark.parametrize("n, m, bound", [(200, 180, 15), (60, 59, 5)])
def test_components_in_bounded_partitions(rows, n, m, bound):
    random.seed(n)
    links = [(k, k + 1) for k in range(m)] if n == m + 1 else [(random.randrange(n), random.randrange(n)) for _ in range(m)] + [(0, random.randrange(n)) for _ in range(m // 2)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    want, found = {}, {}
    for x in list(parent):
        want.setdefault(find(x), set()).add(x)
    for r in groups.components(rows("a int, b int", *links), "a", "b", bound).collect():
        found.setdefault(r["component"], set()).add(int(r["node"]))
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, found.values()))


def test_components_edge_cases(rows):
    t = rows("a string, b string, node string", ("x", None, "clash"), (None, None, None), ("y", "y", ""), ("p", "q", ""), ("p", "q", ""))
    out = {r["node"]: r["component"] for r in groups.components(t, "a", "b").collect()}
    assert set(out) == {"x", "y", "p", "q"} and out["p"] == out["q"] and len(set(out.values())) == 3
    assert groups.components(rows("a string, b string"), "a", "b").count() == 0


# 7: look-alikes


def test_lookalikes(rows):
    cases = {"I h\u0430v\u0435": "I have", "\uff54\uff48\uff45 \uff11\uff12": "the 12", "\U0001d402\U0001d407": "CH", "sta\ufb03ng": "staffing", "cafe\u0301": "caf\xe9", "la\u200bkh": "lakh", "a\xa0b\u3000c": "a b c", "\u0420lease": "Please", "lak\u200ch": "lakh"}
    same = ["क्‍षेत्र", "«Зерно и мельницы»", "«Πύλη υδάτων»", "½ km² “x” – … ’", "tab\tline\n", "", "🙂", "磨坊与谷仓", "ढ़"]
    data = [(n, t) for n, t in enumerate([*cases, *same])] + [(99, None), (98, "long " * 200_000)]
    df = rows("id int, text string, kind string", *((*x, "clash") for x in data), (0, next(iter(cases)), "twice"))
    out = got(lookalikes.normalised(df, ["id"], "text"))
    assert out == sorted([*enumerate(cases.values()), (0, "I have")], key=repr)
    assert lookalikes.normalised(df, ["id"], "text", changed_only=False).count() == df.count()
    assert lookalikes.normalised(df.limit(0), ["id"], "text").count() == 0


def test_classes_are_transitive_and_frequent_members_represent():
    r = lookalikes.representatives([("a", "b"), ("b", "c"), ("x", "y")], lambda s: ({"c": 5, "y": 1}.get(s, 0),))
    assert r == {"a": "c", "b": "c", "c": "c", "x": "y", "y": "y"}
    forms = lookalikes.Rewriter({"a": 9, "e": 9, "f": 1, "i": 1}).forms
    assert {forms[c] for c in "\uff41\u0430\u03b1\U0001d41a"} == {"a"} and forms["e\u0301"] == "\xe9" and forms["\ufb01"] == "fi" and forms["a\u0302\u0301"] == forms["\xe2\u0301"] == "\u1ea5"
    # Where a look-alike script is the usual one, its letters stay and represent the others.
    assert lookalikes.Rewriter({"\u0430": 900, "\u0435": 900, "a": 3}).rewrite("\u0430\u0435 \u03b1") == "\u0430\u0435 \u0430"
    r = lookalikes.Rewriter({})
    assert r.rewrite("\uff41\u0301 \u0441\uff41f\u200b\u0435 x") == "\xe1 cafe x" and r.rewrite("\u0441 \u0437\u0435\u0440\u043d\u043e") == "c \u0437\u0435\u0440\u043d\u043e"


# 8 and 9: tokens and containers

TEXTS = [None, "", " ", "Hello  world\n\n  x", "हम गाँव  जाते हैं।\r\n", "<|endoftext|> it's 34,040", "tab\t\ta", "  wide", "a" * 5000, "word " * 60_000, "x \n", "  lead"]


def test_tokens_are_those_of_the_tokenizer_and_come_back(rows):
    df = rows("id bigint, text string, codes int", *((n, t, 1) for n, t in enumerate(TEXTS)), (3, "again", 2))
    out = tokens.encode_corpus(df, "id", "text")
    plain = tokens.encoder(tokens.vocabulary_path())
    want = [(n, plain.encode_ordinary(t or "")) for n, t in enumerate(TEXTS)] + [(3, plain.encode_ordinary("again"))]
    assert sorted((r["id"], list(r["ids"])) for r in out.collect()) == sorted(want)
    assert sorted((r["id"], r["text"]) for r in tokens.decode_corpus(out, "id").collect()) == sorted([(n, t or "") for n, t in enumerate(TEXTS)] + [(3, "again")])
    assert sorted(map(tuple, tokens.count_tokens(df, "id", "text").collect())) == sorted((n, len(x)) for n, x in want)
    assert tokens.encode_corpus(df.limit(0), "id", "text").count() == 0


def test_tokens_of_random_texts(rows):
    random.seed(2)
    bits = [" ", "  ", "\n", "\t", "a", "B", "'s", "12", "é", "क", "ि", " ", " ", "!", "🙂", "\x1c"]
    texts = ["".join(random.choice(bits) for _ in range(random.randrange(30))) for _ in range(3000)]
    plain = tokens.encoder(tokens.vocabulary_path())
    out = {r["id"]: list(r["ids"]) for r in tokens.encode_corpus(rows("id bigint, text string", *enumerate(texts)), "id", "text").collect()}
    assert all(out[n] == plain.encode_ordinary(t) for n, t in enumerate(texts))


def test_patterns_are_those_of_best_fit_decreasing():
    random.seed(4)
    for _ in range(300):
        capacity = random.randint(2, 60)
        sizes = sorted((random.randint(1, capacity - 1) for _ in range(random.randint(0, 90))), reverse=True)
        found = packing.patterns({s: sizes.count(s) for s in sizes}, capacity)
        room = []
        for s in sizes:
            fits = [k for k, r in enumerate(room) if r >= s]
            k = min(fits, key=lambda k: room[k]) if fits else len(room)
            room += [capacity] * (k == len(room))
            room[k] -= s
        left = [capacity - sum(s * n for s, n in p.held) for p in found for _ in range(p.many)]
        assert sorted(room) == sorted(left)
        assert sorted((s for p in found for s, n in p.held for _ in range(n * p.many)), reverse=True) == sizes
    many = packing.patterns({1_100: 10**9, 900: 10**9 + 7, 3: 5}, 2_048)
    assert len(many) < 10 and sum(p.many for p in many) == 10**9 + 4 and all(sum(s * n for s, n in p.held) <= 2_048 for p in many)


def test_no_task_takes_all_items_where_no_container_gets_full(rows, spark):
    df = spark.range(20_000).select("id", F.lit(1_100).alias("n"))
    out = packing.pack(df, "id", "n", 2_048)
    assert out.select("bin").distinct().count() == 20_000 and out.rdd.getNumPartitions() > 1


def test_containers_hold_everything_once(rows):
    random.seed(6)
    sizes = [random.choice([0, 3, 50, 99, 100, 101, 250, 1000]) for _ in range(400)] + [None]
    df = rows("id bigint, n int, bin string", *((k, n, "clash") for k, n in enumerate(sizes)), (0, 70, "twice"))
    out = packing.pack(df.repartition(5), "id", "n", 100).collect()
    total = {}
    for r in out:
        if r["bin"] is not None:
            total[r["bin"]] = total.get(r["bin"], 0) + r["size"]
    assert max(total.values()) <= 100 and sum(total.values()) == sum(filter(None, sizes)) + 70
    assert sum(r["bin"] is None for r in out) == sum(not n for n in sizes)
    assert len(total) <= 1.1 * -(-sum(total.values()) // 100)
    assert {r["piece"] for r in out if r["id"] and r["size"] and sizes[r["id"]] == 250} <= {0, 1, 2}
    assert packing.pack(df.limit(0), "id", "n", 100).count() == 0


# 10: residue


def test_residue(rows):
    yes = {
        1: "The {{member_name}} spoke.", 2: "of ${party} and", 3: "the %BILL_TITLE% was", 4: "x [Insert party here] y", 5: "of «party» moved", 6: "Lorem ipsum amet dolor velum nullam. Dolor velum ipsum amet.", 7: "Intro line here.\nVelum nullam dolor amet dolor.",
        8: "404 Not Found\n\nThe page you asked for is not on this server.", 9: "Home | Members | Help\nPlease enable JavaScript to read this.\n\n© Site", 10: "Your session has expired. Please sign in again.", 11: "All is well.\nType your summary in this box.", 12: "[यहाँ नाम लिखें] ने कहा", 13: "Velum lorem amet dolor ipsum nullam.",
    }
    no = {
        50: None, 51: "", 52: "  \n", 53: "Members said the portal shows error 404 to farmers.", 54: "The site asks users to enable JavaScript, which phones lack.", 55: "The booklet carried lorem ipsum in place of the reply.", 56: "The word {(sic)} appears; the fee is $ 5.", 57: "<p>Real text in <b>mark-up</b>.</p>",
        58: "The journal «Зерно и мельницы» wrote.", 59: "[Placed in Library, See No. 5]", 60: "long real text. " * 30_000, 61: "100% of 50% and _x_",
    }
    df = rows("id bigint, text string, reason string", *((k, t, "clash") for k, t in (yes | no).items()), (1, yes[1], "twice"))
    out = residue.residue(df, "id", "text")
    assert {r["id"] for r in out.collect()} == set(yes)
    assert residue.residue(df.limit(0), "id", "text").count() == 0


def test_whole_page_templates_are_messages_by_their_share(rows):
    filled = [(n, f"Something about an error, number {n}, on this page") for n in range(12)]
    copies = [(100 + n, "Farmers reported an error of the portal to the House today") for n in range(40)]
    content = [(200 + n, f"Something about an error in field {n}: " + w) for n, w in enumerate(["canal", "mill", "road"])]
    t = rows("id bigint, t string", *filled, *copies)
    assert {r["id"] for r in residue.residue(t, "id", "t").collect()} == set(range(12))  # copies are no template
    t = rows("id bigint, t string", *filled[:5], *content)
    assert residue.residue(t, "id", "t").count() == 0  # five of eight are too few
    speech = [(300 + n, f"Sorry, this House heard {w} " * 9) for n, w in enumerate("a b c d e f g h i j k l m n o p q r s t".split())]
    assert residue.residue(rows("id bigint, t string", *((n, t + "about an error") for n, t in speech)), "id", "t").count() == 0  # the seed is outvoted


def test_blanks_and_defaults_count_only_in_slots(rows):
    slot = [(n, f"Reply to {{{{{w}}}}} was laid by the clerk.") for n, w in enumerate(["member", "party"])]
    t = rows("id bigint, t string", *slot, (10, "Reply to ______ was laid by the clerk."), (11, "Reply to TBD was laid by the clerk."), (12, "Sign here ______ and go."), (13, "Contents ........ 12"))
    assert {r["id"] for r in residue.residue(t, "id", "t").collect()} == {0, 1, 10, 11}


def test_equal_digests_of_different_texts_stay_apart(rows, monkeypatch):
    words = [f"w{n}" for n in range(30)]
    a, b = " ".join(words), " ".join(reversed(words))
    fields = "; ".join(f"name {n}: some value {n}" for n in range(12))
    data = [(1, a), (2, a.upper()), (3, b), (4, b + "!"), (5, fields), (6, "; ".join(reversed(fields.split("; ")))), (7, fields.replace(";", ","))]
    t = rows("id bigint, text string", *data)
    want = [(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2), (5, 5, 3), (6, 5, 3), (7, 5, 3)]
    assert got(duplicates.same_texts(t, "id", "text")) == want
    plain = duplicates.digest
    monkeypatch.setattr(duplicates, "digest", lambda *a, **k: F.substring(plain(*a, **k), 1, 0))  # all digests collide
    assert got(duplicates.same_texts(t, "id", "text")) == want
    assert got(duplicates.collapse(t, "id", ["text"]).where("id < 5")) == want[:4]


RUSSIAN = ["Вопросы каналов и мельниц обсуждались", "журнал писал о вопросах зерна", "мельницы стоят без зерна и воды", "каналы и дороги ждут воды", "зерно для мельниц дороги не дошло", "щедрый хозяин увидел объезд, ещё цифры, чай, юг, этаж"]


def test_single_byte_charsets_read_as_others(rows):
    clean = [(f"c{n}", t) for n, t in enumerate(RUSSIAN * 40)] + [(f"l{n}", t) for n, t in enumerate(CLEAN * 10)]
    bad = {f"b{k}": (t, t.encode(a).decode(b)) for k, (t, a, b) in enumerate((t, a, b) for t in RUSSIAN[:5] for a, b in (("cp1251", "cp1252"), ("koi8-r", "cp1251")))}
    t = rows("id string, text string", *clean, *((k, x) for k, (_, x) in bad.items()), ("n", None), ("e", ""))
    out = {r["id"]: r["restored"] for r in garbled.find_garbled(t, ["id"], "text").collect()}
    assert not [k for k in out if k[0] in "cln"], {k: v for k, v in out.items() if k[0] in "cln"}
    assert set(out) == set(bad)
    long = lambda t: [w for w in t.split() if len(w) > 2]
    assert sum(long(out[k] or "") == long(v) for k, (v, _) in bad.items()) >= 0.7 * len(bad)


def test_characters_beyond_the_first_plane_are_restored(rows):
    t = [(f"c{n}", f"We saw 🙂 number {n} and Ｗide ﬁne forms") for n in range(60)] + [("b", "We saw 🙂 there".encode().decode("cp1252", "replace").replace("�", "")), ("m", "﻿Order, order".encode().decode("cp1252"))]
    out = {r["id"] for r in garbled.find_garbled(rows("id string, text string", *t), ["id"], "text").collect()}
    assert out >= {"m"} and not [k for k in out if k[0] == "c"]
