"""Operators on small tables: nulls, ties, repeated rows, empty tables, clashing columns."""

import datetime
import random

import pytest
from gavel.functions import glyphs, pages, spans
from gavel.functions import text as tx
from gavel.operators import aggregates as agg
from gavel.operators import decisions as dec
from gavel.operators import graph, search
from gavel.operators import relational as rel
from gavel.operators import sequences as seq
from gavel.operators.asof import as_known
from gavel.sources import files
from pyspark.sql import functions as F

D = datetime.date


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_as_known_takes_nothing_from_the_future(rows):
    events = rows("k int, at date, n int, party string", (1, D(2020, 1, 1), 1, "clash"), (1, D(2020, 6, 1), 2, None), (1, D(2020, 6, 1), 2, None), (2, D(2020, 1, 1), 3, None), (None, D(2020, 1, 1), 4, None), (1, None, 5, None), (1, D(2019, 12, 31), 6, None))
    known = rows("k int, since date, party string, n int", (1, D(2020, 1, 1), "a", 9), (1, D(2020, 6, 1), "c", 9), (1, D(2020, 6, 1), "b", 9), (1, D(2021, 1, 1), "z", 9), (3, D(2000, 1, 1), "q", 9), (None, D(2000, 1, 1), "w", 9), (2, None, "v", 9))
    out = as_known(events, known, ["k"], "at", "since", ["party"], prefix="was_", width_days=7)
    assert sorted((r["n"], r["was_party"]) for r in out.collect() if r["was_party"]) == [(1, "a"), (2, "b"), (2, "b")]
    assert out.count() == 7 and out.columns == ["k", "at", "n", "party", "was_party"]
    assert as_known(events.limit(0), known, ["k"], "at", "since", ["party"], prefix="was_").count() == 0
    assert {r["was_party"] for r in as_known(events, known.limit(0), ["k"], "at", "since", ["party"], prefix="was_").collect()} == {None}


def test_as_known_against_brute_force(rows):
    random.seed(3)
    day = lambda: D(2020, 1, 1) + datetime.timedelta(random.randrange(900))
    ev = [(random.choice([1, 1, 1, 2, 3]), day(), n) for n in range(300)]
    at = {(random.choice([1, 1, 2]), day()): n for n in range(120)}
    out = as_known(rows("k int, at date, n int", *ev), rows("k int, since date, v int", *((k, d, v) for (k, d), v in at.items())), ["k"], "at", "since", ["v"])
    for r in out.collect():
        fits = [(d, v) for (k, d), v in at.items() if k == r["k"] and d <= r["at"]]
        assert r["v"] == (max(fits)[1] if fits else None)


def test_negations_differ_on_nulls(rows):
    t = rows("x string", ("a",), ("b",), (None,))
    assert got(t.where(rel.not_in_known(F.col("x"), ["a"]))) == [("b",)]
    assert got(t.where(rel.not_in_or_null(F.col("x"), ["a"]))) == [("b",), (None,)]
    assert got(t.where(rel.contains_literal(F.col("x"), "%"))) == []


def test_interval_join_and_last_row_differ_on_null_days(rows):
    e = rows("id int, k int, at date", (1, 1, None), (2, 1, D(2020, 5, 1)), (3, 9, D(2020, 5, 1)), (4, 1, D(2019, 1, 1)))
    v = rows("k int, since date, id2 int, p string", (1, D(2020, 1, 1), 1, "a"), (1, D(2021, 1, 1), 2, "b"))
    assert got(rel.latest_or_last(e, v, ["k"], "at", "since", "id", "id2", ["p"]).select("id", "p")) == [(1, "b"), (2, "a"), (3, None), (4, None)]
    assert got(rel.interval_join(e, rel.periods(v, ["k"], "since"), ["k"], "at", "since", "until").select("id", "p")) == [(2, "a")]


def test_only_nearest_is_what_all_pairs_give(rows):
    rng = random.Random(3)
    a = [(n, rng.randrange(3), rng.choice([None, *range(-90, 90, 3)])) for n in range(60)]
    b = [(n, rng.randrange(3), float(rng.randrange(-100, 100, 4))) for n in range(40)]
    of = lambda own, other: {x[0]: near[0] for x in own if x[2] is not None for near in [[y[0] for y in other if y[1] == x[1] and abs(y[2] - x[2]) == min(abs(z[2] - x[2]) for z in other if z[1] == x[1])]] if len(near) == 1}
    known = [x for x in a if x[2] is not None]
    there, back = of(a, b), of(b, known)
    want = sorted(((x, y) for x, y in there.items() if back.get(y) == x), key=repr)
    df = lambda t: rows("id int, k int, at double", *((n, k, None if v is None else float(v)) for n, k, v in t))
    out = rel.only_nearest(df(a), df(b), "k", "at", width=8)
    assert got(out.select("a", "b")) == want and want
    assert rel.only_nearest(df(a).limit(0), df(b), "k", "at").count() == 0


def test_sets_upserts_and_diffs(rows):
    o, n = rows("k int, v string", (1, "a"), (2, None), (3, "c")), rows("k int, v string", (2, None), (3, "d"), (4, "e"))
    assert got(rel.diff(o, n, ["k"], ["v"])) == [(1, "delete"), (2, "same"), (3, "update"), (4, "insert")]
    assert got(rel.upsert(o, n, ["k"])) == [(1, "a"), (2, None), (3, "d"), (4, "e")]
    assert got(rel.insert_absent(o, n, ["k"])) == [(1, "a"), (2, None), (3, "c"), (4, "e")]
    assert got(rel.set_difference(o, n, ["k"])) == [(1, "left"), (2, "both"), (3, "both"), (4, "right")]


def stitched(turns, most=25):
    """The rules read aloud, one turn at a time."""
    out, cur, pending = [], None, 0
    for n, p, role, w in sorted(turns):
        if cur and p is not None and role is None and p == cur[0]:
            cur[2], cur[3], cur[4], cur[5], pending = n, cur[3] + 1, cur[4] + pending, cur[5] + w, 0
        elif cur and (role or w <= most):
            pending += 1
        else:
            pending = 0
            if role:
                cur = None
            elif p is not None:
                cur = [p, n, n, 1, 0, w]
                out.append(cur)
            else:
                if w > most:
                    out.append([None, n, n, 1, 0, w])
                cur = None
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_stitch_against_the_rules(rows, seed):
    random.seed(seed)
    turns = {d: [(n, random.choice([None, 1, 1, 2, 3]), random.choice([None, None, None, "crowd"]), random.choice([5, 25, 26, 80])) for n in range(40)] for d in range(20)}
    turns = {d: [(n, None if r else p, r, w) for n, p, r, w in t] for d, t in turns.items()}
    df = rows("debate_id int, seq int, person_id int, role_kind string, word_count int", *((d, n, p, r, w) for d, t in turns.items() for n, p, r, w in t))
    for width in (seq.BLOCK, 3):
        by = {}
        for r in seq.stitch(df, width=width).collect():
            by.setdefault(r["debate_id"], []).append((r["person_id"], r["seq_start"], r["seq_end"], r["turn_count"], r["interruption_count"], r["word_count"]))
        assert {d: sorted(v, key=repr) for d, v in by.items()} == {d: s for d, t in turns.items() if (s := stitched(t))}


def test_islands_runs_and_months(rows):
    days = rows("k int, d date", (1, D(2020, 1, 1)), (1, D(2020, 2, 5)), (1, D(2020, 3, 12)), (1, None), (2, D(2020, 1, 1)))
    assert got(seq.islands(days, ["k"], "d", 35)) == [(1, D(2020, 1, 1), 0), (1, D(2020, 2, 5), 0), (1, D(2020, 3, 12), 1), (2, D(2020, 1, 1), 0)]
    v = rows("k int, t int, v string", (1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a"))
    assert [(r["v"], r["first"], r["last"], r["n"]) for r in seq.runs(v, ["k"], ["t"], "v").orderBy("run").collect()] == [("a", 1, 2, 2), (None, 3, 4, 2), ("a", 5, 5, 1)]
    m = rows("k int, m int, n int", (1, 1, 5), (1, 12, 7), (1, 13, 1))
    assert got(seq.sliding_months(m, ["k"], "m", "n").select("m", "window_sum")) == [(1, 5), (12, 12), (13, 8)]


def test_median_counts_the_absent(rows):
    c = rows("g int, n int", (1, 4), (1, 2), (2, 3))
    assert got(agg.median_with_zeros(c, ["g"], "n", rows("g int, size int", (1, 3), (2, 4), (3, 2)), "size")) == [(1, 2.0), (2, 0.0), (3, 0.0)]


def test_spread_lookup_is_an_inner_join(rows, monkeypatch):
    data = [(n, n % 7 if n % 3 else 99, "x") for n in range(200)] + [(500, None, "x"), (501, 1234, "x")]
    facts = [(k, sum(d[1] == k for d in data), f"v{k}") for k in (*range(7), 99)]
    want = sorted(((n, k, f"v{k}") for n, k, _ in data if k is not None and k != 1234), key=repr)
    for heavy in (1_000, 3):
        monkeypatch.setattr(rel, "HEAVY", heavy)
        out = rel.spread_lookup(rows("id int, k int, clash string", *data), rows("k int, n int, v string", *facts), "k", "n")
        assert got(out.select("id", "k", "v")) == want
    assert rel.spread_lookup(rows("id int, k int"), rows("k int, n int, v string"), "k", "n").count() == 0


def test_dominant_ties_go_to_the_first(rows):
    assert got(agg.dominant(rows("k int, v string", (1, "b"), (1, "a"), (1, None), (2, None)), ["k"], "v")) == [(1, "a", 1)]


def test_text_columns(rows):
    t = rows("s string", ("The Bridges of गाँव, countries",), ("",), (None,))
    assert [r[0] for r in t.select(tx.tokens(F.col("s"))).collect()] == [["the", "bridges", "of", "गाँव", "countries"], [], []]
    assert t.select(tx.stems(F.col("s"), ["the", "of"])).first()[0] == ["bridge", "गाँव", "country"]
    assert t.select(tx.has_phrase(tx.tokens(F.col("s")), ["of", "गाँव"])).first()[0] is True
    s = rows("a string, b string", ("canal road", "canal road"), ("canal", "ferry"), ("", ""))
    assert [r[0] for r in s.select(tx.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    assert t.select(tx.plain(F.lit("A​ “b” – c"))).first()[0] == 'a "b" - c'


def test_search(rows, monkeypatch):
    d = rows("id int, t string", (1, "red red canal"), (2, "canal"), (3, ""), (4, None))
    assert [r["id"] for r in search.bm25(d, "id", tx.tokens(F.col("t")), ["red", "canal"]).orderBy(F.desc("score")).collect()] == [1, 2]
    assert search.bm25(d.limit(0), "id", tx.tokens(F.col("t")), ["red"]).count() == 0
    a, b = rows("id int, rank int", (1, 1), (2, 2)), rows("id int, rank int", (2, 1))
    assert [r["id"] for r in search.fuse([a, b]).orderBy(F.desc("score")).collect()] == [2, 1]
    long = " ".join(["red canal"] + [f"w{k}" for k in range(9)])
    names = rows("n string", (long.upper(),), ("red canal",), ("canal",), ("Red",), (None,), ("",))
    for most in (search.MOST_DICTIONARY, -1):
        monkeypatch.setattr(search, "MOST_DICTIONARY", most)
        found = search.dictionary_hits(rows("id int, t string", (1, f"the {long}"), (2, "canal red"), (3, None), (4, "")), "id", F.col("t"), names, "n")
        assert got(found.select("id", "name", "tf")) == [(1, long, 1), (2, "canal", 1), (2, "red", 1)]
        assert search.dictionary_hits(rows("id int, t string", (1, "x")), "id", F.col("t"), names.limit(0), "n").count() == 0


def test_named_runs_are_the_longest_from_left_to_right(rows):
    known = {("new",): "a", ("new", "delhi"): "b", ("delhi", "road", "fund"): "c", ("road",): "d"}
    texts = {1: "New Delhi road fund", 2: "the delhi, ROAD fund new", 3: "", 4: None, 5: "road road"}
    names = rows("name string, kind string", *((" ".join(w), k) for w, k in known.items()), ("road", "z"), (None, "x"))
    want = sorted(((n, at + 1, " ".join((t or "").lower().replace(",", "").split()[at:end]), v) for n, t in texts.items() for at, end, v in spans.longest_runs((t or "").lower().replace(",", "").split(), known)), key=repr)
    assert got(search.named_runs(rows("id int, t string", *texts.items()), "id", F.col("t"), names)) == want


def test_components_of_chains_and_hubs(rows):
    e = [(n, n + 1) for n in range(30)] + [(100, n) for n in range(101, 140)] + [(7, 7), (500, 500), (None, 3)]
    out = {r["node"]: r["component"] for r in graph.components(rows("a int, b int", *e)).collect()}
    assert {out[n] for n in range(31)} == {0} and {out[n] for n in range(100, 140)} == {100} and out[500] == 500


def test_guard_splits_only_large_groups(rows):
    e = rows("a int, b int, dist double", (1, 2, 0.01), (2, 3, 0.15), (3, 4, 0.01), (10, 11, 0.15))
    out = {r["node"]: r["component"] for r in graph.guarded_groups(e, 2, 0.2, 0.1, 0.1).collect()}
    assert out[1] == out[2] and out[3] == out[4] and out[1] != out[3] and out[10] == out[11]


def test_decisions(rows):
    o = rows("o array<struct<name:string,p:double>>", ([("a", 0.4), ("b", 0.4), ("c", 0.2)],), ([("a", 0.6), ("b", 0.4)],), ([],))
    assert [r[0] for r in o.select(dec.argmax_limit(F.col("o"), 0.5, "none")).collect()] == ["none", "a", "none"]
    assert [r[0] for r in o.select(dec.split_vote(F.col("o"))).collect()] == [True, True, False]
    assert rows("a int", (None,)).select(dec.failed_checks({"x": F.col("a") > 1, "y": F.lit(True)})).first()[0] == ["x"]


def test_pages():
    page = '<p>intro &amp; more<p><A name="4016*1"><b>SHRI A B (X) :</b> I&nbsp;said<br>this.</p><p>and <i>that</i></p><p><b>MR. CHAIRMAN :</b> Order'
    assert pages.turns(page) == [(0, None, None, "intro & more"), (1, "4016", "SHRI A B (X)", "I said\nthis.\nand that"), (2, None, "MR. CHAIRMAN", "Order")]
    assert pages.turns("") == pages.turns(None) == [] and pages.clean(None) is None
    assert pages.grids("<table><tr><td rowspan=2>a<td>b</tr><tr><td>c</table>") == [[["a", "b"], ["a", "c"]]]
    assert pages.to_latin("राम 12") == "raam 12" and pages.folded("Shrīī") == "sri"


def test_files(rows, spark, tmp_path):
    t = rows("a int, b string", (1, 'x "y"'), (2, None))
    files.write_tsv(t, f"{tmp_path}/t")
    assert got(files.read_tsv(spark, f"{tmp_path}/t", "a int, b string")) == [(1, 'x "y"'), (2, None)]
    files.replace_table(t, f"{tmp_path}/p")
    files.replace_table(t.where("a = 1"), f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 1
    assert [r[0] for r in rows("s string", ("3/4/2020",), ("31-12-1999",), ("x",), (None,)).select(files.day_first(F.col("s"))).collect()] == [D(2020, 4, 3), D(1999, 12, 31), None, None]
    assert got(files.canonical_json(t)) == [('{"a":1,"b":"x \\"y\\""}',), ('{"a":2}',)]
    assert files.sitemap(["/a&b"], "http://x/").count("<loc>http://x/a&amp;b</loc>") == 1


def test_glyphs_are_read_once():
    typed = {"gÉÉÒ ®ÉVÉ ÉËºÉc": "श्री राज सिंह", "´ÉÌhÉiÉ BÉEÉªÉÇ": "वर्णित कार्य", "nÉä\xadÉÉÒ cè*": "दोषी है।", "SÉÉcÚÆMÉÉ": "चाहूंगा", "ÉÊ|ÉªÉ xÉäiÉÉ": "प्रिय नेता"}
    assert {t: glyphs.read_glyphs(t) for t in typed} == typed
    for text in ("Vão Belmã and Île Dârme signed a résumé", "Éa", "Élan É", "…(Interruptions)"):
        assert glyphs.read_glyphs(text) == text
    assert glyphs.read_glyphs("£ÉÉ®iÉ Sir ÉÊBÉE") == "भारत Sir कि"
    assert glyphs.read_glyphs("BÉEàÉÇ") == "कर्म"
    for text in (None, "", "plain English ½ text", "पहले से हिन्दी"):
        assert glyphs.read_glyphs(text) == text
    once = glyphs.read_glyphs("£ÉÉ®iÉ ºÉ®BÉEÉ®")
    assert once == "भारत सरकार" and glyphs.read_glyphs(once) == once


def test_spans():
    assert [spans.ordinal(x) for x in ("one hundred and twenty-third", "104 th", "fortieth", "Forty-Second", "order", "", None)] == [123, 104, 40, 42, None, None, None]
    assert spans.mentions("The  Canal\nBill and canal bill", "canal bill") == [(5, 15), (20, 30)] and spans.mentions(None, "x") == []
    assert spans.excerpt("One. The canal is dry! Two.", ["canal"]) == ("The canal is dry!", [(4, 9)]) and spans.excerpt("", ["x"]) is None
    assert abs(spans.jaro_winkler("martha", "marhta") - 0.9611) < 1e-4 and abs(spans.jaro_winkler("dixon", "dicksonx") - 0.8133) < 1e-4 and spans.jaro_winkler("", "") == 0.0
    assert abs(spans.soft_tfidf(["anil", "veda"], ["veda", "anil"], {}) - 1) < 1e-9 and spans.soft_tfidf([], ["x"], {}) == 0.0
    rare = {"anil": 3.0, "kumar": 0.5}
    assert spans.soft_tfidf(["anil", "kumar"], ["anil", "das"], rare) > 0.8 > 0.3 > spans.soft_tfidf(["anil", "kumar"], ["das", "kumar"], rare)
    assert spans.longest_runs("new delhi road".split(), {("new",): "n", ("new", "delhi"): "nd", ("road",): "r"}) == [(0, 2, "nd"), (2, 3, "r")]


def test_order_boxes_and_constrained_groups(rows):
    assert graph.chain_order([3, 1, 2], [[1.0, 0.0], [0.0, 1.0], [0.8, 0.6]])[0] == 1 and graph.chain_order([2, 1], [[1.0], [1.0]]) == [1, 2]
    assert graph.first_fit([5, 6, 4, 12], 10) == [0, 1, 0, 2]
    e = rows("a int, b int, dist double", (1, 2, 0.1), (2, 3, 0.2), (3, 4, 0.3), (5, 6, 0.1))
    s = rows("unit int, size int", *((n, 1) for n in range(1, 8)))
    out = {r["unit"]: r["component"] for r in graph.constrained(e, s, 3, rows("a int, b int", (5, 6))).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
