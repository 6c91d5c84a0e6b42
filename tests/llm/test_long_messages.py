"""Messages of the site are found at any length."""

import pytest

residue = pytest.importorskip("gavel.llm.residue")


def test_long_messages_are_cases(rows):
    trace = "Traceback (most recent call last):\n" + "".join(f'  File "/srv/app/m{n}.py", line {n}, in run\n' for n in range(60))
    html = "<html><head><title>502 Bad Gateway</title></head><body>" + "<p>nginx</p>" * 120 + "</body></html>"
    menu = "".join(f"Home | Debates {n} | Members\n" for n in range(60))
    speech = "Sir, the session ended in error. " * 60
    t = rows("id bigint, t string", (1, trace), (2, html), (3, menu + "Access denied"), (4, speech), (5, "Access denied"), (6, None))
    assert min(len(x) for x in (trace, html, menu, speech)) > 1_000
    assert sorted((r["id"], r["reason"]) for r in residue.residue(t, "id", "t").collect()) == [(1, "message"), (2, "message"), (3, "message"), (5, "message")]
