"""Base spans against plain patterns, the network's gradients and what it
adds, windows, redaction."""
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from resolvr.llm import pii

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    out = []
    for kind, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else 0,
                  16 <= len(d) <= 19 and luhn(d), 8 <= len(d) <= 15)[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", ".", "@", "b-c", "+", "12", "0", "255", "256", " ", "(", ")", "-", "é", "4111111111111111",
                                 "5500 0000 0000 0004", "+1 555 0100 99", "1.2.3.4", "x@y.z", "%"]), max_size=14).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_documents(spark, documents, rows):
    got = {r.doc_id: r for r in pii.find(documents, carry=["doc_id"]).collect()}
    for r in rows:
        base, g = plain(r["text"]), got[r["doc_id"]]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == n for k, _, _ in base) for n in range(4)]
        assert set(pii.joined(base).split(",")) <= set(g.spans.split(","))


def test_gradients():
    r = np.random.default_rng(0)
    t = pii.Tagger(hidden=3, width=4)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x, y = r.integers(0, 20, (4, 7)), np.zeros((4, 7), int)
    y[:, 2], y[:, 3], y[1, 5] = 1, 2, 3
    grad = t.gradients(x, y)[1]
    for k in t.p:
        at = tuple(r.integers(0, s) for s in t.p[k].shape)
        old, around = t.p[k][at], []
        for d in (1e-4, -1e-4):
            t.p[k][at] = old + d
            around.append(t.gradients(x, y)[0])
        t.p[k][at] = old
        assert (around[0] - around[1]) / 2e-4 == pytest.approx(np.asarray(grad[k])[at], abs=2e-3)


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_the_network_splits_runs_that_the_base_drops(tagger):
    text = ["the first one is 4111111111111111 5500000000000004 and so on to the end",
            "call +1 (826) 555-4081 190.137.223.204 with the others", "nothing here 12 or there", None, ""]
    base = [pii.base_spans(t or "") for t in text]
    added = pii.added_spans(text, base, tagger)
    found = {text[i][a:b] for i in range(3) for _, a, b in added[i]}
    assert "+1 (826) 555-4081" in found or "4111111111111111" in found
    assert not added[2] and not added[3] and not added[4]
    for t, b, a in zip(text, base, added):
        assert all(pii._whole(k, t[s:e]) for k, s, e in a)
        assert not any(s < v and u < e for _, s, e in a for _, u, v in b)


def test_windows_cover_a_long_text():
    text = "a" * 1000 + " x@y.example " + "b" * 1000
    numbers = pii.window_numbers(text)
    middle = {i for n in numbers for i in range(n * pii.STEP, (n + 1) * pii.STEP)}
    assert set(range(990, 1020)) <= middle and max(numbers) <= (len(text) - 1) // pii.STEP


def test_edge_rows(edge, nothing):
    got = pii.find(edge, redact=True)
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].text == "Mail [EMAIL], call [PHONE] now" and by[1].text is None and by[1].spans == ""
    assert by[3].n_email == 1 and by[3].spans.startswith("email:5:")
    assert len(got.columns) == len(set(got.columns)) and got.count() == 11
    assert pii.find(nothing).count() == 0


def test_redaction_of_overlapping_spans():
    assert pii.redacted("ab 12 34 cd", [(1, 3, 5), (2, 3, 8)]) == "ab [CARD] cd"
