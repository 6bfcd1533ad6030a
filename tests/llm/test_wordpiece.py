"""Token counts against plain greedy longest match."""
import re

from hypothesis import given, settings, strategies as st

from resolvr.llm import queries, wordpiece

FIRST, LATER = ["a", "ab", "abc", "b", "abcdx", "é"], ["a", "b", "c", "bc", "cd", "d", "é", "abca"]


def greedy(word, first, later):
    n, at, pieces = 0, 0, first
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        n, at, pieces = n + 1, end, later
    return n


@settings(max_examples=500)
@given(st.text("abcdxé", min_size=1, max_size=14))
def test_small_vocabulary(word):
    assert wordpiece.Automaton(FIRST, LATER).count(word) == greedy(word, set(FIRST), set(LATER))


def test_documents(documents, rows):
    first, later = wordpiece.byte_level_pieces(queries.tokenizer_json())
    a, b, want = set(first), set(later), {}
    for r in rows:
        n = [greedy(w, a, b) for w in re.findall(r"[^\W_]+|[^\w\s]|_", r["text"])]
        want[r["doc_id"]] = (len(n), sum(x or 1 for x in n), n.count(0))
    got = wordpiece.token_counts(documents, first, later, carry=["doc_id"]).collect()
    assert {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in got} == want


def test_edge_rows(edge, nothing):
    got = wordpiece.token_counts(edge, FIRST, LATER)
    assert got.columns.count("n_words") == 1 and got.count() == 11
    by = {r.doc_id: r for r in got.collect()}
    assert (by[1].n_words, by[2].n_tokens, by[4].n_tokens) == (0, 0, 6)
    assert wordpiece.token_counts(nothing, FIRST, LATER).count() == 0
