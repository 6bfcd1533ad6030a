"""Token counts by linear longest-match.

The pieces of a vocabulary form one trie with two roots: the start of a word
and the place behind a piece. Every node has a failure link to where matching
goes on when no child fits, and the number of pieces that are popped on the way.
A word is read once, left to right, and its number of greedy longest-match
pieces is the sum of the popped counts; no piece is ever built.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, handed_through
from .packing import byte_of_char

_WORDS = re.compile(r"[^\W_]+|[^\w\s]|_")
_WORD_START, _BEHIND = 0, 1


class Automaton:
    """``children``, ``fail`` and ``popped`` by node; nodes 0 and 1 are the
    roots. ``first`` are pieces that begin a word, ``later`` pieces that go on."""

    def __init__(self, first, later):
        self.children: list[dict] = [{}, {}]
        piece = [False, False]
        for root, pieces in ((_WORD_START, first), (_BEHIND, later)):
            for p in pieces:
                node = root
                for c in p:
                    nxt = self.children[node].get(c)
                    if nxt is None:
                        nxt = self.children[node][c] = len(self.children)
                        self.children.append({})
                        piece.append(False)
                    node = nxt
                if p:
                    piece[node] = True
        n = len(self.children)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque([_WORD_START, _BEHIND])
        while queue:
            u = queue.popleft()
            for c, v in self.children[u].items():
                queue.append(v)
                if piece[v]:
                    self.fail[v], self.popped[v] = _BEHIND, 1
                    continue
                z, count = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.children[z]:
                    count += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.children[z][c], count

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if greedy matching cannot cover it."""
        children, fail, popped = self.children, self.fail, self.popped
        u, n = _WORD_START, 0
        for c in word:
            while c not in children[u]:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 0
            u = children[u][c]
        while u != _BEHIND:
            n += popped[u]
            u = fail[u]
            if u < 0:
                return 0
        return n


def byte_level_pieces(tokenizer_json: str) -> tuple[list[str], list[str]]:
    """Pieces from a byte-level vocabulary: those with a leading space begin
    a word, the others go on. Tokens that are not whole characters are left
    out, and so are those with white space inside."""
    byte, first, later = byte_of_char(), [], []
    for token in json.loads(tokenizer_json)["model"]["vocab"]:
        try:
            text = bytes(byte[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        word = text.removeprefix(" ")
        if word and not any(c.isspace() for c in word):
            (first if text != word else later).append(word)
    return first, later


_AUTOMATA: dict[int, Automaton] = {}


def _automaton(key: int, first: list[str], later: list[str]) -> Automaton:
    """One per Python worker and vocabulary: building it takes half a second."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = Automaton(first, later)
    return _AUTOMATA[key]


def token_counts(docs: DataFrame, first: list[str], later: list[str], text_col: str = "text",
                 carry: list[str] | None = None, memo: int = 300_000) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) and ``n_words,
    n_tokens, n_unknown`` of every whole text; columns of these names are
    replaced.

    Words are runs of letters and digits; every other character but white
    space is a word. A word that the pieces cannot cover counts as one token
    and one unknown. Null and empty texts have zeros, repeated rows are counted
    one by one, an empty table gives no rows."""
    work, names, schema, named = handed_through(docs, text_col, carry, "n_words bigint, n_tokens bigint, n_unknown bigint")
    shared = docs.sparkSession.sparkContext.broadcast(
        (zlib.crc32("\n".join([*first, "", *later]).encode()), first, later))  # a vocabulary: a few MB

    def run(batches):
        automaton, known = _automaton(*shared.value), {}
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                words = tokens = unknown = 0
                for part in _parts(text or ""):
                    for w, k in Counter(_WORDS.findall(part)).items():
                        n = known.get(w)
                        if n is None:
                            if len(known) >= memo:
                                known.clear()
                            n = known[w] = automaton.count(w)
                        words += k
                        tokens += k * (n or 1)
                        unknown += k * (n == 0)
                out.append((words, tokens, unknown))
            cols = [pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names.values()], *cols], schema.names)

    return named(work.mapInArrow(run, schema))


def _parts(text: str, limit: int = SLICE_BYTES):
    """A long text in parts that end at white space (or where a stretch of
    ``limit`` characters has none, at its next character that is)."""
    at = 0
    while at < len(text):
        end = at + limit
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end
