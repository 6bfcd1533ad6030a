"""Personal data: pattern spans, and spans added by a character-level
bidirectional LSTM with CRF transitions.

The pattern spans (the base) always stay. The network is trained in numpy from
labelled spans: windows of a bounded sample of documents around base spans,
with copies in which a second labelled span is put right behind the first (the
base drops such runs, since its patterns swallow both). Every text is read in
overlapping windows; each character takes its tag from the window in whose
middle part it lies, and spans are read off the stitched tags of the whole
text, so a span may cross windows. An added span must hold as its kind by the
same exact checks, and must not touch a base span.

A valid span holds an ``@`` or at least four digits in one of four shapes, so
windows that meet no such shape cannot yield one and are left undecoded.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, handed_through

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the training sample: documents read, windows kept.
TRAIN_DOCS, TRAIN_WINDOWS = 6000, 1500
STEP, MARGIN = 64, 16
WINDOW = STEP + 2 * MARGIN

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_CARD_SHAPE = re.compile(r"[0-9](?:[ -]?[0-9]){15}")


def shapes(text: str):
    """(start, end) of the shapes one of which every valid span holds: an
    ``@``, a ``+`` before a digit, 16 digits, four dotted numbers."""
    for mark in "@+":
        at = text.find(mark)
        while at >= 0:
            if mark == "@" or text[at + 1:at + 2].isdigit():
                yield at, at + 2
            at = text.find(mark, at + 1)
    if _DIGIT.search(text):
        for pattern in (_CARD_SHAPE, _IP):
            yield from (m.span() for m in pattern.finditer(text))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _valid(kind: int, s: str) -> bool:
    if kind == 0:
        return True
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    digits = "".join(_DIGIT.findall(s))
    return 16 <= len(digits) <= 19 and _luhn(digits) if kind == 2 else 8 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches that hold, leftmost and not
    overlapping per kind; a match that fails its check is not tried again."""
    if not text:
        return []
    out = [(0, s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m[0])]
    return out


def _whole(kind: int, s: str) -> bool:
    """Is ``s`` as a whole a span of this kind?"""
    if kind == 0:
        local, _, domain = s.partition("@")
        return bool(local) and set(local) <= _LOCAL and bool(_DOMAIN.fullmatch(domain))
    return bool((_IP, _CARD, _PHONE)[kind - 1].fullmatch(s)) and _valid(kind, s)


# --- characters and windows -------------------------------------------------

_VOCABULARY = 20


def _classes() -> np.ndarray:
    table = np.full(128, 1, np.int64)
    table[ord("a"):ord("z") + 1], table[ord("A"):ord("Z") + 1], table[ord("0"):ord("9") + 1] = 2, 3, 4
    for k, c in enumerate("@.-+() _%:#|=\"\n", 5):
        table[ord(c)] = k
    return np.minimum(table, _VOCABULARY - 1)


_CLASS = _classes()


def encoded(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(c < 128, _CLASS[np.minimum(c, 127)], 2)


def window_numbers(text: str) -> list[int]:
    """Windows whose middle part lies near a shape that a span can have."""
    out: set[int] = set()
    for a, b in shapes(text):
        out.update(range(max(0, a - WINDOW) // STEP, (b + WINDOW) // STEP + 1))
    last = (len(text) - 1) // STEP
    return sorted(n for n in out if n <= last)


def window(codes: np.ndarray, number: int) -> np.ndarray:
    """Characters of window ``number``; 0 beyond the text."""
    a = number * STEP - MARGIN
    part = codes[max(a, 0):a + WINDOW]
    out = np.zeros(WINDOW, np.int64)
    out[max(0, -a):max(0, -a) + len(part)] = part
    return out


# --- the network ------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # 0 outside, 1 + 2k begins kind k, 2 + 2k goes on
_FORBIDDEN = np.zeros((TAGS, TAGS), np.float32)
for _k in range(len(KINDS)):
    _FORBIDDEN[[t for t in range(TAGS) if t not in (1 + 2 * _k, 2 + 2 * _k)], 2 + 2 * _k] = -1e4


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Embedding, one LSTM per direction (both run in one batch), a linear
    layer to the tags, and CRF transitions."""

    def __init__(self, hidden: int = 16, width: int = 10, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.hidden = hidden
        self.p = {"embed": init(_VOCABULARY, width, scale=0.3), "wx": init(2, width, 4 * hidden, scale=width ** -0.5),
                  "wh": init(2, hidden, 4 * hidden, scale=hidden ** -0.5), "b": np.zeros((2, 1, 4 * hidden), np.float32),
                  "out": init(2 * hidden, TAGS, scale=(2 * hidden) ** -0.5), "bias": np.zeros(TAGS, np.float32),
                  "move": np.zeros((TAGS, TAGS), np.float32), "begin": np.zeros(TAGS, np.float32)}
        self.p["b"][:, :, hidden:2 * hidden] = 1

    def _forward(self, x: np.ndarray):
        p, n, t, h = self.p, len(x), x.shape[1], self.hidden
        both = np.stack([x, x[:, ::-1]])
        inputs = np.einsum("dvw,dwg->dvg", np.broadcast_to(p["embed"], (2, *p["embed"].shape)), p["wx"]) + p["b"]
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        states, kept, d = np.zeros((t, 2, n, h), np.float32), [], np.arange(2)[:, None]
        for k in range(t):
            g = inputs[d, both[:, :, k]] + state @ p["wh"]
            g[..., :3 * h] = _sigmoid(g[..., :3 * h])
            g[..., 3 * h:] = np.tanh(g[..., 3 * h:])
            before = cell
            cell = g[..., h:2 * h] * before + g[..., :h] * g[..., 3 * h:]
            squashed = np.tanh(cell)
            kept.append((g, before, squashed, state))
            state = g[..., 2 * h:3 * h] * squashed
            states[k] = state
        top = np.concatenate([states[:, 0], states[::-1, 1]], -1)
        return top @ p["out"] + p["bias"], top, kept, both

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of tag rows ``y`` and its gradients."""
        p, h, (n, t) = self.p, self.hidden, x.shape
        emit, top, kept, both = self._forward(x)
        move = p["move"] + _FORBIDDEN
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0] + p["begin"]
        for k in range(1, t):
            alpha[k] = _lse(alpha[k - 1][:, :, None] + move, 1) + emit[k]
        for k in range(t - 2, -1, -1):
            beta[k] = _lse(move + (emit[k + 1] + beta[k + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        rows, yt = np.arange(n), y.T
        gold = p["begin"][yt[0]] + emit[np.arange(t)[:, None], rows, yt].sum(0) + move[yt[:-1], yt[1:]].sum(0)
        demit = np.exp(alpha + beta - z[:, None])
        grad = {"begin": (demit[0].sum(0) - np.bincount(yt[0], minlength=TAGS)) / n}
        pair = np.zeros((TAGS, TAGS))
        for k in range(1, t):
            pair += np.exp(alpha[k - 1][:, :, None] + move + (emit[k] + beta[k])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(pair, (yt[:-1].ravel(), yt[1:].ravel()), -1)
        grad["move"] = pair / n
        demit[np.arange(t)[:, None], rows, yt] -= 1
        demit /= n
        grad["out"], grad["bias"] = np.einsum("tnh,tng->hg", top, demit), demit.sum((0, 1))
        dtop = demit @ p["out"].T
        dstates = np.stack([dtop[..., :h], dtop[::-1, :, h:]], 1)
        grad["wh"], dinputs = np.zeros_like(p["wh"]), np.zeros((2, _VOCABULARY, 4 * h), np.float32)
        dstate, dcell, d = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32), np.arange(2)[:, None]
        for k in range(t - 1, -1, -1):
            g, before, squashed, state = kept[k]
            i, f, o, c = (g[..., a * h:(a + 1) * h] for a in range(4))
            ds = dstates[k] + dstate
            dc = dcell + ds * o * (1 - squashed ** 2)
            dg = np.concatenate([dc * c * i * (1 - i), dc * before * f * (1 - f), ds * squashed * o * (1 - o),
                                 dc * i * (1 - c ** 2)], -1)
            grad["wh"] += np.einsum("dnh,dng->dhg", state, dg)
            np.add.at(dinputs, (d, both[:, :, k]), dg)
            dstate, dcell = dg @ p["wh"].transpose(0, 2, 1), dc * f
        grad["wx"] = np.einsum("vw,dvg->dwg", p["embed"], dinputs)
        grad["embed"] = np.einsum("dvg,dwg->vw", dinputs, p["wx"])
        grad["b"] = dinputs.sum(1, keepdims=True)
        return float((z - gold).mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.02, seed: int = 7):
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        total = max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), batch):
                step += 1
                _, grad = self.gradients(x[order[a:a + batch]], y[order[a:a + batch]])
                norm = np.sqrt(sum(float((g ** 2).sum()) for g in grad.values()))
                now = rate * (1 - 0.95 * step / total)
                for k, g in grad.items():
                    g = g * min(1.0, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9 ** step))
                                 / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag row of each window (Viterbi)."""
        emit = self._forward(x)[0]
        move, t = self.p["move"] + _FORBIDDEN, len(emit)
        score, back = emit[0] + self.p["begin"] + np.concatenate([[0], np.tile([0, -1e4], len(KINDS))]), []
        for k in range(1, t):
            s = score[:, :, None] + move
            back.append(s.argmax(1))
            score = s.max(1) + emit[k]
        out = np.zeros((t, len(x)), np.int64)
        out[-1] = score.argmax(1)
        rows = np.arange(len(x))
        for k in range(t - 2, -1, -1):
            out[k] = back[k][rows, out[k + 1]]
        return out.T


# --- training ---------------------------------------------------------------

def _labelled(text: str) -> list[str]:
    """Stretches of a text around its shapes, without those whose runs the
    base could not settle (a shape outside every base span)."""
    spans, out = base_spans(text), []
    for a, b in shapes(text):
        if any(s <= a < e for _, s, e in spans):
            out.append(text[max(0, a - 60):b + 60])
    return out


def _examples(stretches: list[str], seed: int = 7):
    """Windows with tags; every other stretch gets a copy with a second
    labelled span behind its first one."""
    r = np.random.default_rng(seed)
    own = [(s, base_spans(s)) for s in stretches]
    own = [(s, b) for s, b in own if b]
    pool = [(k, s[a:e]) for s, b in own for k, a, e in b]
    xs, ys = [], []

    def add(text, spans):
        codes, tags = encoded(text), np.zeros(len(text), np.int64)
        for k, a, e in spans:
            tags[a:e] = 2 + 2 * k
            tags[a] = 1 + 2 * k
        shift = int(r.integers(0, max(1, len(text) - WINDOW // 2)))
        x, y = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
        n = min(WINDOW, len(text) - shift)
        x[:n], y[:n] = codes[shift:shift + n], tags[shift:shift + n]
        if y[0] and y[0] % 2 == 0 and shift:
            y[0] -= 1  # a span that the window cuts still begins with a beginning tag
        xs.append(x)
        ys.append(y)

    for n, (text, spans) in enumerate(own):
        add(text, spans)
        if n % 2 == 0:
            k, s = pool[int(r.integers(len(pool)))]
            first, gap = spans[0], " " if r.random() < 0.8 else "; "
            cut = first[2]
            moved = [(q, a, e) if e <= cut else (q, a + len(gap + s), e + len(gap + s)) for q, a, e in spans]
            add(text[:cut] + gap + s + text[cut:], [*moved, (k, cut + len(gap), cut + len(gap) + len(s))])
        # the same text without its spans
        bare = text
        for _, a, e in sorted(spans, key=lambda x: -x[1]):
            bare = bare[:a] + bare[e:]
        if n % 3 == 0 and not base_spans(bare):
            add(bare, [])
    return np.array(xs).reshape(-1, WINDOW), np.array(ys).reshape(-1, WINDOW)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS,
          train_windows: int = TRAIN_WINDOWS, epochs: int = 10) -> Tagger | None:
    """A tagger from the labelled spans of at most ``train_docs`` documents
    (those with the smallest hash of their id) and ``train_windows`` windows;
    None if they hold no span."""
    ids = F.col(f"`{id_col}`")
    chosen = docs.select(F.xxhash64(ids).alias("h")).where(ids.isNotNull()).orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]
    if chosen is None:
        return None

    def stretches(batches):
        for batch in cut(batches):
            out = [s for t in batch["text"].to_pylist() if t for s in _labelled(t)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["s"])

    found = docs.where(F.xxhash64(ids) <= chosen).select(F.col(f"`{text_col}`").alias("text")).mapInArrow(stretches, "s string")
    rows = found.distinct().orderBy(F.xxhash64("s"), "s").limit(train_windows).collect()
    x, y = _examples([r["s"] for r in rows])
    return Tagger().fit(x, y, epochs) if len(x) else None


# --- applying ---------------------------------------------------------------

def _runs(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the runs of stitched tags."""
    out, at = [], np.flatnonzero(tags)
    k = 0
    while k < len(at):
        begin, kind, end = int(at[k]), (int(tags[at[k]]) - 1) // 2, int(at[k]) + 1
        k += 1
        while k < len(at) and at[k] == end and tags[end] == 2 + 2 * kind:
            end, k = end + 1, k + 1
        out.append((kind, begin, end))
    return out


def added_spans(texts: list[str | None], base: list[list], tagger: Tagger, batch: int = 1024) -> list[list]:
    """What the tagger adds to the base spans of each text."""
    todo, codes = [], {}
    for i, t in enumerate(texts):
        if t and (numbers := window_numbers(t)):
            codes[i] = encoded(t)
            todo += [(i, n) for n in numbers]
    tags: dict[int, np.ndarray] = {}
    for a in range(0, len(todo), batch):
        part = todo[a:a + batch]
        got = tagger.decode(np.stack([window(codes[i], n) for i, n in part]))[:, MARGIN:MARGIN + STEP]
        for (i, n), row in zip(part, got):
            whole = tags.setdefault(i, np.zeros(len(codes[i]), np.int8))
            whole[n * STEP:(n + 1) * STEP] = row[:len(whole) - n * STEP]
    out = [[] for _ in texts]
    for i, whole in tags.items():
        taken = sorted((s, e) for _, s, e in base[i])
        for kind, s, e in _runs(whole):
            if _whole(kind, texts[i][s:e]) and not any(s < b and a < e for a, b in taken):
                out[i].append((kind, s, e))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def redacted(text: str, spans) -> str:
    """Each span (of overlapping ones their union) as its kind in brackets."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


RESULT = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def find(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", carry: list[str] | None = None,
         tagger: Tagger | str | None = "train", redact: bool = False) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default), the counts of base
    spans per kind, ``base_sha256``, and ``spans`` (base and added); with
    ``redact`` the text column has its spans replaced.

    Spans count code points. Null and empty texts have no spans (a null text
    stays null). ``tagger`` None keeps to the base. Columns of ``docs`` with
    the result's names, in any case, are replaced; texts are read whole; repeated
    rows are searched one by one. A table whose ids are all null trains no
    tagger and keeps to the base, too."""
    if tagger == "train":
        tagger = train(docs, id_col, text_col)
    work, names, schema, named = handed_through(docs, text_col, carry, RESULT)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches):
        model = shared.value
        for batch in cut(batches):
            texts = batch["text"].to_pylist()
            base = [base_spans(t) for t in texts]
            spans = [b + a for b, a in zip(base, added_spans(texts, base, model))] if model else base
            counts = [pa.array([sum(k == n for k, _, _ in b) for b in base], pa.int64()) for n in range(len(KINDS))]
            digest = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            kept = {c: batch[c] for c in names.values()}
            if redact and text_col in names:
                kept[names[text_col]] = pa.array([redacted(t, s) if s else t for t, s in zip(texts, spans)], pa.string())
            yield pa.RecordBatch.from_arrays([*kept.values(), *counts, pa.array(digest), pa.array(map(joined, spans), pa.string())],
                                             schema.names)

    return named(work.mapInArrow(run, schema))
