"""Main text of HTML pages with a tree-structured graphical model.

A page becomes a tree of block elements. Each has a hidden state, content or
not; its own features (tag, names in class and id, link share, length) give a
unary potential, and each parent-child edge a 2 x 2 potential. One pass of
sum-product messages from the leaves to the root and one back give exact
marginals; text of blocks whose marginal is above one half is kept.

The potentials are trained on labelled pages: unary weights by logistic
regression, edge potentials by counting. ``labelled`` makes labels from pages
whose markup names its article; any DataFrame of pages can be passed.
"""

from __future__ import annotations

import html as _html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the model is fitted on, taken by the smallest hash of the page.
TRAIN_PAGES = 200

# HTML element kinds and names that pages give to their parts.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr img".split())
# Formulas and drawings are part of the line they stand in; their parts make no elements of the tree.
INLINE |= frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup "
    "msubsup munder mover munderover mmultiscripts mprescripts none mtable maction semantics annotation annotation-xml "
    "svg g defs symbol use switch path rect circle ellipse line polyline polygon tspan textpath image marker pattern "
    "mask clippath lineargradient radialgradient stop filter view metadata animate animatemotion animatetransform mpath "
    "set feblend fecolormatrix fecomponenttransfer fecomposite feconvolvematrix fediffuselighting fedisplacementmap "
    "fedistantlight fedropshadow feflood fefunca fefuncb fefuncg fefuncr fegaussianblur feimage femerge femergenode "
    "femorphology feoffset fepointlight fespecularlighting fespotlight fetile feturbulence".split())
#: Tags that end a line of text and make no element: rows and cells of formulas, labels of drawings.
LINES = frozenset("mtr mlabeledtr mtd text desc foreignobject".split())
#: Elements with text for those who cannot see the rest. HTML lets them stand inside a paragraph; they are elements of
#: the tree where they have names, else their text is that of the element around them.
EMBEDDED = frozenset("noscript object video audio canvas iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title select button".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog fieldset head".split())
ARTICLE_TAGS = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_TAGS = frozenset("p blockquote pre dd figure".split())
LIST_TAGS = frozenset("ul ol li dl dt table tr td th tbody thead".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disqus footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter "
    "notice notices overlay pager pagination popup promo promoted promotion related reply replies respond share "
    "sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())
ARTICLE_NAMES = frozenset("article body content entry main post story text".split())
#: What names end with that say where or how a part stands, not what it is.
PLACE_NAMES = frozenset("area bar block bottom box buttons container group holder inner item items left links list outer "
                        "panel posts right row section slot top unit wrap wrapper".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
                  r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?<![^\s"'/])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Attributes that hide an element, and what their value has to be like.
_HIDDEN = {"hidden": re.compile(r"(?!false|until)", re.I), "aria-hidden": re.compile(r"true", re.I),
           "style": re.compile(r"(?:[^;]*;)*?\s*display\s*:\s*none\b", re.I)}
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
#: Start tags that end an open element of these kinds, up to one of the fences.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
           "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
           "th": (("td", "th"), ("tr", "table")), "tbody": (("tr", "td", "th", "thead"), ("table",))}


def hidden(attributes: str) -> bool:
    """Whether a start tag's attributes hide its element: by their names, not
    by words inside the value of a class or another attribute."""
    return any(name.lower() in _HIDDEN and _HIDDEN[name.lower()].match(value.strip("\"' \t\n\f\r"))
               for name, value in _ATTRIBUTE.findall(attributes))


def roles(attributes: str) -> frozenset[str]:
    """What the names in class, id and role say a part is: the last word of
    each that names no place, so ``comment-list`` is ``comment``, and
    ``legal-history`` is ``history`` and no legal notice."""
    out = set()
    for value in _NAMES.findall(attributes):
        for name in value.strip("\"'").split():
            words = [w.lower() for w in _PART.findall(name)]
            while len(words) > 1 and words[-1] in PLACE_NAMES:
                words.pop()
            out.update(words[-1:])
    return frozenset(out)


class Page:
    """Block elements in page order: ``parent`` (-1 for the root), ``tags``,
    ``names``; ``blocks`` are (element, text, characters inside links)."""

    def __init__(self, source: str):
        self.parent, self.tags, self.names, self.blocks = [-1], ["#root"], [frozenset()], []
        self._stack, self._text, self._linked, self._link = [0], [], 0, False
        at, end = 0, len(source)
        while at < end:
            m = _TAG.search(source, at)
            if m is None:
                self._add(source[at:])
                break
            if m.start() > at:
                self._add(source[at:m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, closing = tag.lower(), bool(m[1] or m[4])
            attributes = m[3] if m[2] else m[6]
            if closing:
                self._close(tag)
            elif tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                if not attributes.endswith("/") or tag in ("script", "style", "title"):
                    at = stop.end() if stop else (end if tag in ("script", "style", "textarea") else at)
            else:
                self._open(tag, attributes)
        self._flush()

    def _add(self, text: str) -> None:
        if "&" in text:  # a reference ends where its run of text ends
            text = _html.unescape(text)
        self._text.append(text)
        if self._link:
            self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[-1], text, self._linked))
        self._text, self._linked = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            self._link = self._link or tag == "a"
            return
        self._flush()
        if tag in VOID or tag in LINES:
            return
        names = roles(attributes) if attributes else frozenset()
        if attributes and hidden(attributes):
            names |= {"overlay"}
        if tag in EMBEDDED and (not names or attributes.endswith("/")):
            return
        self._link = False
        tags, stack = self.tags, self._stack
        if tags[stack[-1]] == "p" and tag not in EMBEDDED or tag in HEADINGS and tags[stack[-1]] in HEADINGS:
            stack.pop()
        if tag in _CLOSES:
            ends, fences = _CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in fences:
                    break
                if tags[stack[k]] in ends:
                    del stack[k:]
                    if tag not in ("tr", "tbody"):
                        break
        self.parent.append(stack[-1])
        stack.append(len(tags))
        tags.append(tag)
        self.names.append(names)

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            self._link = self._link and tag != "a"
            return
        self._flush()
        if tag == "br":
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self.tags[self._stack[k]] == tag:
                del self._stack[k:]
                return


FEATURES = 22
#: Characters of unlinked text that count as prose.
PROSE = 40


def features(page: Page) -> list[list[int]]:
    """Indexes of the binary features that hold for each element."""
    n = len(page.tags)
    size, linked, ends = [0] * n, [0] * n, [0] * n
    for e, text, link in page.blocks:
        size[e] += len(text)
        linked[e] += link
        ends[e] += text[-1] in ".!?…:;\"'”»)"
    # prose that an element holds itself or in its children: what stands beside a link tells a menu from a source list
    prose = [size[i] - linked[i] if size[i] - linked[i] >= PROSE else 0 for i in range(n)]
    around = prose[:]
    for i in range(1, n):
        around[page.parent[i]] += prose[i]
    # a boilerplate part, and what is directly or one step inside it, is in no such company
    apart = [t in BOILERPLATE_TAGS or bool(m & BOILERPLATE_NAMES) for t, m in zip(page.tags, page.names)]
    apart = [a or i > 0 and (apart[page.parent[i]] or page.parent[i] > 0 and apart[page.parent[page.parent[i]]])
             for i, a in enumerate(apart)]
    out = []
    for i in range(n):
        tag, names, f = page.tags[i], page.names[i], [0]
        for k, kind in enumerate((ARTICLE_TAGS, BOILERPLATE_TAGS, HEADINGS, TEXT_TAGS, LIST_TAGS), 1):
            if tag in kind:
                f.append(k)
                break
        else:
            f.append(6 if tag in ("html", "body", "#root") else 7)
        if names:
            if names & BOILERPLATE_NAMES:
                f.append(8)
            elif names & ARTICLE_NAMES:
                f.append(9)
        if size[i]:
            f.append(10 if size[i] < 40 else 11 if size[i] < 200 else 12)
            f.append(13 if 2 * linked[i] > size[i] else 14 if linked[i] else 15)
            f.append(16 if ends[i] else 17)
            if 2 * linked[i] > size[i]:
                up = page.parent[i]
                f.append(20 if not apart[i] and up >= 0 and (around[up] or up and around[page.parent[up]]) else 21)
        else:
            f.append(18)
        out.append(f)
    return out


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


class Model:
    """``unary``: a weight for each feature; ``edge[x][y]``: how well a child
    in state y goes with a parent in state x."""

    def __init__(self, unary: list[float], edge: list[list[float]]):
        self.unary, self.edge = unary, edge

    def messages(self, parent: list[int], unary: list[float]) -> tuple[list[float], list[float], list[float]]:
        """Sum-product on log odds. ``up``: evidence for each element from
        its own features and all below it; ``sent``: what its parent gets
        from it; ``both``: its marginal. Parents come before children."""
        (e00, e01), (e10, e11) = self.edge
        up, sent = list(unary), [0.0] * len(unary)

        def ratio(log_odds, a, b, c, d):
            o = math.exp(max(-60.0, min(60.0, log_odds)))
            return math.log((a + b * o) / (c + d * o))

        for i in range(len(up) - 1, 0, -1):
            sent[i] = ratio(up[i], e10, e11, e00, e01)
            up[parent[i]] += sent[i]
        both = up[:]
        for i in range(1, len(up)):
            both[i] = up[i] + ratio(both[parent[i]] - sent[i], e01, e11, e00, e10)
        return up, sent, both

    def marginals(self, page: Page) -> list[float]:
        """Probability of content for each element."""
        u = self.unary
        return [_logistic(x) for x in self.messages(page.parent, [sum(u[k] for k in f) for f in features(page)])[2]]

    def text(self, source: str | None) -> str:
        page = Page(source or "")
        p = self.marginals(page) if page.blocks else []
        return " ".join(text for e, text, _ in page.blocks if p[e] > 0.5)


def labels(page: Page) -> list[int] | None:
    """Content state of each element of a page that marks its article by a
    tag, or else by a name: inside it, and not inside a part that its tag or
    name sets apart. None without an article."""
    marks = [t in ARTICLE_TAGS for t in page.tags]
    if not any(marks):
        marks = [bool(n & ARTICLE_NAMES) and not n & BOILERPLATE_NAMES for n in page.names]
    if not any(marks):
        return None
    out = [0]
    for i in range(1, len(page.tags)):
        apart = page.tags[i] in BOILERPLATE_TAGS or bool(page.names[i] & BOILERPLATE_NAMES)
        out.append(int(not apart and (marks[i] or out[page.parent[i]] == 1)))
    return out


#: Labelled examples of parts that an article can hold besides its text, so
#: that every feature has evidence; (html of the part, whether it is content).
_PARTS = [("<p>A sentence of the text.</p>", 1), ("<h2>A heading</h2>", 1), ("<ul><li>An item of a list.</li></ul>", 1),
          ("<blockquote>A quotation of some length, as texts have them.</blockquote>", 1),
          ("<div>Text without a paragraph.</div>", 1), ("<p>Words only</p>", 1), ("<p>Words with <a href=/>a link</a> in</p>", 1),
          ("<table><tr><td>A cell</td></tr></table>", 1), ("<pre>x = 1</pre>", 1), ("<dl><dt>Term</dt><dd>Meaning</dd></dl>", 1), ("<div class=content><p>More of the text.</p></div>", 1),
          ("<h2>Sources</h2><ul><li><a href=/>The first source</a></li><li><a href=/>The second one</a></li></ul>", 1),
          ("<p><a href=/>See the full report</a></p>", 1), ("<table><tr><td><a href=/>A row</a></td><td>7</td></tr></table>", 1),
          ("<div><a href=/>A picture of it</a></div>", 1), ("<ol><li><a href=/>A step of many, told elsewhere.</a></li></ol>", 1),
          ("<nav><ul><li><a href=/>Home</a></li></ul></nav>", 0), ("<nav><a href=/>Next page</a><p><a href=/>All news.</a></p></nav>", 0),
          ("<div class=menu><ul><li><a href=/>Home</a></li><li><a href=/>About us</a></li></ul></div>", 0),
          ("<div role=navigation><a href=/>Older</a></div>", 0), ("<div hidden><p>Not shown.</p></div>", 0),
          ("<div hidden>Not shown</div>", 0), ("<object class=ad><p>Buy now.</p></object>", 0), ("<aside><p>Read on.</p></aside>", 0),
          ("<div class=ad>Buy now.</div>", 0), ("<div class=comments><p>I agree with every word.</p></div>", 0),
          ("<form><p>Your name</p></form>", 0), ("<div class=cookie-notice><p>We use cookies here.</p></div>", 0),
          ("<header><p>The site</p></header>", 0), ("<footer><p>All rights reserved.</p></footer>", 0),
          ("<div class=sidebar><ul><li><a href=/>More</a></li></ul></div>", 0)]


def examples() -> list[str]:
    """Small labelled pages made of ``_PARTS``, inside and outside an article
    (``labels`` reads their labels)."""
    prose = "<p>A paragraph of the article that is long enough to be prose, and then some more of it.</p>"
    own = prose + prose.join(h for h, c in _PARTS if c) + prose
    apart = "".join(h for h, c in _PARTS if not c)
    whole = [f"<body>{apart}<article>{own}{apart}{own}</article>{apart}</body>",
             f"<body>{apart}<main><div>{own}</div>{apart}</main></body>",
             f"<body>{apart}<div id=main-content>{own}{apart}</div>{apart}</body>",
             f"<body>{apart}<div class=post>{own}</div>{apart}</body>"]
    frames = ["article", "main", "div class=content", "div id=main-text", "section class=post"]
    single = [f"<{tag}>{prose if '<a' in h else ''}{h * n}</{tag.split()[0]}>" for h, c in _PARTS if c for tag in frames
              for n in (1, 3)]
    single += [f"<{tag}><p>First of it.</p>{h}<p>Last of it.</p></{tag.split()[0]}>" for h, c in _PARTS if not c for tag in frames]
    menu = "<ul><li><a href=/>Home</a></li><li><a href=/>About</a></li></ul>"  # outside the article, without a name
    return whole + single + [f"<body>{x}{apart}</body>" for x in single] + [f"<body>{menu}{x}<div>{menu}</div></body>" for x in single]


def train(sources: list[str], rounds: int = 60, rate: float = 0.4, ridge: float = 0.02) -> Model:
    """All potentials by maximum likelihood: the gradient is what the labels
    have of each feature and each parent-child pair of states, less what the
    sum-product marginals expect (Adam steps, ridge). Pages with the same
    tree count as one with a weight."""
    trees: dict[tuple, int] = {}
    for page in map(Page, [*sources, *examples() * max(1, len(sources) // 20)]):
        y = labels(page)
        if y:
            tree = (tuple(page.parent), tuple(map(tuple, features(page))), tuple(y))
            trees[tree] = trees.get(tree, 0) + 1
    w = np.zeros(FEATURES + 4)  # the last four: log edge potentials 00, 01, 10, 11
    first, second, total = np.zeros_like(w), np.zeros_like(w), sum(len(t[2]) * c for t, c in trees.items())
    for step in range(1, rounds + 1):
        u, e = w[:FEATURES].tolist(), np.exp(w[FEATURES:]).tolist()
        model, grad = Model(u, [e[:2], e[2:]]), [0.0] * len(w)
        for (parent, feats, y), count in trees.items():
            up, sent, both = model.messages(parent, [sum(u[k] for k in f) for f in feats])
            for i, f in enumerate(feats):
                d = count * (y[i] - _logistic(both[i]))
                for k in f:
                    grad[k] += d
                if i:
                    p = math.exp(max(-60.0, min(60.0, both[parent[i]] - sent[i])))
                    c = math.exp(max(-60.0, min(60.0, up[i])))
                    pair = (e[0], e[1] * c, e[2] * p, e[3] * p * c)
                    z = count / sum(pair)
                    for k in range(4):
                        grad[FEATURES + k] -= z * pair[k]
                    grad[FEATURES + 2 * y[parent[i]] + y[i]] += count
        g = np.array(grad) / max(1, total) * 100 - ridge * w
        first, second = 0.8 * first + 0.2 * g, 0.95 * second + 0.05 * g * g
        w += rate * (1 - 0.9 * step / rounds) * (first / (1 - 0.8 ** step)) / (np.sqrt(second / (1 - 0.95 ** step)) + 1e-6)
    return Model(w[:FEATURES].tolist(), np.exp(w[FEATURES:]).reshape(2, 2).tolist())


def training_pages(pages: DataFrame, html_col: str = "html", limit: int = TRAIN_PAGES) -> list[str]:
    """At most ``limit`` pages of at most 100,000 characters that mark an
    article, the same for any order and partitioning of the table."""
    source = F.col(f"`{html_col}`")
    hashed = pages.select(F.xxhash64(source).alias("h"), source.alias("html")) \
        .where((F.length("html") <= 100_000) & F.col("html").rlike("(?i)<(article|main)[ >]"))
    # the hashes alone choose the pages, so no task sends pages that are not used
    last = hashed.select("h").orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    if last is None:
        return []
    return [r["html"] for r in hashed.where(F.col("h") <= last).distinct().orderBy("h", "html").limit(limit).collect()]


def main_text(pages: DataFrame, model: Model | None = None, html_col: str = "html", keep=("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` of every page, whole.

    A null or empty page, and one without content, gives an empty text; very
    long pages are read whole. Without a model one is trained on
    ``training_pages``. Repeated pages are handled one by one; columns of ``pages``
    that are not in ``keep`` are not read, so their names cannot clash."""
    model = model or train(training_pages(pages, html_col))
    shared = pages.sparkSession.sparkContext.broadcast((model.unary, model.edge))
    work = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("_html"))

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            texts = [m.text(h) for h in batch["_html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in keep], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [*keep, "text", "n_chars"])

    types = dict(work.dtypes)
    fields = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return work.mapInArrow(run, f"{fields}, text string, n_chars bigint")
