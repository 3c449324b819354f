"""Main-text extraction by a recurrent block labeller (operator 2).

A page is cut into blocks: the text between two tags that are not inline.  Each block is a
vector of its tag path (tag names, class and id words, hashed), its words (hashed) and a few
counts; a bidirectional LSTM in numpy reads the blocks of a page in order and labels each as
main text or not, with the whole page as context.  The text of the main blocks is returned.

Training.  Pages carry no labels.  Blocks of ``TRAIN_PAGES`` pages (chosen by a hash of id
and html) are labelled by what says outright what they are.  Under something of
``BOILERPLATE``: not main.  Inside ``article`` or ``main`` otherwise: main.  On a page that has
neither, prose (sentences of ``PROSE_WORDS`` words or more with few links) and what stands
beside it in its container is main, and blocks full of links, or repeated on other pages of the
sample, are not.  Other blocks have no label
and no loss.  ``COPIES`` copies of each page get blocks of boilerplate put in between, inside
the article too, other wrappers, and on half of them no ``article`` or ``main`` at all; on half
of them the word-list features are blanked, so that the reader must tell by the words, the
shape and the surroundings of a block.  Training runs on the driver, on that bounded sample;
all pages are labelled in tasks.  If the sample has no block that counts as main, nothing is
fitted, and every block that no path word speaks against is text.

Never text, whatever the labeller says: comments, scripts, styles and other raw elements.

Defined results: a null or empty page, or one without a main block, has empty text; broken
markup is read as far as it goes (unclosed tags end with the page); every row is read on its
own; an empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast.llm.common import arrow_rows, private, str_texts

TRAIN_PAGES = 120
#: Blocks of one training page that are read; a longer page gives several sequences.
TRAIN_BLOCKS = 64
COPIES = 2
EPOCHS = 16
HIDDEN = 16
PATH_DIMS, WORD_DIMS = 24, 16

RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "annotation",
       "select", "canvas", "audio", "video", "title")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
                  "source", "track", "wbr"))
#: Tags that do not end a block.
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data",
                    "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp",
                    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
                    # formulas
                    "math", "semantics", "mfrac", "mi", "mn", "mo", "mover", "mpadded", "mphantom", "mroot",
                    "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd",
                    "mtext", "mtr", "munder", "munderover"))
#: Tags that an opening tag closes when they are open (markup without closing tags).
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
          "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset(("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer",
                    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol",
                    "p", "pre", "section", "table", "ul"))

#: Words of tag names, classes and ids.
BOILERPLATE = frozenset(("nav", "menu", "footer", "aside", "sidebar", "form", "button", "label", "ad",
                         "ads", "advert", "adverts", "advertisement", "banner", "promo", "sponsor",
                         "sponsored", "cookie", "consent", "notice", "alert", "popup", "modal",
                         "comment", "comments", "reply", "replies", "disqus", "share", "social",
                         "related", "recommended", "newsletter", "subscribe", "login", "signup",
                         "breadcrumb", "breadcrumbs", "pagination", "pager", "copyright", "legal",
                         "masthead", "toolbar", "widget", "head", "tags", "search", "skip"))
CONTENT = frozenset(("article", "main", "content", "post", "entry", "story", "body", "text"))

#: Fewest words of a block that counts as prose on pages that name no article.
PROSE_WORDS = 10
#: Blocks that are held as vectors at a time.
CELLS = 1 << 14

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PIECES = re.compile(r"[a-z]+")


def _words_of(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the words of its class, id and role."""
    if "=" not in attributes:
        return (tag,)
    named = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower()
    return (tag, *(f".{w}" for w in _PIECES.findall(named)))


class Node:
    """A tag path: its parent and the words of its last tag.  Features are made from the parent's
    when they are first asked for, so a path costs the same however deep it is."""

    __slots__ = ("parent", "words", "below", "_hashed", "_flags")

    def __init__(self, parent: Node | None = None, words: tuple = ()):
        self.parent, self.words, self.below = parent, words, {}
        self._hashed = np.zeros(PATH_DIMS, dtype=np.float32) if parent is None else None
        #: count of words, boilerplate, content word, header, inside, header before the article
        self._flags = (0, False, False, False, False, False) if parent is None else None

    def child(self, words: tuple) -> Node:
        node = self.below.get(words)
        if node is None:
            node = self.below[words] = Node(self, words)
        return node

    def _made(self) -> Node:
        chain, node = [], self
        while node._flags is None:
            chain.append(node)
            node = node.parent
        for node in reversed(chain):
            hashed = node.parent._hashed.copy()
            n, boiler, content, header, inside, late = node.parent._flags
            for w in node.words:
                h = zlib.crc32(w.encode())
                hashed[h % PATH_DIMS] += 1 if h & 0x10000 else -1
                name = w.lstrip(".")
                boiler = boiler or name in BOILERPLATE
                content = content or (n >= 2 and name in CONTENT)
                if name in ("article", "main"):
                    inside, late = True, header
                header = header or name == "header"
                n += 1
            node._hashed, node._flags = hashed, (n, boiler, content, header, inside, late)
        return self

    def features(self) -> np.ndarray:
        """Hashed path words, and whether one is of boilerplate, of content, a header."""
        self._made()
        return np.append(self._hashed, np.array(self._flags[1:4], dtype=np.float32))

    def label(self) -> int:
        """1 main text, 0 not, -1 unknown, by what the path says outright."""
        _, boiler, _, header, inside, late = self._made()._flags
        if boiler or (late if inside else header):
            return 0
        return 1 if inside else -1

    def tags(self) -> list[tuple]:
        """The words of each tag, outermost first."""
        out, node = [], self
        while node.parent is not None:
            out.append(node.words)
            node = node.parent
        return out[::-1]


def path(tags, root: Node) -> Node:
    for words in tags:
        root = root.child(words)
    return root


def blocks_of(page: str | None, root: Node | None = None) -> list[tuple[Node, str, int]]:
    """(path, text, characters in links) of each block with text, in page order.

    Paths hang below ``root``, which pages may share.  White space inside a block is one
    space; character references are decoded after the markup is gone.
    """
    out: list = []
    if not page:
        return out
    stack: list[str] = []
    nodes: list[Node] = [root or Node()]
    still: Counter = Counter()  # open tags by name: a closing tag without one is not looked for
    parts: list[str] = []
    link = [0]
    links_open = 0

    def flush():
        if parts:
            raw = parts[0] if len(parts) == 1 else "".join(parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append((nodes[-1], text, min(link[0], len(text))))
            parts.clear()
            link[0] = 0

    def shut_from(i: int):
        for name in stack[i:]:
            still[name] -= 1
        del stack[i:], nodes[i + 1:]

    pos, size = 0, len(page)
    while pos < size:
        m = _TOKEN.search(page, pos)
        stop = m.start() if m else size
        if stop > pos:
            parts.append(page[pos:stop])
            if links_open:
                link[0] += stop - pos
        if not m:
            break
        pos = m.end()
        tag = m.group(2) or m.group(5)
        if not tag:
            continue
        tag, closing = tag.lower(), m.group(1) or m.group(4)
        attributes = m.group(3) or m.group(6) or ""
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links_open = 0 if closing else 1
            continue
        flush()
        if closing:
            if still[tag]:
                i = len(stack) - 1
                while stack[i] != tag:
                    i -= 1
                shut_from(i)
        else:
            if tag in VOID:
                continue
            if tag in _RAW_END:
                if not attributes.rstrip().endswith("/"):
                    end = _RAW_END[tag].search(page, pos)
                    pos = end.end() if end else size
                continue
            shut = CLOSES.get(tag, ()) if tag != "p" else ()
            if tag in ENDS_P:
                shut = (*shut, "p")
            if any(still[t] for t in shut):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i] in shut:
                        shut_from(i)
                        break
                    if stack[i] in ("ul", "ol", "table", "div", "article", "section"):
                        break
            stack.append(tag)
            still[tag] += 1
            nodes.append(nodes[-1].child(_words_of(tag, attributes)))
    flush()
    return out


# --------------------------------------------------------------------------- vectors

_DENSE = 8
DIMS = PATH_DIMS + WORD_DIMS + _DENSE
#: Columns of a vector that say whether a path word is of a list.
LISTED = slice(PATH_DIMS, PATH_DIMS + 3)


def vectors(blocks: list, known: dict | None = None) -> np.ndarray:
    """One row a block: hashed path words, hashed text words, counts.  ``known`` keeps the
    features of the paths of several pages."""
    known = {} if known is None else known
    out = np.zeros((len(blocks), DIMS), dtype=np.float32)
    total = max(1, sum(len(t) for _, t, _ in blocks))
    for i, (node, text, link) in enumerate(blocks):
        kept = known.get(node)
        if kept is None:
            kept = known[node] = node.features()
        row = out[i]
        row[:PATH_DIMS + 3] = kept
        words = text.encode().split()
        codes = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
        row[PATH_DIMS + 3:PATH_DIMS + 3 + WORD_DIMS] = \
            np.bincount(codes % WORD_DIMS, minlength=WORD_DIMS) / max(1, len(words)) ** 0.5 / 4
        row[-5:] = (np.log1p(len(words)) / 5, link / len(text), len(text) / total,
                    text[-1] in ".!?", i / len(blocks))
    return out


# ------------------------------------------------------------------------------ model

def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _new_weights(rng) -> dict:
    w = {}
    for side in "fb":
        w[f"{side}x"] = rng.normal(0, DIMS ** -0.5, (DIMS, 4 * HIDDEN))
        w[f"{side}h"] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 4 * HIDDEN))
        w[f"{side}b"] = np.zeros(4 * HIDDEN)
        w[f"{side}b"][HIDDEN:2 * HIDDEN] = 1.0  # forget gates start open
    w["o"] = rng.normal(0, 0.1, 2 * HIDDEN)
    w["ob"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _read(w: dict, side: str, x: np.ndarray, keep: bool):
    """One direction over (pages, steps, DIMS), all pages in step; states, and a trace."""
    pages, steps, _ = x.shape
    into = x.reshape(-1, x.shape[2]) @ w[f"{side}x"] + w[f"{side}b"]
    into = into.reshape(pages, steps, -1)
    h = np.zeros((pages, HIDDEN), dtype=x.dtype)
    c = np.zeros((pages, HIDDEN), dtype=x.dtype)
    out = np.zeros((pages, steps, HIDDEN), dtype=x.dtype)
    trace = []
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = into[:, t] + h @ w[f"{side}h"]
        gate = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN:2 * HIDDEN], gate[:, 2 * HIDDEN:]
        g = np.tanh(z[:, 3 * HIDDEN:])
        if keep:
            trace.append((t, h, c, i, f, o, g))
        c = f * c + i * g
        h = o * np.tanh(c)
        if keep:
            trace[-1] += (c,)
        out[:, t] = h
    return out, trace


def _read_back(w: dict, side: str, x: np.ndarray, trace: list, d_out: np.ndarray, grad: dict):
    """Gradients of one direction."""
    d_h = np.zeros((x.shape[0], HIDDEN), dtype=x.dtype)
    d_c = np.zeros_like(d_h)
    d_z_all = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=x.dtype)
    for t, h0, c0, i, f, o, g, c in reversed(trace):
        d_h = d_h + d_out[:, t]
        tanh = np.tanh(c)
        d_c = d_c + d_h * o * (1 - tanh ** 2)
        d_z = np.concatenate([d_c * g * i * (1 - i), d_c * c0 * f * (1 - f),
                              d_h * tanh * o * (1 - o), d_c * i * (1 - g ** 2)], axis=1)
        d_z_all[:, t] = d_z
        grad[f"{side}h"] += h0.T @ d_z
        d_h = d_z @ w[f"{side}h"].T
        d_c = d_c * f
    flat = d_z_all.reshape(-1, 4 * HIDDEN)
    grad[f"{side}x"] += x.reshape(-1, x.shape[2]).T @ flat
    grad[f"{side}b"] += flat.sum(axis=0)


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS) -> dict:
    """Weights after Adam steps on the log loss of the labelled blocks."""
    rng = np.random.default_rng(7)
    w = _new_weights(rng)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for _ in range(epochs if sequences else 0):
        order = rng.permutation(len(sequences))
        for lo in range(0, len(order), 64):
            chosen = order[lo:lo + 64]
            steps = max(len(sequences[k]) for k in chosen)
            x = np.zeros((len(chosen), steps, DIMS), dtype=np.float32)
            y = np.full((len(chosen), steps), -1)
            for row, k in enumerate(chosen):
                x[row, :len(sequences[k])] = sequences[k]
                y[row, :len(labels[k])] = labels[k]
            fwd, trace_f = _read(w, "f", x, True)
            bwd, trace_b = _read(w, "b", x, True)
            both = np.concatenate([fwd, bwd], axis=2)
            p = _sigmoid(both @ w["o"] + w["ob"])
            known = y >= 0
            d = (np.where(known, p - y, 0) / max(1, known.sum())).astype(np.float32)
            grad = {k: np.zeros_like(v) for k, v in w.items()}
            grad["o"] = both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1)
            grad["ob"] = d.sum(keepdims=True).reshape(1)
            back = d[:, :, None] * w["o"]
            _read_back(w, "f", x, trace_f, back[:, :, :HIDDEN], grad)
            _read_back(w, "b", x, trace_b, back[:, :, HIDDEN:], grad)
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                s[k] = 0.99 * s[k] + 0.01 * grad[k] ** 2
                w[k] = w[k] - 0.02 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in w.items()}


def main_scores(w: dict, sequences: list[np.ndarray]) -> list[np.ndarray]:
    """Probability of main text of each block; pages of similar length are read together."""
    out: list = [None] * len(sequences)
    order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
    lo = 0
    while lo < len(order):
        hi, steps = lo + 1, len(sequences[order[lo]])
        while hi < len(order) and len(sequences[order[hi]]) <= max(8, steps * 2) and hi - lo < 128 \
                and (hi - lo + 1) * len(sequences[order[hi]]) <= CELLS:
            hi += 1
        chosen = order[lo:hi]
        # pages are padded at the end; the backward reader gets its own, turned, copy
        longest = len(sequences[chosen[-1]])
        x = np.zeros((len(chosen), longest, DIMS), dtype=np.float32)
        turned = np.zeros_like(x)
        for row, k in enumerate(chosen):
            n = len(sequences[k])
            x[row, :n] = sequences[k]
            turned[row, :n] = sequences[k][::-1]
        fwd, _ = _read(w, "f", x, False)
        bwd, _ = _read({"fx": w["bx"], "fh": w["bh"], "fb": w["bb"]}, "f", turned, False)
        for row, k in enumerate(chosen):
            n = len(sequences[k])
            both = np.concatenate([fwd[row, :n], bwd[row, :n][::-1]], axis=1)
            out[k] = _sigmoid(both @ w["o"] + w["ob"])
        lo = hi
    return out


# --------------------------------------------------------------------------- training set

#: Paths that extra blocks of boilerplate get in the copies of the training pages.
_EXTRA = tuple(tuple(tuple(tag.split(" ")) for tag in tags.split(" > ")) for tags in (
    "aside .sidebar", "div .comments", "section .comments > div .comment", "div .cookie .notice", "form",
    "form > label", "div .newsletter > form", "header > div", "div .menu > ul > li", "ul .breadcrumb > li",
    "div .related > ul > li", "div .share", "div .banner", "div .advert", "aside", "nav > ul > li",
    "footer > p", "div .notice", "div .ad"))


#: What may stand for ``article`` and ``main`` in copies that have neither.
_WRAPPERS = ((), ("div",), ("div", ".content"), ("div", ".post", ".body"), ("td",), ("section",), ("div", ".text"))


def page_labels(blocks: list, repeated: set[str]) -> list[int]:
    """1 main text, 0 not, -1 unknown, of the blocks of a page."""
    out = [node.label() for node, _, _ in blocks]
    if 1 in out:
        return out
    for i, (_, text, link) in enumerate(blocks):
        if out[i] < 0:
            if text in repeated or link > 0.5 * len(text):
                out[i] = 0
            elif link < 0.3 * len(text) and text[-1] in ".!?\"\u201d" and len(text.split()) >= PROSE_WORDS:
                out[i] = 1
    # what stands beside prose in its container is main too: headings, short paragraphs
    beside = {id(node.parent) for (node, _, _), y in zip(blocks, out, strict=True) if y == 1}
    return [1 if y < 0 and id(node.parent) in beside else y for (node, _, _), y in zip(blocks, out, strict=True)]


def _augmented(blocks: list, labels: list[int], rng, root: Node) -> tuple[list, list[int]]:
    """The page's blocks in other wrappers, with blocks of boilerplate in between (texts from
    the page itself), and their labels."""
    out, out_labels = [], []
    wrapper = [("div", f".w{rng.integers(1000)}") for _ in range(rng.integers(3))]
    bare = rng.random() < 0.5
    instead = _WRAPPERS[rng.integers(len(_WRAPPERS))]
    for (node, text, link), label in zip(blocks, labels, strict=True):
        tags = node.tags()
        tags = tags[:2] + wrapper + tags[2:]
        if bare:
            tags = [(w if w[0] not in ("article", "main") else instead) for w in tags]
            tags = [w for w in tags if w]
        elif rng.random() < 0.3 and label == 1:
            tags = tags[:2] + ([("main",)] if rng.random() < 0.5 else [("div", ".content"), ("article",)]) + tags[-1:]
        while rng.random() < 0.25:
            extra = _EXTRA[rng.integers(len(_EXTRA))]
            base = tags if rng.random() < 0.5 else tags[:2]
            other = blocks[rng.integers(len(blocks))][1]
            out.append((path([*base, *extra], root), other, 0 if rng.random() < 0.7 else len(other)))
            out_labels.append(0)
        out.append((path(tags, root), text, link))
        out_labels.append(label)
    return out, out_labels


def train(pages: DataFrame, html_col: str, id_col: str, train_pages: int = TRAIN_PAGES) -> dict | None:
    """Weights from a sample of the pages and their augmented copies; None if no block of the
    sample counts as main text.

    The pages with the smallest hashes of id and html are taken, of those that have blocks,
    repeated ones once.  They are looked for in a hash class of about four times
    ``train_pages`` pages, and in all pages only if the class holds too few; hashes alone are
    sorted.
    """
    rows = pages.select(F.col(f"`{html_col}`").alias("html"),
                        F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{html_col}`")).alias("h")) \
        .filter("html is not null")

    def smallest(part):
        marked = arrow_rows(part, ["html"], lambda a: [[bool(blocks_of(x)) for x in str_texts(a[0])]],
                            [T.StructField("some", T.BooleanType(), False)], ["h"])
        return [r["h"] for r in marked.filter("some").select("h").distinct().orderBy("h").limit(train_pages).collect()]

    classes = max(1, rows.count() // (4 * train_pages))
    found = smallest(rows.filter(F.pmod("h", F.lit(classes)) == 0))
    if classes > 1 and len(found) < train_pages:
        found = smallest(rows)
    chosen = rows.filter(F.col("h").isin(found)).dropDuplicates(["h"]).orderBy("h")
    rng = np.random.default_rng(3)
    root, texts, sample = Node(), Counter(), []
    for row in chosen.toLocalIterator():
        sample.append(blocks_of(row["html"], root))
        texts.update({t for _, t, _ in sample[-1]})
    often = max(3, len(sample) // 20)
    repeated = {t for t, n in texts.items() if n >= often}
    sequences, labels, some = [], [], False
    for own in sample:
        marks = page_labels(own, repeated)
        some = some or 1 in marks
        for copy in range(1 + COPIES):
            blocks, y = _augmented(own, marks, rng, root) if copy else (own, marks)
            x = vectors(blocks)
            if copy and rng.random() < 0.5:
                x[:, LISTED] = 0
            for lo in range(0, len(blocks), TRAIN_BLOCKS):
                sequences.append(x[lo:lo + TRAIN_BLOCKS])
                labels.append(np.array(y[lo:lo + TRAIN_BLOCKS], dtype=np.int64))
    return fit(sequences, labels) if some else None


def _labelled(blocks: list[list], weights: dict | None) -> list[str]:
    if weights is None:
        return ["\n\n".join(t for node, t, _ in b if node.label() != 0) for b in blocks]
    known: dict = {}
    scores = main_scores(weights, [vectors(b, known) for b in blocks])
    return ["\n\n".join(t for (_, t, _), s in zip(b, score) if s > 0.5)
            for b, score in zip(blocks, scores)]


def extract_batch(pages: list[str | None], weights: dict | None) -> list[str]:
    """Main text of each page; about ``CELLS`` blocks, or one page, are held at a time."""
    out, held, cells, root = [], [], 0, Node()
    for page in pages:
        held.append(blocks_of(page, root))
        cells += len(held[-1])
        if cells >= CELLS:
            out += _labelled(held, weights)
            held, cells, root = [], 0, Node()
    return out + _labelled(held, weights)


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id",
            prefix: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``pages`` (or its columns ``keep``) and, under ``prefix``, ``text`` and ``n_chars``."""
    p = private(pages) if prefix is None else prefix
    shared = pages.sparkSession.sparkContext.broadcast(train(pages, html_col, id_col))

    def run(arrays):
        texts = extract_batch(str_texts(arrays[0]), shared.value)
        return [texts, [len(t) for t in texts]]

    fields = [T.StructField(f"{p}text", T.StringType(), False),
              T.StructField(f"{p}n_chars", T.LongType(), False)]
    return arrow_rows(pages, [html_col], run, fields, keep)
