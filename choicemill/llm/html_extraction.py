"""Main text of web pages by a recurrent block labeller.

1. A tolerant reader cuts a page into leaf blocks: text between block-level tags, with the path of open
   elements above it. Scripts, styles and other elements that show no text never become blocks.
2. A block is a vector: hashed tags and attribute words along its path (nearer ones weigh more), its own
   tag, hashed words, and a few measures such as length, share of linked text and punctuation.
3. A bidirectional LSTM in NumPy reads the whole page as one sequence of blocks, so every block is judged
   in the context of the document, and labels each as article or not. There is no limit on blocks.

The model is trained here. Training pages are (a) a hash sample of about SAMPLE_PAGES pages of SAMPLE_CHARS
characters or fewer that mark their article by HTML elements, which label their blocks, and (b) LAYOUTS pages
drawn from a grammar of common layouts (menus, notices, adverts, sidebars, forms, comments, with and without
telling names), filled with words of the sample. The sample is bounded and goes to the driver; the fitted
weights, some 40,000 numbers at any size of the corpus, travel with the tasks. All pages are then labelled
whole in one pass without a shuffle.

Defined cases: null and empty html, and pages without an article block, have an empty text; repeated rows
are read each; a page of any length or depth is read whole; of an empty table no row comes out; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicemill.llm.common import Words, byte_class, drawn, slices

SAMPLE_PAGES = 300
SAMPLE_CHARS = 50_000
LAYOUTS = 700
PATH, OWN, WORD = 64, 16, 32
HIDDEN = 24
EPOCHS = 12
CELLS = 16_384  # blocks that one step of the network holds, padding included

# Elements by what HTML does with them.
SILENT = "script style noscript template iframe svg canvas textarea title select object video audio math".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section
summary table tbody td tfoot th thead tr ul""".split())
ENDS_PARAGRAPH = BLOCK - {"body", "button", "caption", "head", "html", "label", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
# An element ends an open one of its group, if no element of the scope was opened since.
GROUPS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
          "tr": (("tr",), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr", "table")),
          "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select", "form"))}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(SILENT)})(?=[\s/>])[^>]*+>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)", re.S | re.I)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
NAME = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

STOPS = byte_class(".,;:!?")
DIGITS = byte_class("0123456789")
CAPITALS = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


# ---------------------------------------------------------------- blocks

def _slots(name: str, width: int) -> list[tuple[int, float]]:
    """Two signed places for a name in a hashed vector."""
    code = zlib.crc32(name.encode())
    return [(code % width, 1.0 if code >> 31 else -1.0), ((code >> 8) % width, 1.0 if code >> 30 & 1 else -1.0)]


class Paths:
    """Paths of open elements as numbers, with a hashed vector each that is its parent's, faded, plus its own names."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.vectors = [np.zeros(PATH, np.float32)]
        self.tags = ["body"]  # the innermost block-level tag of each path
        self.slots: dict[str, list[tuple[int, float]]] = {}

    def child(self, parent: int, tag: str, names: str = "") -> int:
        key = (parent, tag, names)
        at = self.known.get(key)
        if at is None:
            vector = self.vectors[parent] * np.float32(0.8)
            for name in [f"<{tag}>", *NAME.findall(CAMEL.sub(" ", names).lower())]:
                slots = self.slots.get(name)
                if slots is None:
                    slots = self.slots.setdefault(name, _slots(name, PATH))
                for place, sign in slots:
                    vector[place] += sign
            at = self.known[key] = len(self.vectors)
            self.vectors.append(vector)
            self.tags.append(tag if tag in BLOCK else self.tags[parent])
        return at


@dataclass
class Blocks:
    """Leaf blocks of one page."""

    text: list[str] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    marks: list[frozenset[str]] = field(default_factory=list)

    def add(self, text: str, path: int, linked: int, marks: frozenset[str] = frozenset()) -> None:
        self.text.append(text)
        self.path.append(path)
        self.linked.append(linked)
        self.marks.append(marks)


def read_blocks(page: str, paths: Paths, marked: bool = False) -> Blocks:
    """Blocks of a page in order; if ``marked``, with the tags and names above each."""
    out = Blocks()
    stack: list[tuple[str, int, str]] = []  # tag, path, names
    count: dict[str, int] = {}
    parts: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                above = frozenset(w for t, _, n in stack for w in [t, *NAME.findall(n.lower())]) if marked else frozenset()
                out.add(text, stack[-1][1] if stack else 0, min(linked, len(text)), above)
            parts.clear()
            linked = 0

    def pop(tag: str) -> None:
        nonlocal links
        while stack:
            top = stack.pop()[0]
            count[top] -= 1
            links -= top == "a"
            if top == tag:
                return

    def take(piece: str) -> None:
        nonlocal linked
        if piece:
            decoded = html.unescape(piece) if "&" in piece else piece
            parts.append(decoded)
            if links:
                linked += len(decoded.strip())

    at = 0
    for found in TOKEN.finditer(page):
        take(page[at: found.start()])
        at = found.end()
        tag = found.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if found.group(2):
            if count.get(tag):
                if tag in BLOCK or any(t in BLOCK for t, _, _ in _above(stack, tag)):
                    flush()
                pop(tag)
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_PARAGRAPH and count.get("p"):
                pop("p")
            if tag in GROUPS:
                ended, scope = GROUPS[tag]
                for t, _, _ in reversed(stack):
                    if t in scope:
                        break
                    if t in ended:
                        pop(t)
                        break
        if tag in VOID or found.group(4).endswith("/"):
            continue
        names = " ".join(n.strip("\"'") for n in NAMES.findall(found.group(4))) if "=" in found.group(4) else ""
        stack.append((tag, paths.child(stack[-1][1] if stack else 0, tag, names), names))
        count[tag] = count.get(tag, 0) + 1
        links += tag == "a"
    take(page[at:])
    flush()
    return out


def _above(stack: list, tag: str) -> Iterator[tuple]:
    """Open elements from the innermost one up to the nearest with this tag, itself left out."""
    for entry in reversed(stack):
        if entry[0] == tag:
            return
        yield entry


def vectors(pages: list[Blocks], paths: Paths) -> np.ndarray:
    """One row of numbers for each block of all pages."""
    text = pa.array([t for p in pages for t in p.text], pa.string())
    n = len(text)
    if not n:
        return np.zeros((0, PATH + OWN + WORD + 10), np.float32)
    out = np.zeros((n, PATH + OWN + WORD + 10), np.float32)
    out[:, :PATH] = np.array(paths.vectors)[[i for p in pages for i in p.path]]
    own = [paths.tags[i] for p in pages for i in p.path]
    slots = {t: _slots(t, OWN) for t in set(own)}
    for j in (0, 1):
        np.add.at(out, (np.arange(n), PATH + np.array([slots[t][j][0] for t in own])), [slots[t][j][1] for t in own])
    words = Words(text, lower=True)
    hashed = words.hashes
    count = np.diff(words.bounds)
    for shift in (0, 20):
        sign = np.where(hashed >> np.uint64(shift + 10) & np.uint64(1), 1, -1)
        np.add.at(out, (words.owner, PATH + OWN + (hashed >> np.uint64(shift) & np.uint64(WORD - 1)).astype(np.int64)), sign)
    out[:, PATH + OWN: PATH + OWN + WORD] /= np.sqrt(np.maximum(count, 1))[:, None]

    raw, offs = Words(text).data, words.offs
    def share(table):
        return np.add.reduceat(table[raw].astype(np.int64), offs[:-1])

    size = np.diff(offs)
    chars = np.array([len(t) for p in pages for t in p.text])
    linked = np.array([x for p in pages for x in p.linked])
    place = np.concatenate([np.arange(len(p.text)) / max(1, len(p.text) - 1) for p in pages])
    measures = [np.log1p(chars) / 3, np.log1p(count) / 3, linked / chars, share(STOPS) / np.maximum(count, 1),
                share(DIGITS) / size, share(CAPITALS) / np.maximum(count, 1), STOPS[raw[offs[1:] - 1]], place, place == 0, place == 1]
    out[:, -10:] = np.array(measures, np.float32).T
    return out


# ---------------------------------------------------------------- network

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(x: np.ndarray, p: dict[str, np.ndarray], way: str) -> tuple[np.ndarray, tuple]:
    """States of one direction over (time, page, feature)."""
    steps, pages, _ = x.shape
    wx, wh, b = p[f"wx{way}"], p[f"wh{way}"], p[f"b{way}"]
    pre = x @ wx + b
    h, c = np.zeros((pages, HIDDEN), x.dtype), np.zeros((pages, HIDDEN), x.dtype)
    states, cells, gates = (np.zeros((steps, pages, k * HIDDEN), x.dtype) for k in (1, 1, 4))
    for t in range(steps):
        z = pre[t] + h @ wh
        z[:, : 3 * HIDDEN] = _sigmoid(z[:, : 3 * HIDDEN])
        z[:, 3 * HIDDEN:] = np.tanh(z[:, 3 * HIDDEN:])
        i, f, o, g = np.split(z, 4, axis=1)
        c = f * c + i * g
        h = o * np.tanh(c)
        states[t], cells[t], gates[t] = h, c, z
    return states, (x, states, cells, gates)


def _backward(d: np.ndarray, kept: tuple, p: dict[str, np.ndarray], way: str) -> dict[str, np.ndarray]:
    x, states, cells, gates = kept
    steps, pages, _ = x.shape
    wh = p[f"wh{way}"]
    dz = np.zeros_like(gates)
    dh, dc = np.zeros((pages, HIDDEN), x.dtype), np.zeros((pages, HIDDEN), x.dtype)
    for t in range(steps - 1, -1, -1):
        i, f, o, g = np.split(gates[t], 4, axis=1)
        before = cells[t - 1] if t else np.zeros_like(cells[0])
        th = np.tanh(cells[t])
        dh = dh + d[t]
        dc = dc + dh * o * (1 - th * th)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dh, dc = dz[t] @ wh.T, dc * f
    flat = dz.reshape(-1, dz.shape[2])
    return {f"wx{way}": x.reshape(len(flat), -1).T @ flat, f"b{way}": flat.sum(axis=0),
            f"wh{way}": states[:-1].reshape(-1, HIDDEN).T @ dz[1:].reshape(-1, dz.shape[2])}


def _turned(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each page's steps in reverse; the padding behind stays."""
    t = np.arange(len(x))[:, None]
    at = np.where(t < length, length - 1 - t, t)
    return x[at, np.arange(x.shape[1])]


class Labeller:
    """Bidirectional LSTM over the blocks of a page; a logistic output also sees the block itself."""

    def __init__(self, width: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for way in "fb":
            self.p[f"wx{way}"] = (rng.standard_normal((width, 4 * HIDDEN)) / np.sqrt(width)).astype(np.float32)
            self.p[f"wh{way}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN: 2 * HIDDEN] = 1
            self.p[f"b{way}"] = bias
        self.p["v"] = np.zeros(2 * HIDDEN + width, np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, length: np.ndarray):
        ahead, kept_f = _forward(x, self.p, "f")
        back, kept_b = _forward(_turned(x, length), self.p, "b")
        seen = np.concatenate([ahead, _turned(back, length), x], axis=2)
        return _sigmoid(seen @ self.p["v"] + self.p["c"]), seen, kept_f, kept_b

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over real blocks, and its gradient."""
        prob, seen, kept_f, kept_b = self._run(x, length)
        real = np.arange(len(x))[:, None] < length
        n = real.sum()
        d = np.where(real, prob - y, 0).astype(x.dtype) / n
        likely = np.where(y == 1, prob, 1 - prob)
        loss = float(-np.log(np.maximum(likely, 1e-7))[real].sum() / n)
        dseen = d[..., None] * self.p["v"]
        grads = {"v": np.tensordot(d, seen, ((0, 1), (0, 1))), "c": d.sum(keepdims=True)[0]}
        grads |= _backward(dseen[..., :HIDDEN], kept_f, self.p, "f")
        grads |= _backward(_turned(dseen[..., HIDDEN: 2 * HIDDEN], length), kept_b, self.p, "b")
        return loss, grads

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 32, rate: float = 5e-3,
            seed: int = 2) -> Labeller:
        """Adam over batches of pages of similar length."""
        rng = np.random.default_rng(seed)
        order = np.argsort([len(p) for p in pages], kind="stable")
        batches = [order[i: i + batch] for i in range(0, len(order), batch)]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            for at in rng.permutation(len(batches)):
                x, y, length = _padded([pages[i] for i in batches[at]], [labels[i] for i in batches[at]])
                _, grads = self.loss_and_gradient(x, y, length)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-12))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                    self.p[k] = (self.p[k] - pace * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
        return self

    def label(self, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Probability that each block is article text; ``size`` blocks a page, pages one after the other."""
        ends = np.cumsum(size)
        out = np.zeros(len(rows))
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and size[order[to]] * (to + 1 - at) <= CELLS:
                to += 1
            pick = order[at:to]
            x, _, length = _padded([rows[ends[i] - size[i]: ends[i]] for i in pick])
            prob = self._run(x, length)[0]
            for j, i in enumerate(pick):
                out[ends[i] - size[i]: ends[i]] = prob[: size[i], j]
            at = to
        return out


def _padded(pages: list[np.ndarray], labels: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(p) for p in pages])
    x = np.zeros((length.max(), len(pages), pages[0].shape[1]), np.float32)
    y = np.zeros(x.shape[:2], np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i] = p
        if labels is not None:
            y[: len(p), i] = labels[i]
    return x, y, length


# ---------------------------------------------------------------- training pages

# Elements that say what they hold, and names that pages commonly give to their parts.
MAIN = frozenset(("article", "main"))
ASIDE = frozenset(("nav", "aside", "footer", "form", "header", "button", "ad", "ads", "advert", "comment", "comments", "sidebar"))
PARTS = {
    "wrap": (("div",), ("page", "wrapper", "container", "layout", "site", "row", "")),
    "header": (("header", "div"), ("header", "masthead", "top", "site-header", "branding")),
    "menu": (("nav", "div", "ul"), ("menu", "nav", "navigation", "navbar", "breadcrumbs", "topnav", "links")),
    "notice": (("div", "section", "aside", "p"), ("notice", "cookie-banner", "consent", "alert", "gdpr", "popup", "subscribe", "paywall")),
    "advert": (("div", "aside", "section"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner")),
    "sidebar": (("aside", "div", "section"), ("sidebar", "side", "widget", "rail", "right-column", "related", "recommended", "popular")),
    "article": (("article", "main", "div", "section"), ("article", "content", "post", "entry", "story", "article-body", "main-content", "text")),
    "share": (("div", "ul", "p"), ("share", "social", "tools", "tags", "pagination", "print")),
    "comments": (("section", "div", "ol"), ("comments", "discussion", "responses", "replies", "reader-comments", "feedback")),
    "form": (("form",), ("search", "login", "signup", "newsletter", "contact", "survey", "")),
    "footer": (("footer", "div"), ("footer", "bottom", "copyright", "site-info", "legal", "imprint")),
}


class Layouts:
    """Pages drawn from a grammar of layouts, with a label for each block, filled with given words."""

    def __init__(self, words: list[str], paths: Paths, seed: int = 3):
        self.rng = np.random.default_rng(seed)
        self.words, self.paths = words or ["text"], paths

    def some(self, *values):
        return values[self.rng.integers(len(values))]

    def chance(self, share: float) -> bool:
        return bool(self.rng.random() < share)

    def line(self, low: int, high: int, stop: bool = True) -> str:
        pick = [self.words[i] for i in self.rng.integers(len(self.words), size=self.rng.integers(low, high + 1))]
        text = " ".join(pick)
        return text[:1].upper() + text[1:].rstrip(".,;:") + ("." if stop else "")

    def part(self, parent: int, kind: str) -> int:
        tags, names = PARTS[kind]
        tag, name = self.some(*tags), self.some(*names)
        # A part is told by its element, its name or both; few pages leave out both.
        if self.plain and not self.chance(0.1):
            tag = tags[0] if kind != "article" or self.chance(0.8) else "div"
            name = ""
        elif self.bare and "div" in tags:
            tag = "div"
        return self.paths.child(parent, tag, name)

    def put(self, parent: int, tag: str, text: str, label: int, linked: float = 0.0, name: str = "") -> None:
        # As in a page that is read, an inline element has been closed where its block ends.
        path = self.paths.child(parent, tag, name) if tag in BLOCK or name else parent
        self.page.add(text, path, int(linked * len(text)))
        self.labels.append(label)

    def links(self, parent: int, low: int, high: int) -> None:
        holder = self.paths.child(parent, "ul") if self.chance(0.8) else parent
        tag = "li" if self.chance(0.8) else self.some("p", "div", "td")
        for _ in range(self.rng.integers(low, high + 1)):
            self.put(holder, tag, self.line(1, 4, self.chance(0.2)), 0, 1.0)

    def body(self, parent: int) -> None:
        top = self.part(parent, "article")
        inner = self.paths.child(top, "div", self.some("", "body", "inner", "content")) if self.chance(0.3) else top
        if self.chance(0.85):
            self.put(top, self.some("h1", "h1", "h2"), self.line(2, 14, self.chance(0.5)), 1)
        tag = self.some("p", "p", "p", "p", "div", "section")
        for _ in range(self.rng.integers(1, 28)):
            draw = self.rng.random()
            if draw < 0.06:
                self.put(inner, self.some("h2", "h3"), self.line(1, 8, False), 1)
            elif draw < 0.10:
                holder = self.paths.child(inner, self.some("ul", "ol"))
                for _ in range(self.rng.integers(2, 6)):
                    self.put(holder, "li", self.line(2, 20), 1)
            elif draw < 0.13:
                self.put(self.paths.child(inner, "blockquote"), "p", self.line(5, 30), 1)
            elif draw < 0.15:
                self.put(inner, self.some("pre", "td", "figcaption"), self.line(2, 15), 1)
            elif draw < 0.19:
                self.put(self.part(inner, "advert"), "p", self.line(3, 18), 0, self.some(0.0, 1.0))
            else:
                self.put(inner, tag, " ".join(self.line(1, 14) for _ in range(self.rng.integers(1, 6))), 1, self.some(0.0, 0.0, 0.0, 0.2))
        if self.chance(0.15):
            self.comments(top)
        if self.chance(0.15):
            self.links(self.part(top, "share"), 2, 5)

    def comments(self, parent: int) -> None:
        top = self.part(parent, "comments")
        if self.chance(0.7):
            self.put(top, self.some("h2", "h3", "div"), self.some("Comments", self.line(1, 3, False)), 0)
        for _ in range(self.rng.integers(1, 9)):
            each = self.paths.child(top, self.some("div", "li", "article"), self.some("comment", "reply", "comment-body"))
            if self.chance(0.7):
                self.put(each, self.some("div", "p", "h4"), self.line(1, 2, False), 0, self.some(0.0, 1.0), self.some("author", "user", "meta", ""))
            for _ in range(self.rng.integers(1, 4)):
                self.put(each, "p", self.line(2, 40), 0)
            if self.chance(0.4):
                self.put(each, self.some("div", "p"), "Reply", 0, 1.0)
        if self.chance(0.4):
            self.form(top)

    def form(self, parent: int) -> None:
        top = self.part(parent, "form")
        for _ in range(self.rng.integers(1, 5)):
            self.put(top, self.some("label", "p", "div", "option", "legend"), self.line(1, 12, self.chance(0.3)), 0)
        if self.chance(0.8):
            self.put(top, "button", self.line(1, 2, False), 0)

    def header(self, parent: int) -> None:
        top = self.part(parent, "header")
        self.put(top, self.some("h1", "div", "p", "a"), self.line(1, 4, False), 0, self.some(0.0, 1.0), self.some("", "logo", "site-title", "brand"))
        if self.chance(0.5):
            self.put(top, self.some("p", "div", "h2"), self.line(3, 10), 0, 0.0, self.some("", "tagline", "slogan"))

    def notice(self, parent: int) -> None:
        top = self.part(parent, "notice")
        for _ in range(self.rng.integers(1, 3)):
            self.put(top, self.some("p", "div"), self.line(4, 25), 0)
        if self.chance(0.5):
            self.put(top, "button", self.some("Accept", "OK", "Close", self.line(1, 2, False)), 0)

    def sidebar(self, parent: int) -> None:
        top = self.part(parent, "sidebar")
        self.put(top, self.some("h2", "h3", "h4"), self.line(1, 4, False), 0)
        if self.chance(0.7):
            self.links(top, 2, 8)
        for _ in range(self.rng.integers(0, 4)):
            self.put(top, "p", self.line(3, 25), 0, self.some(0.0, 0.0, 1.0))

    def footer(self, parent: int) -> None:
        top = self.part(parent, "footer")
        mark = self.some("©", "© 2024", "Copyright", "")
        self.put(top, self.some("p", "div", "span"), f"{mark} {self.line(2, 12)}".strip(), 0)
        if self.chance(0.5):
            self.links(top, 2, 8)

    def draw(self) -> tuple[Blocks, np.ndarray]:
        self.page, self.labels = Blocks(), []
        self.plain, self.bare = self.chance(0.3), self.chance(0.4)
        top = self.paths.child(self.paths.child(0, "html"), "body")
        if self.chance(0.5):
            top = self.part(top, "wrap")

        def maybe(share: float, step) -> None:
            if self.chance(share):
                step(top)

        maybe(0.25, self.notice)
        maybe(0.6, self.header)
        maybe(0.8, lambda t: self.links(self.part(t, "menu"), 3, 10))
        maybe(0.4, lambda t: self.put(self.part(t, "advert"), self.some("p", "div", "a"), self.line(2, 20), 0, self.some(0.0, 1.0)))
        maybe(0.25, self.sidebar)
        maybe(0.15, self.form)
        self.body(top)
        maybe(0.3, lambda t: self.links(self.part(t, "share"), 2, 6))
        maybe(0.35, self.comments)
        maybe(0.35, self.sidebar)
        maybe(0.2, self.form)
        maybe(0.2, self.notice)
        maybe(0.65, self.footer)
        return self.page, np.array(self.labels, np.float32)


def marked_article(page: Blocks) -> np.ndarray | None:
    """Labels of a page that marks its article by elements; None where none does."""
    inside = [bool(m & MAIN) for m in page.marks]
    if not any(inside):
        return None
    return np.array([i and not m & ASIDE for i, m in zip(inside, page.marks, strict=True)], np.float32)


def cropped(page: Blocks, labels: np.ndarray, before: bool, after: bool) -> tuple[Blocks, np.ndarray]:
    """A page without what stands before or after its article, as not every page has a menu and a footer."""
    inside = np.flatnonzero(labels)
    s, e = inside[0] if before else 0, inside[-1] + 1 if after else len(labels)
    return Blocks(page.text[s:e], page.path[s:e], page.linked[s:e], page.marks[s:e]), labels[s:e]


def train(sample: list[str], layouts: int = LAYOUTS, epochs: int = EPOCHS, seed: int = 1) -> Labeller:
    """A labeller from sampled pages and drawn layouts."""
    paths = Paths()
    read = [read_blocks(page, paths, marked=True) for page in sample]
    labelled = [(p, y) for p in read if p.text and (y := marked_article(p)) is not None]
    rng = np.random.default_rng(seed)
    labelled = [cropped(p, y, *(rng.random(2) < 0.3)) if y.any() else (p, y) for p, y in labelled]
    words = sorted({w for p in read for t in p.text for w in t.split()[:200] if len(w) <= 30})
    drawn = Layouts(words, paths, seed + 2)
    labelled += [drawn.draw() for _ in range(layouts)]
    pages = [p for p, _ in labelled]
    rows = vectors(pages, paths)
    ends = np.cumsum([len(p.text) for p in pages])
    model = Labeller(rows.shape[1], seed)
    return model.fit([rows[e - len(p.text): e] for p, e in zip(pages, ends, strict=True)], [y for _, y in labelled], epochs)


# ---------------------------------------------------------------- Spark

def _extract(model: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            paths = Paths()
            pages = [read_blocks(page or "", paths) for page in b.column("html").to_pylist()]
            size = np.array([len(p.text) for p in pages])
            good = model.label(vectors(pages, paths), size) >= 0.5
            ends = np.cumsum(size)
            text = ["\n\n".join([t for t, g in zip(p.text, good[e - n: e], strict=True) if g])
                    for p, n, e in zip(pages, size, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                ["page_id", "url", "text", "n_chars"])
    return run


def training_sample(pages: DataFrame, rows: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> list[str]:
    """Html of a hash sample of about ``rows`` pages of ``chars`` characters or fewer, in a fixed order."""
    some = pages.select("page_id", "html").where(F.length("html").between(1, chars))
    share = min(1.0, rows / max(1, some.count()))
    return sorted(r.html for r in some.where(drawn(share, "page_id", "html")).select("html").collect())


def main_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages``; the labeller is trained if none is given."""
    fitted = model if model is not None else train(training_sample(pages))
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(_extract(fitted), f"{', '.join(kinds)}, text string, n_chars long")


def op13_html_extraction(spark, sf_dir):
    """The main text of every page, by a recurrent labeller trained here."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


# The pages of these tables mark their articles, so SQL can state the text that the labeller has to find.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, generate_subscripts(s, 1) AS place, unnest(s) AS piece
      FROM (SELECT page_id, url, regexp_split_to_array(body, '</?(?:p|h1)>') AS s FROM a)),
c AS (SELECT page_id, url, place, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
               regexp_replace(regexp_replace(piece, '<br>', ' ', 'g'), '</?b>', '', 'g'),
               '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS piece FROM b),
t AS (SELECT page_id, url, coalesce(string_agg(piece, chr(10) || chr(10) ORDER BY place) FILTER (WHERE piece <> ''), '') AS text
      FROM c GROUP BY page_id, url)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""
