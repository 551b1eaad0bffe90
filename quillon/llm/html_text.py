"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of text blocks (leaves). Each has a vector of its tag path and of its hashed words and
shape; a bidirectional LSTM in numpy reads the whole sequence in both directions and classifies every block as main
text or not. It is trained here on pages that ``sample_pages`` makes, where the place of every block is known.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the HTML standard: elements without an end tag, and those whose content is not text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title select iframe svg math object head".split())
#: Of RAW, those that may close themselves or be left open; the content of the others goes on to their end tag.
CLOSED = frozenset("select svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: A start tag of the first kind ends an open element of the second.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
START = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?/]")
STOP = re.compile("[>\"']")
CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[^\W_]+")
WHITE = re.compile(r"\s+")

#: Elements above a block, the nearest ones, that its features tell of.
DEPTH = 48
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
PATH_DIMS, WORD_DIMS, SHAPE_DIMS = 64, 32, 10
DIMS = PATH_DIMS + WORD_DIMS + SHAPE_DIMS


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int = 0
    heading: bool = False


def end_of(page: str, tag: str, at: int) -> int:
    """Where the next end tag of an element ends, or the page."""
    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
    return end.end() if end else len(page)


@dataclass
class Tag:
    begin: int
    name: str
    closing: bool
    attributes: str

    @property
    def closed(self) -> bool:
        return self.attributes.rstrip().endswith("/")


class Tags:
    """The tags of a page in turn; every character is looked at a bounded number of times.

    A quote that nothing closes is a character like others. A tag, comment or declaration that the page ends in goes on
    to its end.
    """

    def __init__(self, page: str) -> None:
        self.page, self.alone = page, {"'": len(page), '"': len(page)}

    def _end(self, at: int) -> int:
        page = self.page
        while (m := STOP.search(page, at)) is not None:
            at = m.end()
            mark = m[0]
            if mark == ">":
                return at
            if m.start() < self.alone[mark]:
                end = page.find(mark, at)
                if end < 0:
                    self.alone[mark] = m.start()  # none from here on is closed
                else:
                    at = end + 1
        return len(page) + 1

    def next(self, at: int) -> tuple[int, int, Tag | None] | None:
        """Begin and end of the next piece of markup, and what tag it is if it is one."""
        m = START.search(self.page, at)
        if m is None:
            return None
        if m[2] is None:
            end = self.page.find("-->" if m[0] == "<!--" else ">", m.end())
            return m.start(), len(self.page) if end < 0 else end + (3 if m[0] == "<!--" else 1), None
        end = self._end(m.end())
        if end > len(self.page):
            return m.start(), len(self.page), None
        return m.start(), end, Tag(m.start(), m[2].lower(), bool(m[1]), self.page[m.end() : end - 1])


def ends_of(page: str) -> dict[int, int]:
    """Where the elements of CLOSED that are closed end, by the place of their start tag."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in CLOSED}
    at, tags = 0, Tags(page)
    while (found := tags.next(at)) is not None:
        _, at, tag = found
        if tag is None:
            continue
        if tag.name in CLOSED and tag.closing:
            if opened[tag.name]:
                out[opened[tag.name].pop()] = at
        elif tag.name in CLOSED:
            if not tag.closed:
                opened[tag.name].append(tag.begin)
        elif tag.name in RAW and tag.name != "head" and not tag.closing:
            at = end_of(page, tag.name, at)
    return out


class Open:
    """The open elements, how many there are of each, and the nearest ones that are not inline."""

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.count: Counter[str] = Counter()
        self.levels: list[tuple[int, tuple[str, ...]]] = []

    def push(self, tag: str, words: list[str]) -> None:
        if tag not in INLINE:
            self.levels.append((len(self.stack), (tag, *(f".{w}" for w in words))))
        self.stack.append(tag)
        self.count[tag] += 1

    def cut(self, at: int) -> None:
        """Close the elements from a place on."""
        for tag in self.stack[at:]:
            self.count[tag] -= 1
        del self.stack[at:]
        while self.levels and self.levels[-1][0] >= at:
            self.levels.pop()

    def remove(self, at: int) -> None:
        """Close one inline element; what is open within it stays open."""
        self.count[self.stack.pop(at)] -= 1

    def last(self, tag: str, until: Callable[[str], bool]) -> int | None:
        """The place of the last open element of a name, unless one of another kind is met before."""
        if self.count[tag]:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i] == tag:
                    return i
                if until(self.stack[i]):
                    return None
        return None

    def path(self) -> tuple[str, ...]:
        return tuple(x for _, own in self.levels[-DEPTH:] for x in own)


#: A start tag ends an open element of its own name unless one of these is met before.
ENDS_OWN = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page in order, each with the tags and class words of the nearest DEPTH elements above it.

    A block is the text between two block-level tags; inline tags and line breaks do not end it (a line break is white
    space). Unclosed elements end where an enclosing one ends. Nothing in scripts, styles and comments is text, nor is
    a tag that the page ends in. An element of CLOSED that closes itself or is never closed has no content. The work
    grows with the page's length, whatever is nested or left open in it.
    """
    page = page or ""
    out: list[Block] = []
    opened, tags = Open(), Tags(page)
    parts: list[str] = []
    linked = 0
    closed: dict[int, int] | None = None

    def flush() -> None:
        nonlocal linked
        if parts:
            text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(opened.path(), text, linked, any(opened.count[h] for h in HEADINGS)))
            parts.clear()
        linked = 0

    at = 0
    while at < len(page):
        found = tags.next(at)
        begin = len(page) if found is None else found[0]
        if begin > at:
            parts.append(page[at:begin])
            if opened.count["a"]:
                linked += begin - at
        if found is None:
            break
        _, at, tag = found
        if tag is None:
            continue
        name = tag.name
        if tag.closing:
            if name in INLINE:
                i = opened.last(name, lambda t: t not in INLINE)
                if i is not None:
                    opened.remove(i)  # only inline ones lie above it, so no level moves
                continue
            flush()
            i = opened.last(name, lambda t: False)
            if i is not None:
                opened.cut(i)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
        if name in RAW and name != "head":
            if name in CLOSED:
                closed = ends_of(page) if closed is None else closed
                at = closed.get(tag.begin, at)
            else:
                at = end_of(page, name, at)
            continue
        if name in ENDS_P and (i := opened.last("p", lambda t: t not in INLINE)) is not None:
            opened.cut(i)
        if name in ENDS_OWN and (i := opened.last(name, lambda t: t in ENDS_OWN[name])) is not None:
            opened.cut(i)
        if name in VOID or tag.closed:
            continue
        words = WORD.findall(" ".join(a or b or c for a, b, c in CLASS.findall(tag.attributes)).lower()) if tag.attributes and name not in INLINE else []
        opened.push(name, words)
    flush()
    return out


_HASHES: dict[str, tuple[int, float]] = {}


def _hashed(word: str, dims: int) -> tuple[int, float]:
    if len(_HASHES) > 200_000:
        _HASHES.clear()
    got = _HASHES.get(word)
    if got is None:
        h = zlib.crc32(word.encode())
        got = _HASHES[word] = (h >> 1, 1.0 if h & 1 else -1.0)
    return got[0] % dims, got[1]


def vectors(blocks: list[Block]) -> np.ndarray:
    """A row for each block: hashed tag path, hashed words (the mean over all of them), shape."""
    x = np.zeros((len(blocks), DIMS), np.float32)
    for r, b in enumerate(blocks):
        for depth, part in enumerate(b.path):
            for name in (part, f"{part}>{b.path[depth - 1]}") if depth else (part,):
                i, sign = _hashed(name, PATH_DIMS)
                x[r, i] += sign
        words = b.text.lower().split(" ")
        for w in words:
            i, sign = _hashed(f"w {w}", WORD_DIMS)
            x[r, PATH_DIMS + i] += sign / len(words)
        n = len(b.text)
        ends = b.text[-1] in ".!?…\"”»)"
        x[r, PATH_DIMS + WORD_DIMS :] = (np.log1p(n) / 8, n < 25, n > 120, b.linked / max(n, b.linked), b.heading, ends, "©" in b.text or "·" in b.text, "," in b.text, r / len(blocks), 1)
    return np.clip(x, -3, 3)


class BiLSTM:
    """One LSTM in each direction and a logistic output over both states of a block."""

    def __init__(self, hidden: int = 16, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.W = [draw(DIMS, 4 * hidden) for _ in range(2)]
        self.R = [draw(hidden, 4 * hidden) for _ in range(2)]
        self.b = [np.zeros(4 * hidden, np.float32) for _ in range(2)]
        for b in self.b:
            b[hidden : 2 * hidden] = 1
        self.o, self.c = draw(2 * hidden, 1), np.zeros(1, np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.W, *self.R, *self.b, self.o, self.c]

    @staticmethod
    def _sig(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _run(self, x: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, list]:
        """x: pages, steps, dims. Steps past a page's end keep the state."""
        pages, steps, _ = x.shape
        h = c = np.zeros((pages, self.hidden), np.float32)
        out, tape, n = np.zeros((pages, steps, self.hidden), np.float32), [], self.hidden
        into = x @ self.W[k] + self.b[k]
        for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
            z = into[:, t] + h @ self.R[k]
            i, f, g, o = self._sig(z[:, :n]), self._sig(z[:, n : 2 * n]), np.tanh(z[:, 2 * n : 3 * n]), self._sig(z[:, 3 * n :])
            m = mask[:, t : t + 1]
            c2 = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c2)
            h2 = m * (o * tc) + (1 - m) * h
            tape.append((t, h, c, i, f, g, o, tc, m))
            h, c = h2, c2
            out[:, t] = h
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, k)[0] for k in (0, 1)], 2)
        return (both @ self.o)[..., 0] + self.c[0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        runs = [self._run(x, mask, k) for k in (0, 1)]
        both, n = np.concatenate([r[0] for r in runs], 2), self.hidden
        d = (self._sig((both @ self.o)[..., 0] + self.c[0]) - y) * mask / mask.sum()
        do, dc = np.einsum("pth,pt->h", both, d)[:, None], np.array([d.sum()], np.float32)
        dW, dR, db = [], [], []
        for k, (out, tape) in enumerate(runs):
            dout = d[..., None] * self.o[k * n : (k + 1) * n, 0]
            dz_all = np.zeros((*x.shape[:2], 4 * n), np.float32)
            r = np.zeros_like(self.R[k])
            dh = dcell = np.zeros((x.shape[0], n), np.float32)
            for t, h, c, i, f, g, o, tc, m in reversed(tape):
                dh = dh + dout[:, t]
                live, past = dh * m, dh * (1 - m)
                cell = (dcell + live * o * (1 - tc**2)) * m
                dz = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), cell * i * (1 - g**2), live * tc * o * (1 - o)], 1)
                dz_all[:, t] = dz
                r += h.T @ dz
                dcell = dcell * (1 - m) + cell * f
                dh = past + dz @ self.R[k].T
            dW.append(np.einsum("ptd,pth->dh", x, dz_all))
            dR.append(r)
            db.append(dz_all.sum((0, 1)))
        return [*dW, *dR, *db, do, dc]


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(1, max(map(len, rows), default=1))
    x, mask = np.zeros((len(rows), steps, DIMS), np.float32), np.zeros((len(rows), steps), np.float32)
    for i, r in enumerate(rows):
        x[i, : len(r)], mask[i, : len(r)] = r, 1
    return x, mask


def sample_pages(n: int, seed: int = 5) -> list[str]:
    """Pages whose main blocks begin with the mark U+E000, in many layouts and with made-up words.

    Layouts differ in wrappers, class names, order, unclosed tags and in what surrounds the article, so that neither
    one tag nor one place decides.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    syllables = "ka lo mi ren tas vo shi del por ne ga ru li sta men qua bri do fe zu ör né ció ße".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    suffix = ""

    def sentence(low: int = 3, high: int = 18) -> str:
        return (" ".join(word() + suffix for _ in range(int(rng.integers(low, high)))) + pick([".", ".", ".", "!", "?", "", ","])).capitalize()

    text = lambda k: " ".join(sentence() for _ in range(int(rng.integers(1, k))))
    link = lambda: f'<a href="/{word()}">{" ".join(word() for _ in range(int(rng.integers(1, 4))))}</a>'

    def menu() -> str:
        items = [link() for _ in range(int(rng.integers(2, 9)))]
        return pick(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", "<ul>" + "<li>".join(["", *items]) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)])

    def aside(kind: str) -> str:
        inner = {
            "nav": menu,
            "header": lambda: pick([f"<a href='/'>{word()}</a>", f"<h1>{word()}</h1>", f"<p>{sentence()}</p>", f"<span>{word()}</span>"]) + pick(["", menu()]),
            "footer": lambda: pick([f"&copy; {word()}.example.com &middot; {sentence()}", f"<p>&copy; 20{int(rng.integers(10, 30))} {word()}</p>{menu()}", f"<p>{text(3)}</p>", sentence()]),
            "aside": lambda: f"<h{pick('234')}>{sentence(1, 4)}</h3>" + pick([menu(), f"<p>{text(4)}</p>"]),
            "ad": lambda: pick([text(3), f"<p>{text(3)}</p>", link(), f"<a href='/x'>{sentence()}</a>"]),
            "notice": lambda: f"<p>{text(3)}</p><button>{word()}</button>",
            "form": lambda: f"<form action='/s'><label>{sentence(1, 4)}</label><input name='q'><button>{word()}</button></form>",
            "comments": lambda: f"<h3>{sentence(1, 4)}</h3>" + "".join(pick([f"<div class='comment'><b>{word()}</b><p>{text(4)}</p></div>", f"<li class='comment'><span>{word()}</span> <p>{text(4)}</p></li>"]) for _ in range(int(rng.integers(1, 5)))),
        }[kind]()
        names = {"nav": ["nav", "menu", "navbar", "breadcrumb"], "header": ["header", "site-header", "top", "masthead"], "footer": ["footer", "site-footer", "bottom", "copyright"], "aside": ["sidebar", "related", "widget", "aside"], "ad": ["ad", "ads", "advert", "sponsored", "promo", "banner"], "notice": ["cookie-notice", "notice", "consent", "banner", "newsletter"], "form": ["search", "subscribe", "form", "login"], "comments": ["comments", "discussion", "comment-list", "replies"]}[kind]
        tags = {"nav": ["nav", "nav", "div"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "div"], "comments": ["section", "div"]}.get(kind, ["div", "div", "section", "aside"])
        tag = pick(tags)
        named = tag == "div" or tag == "section" or rng.random() < 0.5
        return f"<{tag}" + (f' {pick(["class", "id"])}="{pick(names)}"' if named else "") + f">{inner}</{tag}>"

    def article() -> str:
        mark = ""
        out = [f"<h1>{mark}{sentence(2, 10)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(int(rng.integers(1, 16))):
            body = mark + text(int(pick([2, 2, 4, 9])))
            out.append(
                pick([f"<p>{body}</p>"] * 9 + [f"<p><b>{body}<br>", f"<p><b>{body}<br>", f"<p>{body}", f"<h2>{mark}{sentence(1, 7)}</h2>", f"<blockquote>{body}</blockquote>", f"<ul><li>{mark}{sentence()}</li><li>{mark}{sentence()}</li></ul>", f"<pre>{body}</pre>", f"<div>{body}</div>", f"<p>{body} {link()} {sentence()}</p>", f"<table><tr><td>{mark}{word()}</td><td>{mark}{sentence(1, 5)}</td></tr></table>"])
            )
            if rng.random() < 0.06:
                out.append(aside(pick(["ad", "aside", "form", "notice"])))
        inner = "".join(out)
        wrap = pick(["article", "article", "article", "article", "main", "div", "div", "section"])
        named = wrap in ("div", "section") or rng.random() < 0.3
        inner = f"<{wrap}" + (f' {pick(["class", "id"])}="{pick(["content", "post", "entry-content", "article-body", "main", "story", "text", "page-content"])}"' if named else "") + f">{inner}</{wrap}>"
        return pick([inner, inner, f"<main>{inner}</main>", f'<div class="{pick(["container", "wrapper", "page"])}">{inner}</div>'])

    pages = []
    for _ in range(n):
        suffix = pick([""] * 6 + ["***", "%%%", "&amp;&amp;&amp;", "!!"])
        before = [aside(k) for k in ("notice", "header", "nav", "form", "ad", "aside") if rng.random() < 0.45]
        after = [aside(k) for k in ("ad", "comments", "aside", "form", "nav", "notice", "footer") if rng.random() < 0.4]
        tail = pick(["</body></html>", "</body></html>", "</html>", "", ""])
        pages.append(f'<!DOCTYPE html><html lang="en"><head><title>{sentence()}</title><script>var a="<p>";</script></head><body>' + "".join([*before, article(), *after]) + tail)
    return pages


def train(pages: int = 900, epochs: int = 8, batch: int = 24, rate: float = 6e-3, seed: int = 11) -> BiLSTM:
    model, rows, labels = BiLSTM(seed=seed), [], []
    for page in sample_pages(pages):
        blocks = blocks_of(page)
        labels.append(np.array([b.text.startswith("") for b in blocks], np.float32))
        for b in blocks:
            b.text = b.text.replace("", "").strip() or "."
        rows.append(vectors(blocks))
    params = model.params()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(rows)), key=lambda i: len(rows[i]) // 8)
        starts = rng.permutation(range(0, len(order), batch))
        for at in starts:
            own = order[at : at + batch]
            x, mask = padded([rows[i] for i in own])
            y = np.zeros(mask.shape, np.float32)
            for r, i in enumerate(own):
                y[r, : len(labels[i])] = labels[i]
            step += 1
            for p, g, mi, vi in zip(params, model.gradients(x, mask, y), m, v, strict=True):
                g = np.clip(g, -1, 1)
                mi += 0.1 * (g - mi)
                vi += 0.01 * (g * g - vi)
                p -= rate * 0.5 ** (epoch / 4) * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.99**step)) + 1e-8)
    return model


@cache
def trained() -> BiLSTM:
    """The model of the defaults, trained once in a process."""
    return train()


def extract(model: BiLSTM, pages: list[str | None]) -> list[str]:
    """The main text of each page: blocks judged main, joined by an empty line; page order, nothing cut."""
    found = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):  # pages of like length together, so that padding stays small
        own = [order[at]]
        while at + len(own) < len(order) and len(own) < 64 and (len(own) + 1) * len(found[order[at + len(own)]]) <= 4096:
            own.append(order[at + len(own)])
        at += len(own)
        logits = model.logits(*padded([vectors(found[i]) for i in own]))
        for r, i in enumerate(own):
            out[i] = "\n\n".join(b.text for b, z in zip(found[i], logits[r], strict=False) if z > 0)
    return out


def main_text(pages: DataFrame, model: BiLSTM | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row. Null or empty html, and pages without main blocks, have empty text.

    Pages of any length are read whole, in time that grows with the length. Rows are independent: there is no shuffle.
    Repeated rows and null ids give a result each; other columns are ignored, whatever their names; an empty table gives
    an empty result. Without a model the default one is trained, once in a process.
    """
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = extract(model, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr(f"cast(`{id_col}` as long) as page_id", f"`{url_col}` as url", f"`{html_col}` as html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
