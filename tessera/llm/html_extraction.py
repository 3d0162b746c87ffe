"""HTML extraction by a recurrent block labeller (operator 10).

A page becomes its sequence of leaf blocks: runs of text between block boundaries, each with the path of open
elements. Hashed path tokens (names, classes, ids, roles) and hashed words of a block make its vector; a
bidirectional LSTM in numpy reads the vectors of the whole page and labels every block main text or not. The model
is trained here, on pages drawn from a generator of layouts, and stored in the shared folder for later runs. Prose has
random words there; half of the junk has words that such blocks carry on real sites, so both halves of a vector tell.

Pages go through the network in batches of a bounded number of blocks, padding included; one with more is read in
chunks of steps that hand on the state, so memory does not grow with it beyond its texts and 100 bytes a block.
"""

from __future__ import annotations

import functools
import hashlib
import html
import inspect
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import shared_dir, unused

PATH_WIDTH, WORD_WIDTH, HIDDEN = 192, 64, 24
_NUMBERS = 4
WIDTH = PATH_WIDTH + WORD_WIDTH + _NUMBERS
#: Pages that go through the network together, and blocks, padding included; characters of HTML that are parsed together.
PAGES_TOGETHER, BLOCKS_TOGETHER, CHARS_TOGETHER = 64, 8192, 4_000_000

#: (text, packed bits of the cells of its path's tokens, share of its characters in links)
Block = tuple[str, bytes, float]

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|textarea|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|[^<]+|<", re.S | re.I)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i ins del kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Opening one of these ends an open p; opening one of the keys' ends an open element of the values.
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WORDS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+")


def blocks(page: str) -> list[Block]:
    """Every block with text, in page order. What is open is counted as elements open and close, so deep nesting costs
    a block no more than the width of its vector."""
    out: list[Block] = []
    stack: list[tuple[str, list[int]]] = []
    open_names, cells, bits = Counter(), [0] * PATH_WIDTH, 0
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, bits.to_bytes(PATH_WIDTH // 8, "big"), linked / max(1, sum(map(len, parts)))))
        parts.clear()
        linked = 0

    def cut(i: int) -> None:
        nonlocal bits
        for name, own in stack[i:]:
            open_names[name] -= 1
            for c in own:
                cells[c] -= 1
                if not cells[c]:
                    bits ^= 1 << (PATH_WIDTH - 1 - c)
        del stack[i:]

    for m in _TOKEN.finditer(page):
        whole, name = m[0], m[3]
        if name is None:
            if m[1] is None and whole[0] != "<" or whole == "<":
                parts.append(whole)
                if open_names["a"]:
                    linked += len(whole)
            continue
        name = name.lower()
        if name not in _INLINE:
            close()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1) if open_names[name] else ():
                if stack[i][0] == name:
                    cut(i)
                    break
                if name in _INLINE and stack[i][0] not in _INLINE:
                    break
            continue
        ends = ("p",) if name in _CLOSES_P else _CLOSES.get(name, ())
        if any(open_names[e] for e in ends):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    cut(i)
                    break
                if stack[i][0] not in _INLINE and stack[i][0] != "p":
                    break
        if name in _VOID or m[4].endswith("/"):
            continue
        own = {_cell("path", name, PATH_WIDTH)}
        for a in _NAMED.finditer(m[4]):
            own.update(_cell("path", w.lower(), PATH_WIDTH) for w in _WORDS.findall(a[2] or a[3] or a[4] or ""))
        stack.append((name, list(own)))
        open_names[name] += 1
        for c in own:
            if not cells[c]:
                bits |= 1 << (PATH_WIDTH - 1 - c)
            cells[c] += 1
    close()
    return out


@functools.lru_cache(1 << 16)
def _cell(kind: str, token: str, width: int) -> int:
    return zlib.crc32(f"{kind}:{token}".encode()) % width


class _WordCells(dict):
    """The cells of words, looked up some ten million times a task; forgotten beyond a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        return self.setdefault(word, zlib.crc32(f"word:{word}".encode()) % WORD_WIDTH)


_WORD_CELLS = _WordCells()


def vectors(page: list[Block], low: int = 0, high: int | None = None) -> np.ndarray:
    """The vectors of a page's blocks from low to high. All words of a block count, long blocks' in proportion."""
    own = page[low:high]
    if not own:
        return np.zeros((0, WIDTH), np.float32)
    words = [text.lower().split() for text, _, _ in own]
    n = np.array([*map(len, words)])
    cells = np.fromiter(map(_WORD_CELLS.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(n.sum()))
    counts = np.bincount(cells + np.repeat(np.arange(len(own)) * WORD_WIDTH, n), minlength=len(own) * WORD_WIDTH)
    x = np.zeros((len(own), WIDTH), np.float32)
    x[:, :PATH_WIDTH] = np.unpackbits(np.frombuffer(b"".join(b[1] for b in own), np.uint8).reshape(len(own), -1), axis=1)
    x[:, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] = counts.reshape(len(own), WORD_WIDTH) * (1.2 / np.maximum(12, n))[:, None]
    x[:, -4] = np.minimum(1, np.log1p(n) / 6)
    x[:, -3] = [b[2] for b in own]
    x[:, -2] = [b[0][-1] in ".!?" for b in own]
    x[:, -1] = (low + np.arange(len(own))) / len(page)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    """A bidirectional LSTM over block vectors with one output a block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {}
        for d in ("f", "b"):
            self.w[f"{d}x"] = rng.normal(0, 0.15, (WIDTH, 4 * h))
            self.w[f"{d}h"] = rng.normal(0, 0.2, (h, 4 * h))
            self.w[f"{d}c"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.w["o"] = rng.normal(0, 0.2, (2 * h, 1))
        self.w["oc"] = np.zeros(1)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None, state: list | None = None) -> np.ndarray:
        """The states of direction d after every step. state: [h, c] to begin with, replaced by those at the end."""
        steps, pages = x.shape[:2]
        gates = x.reshape(-1, WIDTH) @ self.w[f"{d}x"] + self.w[f"{d}c"]
        gates = gates.reshape(steps, pages, 4 * HIDDEN)
        h, c = state or [np.zeros((pages, HIDDEN), np.float32)] * 2
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.w[f"{d}h"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((t, i, f, o, g, c, tanh, h, m))
            c, h = np.where(m, new, c), np.where(m, o * tanh, h)
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out

    def label_long(self, page: list[Block], together: int = BLOCKS_TOGETHER) -> np.ndarray:
        """label() of one page, whose vectors are made for some blocks at a time."""
        out = np.zeros((len(page), 2 * HIDDEN), np.float32)
        starts = range(0, len(page), together)
        for d, at in (("f", 0), ("b", HIDDEN)):
            state = [np.zeros((1, HIDDEN), np.float32)] * 2
            for low in starts if d == "f" else reversed(starts):
                x = vectors(page, low, low + together)[:, None]
                out[low : low + together, at : at + HIDDEN] = self._run(d, x, np.ones(x.shape[:2], bool), state=state)[:, 0]
        return _sigmoid((out @ self.w["o"])[:, 0] + self.w["oc"])

    def label(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run("f", x, mask), self._run("b", x, mask)], 2)
        return _sigmoid((both @ self.w["o"])[..., 0] + self.w["oc"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over blocks, by back-propagation through both directions."""
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(d, x, mask, kept[d]) for d in ("f", "b")], 2)
        error = (_sigmoid((both @ self.w["o"])[..., 0] + self.w["oc"]) - y) * mask / max(1, mask.sum())
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["o"][:, 0] = (both * error[..., None]).sum((0, 1))
        g["oc"][0] = error.sum()
        for n, d in enumerate(("f", "b")):
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            at = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            out = error[..., None] * self.w["o"][n * HIDDEN : (n + 1) * HIDDEN, 0]
            for t, i, f, o, gg, c, tanh, h, m in reversed(kept[d]):
                dh = dh + out[t]
                own = np.where(m, dh, 0)
                dnew = np.where(m, dc + own * o * (1 - tanh * tanh), 0)
                dz = np.concatenate([dnew * gg * i * (1 - i), dnew * c * f * (1 - f), own * tanh * o * (1 - o), dnew * i * (1 - gg * gg)], 1)
                at[t] = dz
                g[f"{d}h"] += h.T @ dz
                dh = np.where(m, 0, dh) + dz @ self.w[f"{d}h"].T
                dc = np.where(m, dnew * f, dc)
            g[f"{d}x"] = x.reshape(-1, WIDTH).T @ at.reshape(-1, 4 * HIDDEN)
            g[f"{d}c"] = at.sum((0, 1))
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int, together: int = 32, rate: float = 0.01, seed: int = 4) -> None:
        rng, first, second, n = np.random.default_rng(seed), {}, {}, 0
        for _ in range(rounds):
            # pages of like length go together, so that one long page does not stretch every batch
            order = sorted(rng.permutation(len(pages)), key=lambda i: len(pages[i][0]))
            for at in rng.permutation(range(0, len(order), together)):
                x, mask, y = padded([pages[i][0] for i in order[at : at + together]], [pages[i][1] for i in order[at : at + together]])
                n += 1
                for k, g in self.gradients(x, mask, y).items():
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                    second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
                    self.w[k] -= (rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)


def padded(xs: list[np.ndarray], ys: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(map(len, xs))
    x, mask, y = np.zeros((steps, len(xs), WIDTH), np.float32), np.zeros((steps, len(xs)), bool), np.zeros((steps, len(xs)), np.float32)
    for i, v in enumerate(xs):
        x[: len(v), i], mask[: len(v), i] = v, True
        if ys is not None:
            y[: len(v), i] = ys[i]
    return x, mask, y


#: Class and id words of the generator's wrappers, by what they hold.
_PARTS = {
    "menu": ("nav", "menu", "navbar", "breadcrumb", "pagination", "toc", "links"),
    "header": ("header", "masthead", "topbar", "branding", "logo"),
    "footer": ("footer", "colophon", "copyright", "legal", "bottom"),
    "side": ("sidebar", "aside", "widget", "related", "recommended", "trending", "tags", "author"),
    "notice": ("notice", "cookie", "consent", "banner", "alert", "popup", "modal", "gdpr", "disclaimer", "paywall", "notification"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "adsense", "promotion"),
    "form": ("form", "newsletter", "subscribe", "signup", "search", "login", "contact"),
    "comment": ("comments", "comment", "discussion", "replies", "respond", "disqus", "reply"),
    "share": ("share", "social", "sharing", "follow"),
}
_ELEMENT = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}
_MAIN = ("content", "post", "entry", "article", "body", "story", "main", "text")
#: Words that junk blocks carry on real sites, by their kind; prose has none of its own.
_SAYS = {
    "menu": "home about contact blog archive categories news products services login register next previous more",
    "header": "menu search login register welcome skip to content home site",
    "footer": "copyright all rights reserved privacy policy terms of use imprint contact powered by © ®",
    "side": "related articles recommended for you popular posts trending tags archives read more about the author",
    "notice": "we use cookies to improve your experience accept reject all settings privacy policy consent by continuing you agree this site",
    "advert": "advertisement sponsored buy now sale discount offer shop free shipping deal click here limited % off $",
    "form": "subscribe to our newsletter enter your email address sign up log in password username submit send search comment",
    "comment": "reply replies comments says ago like likes report flag login to comment posted thanks great post",
    "share": "share this on facebook twitter whatsapp email print follow us tweet pin link copy",
}
#: Words that wrappers of either kind carry, so they tell nothing.
_PLAIN = ("box", "wrap", "wrapper", "block", "container", "inner", "slot", "site", "page", "col", "row", "list", "item", "section", "area")


_SYLLABLES = ("ka", "lo", "mi", "ter", "an", "ou", "esh", "ti", "ron", "ble")
_SYLLABIC = [*_SYLLABLES, *(a + b for a in _SYLLABLES for b in _SYLLABLES), *(a + b + c for a in _SYLLABLES for b in _SYLLABLES for c in _SYLLABLES[::2])]


def training_page(rng: np.random.Generator) -> list[tuple[str, bytes, float, int]]:
    """Blocks of a random layout with their labels, parsed from its HTML; \\x01 marks main text."""
    def text(least: int, most: int, mark: str, kind: str = "") -> str:
        n = int(rng.integers(least, most))
        words = [_SYLLABIC[i] for i in rng.integers(0, len(_SYLLABIC), n)]
        if kind and rng.random() < 0.5:
            own = _SAYS[kind].split()
            words = [own[i % len(own)] if said else w for w, i, said in zip(words, range(int(rng.integers(99)), 1 << 30), rng.random(n) < 0.6, strict=False)]
        if words and rng.random() < 0.5:
            words[0] = words[0].capitalize()
        return mark + " ".join(words) + ("." if (end := rng.random()) < 0.7 else "" if end < 0.95 else "!")

    def junk(kind: str) -> str:
        names = " ".join(rng.choice(_PARTS[kind], rng.integers(1, 3)))
        if rng.random() < 0.4:
            names = f"{names}-{rng.choice(_PLAIN)}" if rng.random() < 0.7 else f"{rng.choice(_PLAIN)}-{names}"
        tag = _ELEMENT.get(kind, "div") if rng.random() < 0.6 else str(rng.choice(["div", "section", "p"] if kind in ("advert", "notice") else ["div", "section"]))
        attribute = f' {rng.choice(["class", "id"])}="{names}"' if tag in ("div", "section", "p") or rng.random() < 0.4 else ""
        if kind == "menu" or rng.random() < 0.25:
            inner = "<ul>" + "".join(f"<li><a href='/x'>{text(1, 4, '', kind)}</a></li>" for _ in range(rng.integers(2, 9))) + "</ul>"
        elif kind == "form":
            inner = f"<label>{text(1, 5, '', kind)}</label><input><button>{text(1, 3, '', kind)}</button>"
        elif kind == "comment":
            inner = "".join(f"<div class='{rng.choice(_PARTS['comment'])}'><p>{text(3, 60, '', kind)}</p></div>" for _ in range(rng.integers(1, 5)))
        elif rng.random() < 0.5:
            inner = text(1, 40, "", kind)
        else:
            inner = "".join(f"<p>{text(2, 50, '', kind)}</p>" for _ in range(rng.integers(1, 4)))
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def prose() -> str:
        kind = rng.random()
        if kind < 0.7:
            return f"<p>{'<b>' if rng.random() < 0.1 else ''}{text(1, 120, chr(1))}" + ("</p>" if rng.random() < 0.85 else "<br>" + text(2, 40, chr(1)))
        if kind < 0.8:
            return f"<h{(n := rng.integers(2, 4))}>{text(1, 9, chr(1))}</h{n}>"
        if kind < 0.9:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{text(1, 25, chr(1))}</li>" for _ in range(rng.integers(1, 6))) + f"</{tag}>"
        tag = rng.choice(["blockquote", "pre", "td", "figcaption"])
        return f"<{tag}>{text(3, 40, chr(1))}</{tag}>"

    inside = [prose() for _ in range(rng.integers(1, 14) if rng.random() < 0.92 else rng.integers(60, 160))]
    if rng.random() < 0.5:
        for _ in range(rng.integers(1, 3)):
            inside.insert(rng.integers(1, len(inside) + 1), junk(str(rng.choice(["advert", "notice", "form", "share", "side", "comment"]))))
    title = f"<h1>{text(2, 14, chr(1))}</h1>" if rng.random() < 0.85 else ""
    if title and rng.random() < 0.2:
        title = f"<div class='title'>{title}</div>"
    wrapped = title + "".join(inside)
    which = rng.random()
    if which < 0.55:
        wrapped = f"<article>{wrapped}</article>"
    elif which < 0.7:
        wrapped = f"<main>{wrapped}</main>"
    elif which < 0.9:
        names = [*rng.choice(_MAIN, rng.integers(1, 3)), *rng.choice(_PLAIN, rng.integers(0, 2))]
        wrapped = f"<div class='{'-'.join(names)}'>{wrapped}</div>"
    elif which < 0.97:
        wrapped = f"<div class='{rng.choice(_PLAIN)}'>{wrapped}</div>"
    if rng.random() < 0.4:
        wrapped = f"<div class='{'-'.join(rng.choice(_PLAIN, rng.integers(1, 3)))}'>{wrapped}</div>"
    if rng.random() < 0.3:
        wrapped = f"<{(t := rng.choice(['main', 'div', 'section']))}>{wrapped}</{t}>"
    before = [junk(str(rng.choice(["menu", "header", "notice", "advert", "form", "side"]))) for _ in range(rng.integers(0, 4))]
    after = [junk(str(rng.choice(["footer", "comment", "side", "advert", "form", "notice", "share", "menu"]))) for _ in range(rng.integers(0, 5))]
    page = "<html><body>" + "".join(before) + wrapped + "".join(after) + "</body></html>"
    return [(t.replace("\x01", ""), path, linked, int("\x01" in t)) for t, path, linked in blocks(page)]


@functools.lru_cache(2)
def trained(pages: int = 600, rounds: int = 14, seed: int = 11) -> Labeller:
    """The labeller, fitted on a fixed number of generated pages; the same for the same parameters."""
    rng = np.random.default_rng(seed)
    made = [p for p in (training_page(rng) for _ in range(pages)) if p]
    model = Labeller()
    model.fit([(vectors([b[:3] for b in p]), np.array([b[3] for b in p], np.float32)) for p in made], rounds)
    return model


def stored(spark: SparkSession, pages: int = 600, rounds: int = 14, seed: int = 11) -> Labeller:
    """trained(), from the shared folder if a run with the same parameters and code has left it there."""
    key = hashlib.sha256(repr((pages, rounds, seed, WIDTH, HIDDEN, inspect.getsource(training_page), _PARTS, _SAYS)).encode()).hexdigest()[:16]
    path, model = f"{shared_dir(spark)}/html-labeller-{key}", Labeller()
    try:
        found = {r["name"]: np.frombuffer(r["value"], np.float32) for r in spark.read.schema("name string, value binary").parquet(path).collect()}  # a few rows
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = {}
    if found.keys() == model.w.keys():
        model.w = {k: found[k].reshape(v.shape) for k, v in model.w.items()}
        return model
    model = trained(pages, rounds, seed)
    rows = [(k, v.astype(np.float32).tobytes()) for k, v in model.w.items()]
    spark.createDataFrame(rows, "name string, value binary").coalesce(1).write.mode("ignore").parquet(path)
    return model


def main_blocks(model: Labeller, pages: list[list[Block]], threshold: float = 0.5) -> list[list[str]]:
    """The texts of the blocks that the labeller takes for main text, page by page."""
    out: list[list[str]] = [[] for _ in pages]
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < min(len(order), at + PAGES_TOGETHER) and len(pages[order[end]]) * (end + 1 - at) <= BLOCKS_TOGETHER:
            end += 1
        own, at = order[at:end], end
        if len(pages[own[0]]) > BLOCKS_TOGETHER:
            score = model.label_long(pages[own[0]])[:, None]
        else:
            x, mask, _ = padded([vectors(pages[i]) for i in own])
            score = model.label(x, mask)
        for n, i in enumerate(own):
            out[i] = [b[0] for b, s in zip(pages[i], score[:, n], strict=False) if s >= threshold]
    return out


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Labeller | None = None, text_col: str = "text") -> DataFrame:
    """The columns of `keep` and text, the main text of each page: its blocks in page order, joined by one space.

    A null or empty page, or one without main text, has an empty text. Rows keep their number; repeated rows give the
    same text; other columns are not read. A block whose score is exactly the threshold is main text.
    """
    model = model or stored(pages.sparkSession)
    rows = pages.select(*keep, F.col(html_col).cast("string").alias(unused("html", pages.select(*keep))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
            at = size = 0
            for i, n in enumerate(sizes, 1):
                size += n
                if size >= CHARS_TOGETHER or i - at == 4 * PAGES_TOGETHER or i == len(sizes):
                    part = batch.slice(at, i - at)
                    found = main_blocks(model, [blocks(x or "") for x in part.column(part.num_columns - 1).to_pylist()])
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([" ".join(x) for x in found], pa.string())], [*keep, text_col])
                    at, size = i, 0

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, `{text_col}` string")
