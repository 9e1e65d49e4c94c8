"""HTML main text by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags.  Each
block is a vector of its hashed tag path (tag names, classes, ids, roles of
its ancestors), its hashed words and a few figures.  A bidirectional LSTM
reads the blocks of a page in order and labels every block as article or
not, so a label depends on the whole page.  The article's blocks, white space folded, are
joined in page order.

The model is trained here, in numpy: on at most ``SAMPLE`` pages of the
table, labelled by their own structure (distant labels from semantic tags
and telling class names), and on generated layouts with sidebars, forms,
notices, comments and other parts that tables may lack.  For some training
pages the paths are hidden, so that words, figures and context count too.

Cases: null and empty pages have no text; broken and truncated markup is
read as far as it goes (an unfinished tag at the end is dropped, an unclosed
script hides the rest); an empty table trains on generated pages alone;
repeated rows give equal results; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.words import find_words, lower_ascii, slices, text_bytes, word_hashes

#: Parameters: bound of the pages of the table that are used for training, and of generated ones.
SAMPLE, GENERATED = 300, 300
HIDDEN, EPOCHS, RATE = 16, 8, 0.01
PATH_DIMS, WORD_DIMS, FIGURES = 64, 32, 8
DIMS = PATH_DIMS + WORD_DIMS + FIGURES
#: Cells (pages x blocks) of one padded batch.
BATCH_CELLS = 1 << 15

#: Fixed values of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg math select".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
                     "h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                "th": ("td", "th"), "option": ("option",)}
#: Fixed values of the distant labels.
NOT_MAIN_TAGS = frozenset("nav header footer aside form menu button label select noscript dialog head".split())
NOT_MAIN_NAMES = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies "
                           "disclaimer footer header login menu nav navbar navigation newsletter notice pager popup "
                           "promo promoted related reply replies respond share sharing sidebar signup social sponsor "
                           "sponsored subscribe toolbar widget".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"""
                  r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    text: str
    path: tuple[tuple[str, ...], ...]  # per ancestor: tag and names
    linked: int


def _names(attributes: str) -> tuple[str, ...]:
    out: list[str] = []
    for key, value in _ATTR.findall(attributes):
        key = key.lower()
        if key in ("hidden", "aria-hidden"):
            if "false" not in value:
                out.append("#hidden")
        else:
            out.extend(_NAME.findall(value.lower()))
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order; text is decoded and folded, empty blocks are left out."""
    out: list[Block] = []
    stack: list[tuple[str, ...]] = []
    held: list[tuple[str, bool]] = []

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(t for t, _ in held))).strip()
            if text:
                path = tuple(e for e in stack if e[0] not in INLINE or len(e) > 1)
                out.append(Block(text, path, sum(len(t) for t, link in held if link)))
            held.clear()

    def pop_to(names: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at, links = 0, 0
    while True:
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            held.append((page[at:end], links > 0))
        if m is None:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing = name.lower(), m[1] or m[4]
        if m[2] is None and not page.endswith(">", 0, at):
            break  # a tag that the end of the page cuts off
        if closing:
            if name in INLINE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i]
                        links -= name == "a"
                        break
                    if stack[i][0] not in INLINE:
                        break
            else:
                flush()
                pop_to((name,))
                links = sum(e[0] == "a" for e in stack)
            continue
        attributes = m[3] if m[2] else m[6]
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            if name not in INLINE:
                flush()
            at = len(page) if close is None else close.start()
            if close is not None and (gt := page.find(">", at)) >= 0:
                at = gt + 1
            elif close is not None:
                at = len(page)
            continue
        if name == "br":
            held.append((" ", False))
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES_P:
                pop_to(("p",), ("article", "div", "section", "td", "li", "body", "main", "aside", "form", "blockquote"))
            elif name in SELF_CLOSING:
                pop_to(SELF_CLOSING[name], ("ul", "ol", "dl", "table", "select"))
            links = sum(e[0] == "a" for e in stack)
        if name not in VOID and not attributes.endswith("/"):
            stack.append((name, *_names(attributes)))
            links += name == "a"
    flush()
    return out


def structure_label(b: Block) -> bool:
    """Distant label: article text by the page's own structure."""
    for e in b.path:
        if e[0] in NOT_MAIN_TAGS or not NOT_MAIN_NAMES.isdisjoint(e[1:]) or "#hidden" in e:
            return False
    return any(e[0] in ("article", "main") for e in b.path) or b.path[-1:] and b.path[-1][0] in (
        "p", "h1", "h2", "h3", "h4", "blockquote", "pre", "li", "td", "dd", "figcaption") or False


# --------------------------------------------------------------------------
# vectors
# --------------------------------------------------------------------------
@lru_cache(maxsize=50_000)
def _path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    v = np.zeros(PATH_DIMS, np.float32)
    tokens = [t if i == 0 else "." + t for e in path for i, t in enumerate(e)]
    if path:
        tokens.append("last:" + path[-1][0])
    for t in tokens:
        v[zlib.crc32(t.encode()) % PATH_DIMS] = 1
    return v


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """One row per block of all pages."""
    every = [b for p in pages for b in p]
    out = np.zeros((len(every), DIMS), np.float32)
    if not every:
        return out
    column = pa.array([b.text for b in every], pa.large_string())
    done = 0
    for x, y in slices(column):
        data, bounds = text_bytes(column.slice(x, y - x))
        w = find_words(lower_ascii(data), bounds)
        n = np.diff(w.ptr)
        owner = np.repeat(np.arange(y - x), n)
        count = np.bincount(owner * WORD_DIMS + (word_hashes(w) & np.uint64(WORD_DIMS - 1)).astype(np.int64),
                            minlength=(y - x) * WORD_DIMS).reshape(y - x, WORD_DIMS)
        norm = np.sqrt((count**2).sum(1, keepdims=True))
        out[x:y, PATH_DIMS:PATH_DIMS + WORD_DIMS] = count / np.maximum(norm, 1)
        out[x:y, -1] = np.log1p(n) / 5
        signs = np.add.reduceat(np.concatenate((np.isin(data, (33, 44, 46, 59, 63)), [0])), bounds[:-1]) \
            if len(data) else np.zeros(y - x)
        out[x:y, -2] = np.minimum(1, signs / np.maximum(1, n))
        done = y
    for i, b in enumerate(every):
        out[i, :PATH_DIMS] = _path_vector(b.path)
        out[i, -3] = min(1.0, b.linked / len(b.text))
        out[i, -4] = len(b.path) / 10
    at = 0
    for p in pages:
        if p:
            out[at:at + len(p), -5] = np.linspace(0, 1, len(p))
            at += len(p)
    return out


# --------------------------------------------------------------------------
# network
# --------------------------------------------------------------------------
def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pass(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, mask: np.ndarray, keep: bool):
    """One direction over (steps, pages, dims); padded steps carry the state on."""
    steps, n, _ = x.shape
    h = np.zeros((n, HIDDEN), np.float32)
    c = np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((steps, n, HIDDEN), np.float32)
    trace = []
    fed = x @ w + b
    for t in range(steps):
        z = fed[t] + h @ u
        i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN:])
        m = mask[t][:, None]
        new = f * c + i * g
        tc = np.tanh(new)
        if keep:
            trace.append((h, c, i, f, o, g, tc, m))
        c = m * new + (1 - m) * c
        h = m * (o * tc) + (1 - m) * h
        out[t] = h
    return out, trace


def _back(x: np.ndarray, u: np.ndarray, d_out: np.ndarray, trace: list):
    """Gradients of one direction."""
    dw, du = np.zeros((x.shape[2], 4 * HIDDEN), np.float32), np.zeros_like(u)
    db = np.zeros(4 * HIDDEN, np.float32)
    dh = np.zeros_like(d_out[0])
    dc = np.zeros_like(d_out[0])
    for t in range(len(trace) - 1, -1, -1):
        h, c, i, f, o, g, tc, m = trace[t]
        dh = dh + d_out[t]
        dn = dh * m * o * (1 - tc * tc) + dc * m
        z = np.concatenate((dn * g * i * (1 - i), dn * c * f * (1 - f), dh * m * tc * o * (1 - o),
                            dn * i * (1 - g * g)), 1)
        dw += x[t].T @ z
        du += h.T @ z
        db += z.sum(0)
        dh = z @ u.T + dh * (1 - m)
        dc = dn * f + dc * (1 - m)
    return dw, du, db


class Labeller:
    """Bidirectional LSTM with a logistic output per block; the output also sees the block itself."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["w" + d] = r.normal(0, 0.1, (DIMS, 4 * HIDDEN)).astype(np.float32)
            self.p["u" + d] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p["b" + d] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN))).astype(np.float32)
        self.p["v"] = r.normal(0, 0.1, (2 * HIDDEN + DIMS, 1)).astype(np.float32)
        self.p["a"] = np.zeros(1, np.float32)

    @staticmethod
    def pad(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(map(len, x))
        out = np.zeros((steps, len(x), DIMS), np.float32)
        mask = np.zeros((steps, len(x)), np.float32)
        for i, v in enumerate(x):
            out[:len(v), i] = v
            mask[:len(v), i] = 1
        return out, mask

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        p = self.p
        hf, tf = _pass(x, p["wf"], p["uf"], p["bf"], mask, keep)
        hb, tb = _pass(x[::-1], p["wb"], p["ub"], p["bb"], mask[::-1], keep)
        top = np.concatenate((hf, hb[::-1], x), 2)
        return _sigmoid(top @ p["v"] + p["a"])[:, :, 0], top, tf, tb

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        out, top, tf, tb = self.run(x, mask, keep=True)
        d = ((out - y) * mask / mask.sum())[:, :, None].astype(np.float32)
        g = {"v": np.einsum("tnk,tno->ko", top, d), "a": d.sum((0, 1))}
        dt = d @ self.p["v"].T
        g["wf"], g["uf"], g["bf"] = _back(x, self.p["uf"], dt[:, :, :HIDDEN], tf)
        g["wb"], g["ub"], g["bb"] = _back(x[::-1], self.p["ub"], dt[::-1, :, HIDDEN:2 * HIDDEN], tb)
        return g

    def fit(self, x: list[np.ndarray], y: list[np.ndarray], epochs: int = EPOCHS, batch: int = 32) -> "Labeller":
        r = np.random.default_rng(1)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        n = 0
        for _ in range(epochs):
            # pages of like length together
            order = sorted(r.permutation(len(x)), key=lambda i: len(x[i]) + r.random() * 8)
            parts = [order[k:k + batch] for k in range(0, len(order), batch)]
            for k in r.permutation(len(parts)):
                feats = []
                for i in parts[k]:
                    v = x[i].copy()
                    if r.random() < 0.25:  # hide the paths
                        v[:, :PATH_DIMS] = 0
                    feats.append(v)
                xs, mask = self.pad(feats)
                ys = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(parts[k]):
                    ys[:len(y[i]), j] = y[i]
                n += 1
                for name, g in self.step(xs, mask, ys).items():
                    g = np.clip(g, -1, 1)
                    a, b = m[name]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    self.p[name] -= RATE * (a / (1 - 0.9**n)) / (np.sqrt(b / (1 - 0.999**n)) + 1e-8)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probability of article text for each block."""
        x = vectors(pages)
        ends = np.cumsum([len(p) for p in pages])
        parts = [x[e - len(p):e] for p, e in zip(pages, ends)]
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if pages[i]]
        k = 0
        while k < len(order):
            z = k + 1
            while z < len(order) and (z - k + 1) * len(pages[order[z]]) <= BATCH_CELLS:
                z += 1
            xs, mask = self.pad([parts[i] for i in order[k:z]])
            p = self.run(xs, mask)[0]
            for j, i in enumerate(order[k:z]):
                out[i] = p[:len(pages[i]), j]
            k = z
        return out


# --------------------------------------------------------------------------
# generated training pages
# --------------------------------------------------------------------------
def generated_page(r: np.random.Generator) -> tuple[str, set[str]]:
    """A layout with marked paragraphs: markup, and the texts of the article's blocks."""
    parts = "ka lo mi nu re sa to vi xe zu be da fo gi hu".split()
    word = lambda: "".join(r.choice(parts, r.integers(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.integers(a, b)))
    pick = lambda *x: x[r.integers(len(x))]
    main: set[str] = set()

    def own(tag: str, a: int, b: int) -> str:
        text = (words(a, b) + pick(".", ".", "", "!")).capitalize()
        main.add(text)
        return f"<{tag}>{text}</{tag}>"

    def links(tag: str, name: str) -> str:
        items = "".join(f'<li><a href="/x">{words(1, 4)}</a></li>' for _ in range(r.integers(3, 9)))
        return f'<{tag}{name}><ul>{items}</ul></{tag}>'

    def other(kind: str) -> str:
        if kind == "nav":
            return links(pick("nav", "div", "div"), pick("", ' class="menu"', ' id="nav"', ' class="navbar"'))
        if kind == "header":
            return f'<{(t := pick("header", "div"))} class="{pick("header", "banner", "top header")}"><span>{words(1, 4)}</span><p>{words(2, 8)}</p></{t}>'
        if kind == "aside":
            t = pick("aside", "div")
            return f'<{t} class="{pick("sidebar", "widget", "related")}"><h3>{words(1, 4)}</h3><p>{words(4, 25)}.</p>{links("div", "")}</{t}>'
        if kind == "ad":
            return f'<div class="{pick("ad", "ads", "advert", "promo", "sponsored")}">{pick("", "<p>")}{words(3, 20)}.</div>'
        if kind == "notice":
            return f'<div class="{pick("cookie", "notice", "popup", "newsletter")}"><p>{words(5, 25)}.</p><button>{words(1, 3)}</button></div>'
        if kind == "form":
            return f'<form><label>{words(1, 3)}</label><input><p>{words(3, 12)}</p><button>{words(1, 2)}</button></form>'
        if kind == "comments":
            some = "".join(f'<div class="comment"><b>{word()}</b><p>{words(4, 40)}.</p></div>' for _ in range(r.integers(1, 7)))
            return f'<{(t := pick("section", "div"))} {pick("id", "class")}="comments"><h3>{words(1, 3)}</h3>{some}</{t}>'
        return f'<{(t := pick("footer", "div"))} class="footer"><p>&copy; {words(2, 10)}</p>{pick("", links("div", ""))}</{t}>'

    body = [own("h1", 3, 12)]
    for _ in range(r.integers(1, 14)):
        kind = r.random()
        if kind < 0.75:
            body.append(own("p", 5, 90))
        elif kind < 0.82:
            body.append(own("h2", 2, 8))
        elif kind < 0.9:
            body.append("<ul>" + "".join(own("li", 2, 20) for _ in range(r.integers(2, 5))) + "</ul>")
        elif kind < 0.94:
            body.append(own("blockquote", 5, 40))
        else:
            body.append(other(pick("ad", "aside", "form")))
    tag, name = pick(("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'),
                     ("div", ' id="article"'), ("section", ' class="entry"'))
    before = [other(k) for k in ("header", "nav", "notice", "ad") if r.random() < 0.5]
    after = [other(k) for k in ("ad", "comments", "aside", "form", "footer") if r.random() < 0.5]
    return (f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(before)}<{tag}{name}>{''.join(body)}"
            f"</{tag}>{''.join(after)}</body></html>"), main


def train(sample: list[str]) -> Labeller:
    """Model from pages with distant labels and from generated pages."""
    pages, labels = [], []
    for text in sample:
        found = blocks(text)
        if found:
            pages.append(found)
            labels.append(np.array([structure_label(b) for b in found], np.float32))
    r = np.random.default_rng(17)
    for _ in range(GENERATED):
        text, main = generated_page(r)
        found = blocks(text)
        pages.append(found)
        labels.append(np.array([b.text in main for b in found], np.float32))
    x = vectors(pages)
    ends = np.cumsum([len(p) for p in pages])
    return Labeller().fit([x[e - len(p):e] for p, e in zip(pages, ends)], labels)


def label_blocks(pages: DataFrame, model: Labeller, page_id: str = "page_id", url: str = "url",
                 markup: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) per page."""
    id_kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(2)
            for x, y in slices(column, 8 << 20):
                cut = [blocks(t or "") for t in column.slice(x, y - x).to_pylist()]
                kept = [[k.text for k, p in zip(c, probs) if p > 0.5] for c, probs in zip(cut, model.label(cut))]
                text = [" ".join(k) for k in kept]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(x, y - x), b.column(1).slice(x, y - x), pa.array(text, pa.string()),
                     pa.array([len(t) for t in text], pa.int64()), pa.array([len(c) for c in cut], pa.int64()),
                     pa.array([len(k) for k in kept], pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    return pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(markup).cast("string").alias("html")) \
        .mapInArrow(run, f"page_id {id_kind}, url string, text string, n_chars long, n_blocks long, n_main long")


def extract(pages: DataFrame, sample: int = SAMPLE, page_id: str = "page_id", markup: str = "html") -> DataFrame:
    """Main text of every page, with a model fitted on at most ``sample`` of them."""
    n = pages.count()
    share = min(1.0, 0.8 * sample / max(1, n))
    picked = pages.where(F.pmod(F.xxhash64(page_id), F.lit(1 << 30)) < int(share * (1 << 30))) \
        .select(page_id, F.col(markup).cast("string").alias("html")).where("html is not null").limit(sample).toArrow()
    rows = sorted(zip(picked[0].to_pylist(), picked[1].to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return label_blocks(pages, train([r[1] for r in rows]), page_id=page_id, markup=markup)


def op8_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("n_blocks", "n_main")
