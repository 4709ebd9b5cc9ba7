"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: the text directly inside a block element. A block is
described by hashed vectors of its tag path (tags, classes and ids from the root) and of
its words, and a few counts. A bidirectional LSTM (numpy) reads the sequence of a page's
blocks, so every block is judged in the context of the whole page, and a logistic layer
keeps or drops it. Pages are read in one pass without a shuffle; equal lengths run as
one batch.

No page is labelled, so the network learns from structure: in a bounded sample of pages
(``SAMPLE``, drawn by hash, of at most ``LONGEST`` characters) blocks inside article
elements are content and those in menus, footers, notices and the like are not; the same
texts are then laid out anew in other templates (plain divisions, sidebars, forms,
comment lists), so that no single tag decides.

Defined cases: null and empty html has an empty text; unclosed and misnested elements
close as browsers close them in the usual cases; an unclosed comment, script or style
runs to the end; a page without a content block has an empty text; repeated rows are rows
of their own; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import words_in

SAMPLE = 160
LONGEST = 60_000
VARIANTS = 3
HIDDEN = 16
PATH_DIM = 32
WORD_DIM = 16
COUNTS = 4
EPOCHS = 14
SEED = 9

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style title textarea noscript template iframe svg object select".split())
# An element that a new one of the second kind closes.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
KEEP = "data-keep"

_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def leaf_blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """Path tokens, text and share of link text of every leaf block, in page order."""
    out: list = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((tuple(t for _, own in stack for t in own), text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def say(raw: str):
        nonlocal linked
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if any(tag == "a" for tag, _ in stack):
            linked += len(text)

    at = 0
    while at < len(page):
        m = _OPEN.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
            continue
        rest = _REST.match(page, m.end())
        end = rest.end()
        if page[end : end + 1] != ">":
            end = page.find(">", m.end())
            end = len(page) if end < 0 else end
        attributes = page[m.end() : end]
        at = end + 1
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            if any(tag == t for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag == "br":
            parts.append(" ")
        if tag in SILENT and not attributes.endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in BLOCKS:
            flush()
            names = [t for t, _ in stack]
            if "p" in names:
                cut = len(names) - 1 - names[::-1].index("p")
                del stack[cut:]
            for closed in reversed(stack):
                if closed[0] in CLOSED_BY.get(tag, ()):
                    while stack.pop()[0] != closed[0]:
                        pass
                    break
                if closed[0] in ("ul", "ol", "dl", "table", "select", "div"):
                    break
        if tag not in VOID:
            own = [tag]
            for k, v in _NAMED.findall(attributes) if attributes.strip() else ():
                own += [f"{k.lower()}={w}" for w in re.split(r"[\s_-]+", v.strip("\"'").lower()) if w]
            if KEEP in attributes:
                own.append(KEEP)
            stack.append((tag, tuple(own)))
    flush()
    return out


def _hashed(token: str, dim: int) -> np.ndarray:
    out = np.zeros(dim, np.float32)
    for k in range(4):
        h = zlib.crc32(f"{k}:{token}".encode())
        out[h % dim] += 1.0 if h >> 16 & 1 else -1.0
    return out


@functools.lru_cache(maxsize=20_000)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    tokens = [t for t in path if t not in (KEEP, "html", "body")] or ["body"]
    return sum(_hashed(t, PATH_DIM) for t in tokens) / np.sqrt(len(tokens))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_RIM = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def inputs(pages: list[list]) -> list[np.ndarray]:
    """The vectors of every block of every page."""
    leaves = [leaf for page in pages for leaf in page]
    if not leaves:
        return [np.zeros((0, PATH_DIM + WORD_DIM + COUNTS), np.float32) for _ in pages]
    raw = [leaf[1].encode("utf-8") for leaf in leaves]
    text = _FOLD[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    edges = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    start, _, word = words_in(text, _RIM[text])
    row = np.searchsorted(edges, start, side="right") - 1
    count = np.bincount(row, minlength=len(leaves))
    sign = np.where(word >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    cell = row * WORD_DIM + (word % np.uint64(WORD_DIM)).astype(np.int64)
    words = np.bincount(cell, sign, len(leaves) * WORD_DIM).reshape(-1, WORD_DIM) / np.sqrt(np.maximum(count, 1))[:, None]
    x = np.empty((len(leaves), PATH_DIM + WORD_DIM + COUNTS), np.float32)
    x[:, :PATH_DIM] = np.stack([path_vector(leaf[0]) for leaf in leaves])
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = 0.3 * words
    x[:, -4] = np.log1p(count) / 5
    x[:, -3] = [leaf[2] for leaf in leaves]
    x[:, -2] = [leaf[1].endswith((".", "!", "?")) for leaf in leaves]
    sizes = [len(p) for p in pages]
    x[:, -1] = np.concatenate([np.linspace(0, 1, n) for n in sizes if n])
    return np.split(x, np.cumsum(sizes)[:-1])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


CELLS = 1 << 16  # blocks of one padded batch of pages


class Labeller:
    """A bidirectional LSTM with a logistic layer over both directions' states."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d, h = PATH_DIM + WORD_DIM + COUNTS, HIDDEN
        self.w = {}
        for s in "fb":
            self.w[f"x{s}"] = rng.normal(0, 0.2, (d, 4 * h))
            self.w[f"h{s}"] = rng.normal(0, 0.2, (h, 4 * h))
            self.w[f"c{s}"] = np.repeat([0.0, 1.0, 0.0, 0.0], h)  # forget gates start open
        self.w["o"] = rng.normal(0, 0.2, 2 * h)
        self.w["b"] = np.zeros(1)

    def _run(self, x, mask, s, keep=None):
        n, steps, _ = x.shape
        z = x @ self.w[f"x{s}"] + self.w[f"c{s}"]
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out = np.zeros((n, steps, HIDDEN))
        for t in range(steps) if s == "f" else range(steps - 1, -1, -1):
            a = z[:, t] + h @ self.w[f"h{s}"]
            gates = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new = (f * c + i * g) * m
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh, m))
            c, h = new, o * tanh * m
            out[:, t] = h
        return out

    def probabilities(self, x, mask):
        both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], 2)
        return _sigmoid(both @ self.w["o"] + self.w["b"])

    def gradients(self, x, mask, y):
        kept = {"f": [], "b": []}
        outs = {s: self._run(x, mask, s, kept[s]) for s in "fb"}
        both = np.concatenate([outs["f"], outs["b"]], 2)
        p = _sigmoid(both @ self.w["o"] + self.w["b"])
        d = (p - y) * mask / mask.sum()
        grad = {"o": np.einsum("nt,ntk->k", d, both), "b": np.array([d.sum()])}
        for s, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            flow = d[:, :, None] * self.w["o"][half]
            gx, gh, gc = (np.zeros_like(self.w[f"{k}{s}"]) for k in "xhc")
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for t, h, c, i, f, o, g, tanh, m in reversed(kept[s]):
                dh = (dh + flow[:, t]) * m
                dc = (dc + dh * o * (1 - tanh**2)) * m
                a = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g**2)], 1)
                gx += x[:, t].T @ a
                gh += h.T @ a
                gc += a.sum(0)
                dh, dc = a @ self.w[f"h{s}"].T, dc * f
            grad |= {f"x{s}": gx, f"h{s}": gh, f"c{s}": gc}
        return grad

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> None:
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        groups = batches(pages, 16)
        step = 0
        for epoch in range(EPOCHS):
            for g in rng.permutation(len(groups)):
                x, mask = padded([pages[r] for r in groups[g]])
                y = np.zeros(mask.shape)
                for j, r in enumerate(groups[g]):
                    y[j, : len(labels[r])] = labels[r]
                step += 1
                lr = 0.01 * (1 - epoch / EPOCHS) + 0.0005
                for k, d in self.gradients(x, mask, y).items():
                    d = np.clip(d, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d**2
                    self.w[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def keep(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For every page which blocks stay; pages of like length run together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        for part in batches(pages, 64):
            if not len(pages[part[-1]]):
                continue
            x, mask = padded([pages[i] for i in part])
            p = self.probabilities(x, mask)
            for j, i in enumerate(part):
                out[i] = p[j, : len(pages[i])] >= 0.5
        return out


def batches(pages: list[np.ndarray], most: int) -> list[list[int]]:
    """Pages of like length together: at most ``most``, and no more than fit ``CELLS`` blocks
    once padded, so that a very long page runs alone instead of stretching its neighbours."""
    out: list[list[int]] = []
    for i in np.argsort([len(p) for p in pages], kind="stable"):
        if not out or len(out[-1]) == most or (len(out[-1]) + 1) * len(pages[i]) > CELLS:
            out.append([])
        out[-1].append(int(i))
    return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32), np.zeros((len(pages), steps))
    for j, p in enumerate(pages):
        x[j, : len(p)], mask[j, : len(p)] = p, 1
    return x, mask


ASIDE = frozenset(
    "nav aside header footer form menu sidebar ad ads advert advertisement promo banner notice cookie comment comments "
    "related share social breadcrumb breadcrumbs widget newsletter subscribe button".split()
)


def by_structure(path: tuple[str, ...]) -> bool:
    """The label of a block in a page that names its parts: inside an article, and in nothing beside it."""
    names = {t.partition("=")[2] or t for t in path}
    return bool(names & {"article", "main"}) and not names & ASIDE


def _short(rng: random.Random, texts: list[str], n: int) -> str:
    words = rng.choice(texts).split()
    lo = rng.randrange(max(1, len(words) - n))
    return entities.escape(" ".join(words[lo : lo + rng.randint(1, n)]))


def laid_out(rng: random.Random, content: list[str], other: list[str]) -> str:
    """The given content in a random template, with parts beside it that use the texts of ``other``."""
    s = lambda n: _short(rng, other, n)
    items = lambda n: "".join(f"<li><a href='/x'>{s(3)}</a></li>" for _ in range(n))
    prose = lambda: "".join(f"<p>{entities.escape(t[:600])}</p>" for t in rng.sample(other, min(len(other), rng.randint(1, 3))))
    pick = rng.choice
    menu = lambda: pick([f"<nav><ul>{items(6)}</ul></nav>", f"<div class='menu'><ul>{items(5)}</ul></div>", f"<ul id='nav'>{items(4)}</ul>", f"<div class='breadcrumb'><a href='/'>{s(2)}</a> &gt; <a href='/b'>{s(2)}</a></div>", f"<nav class='nav'><a href='/'>{s(2)}</a> <a href='/c'>{s(2)}</a></nav>"])
    head = lambda: pick([f"<header><h1>{s(4)}</h1><p>{s(8)}</p></header>", f"<div class='header'><a href='/'>{s(3)}</a></div>", f"<div id='header'><h2>{s(3)}</h2></div>", ""])
    side = lambda: pick([f"<aside><h3>{s(3)}</h3>{prose()}</aside>", f"<div class='sidebar'><h4>{s(3)}</h4><ul>{items(4)}</ul>{prose()}</div>", f"<aside class='sidebar'><p>{s(20)}</p></aside>", f"<div id='sidebar'><p>{s(12)}</p></div>", f"<div class='related'><h3>{s(2)}</h3><ul>{items(3)}</ul></div>", f"<section class='widget'><p>{s(15)}</p></section>"])
    ad = lambda: pick([f"<div class='ad'>{s(12)}</div>", f"<div class='advert'><p>{s(15)}</p></div>", f"<div class='ads banner'><a href='/ad'>{s(8)}</a></div>", f"<div class='promo'><p>{s(14)}</p></div>", f"<div class='sponsored ad'>{prose()}</div>", f"<section id='ad'><p>{s(10)}</p></section>"])
    note = lambda: pick([f"<div class='notice'><p>{s(16)}</p></div>", f"<div class='cookie banner'>{s(14)} <button>{s(1)}</button></div>", f"<p class='notice'>{s(12)}</p>", f"<div id='cookie-notice'><p>{s(15)}</p></div>", f"<div class='alert' role='alert'>{s(12)}</div>"])
    form = lambda: pick([f"<form><label>{s(2)}</label><input name='q'><button>{s(1)}</button></form>", f"<form class='subscribe'><p>{s(10)}</p><input><button>{s(2)}</button></form>", f"<div class='newsletter'><form><p>{s(12)}</p></form></div>", f"<form id='search'><fieldset><legend>{s(2)}</legend><p>{s(6)}</p></fieldset></form>"])
    remark = lambda: pick([f"<li class='comment'><b>{s(2)}</b><p>{s(40)}</p></li>", f"<div class='comment'><p>{s(2)}</p>{prose()}</div>", f"<article class='comment'><p>{s(30)}</p></article>", f"<li><cite>{s(2)}</cite><p>{s(30)}</p></li>"])
    many = "".join(remark() for _ in range(rng.randint(1, 5)))
    remarks = pick([f"<section id='comments'><h3>{s(2)}</h3>{many}</section>", f"<div class='comments'><h3>{s(2)}</h3><ol>{many}</ol></div>", f"<ul class='comment-list'>{many}</ul>", ""])
    foot = pick([f"<footer>&copy; {s(12)}</footer>", f"<footer><p>{s(10)}</p><ul>{items(3)}</ul></footer>", f"<div class='footer'><p>{s(12)}</p></div>", f"<div id='footer'>{s(8)}</div>", ""])
    blocks = []
    for k, t in enumerate(content):
        body = entities.escape(t)
        kinds = ["<p>{}</p>"] * 6 + ["<p><b>{}</b></p>", "<p><b>{}<br>", "<p>{}", "<div>{}</div>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<p>{}<br></p>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>"]
        blocks.append((pick(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<p>{}</p>"]) if k == 0 else pick(kinds)).format(body))
    inside = [side(), ad(), note(), form()]
    for _ in range(pick([0, 0, 1, 2])):
        part = pick(inside)
        blocks.insert(rng.randint(1, len(blocks)), f"</div>{part}<div {KEEP}>")
    shell = pick(["article", "article", "article", "main", "section class='post'", "div class='content'", "div id='content'", "div class='article-body'", "div class='post entry'", "div id='main'", "div class='story'"])
    body = f"<{shell}><div {KEEP}>{''.join(blocks)}</div></{shell.split()[0]}>"
    if rng.random() < 0.4:
        # The marks are not seen by the network; without a division of their own the path is shorter.
        body = f"<{shell} {KEEP}>{''.join(blocks).replace(f'</div>', '').replace(f'<div {KEEP}>', '')}</{shell.split()[0]}>" if "</div>" not in "".join(blocks) else body
    before, after = [menu() if rng.random() < 0.8 else "", head()], [remarks, foot]
    for part in (side, ad, note, form):
        if rng.random() < 0.45:
            pick([before, after]).insert(rng.randint(0, 1), part())
    rng.shuffle(before)
    wrapped = f"{''.join(before)}{body}{''.join(after)}"
    return pick(["{}", "<html><body>{}</body></html>", "<body><div class='wrapper'>{}</div></body>", "<div id='page'>{}"]).format(wrapped)


def fit(pages: DataFrame, key: str = "page_id", html: str = "html") -> Labeller:
    """Trained on at most ``2 * SAMPLE`` pages of the table and ``VARIANTS`` layouts of each."""
    known = pages.where(F.length(html).between(1, LONGEST))
    total = known.count()
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(29)), F.lit(1 << 30)) <= F.lit(int(min(1.0, SAMPLE / max(1, total)) * (1 << 30)))
    got = known.where(draw).select(F.col(key).alias("k"), F.col(html).alias("t")).limit(2 * SAMPLE).toArrow().sort_by([("k", "ascending"), ("t", "ascending")])
    rng = random.Random(SEED)
    real = [leaf_blocks(t) for t in got.column("t").to_pylist()]
    contents = [[b[1] for b in p if by_structure(b[0])] for p in real]
    known_pages = [(p, np.array([by_structure(b[0]) for b in p], float)) for p, c in zip(real, contents) if c]
    contents = [c for c in contents if c]
    if not contents:
        # Nothing to learn from: the layouts are filled with the words of this module.
        words = (__doc__ or "").split()
        contents = [[" ".join(words[i : i + 12]) for i in range(j, j + 80, 12)] for j in range(0, 60, 3)]
    texts = [t for c in contents for t in c]
    for c in contents:
        for _ in range(VARIANTS):
            own = [x[: rng.choice([60, 300, 1500])] for x in c[: rng.randint(1, 25)]]
            blocks = leaf_blocks(laid_out(rng, own, rng.sample(texts, min(len(texts), 8))))
            if blocks:
                known_pages.append((blocks, np.array([KEEP in b[0] for b in blocks], float)))
    net = Labeller()
    net.train(inputs([p for p, _ in known_pages]), [y for _, y in known_pages])
    return net


def extract(pages: DataFrame, net: Labeller, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: the blocks that stay, in page order, parted by an empty line."""
    spark = SparkSession.active()
    shared = spark.sparkContext.broadcast(net)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                blocks = [leaf_blocks(h.as_py() or "") for h in b.column(2)]
                stay = shared.value.keep(inputs(blocks))
                texts = ["\n\n".join(t for (_, t, _), k in zip(p, s) if k) for p, s in zip(blocks, stay)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages, fit(pages))
