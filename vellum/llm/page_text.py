"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags.  Each block
becomes a vector of its hashed tag path (names, classes and ids of its ancestors),
its hashed words and a few shares and positions.  A bidirectional LSTM in numpy
reads all blocks of the page and gives each the probability of being main text, so
every decision sees the whole page.  It is trained here on pages that a generator
invents with known blocks, in many layouts.

The text of a page is its main blocks: character references decoded (each run of text between
tags by itself), white space in a block turned into single spaces, blocks joined by line feeds in page order.
Contents of scripts, styles, templates, the head, text fields, drawings and embedded frames are never
blocks; formulas are text, and what stands in for scripts or objects is labelled like any other block.

Cases: null and empty pages, and pages without main text, give an empty string;
pages cut off inside a tag or a comment lose only that tag or comment; long pages are read
whole, the recurrent passes in runs of `STEPS` blocks that hand on their state; repeated rows are read each; an empty table gives no rows; extra columns are
kept, and a clash with a result column raises ValueError.
"""

from __future__ import annotations

import functools
import html as references
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .frames import append_columns

PATH, WORD, OTHER = 160, 40, 8
INPUT = PATH + WORD + OTHER
HIDDEN = 24
PAGES, EPOCHS, GROUP, RATE = 900, 14, 32, 0.01
#: Blocks of a page whose vectors are held at a time.
STEPS = 8192

#: Elements whose content is not text of the page.
SILENT = ("script", "style", "template", "svg", "textarea", "title", "iframe", "canvas")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br math mi mn mo ms mtext mrow mfrac msup msub msqrt".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a following one of the same set ends.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<svg\b(?>[^>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*+/>|<({'|'.join(SILENT)})\b(?>[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)/?>|</?[a-zA-Z][^>]*>?|<[!?][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    linked: int


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    found = [tag]
    if attributes and "=" in attributes:
        for groups in _NAMES.findall(attributes):
            found += [f".{x}" for x in _PARTS.split("".join(groups).lower()) if x]
    return tuple(found)


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, none of them empty."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text and not any(t == "head" for t, _ in stack):
                out.append(Block(text, tuple(x for t, names in stack if t not in INLINE for x in names), linked))
            held.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                held.append(references.unescape(token))
                if any(t == "a" for t, _ in stack):
                    linked += len(token)
            continue
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            close()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if inline and stack[k][0] not in INLINE:
                    break
            continue
        if tag in VOID:
            continue
        if not inline:
            while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p"):
                stack.pop()
            ends = CLOSED_BY.get(tag)
            if ends and stack and stack[-1][0] in ends:
                stack.pop()
            if tag == "body":
                stack = [x for x in stack if x[0] == "html"]
        stack.append((tag, _names(tag, m[4])))
    close()
    return out


def _hash(x: str, n: int) -> int:
    return zlib.crc32(x.encode("utf-8", "surrogatepass")) % n


def vectors(blocks: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """A row of INPUT numbers for each block of a page, or for those from number `first` on of a page of `total` blocks."""
    total = total or len(blocks)
    out = np.zeros((len(blocks), INPUT), np.float32)
    paths: dict[tuple[str, ...], list[int]] = {}
    for k, b in enumerate(blocks):
        at = paths.get(b.path)
        if at is None:
            at = paths[b.path] = [_hash(x, PATH) for x in {*b.path, f">{b.path[-1] if b.path else ''}"}]
        out[k, at] = 1
        words = b.text.split(" ")
        out[k, PATH : PATH + WORD] = np.bincount([_hash(w, WORD) for w in b.text.lower().split(" ")], minlength=WORD)
        n = len(b.text)
        out[k, PATH : PATH + WORD] = np.sqrt(out[k, PATH : PATH + WORD] / len(words)) * 2
        out[k, -OTHER:] = (
            np.log1p(n) / 6, min(1.0, b.linked / n), b.text[-1] in ".!?:;\"'", sum(map(b.text.count, ".,;")) / n * 10,
            (first + k) / total, np.log1p(total) / 5, len(words) < 5, len(b.path) / 10,
        )
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output for every block."""

    NAMES = ("f_x", "f_h", "f_b", "b_x", "b_h", "b_b", "o_w", "o_b")

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        small = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        self.p = {"f_x": small(INPUT, 4 * HIDDEN), "f_h": small(HIDDEN, 4 * HIDDEN), "f_b": bias, "b_x": small(INPUT, 4 * HIDDEN), "b_h": small(HIDDEN, 4 * HIDDEN), "b_b": bias.copy(), "o_w": small(2 * HIDDEN, 1), "o_b": np.zeros(1, np.float32)}

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool, before: tuple[np.ndarray, np.ndarray] | None = None):
        """Hidden states of one direction; time runs along the first axis of x (time, pages, INPUT).

        `before` has the state of the blocks before; without `keep` the second result is the state at the end.
        """
        wx, wh, b = self.p[side + "x"], self.p[side + "h"], self.p[side + "b"]
        steps, pages, _ = x.shape
        h, c = before or (np.zeros((pages, HIDDEN), np.float32),) * 2
        hs, memory = np.zeros((steps, pages, HIDDEN), np.float32), []
        drive = x.reshape(-1, INPUT) @ wx + b
        drive = drive.reshape(steps, pages, -1)
        for t in range(steps):
            z = drive[t] + h @ wh
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -20, 20)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            m = mask[t][:, None]
            out = o * np.tanh(new)
            if keep:
                memory.append((h, c, i, f, o, g, new, m))
            c, h = np.where(m, new, c), np.where(m, out, h)
            hs[t] = h
        return hs, memory if keep else (h, c)

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        forward, a = self._pass(x, mask, "f_", keep)
        backward, b = self._pass(x[::-1], mask[::-1], "b_", keep)
        both = np.concatenate([forward, backward[::-1]], axis=2)
        return (both @ self.p["o_w"])[:, :, 0] + self.p["o_b"], both, a, b

    def _back(self, x: np.ndarray, d_hs: np.ndarray, memory: list, side: str, grads: dict) -> None:
        wh = self.p[side + "h"]
        d_h = d_c = np.zeros_like(d_hs[0])
        d_z = np.zeros((*d_hs.shape[:2], 4 * HIDDEN), np.float32)
        for t in range(len(d_hs) - 1, -1, -1):
            h, c, i, f, o, g, new, m = memory[t]
            d_h = d_h + d_hs[t]
            live = np.where(m, d_h, 0)
            tanh = np.tanh(new)
            d_new = live * o * (1 - tanh * tanh) + np.where(m, d_c, 0)
            z = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), live * tanh * o * (1 - o), d_new * i * (1 - g * g)], axis=1)
            d_z[t] = z
            grads[side + "h"] += h.T @ z
            d_h = np.where(m, 0, d_h) + z @ wh.T
            d_c = np.where(m, d_new * f, d_c)
        flat = d_z.reshape(-1, 4 * HIDDEN)
        grads[side + "x"] += x.reshape(-1, INPUT).T @ flat
        grads[side + "b"] += flat.sum(0)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        s, both, a, b = self.logits(x, mask, True)
        n = mask.sum()
        loss = float((np.logaddexp(0, s) - y * s)[mask].sum() / n)
        d_s = np.where(mask, 1 / (1 + np.exp(-np.clip(s, -20, 20))) - y, 0).astype(np.float32)[:, :, None] / n
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["o_w"] += np.einsum("tph,tpo->ho", both, d_s)
        grads["o_b"] += d_s.sum((0, 1))
        d_both = d_s @ self.p["o_w"].T
        self._back(x, d_both[:, :, :HIDDEN], a, "f_", grads)
        self._back(x[::-1], d_both[::-1, :, HIDDEN:], b, "b_", grads)
        return loss, grads

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 3) -> Labeller:
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            order = order[np.argsort([len(pages[k][1]) // 8 for k in order], kind="stable")]
            groups = [order[at : at + GROUP] for at in range(0, len(order), GROUP)]
            for k in rng.permutation(len(groups)):
                x, mask = padded([pages[i][0] for i in groups[k]])
                y = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(groups[k]):
                    y[: len(pages[i][1]), j] = pages[i][1]
                _, grads = self.gradients(x, mask, y)
                step += 1
                for name, g in grads.items():
                    g = np.clip(g, -1, 1)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.p[name] = self.p[name] - np.float32(RATE) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + np.float32(1e-7))
        return self

    def label_long(self, blocks: list[Block]) -> np.ndarray:
        """Whether each block of one long page is main text: both directions in runs of STEPS blocks, of which only a number a block is kept."""
        score = np.full(len(blocks), self.p["o_b"][0], np.float32)
        starts = list(range(0, len(blocks), STEPS))
        for side, order, weight in (("f_", starts, self.p["o_w"][:HIDDEN, 0]), ("b_", starts[::-1], self.p["o_w"][HIDDEN:, 0])):
            state, turn = None, 1 if side == "f_" else -1
            for at in order:
                x = vectors(blocks[at : at + STEPS], at, len(blocks))[::turn, None]
                hs, state = self._pass(x, np.ones(x.shape[:2], bool), side, False, state)
                score[at : at + STEPS] += (hs[:, 0] @ weight)[::turn]
        return score > 0

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < 256 and len(pages[order[to]]) * (to - at + 1) <= 20_000:
                to += 1
            x, mask = padded([pages[k] for k in order[at:to]])
            s = self.logits(x, mask)[0]
            for j, k in enumerate(order[at:to]):
                out[k] = s[: len(pages[k]), j] > 0
            at = to
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), bool)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, True
    return x, mask


#: Names that real pages commonly give to their parts.
PARTS = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs tabs toc links skip pager pagination",
    "header": "header masthead banner site-header top topbar logo branding page-header",
    "footer": "footer site-footer bottom copyright legal colophon credits page-footer",
    "side": "sidebar side aside rail widget widgets related recommended popular trending tags author-box",
    "ad": "ad ads advert advertisement sponsored promo promotion banner-ad adslot sponsor",
    "notice": "cookie cookies consent notice alert gdpr banner popup modal newsletter subscribe overlay paywall message",
    "comments": "comments comment reply discussion responses comment-list disqus thread reader-comments",
    "form": "form search login signup contact newsletter-form subscribe-form search-form",
    "share": "share social sharing follow buttons toolbar meta byline",
}
MAIN = "content main article post entry story body text post-content entry-content article-body main-content page-content story-body"
PHRASES = "Home;About us;Contact;Log in;Sign up;Read more;Share;Tweet;Reply;Subscribe;Accept all cookies;We use cookies;Privacy policy;Terms of use;All rights reserved;Advertisement;Sponsored;Related articles;Comments;Leave a comment;Search;Menu;Next;Previous;Back to top;Follow us;Newsletter;Submit;Cancel"


def invented_page(rng: np.random.Generator) -> str:
    """A page in a random layout; blocks of main text begin with the character U+0001."""
    pick = lambda x: x[rng.integers(len(x))]
    syllables = ["".join(pick(list("bcdfghjklmnprstvwz")) + pick(list("aeiouyéü")) for _ in range(rng.integers(1, 3))) for _ in range(40)]
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 3)))

    def prose(low: int, high: int) -> str:
        words = [word() + pick(["", "", "", "", ",", "&amp;", ".", "&nbsp;", "***"]) for _ in range(rng.integers(low, high))]
        return (" ".join(words)).capitalize() + pick([".", ".", ".", "!", "?", ""])

    short = lambda: pick(PHRASES.split(";")) if rng.random() < 0.4 else prose(1, 6)
    close = lambda tag: f"</{tag}>" if rng.random() < 0.9 else ""

    def wrap(kind: str, inner: str) -> str:
        tags = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}
        tag = tags.get(kind, "div") if rng.random() < 0.6 else pick(["div", "section", "div", "ul"] if kind == "nav" else ["div", "section", "div"])
        name = f' {pick(["class", "id", "class"])}="{pick(PARTS[kind].split())}{pick(["", "", " box", " wrap", " col-4", "-1"])}"' if tag in ("div", "section", "ul") or rng.random() < 0.4 else ""
        return f"<{tag}{name}>{inner}</{tag}>"

    def junk(kind: str) -> str:
        if kind in ("nav", "share") or kind in ("footer", "side", "header") and rng.random() < 0.5:
            items = "".join(f'<li><a href="/{word()}">{short()}</a>{close("li")}' for _ in range(rng.integers(1, 9)))
            inner = pick([f"<ul>{items}</ul>", items, re.sub(r"</?li>", " ", items)])
        elif kind == "comments":
            inner = f"<h3>{short()}</h3>" * (rng.random() < 0.5) + "".join(f'<div class="{pick(["comment", "reply", "c"])}"><p>{prose(3, 60)}</p></div>' for _ in range(rng.integers(1, 5)))
        elif kind == "form":
            inner = f"<label>{short()}</label><input name=q><button>{short()}</button>" + f"<p>{prose(3, 20)}</p>" * (rng.random() < 0.5)
        else:
            inner = pick([prose(2, 40), f"<p>{prose(2, 40)}</p>", f"<p>{prose(3, 25)}</p><p>{prose(3, 25)}</p>", f'<a href="#">{prose(2, 12)}</a>', f"<h4>{short()}</h4><p>{prose(3, 20)}</p>"])
        return wrap(kind, inner)

    def junks(kinds: list[str], chance: float) -> str:
        return "".join(junk(k) for k in kinds if rng.random() < chance)

    def body() -> str:
        mark = "\x01"
        parts = [f"<{(t := pick(['h1', 'h1', 'h2']))}>{mark}{prose(2, 12)}</{t}>"] if rng.random() < 0.85 else []
        if parts and rng.random() < 0.15:
            parts = [f"<header>{parts[0]}</header>"]
        if rng.random() < 0.15:
            parts.append(junk("share"))
        for _ in range(rng.integers(1, 14)):
            kind = rng.random()
            text = prose(*pick([(1, 6), (5, 40), (20, 90), (60, 150)]))
            if rng.random() < 0.2:
                text = f"<{(t := pick(['b', 'em', 'a href=x', 'span']))}>{text}" + f"</{t.split()[0]}>" * (rng.random() < 0.6)
            if kind < 0.75:
                parts.append(f"<p>{mark}{text}{pick(['', '<br>', ''])}{close('p')}")
            elif kind < 0.82:
                parts.append(f"<h3>{mark}{prose(1, 7)}</h3>")
            elif kind < 0.88:
                parts.append(f"<ul>{''.join(f'<li>{mark}{prose(2, 15)}{close("li")}' for _ in range(rng.integers(1, 5)))}</ul>")
            elif kind < 0.92:
                parts.append(f"<blockquote>{mark}{text}</blockquote>")
            elif kind < 0.95:
                parts.append(f"<table><tr>{''.join(f'<td>{mark}{prose(1, 4)}</td>' for _ in range(rng.integers(1, 4)))}</tr></table>")
            else:
                parts.append(junk(pick(["ad", "side", "notice", "form"])))
        if rng.random() < 0.15:
            parts.append(junk("comments"))
        return "".join(parts)

    if rng.random() < 0.6:
        main = f"<article>{body()}</article>"
        if rng.random() < 0.3:
            main = f"<main>{main}</main>"
    else:
        tag = pick(["main", "div", "section", "div"])
        name = f' {pick(["id", "class"])}="{pick(MAIN.split())}"' if tag != "main" else ""
        main = f"<{tag}{name}>{body()}</{tag}>"
    if rng.random() < 0.3:
        side = junk("side")
        main = pick([f'<div class="{pick(["wrapper", "container", "row", "page"])}">{main}{side}</div>', f'<div id="wrap">{side}{main}</div>'])
    before = [k for k in rng.permutation(["header", "nav", "ad", "notice", "form", "side"])]
    after = [k for k in rng.permutation(["comments", "side", "ad", "share", "form", "notice"])] + ["footer"]
    page = f"<html><head><title>{prose(2, 8)}</title></head><body>{junks(before, 0.35)}{main}{junks(after, 0.35)}</body></html>"
    return page if rng.random() < 0.9 else page[: int(len(page) * rng.uniform(0.5, 1))]


def lesson(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of an invented page."""
    blocks = leaf_blocks(page)
    labels = np.array([b.text.startswith("\x01") for b in blocks], np.float32)
    return vectors([b._replace(text=b.text.replace("\x01", "") or "x") for b in blocks]), labels


@functools.cache
def trained(pages: int = PAGES, seed: int = 1) -> Labeller:
    rng = np.random.default_rng(seed)
    lessons = [x for x in (lesson(invented_page(rng)) for _ in range(pages)) if len(x[1])]
    return Labeller().train(lessons)


RESULT = [("text", pa.string()), ("n_chars", pa.int64())]


def extract(pages: DataFrame, weights: dict[str, np.ndarray], html: str = "html") -> DataFrame:
    """All columns of `pages`, the main text and its length in characters."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        model = Labeller()
        model.p = weights
        for batch in W.slices(batches, html, 2 << 20):
            blocks = [leaf_blocks(x or "") for x in batch.column(html).to_pylist()]
            short = [k for k, b in enumerate(blocks) if len(b) <= STEPS]
            labels: list[np.ndarray] = [np.zeros(0, bool)] * len(blocks)
            for at in range(0, len(short), 256):
                some = short[at : at + 256]
                for k, found in zip(some, model.label([vectors(blocks[k]) for k in some]), strict=True):
                    labels[k] = found
            for k in range(len(blocks)):
                if len(blocks[k]) > STEPS:
                    labels[k] = model.label_long(blocks[k])
            texts = ["\n".join(b.text for b, main in zip(bs, ls, strict=True) if main) if bs else "" for bs, ls in zip(blocks, labels, strict=True)]
            yield batch, [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return append_columns(pages, RESULT, part)
