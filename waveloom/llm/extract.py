"""Main text of web pages: a bidirectional LSTM labels every leaf block as article or not."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lstm
from .blocks import Block, leaf_blocks
from .shared import table, worker
from .textbytes import slices

PATH_DIM, WORD_DIM, OTHER = 80, 40, 20
#: Pages of the table (those with the smallest hash) and composed pages the labeller is trained on; a page of the table
#: is used if it has at most so many bytes and blocks, and gives at most so many of its words to the composed ones.
FIT_PAGES, FIT_COMPOSED = 200, 1800
FIT_BYTES, FIT_BLOCKS, FIT_WORDS = 1 << 20, 400, 300
SEED = 11

#: Elements and names that tell article from rest when pages say so themselves; used for training labels alone.
_REST = re.compile(r"^(?:nav|header|footer|aside|form|menu|button|select|dialog)\b|[. _-](?:nav|menu|header|footer|sidebar|aside|ad|ads|advert\w*|banner|promo\w*|sponsor\w*|cookie\w*|consent|notice|alert|popup|modal|newsletter|subscribe|comment\w*|reply|replies|discussion|disqus|share|social|related|breadcrumb\w*|pagination|search|login|copyright|widget)\b")
_MAIN = re.compile(r"^(?:article|main)\b|[. _-](?:article|post|entry|content|story|main|body-text|article-body|post-body)\b")


class _Buckets(dict):
    """A word's number below `size`, by its CRC; forgotten as a whole when there are very many words."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        k = self[word] = zlib.crc32(word.encode()) % self.size
        return k


_OF_PATH, _OF_WORD = _Buckets(PATH_DIM), _Buckets(WORD_DIM)
_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = _PATHS.get(path)
    if v is None:
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        v = np.zeros(PATH_DIM, np.float32)
        for depth, item in enumerate(reversed(path)):
            tag, _, names = item.partition(".")
            weight = max(0.85**depth, 0.3)
            for token in (tag, *(x for n in names.split() for x in {n, *re.split(r"[-_]", n)})):
                k = _OF_PATH[token]
                v[k] = max(v[k], weight)
        _PATHS[path] = v
    return v


def vectors(blocks: list[Block], names: bool = True) -> np.ndarray:
    """One row per block: hashed path (with or without the elements' names), hashed words, and numbers: length, links,
    punctuation, place, and what share of the page's unlinked text the elements above it hold."""
    count = len(blocks)
    x = np.zeros((count, PATH_DIM + WORD_DIM + OTHER), np.float32)
    if not count:
        return x
    total = sum(len(b.text) for b in blocks)
    plain = [max(0, len(b.text) - b.linked) for b in blocks]
    held: dict[int, int] = {}
    most: dict[int, int] = {}
    for b, n in zip(blocks, plain):
        for k in b.numbers:
            held[k] = held.get(k, 0) + n
            most[k] = most.get(k, 0) + 1
    unlinked = sum(plain) + 1
    # how many elements two neighbours share, and whether they are of one kind
    shared = [0]
    alike = [False]
    for b, c in zip(blocks, blocks[1:]):
        same = 0
        for p, q in zip(b.numbers, c.numbers):
            if p != q:
                break
            same += 1
        shared.append(same)
        alike.append(b.path[-1:] == c.path[-1:])
    shared.append(0)
    alike.append(False)
    before = 0
    flat, n_words, rest = [], [], []
    for i, b in enumerate(blocks):
        x[i, :PATH_DIM] = _path_vector(b.path if names else tuple(p.partition(".")[0] for p in b.path))
        words = b.text.lower().split()
        flat += map(_OF_WORD.__getitem__, words)
        n_words.append(len(words))
        n, depth, text = len(b.text), len(b.numbers), b.text
        marks = text.count(".") + text.count(",") + text.count(";") + text.count("!") + text.count("?")
        row = [min(1.0, b.linked / n), min(1.0, marks / max(1, len(words))), text[-1] in ".!?", i / count, before / total, n / total, depth / 10, text[0] in "\u00a9(|\u00bb"]
        # shares of the element itself, its parent, and so on
        row += [held[k] / unlinked for k in b.numbers[: -6 if depth > 5 else None : -1]]
        row += [0.0] * (13 - len(row))
        # elements that end or begin between the block and its neighbours
        row += (most[b.numbers[-2]] / count if depth > 1 else 1.0, (depth - shared[i]) / 5 if i else 0.0, alike[i], (depth - shared[i + 1]) / 5 if i + 1 < count else 0.0, alike[i + 1])
        rest.append(row)
        before += n
    at = PATH_DIM + WORD_DIM
    w = np.array(n_words)
    x[:, PATH_DIM:at] = np.bincount(np.repeat(np.arange(count) * WORD_DIM, w) + np.array(flat, np.int64), minlength=count * WORD_DIM).reshape(count, WORD_DIM) / np.maximum(w, 1)[:, None]
    x[:, at] = np.log1p([len(b.text) for b in blocks]) / 6
    x[:, at + 1] = np.log1p(w) / 5
    x[:, at + 2 : at + 2 + len(rest[0])] = rest
    return x


def own_labels(blocks: list[Block]) -> np.ndarray | None:
    """Article or not, where the page's own elements say it; None if they do not."""
    y = np.zeros(len(blocks), bool)
    for i, b in enumerate(blocks):
        for item in b.path:
            name = item.replace(" ", " .") if "." in item else item
            if _REST.search(name):
                y[i] = False
                break
            if _MAIN.search(name):
                y[i] = True
    return y if y.any() else None


#: Names that some composed pages give to their parts, by kind.
_FRAMES = {
    "main": ["article", "main", 'div class="article-body"', 'div id="content"', 'div class="post-content"', 'section class="entry"', 'div class="story"'],
    "menu": ["nav", 'div class="menu"', 'ul class="nav-list"', 'div id="navigation"', 'div class="breadcrumbs"'],
    "header": ["header", 'div class="header"', 'div id="top"', 'div class="masthead"'],
    "footer": ["footer", 'div class="footer"', 'div id="bottom"', 'div class="copyright"'],
    "side": ["aside", 'div class="sidebar"', 'div id="right-column"', 'div class="widget related"', 'div class="promo"'],
    "notice": ['div class="cookie-notice"', 'div class="alert"', 'div id="consent"', 'p class="notice"', 'div class="newsletter popup"'],
    "ad": ['div class="ad"', 'div class="advert"', 'div class="sponsored banner"', 'div id="ad-1"', 'aside class="ads"'],
    "form": ["form", 'form class="search"', 'div class="login"', 'form id="subscribe"'],
    "comments": ['div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div class="discussion"', 'section class="replies"'],
}
#: Words that such parts often hold, so that pages without names can be told apart.
_SAYS = {
    "menu": ["Home", "About", "Contact", "News", "Menu", "Archive", "Login", "Help"],
    "header": ["Welcome to", "The daily", "Online since"],
    "footer": ["Copyright 2020", "\u00a9 2024", "All rights reserved", "Imprint", "Privacy policy", "Terms of use", "Powered by"],
    "side": ["Related", "Most read", "See also", "Popular posts", "Tags", "Follow us", "Archive"],
    "notice": ["We use cookies", "This site uses cookies", "Please accept", "Notice"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Special offer"],
    "form": ["Search", "Subscribe", "Sign in", "Your e-mail", "Send"],
    "comments": ["Comments", "Leave a reply", "Reply", "3 comments", "wrote", "says"],
}
_MARK = "\ue000"  # opens each piece of article text in a composed page, and is taken out again


def compose(rng: np.random.Generator, words: list[str]) -> tuple[list[Block], np.ndarray]:
    """The blocks of one invented page and their labels: an article among the other kinds of parts, in many forms of
    markup, over the given words. Most pages give their parts no telling names, and articles hold tables,
    lists, figures, quotes and further levels of elements."""
    r = random.Random(int(rng.integers(1 << 62)))  # for single draws many times as fast
    named = r.random() < 0.3
    pick = lambda *of: r.choice(of)
    some = r.randrange
    letters = lambda low, high: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=some(low, high)))
    plain = lambda: pick("", "", "", f' class="{letters(1, 7)}"', f' class="{letters(1, 5)} {letters(1, 4)}{some(0, 9)}"', f' id="{letters(1, 6)}"', ' style="margin:0"')
    if r.random() < 0.6:  # words of its own, so that no part is known by its words alone
        words = [letters(2, 11) for _ in range(60)]

    def phrase(n: int) -> str:
        return " ".join(r.choices(words, k=n))

    def sentences(n: int) -> str:
        out = []
        for _ in range(n):
            t = phrase(some(3, 18))
            out.append(t[:1].upper() + t[1:] + pick(".", ".", ".", "!", "?"))
        return " ".join(out)

    tagged = r.random() < 0.2  # parts are told by their elements alone
    short = r.random() < 0.3  # an article of a sentence or a few, beside parts that are longer

    def frame(kind: str, inner: str, tag: str | None = None) -> str:
        if tagged and not tag and (bare := {"main": "article", "menu": "nav", "header": "header", "footer": "footer", "side": "aside", "ad": "aside"}.get(kind)):
            return f"<{bare}>{inner}</{bare}>"
        head = pick(*_FRAMES[kind]) if named and r.random() < 0.8 else pick("div", "div", "div", "section", *(["article"] if kind == "main" else []), *(["footer"] if kind == "footer" else []), *(["nav"] if kind == "menu" else [])) + plain()
        head = tag + plain() if tag else head
        deep = some(0, 3) if not tag else 0
        return f"<{head}>" + f"<div{plain()}>" * deep + inner + "</div>" * deep + f"</{head.split()[0]}>"

    def says(kind: str) -> str:
        return pick(*_SAYS[kind]) + " " if r.random() < 0.5 else ""

    def links(kind: str, n: int) -> str:
        if r.random() < 0.2:
            row = pick(" | ", " &middot; ", " ", "<br>").join(f'<a href="/x">{phrase(some(1, 3))}</a>' for _ in range(n))
            return row if r.random() < 0.5 else f"<div{plain()}>{row}</div>"
        tag = pick("li", "li", "span", "div", "p", "td")
        inner = "".join(f'<{tag}><a href="/x">{pick(*_SAYS[kind]) if r.random() < 0.3 else phrase(some(1, 5))}</a></{tag}>' for _ in range(n))
        return {"li": f"<ul{plain()}>{inner}</ul>", "td": f"<table><tr>{inner}</tr></table>"}.get(tag, inner)

    def title(kind: str, n: int = 5) -> str:
        h = pick("h2", "h3", "h4", "h3", "div", "b")
        return f"<{h}>{says(kind)}{phrase(some(1, n))}</{h}>"

    def note(kind: str) -> str:
        tag = pick("p", "p", "div", "span")
        return f"<{tag}{plain()}>{says(kind)}{sentences(some(1, 4))}</{tag}>"

    def text(n: int) -> str:
        """A paragraph's inside, with the mark, and at times inline elements."""
        t = sentences(n)
        if r.random() < 0.3:
            t += f" <{pick('b', 'em', 'i', 'code', 'a href=/y')}>{phrase(some(1, 4))}</{'a' if r.random() < 0.1 else 'x'}> {sentences(1)}"
        return _MARK + t

    def body_part(level: int) -> str:
        kind = r.random()
        if kind < 0.62:
            tag = pick("p", "p", "p", "p", "div")
            return f"<{tag}{plain() if r.random() < 0.2 else ''}>{text(some(1, 7))}" + (f"</{tag}>" if r.random() < 0.93 else "<br>")
        if kind < 0.70:
            h = pick("h2", "h2", "h3", "h4")
            return f"<{h}>{_MARK}{phrase(some(1, 9))}</{h}>"
        if kind < 0.78:
            outer = pick("ul", "ol")
            return f"<{outer}>" + "".join(f"<li>{_MARK}{phrase(some(1, 9)) if r.random() < 0.6 else sentences(1)}" + pick("</li>", "") for _ in range(some(2, 7))) + f"</{outer}>"
        if kind < 0.86:
            cols = some(2, 5)
            rows = "".join("<tr>" + "".join(f"<{c}>{_MARK}{phrase(some(1, 4)) if r.random() < 0.7 else some(1, 4000)}" + pick(f"</{c}>", f"</{c}>", "") for c in ["th" if k == 0 and r.random() < 0.7 else "td"] * cols) + "</tr>" for k in range(some(2, 7)))
            caption = f"<caption>{_MARK}{phrase(some(2, 6))}</caption>" if r.random() < 0.3 else ""
            return f"<table{plain()}>{caption}{pick('', '<tbody>')}{rows}</table>"
        if kind < 0.90:
            return f"<blockquote>{pick('', '<p>')}{text(some(1, 3))}</blockquote>"
        if kind < 0.94:
            return f'<figure><img src="i.png" alt="{phrase(2)}"><figcaption>{_MARK}{phrase(some(2, 12))}</figcaption></figure>'
        if kind < 0.96:
            return f"<pre>{_MARK}{phrase(some(4, 20))}</pre>"
        if kind < 0.98:
            return "<dl>" + "".join(f"<dt>{_MARK}{phrase(some(1, 3))}<dd>{text(1)}" for _ in range(some(1, 4))) + "</dl>"
        inner = "".join(body_part(level + 1) for _ in range(some(1, 4))) if level < 2 else f"<p>{text(2)}</p>"
        return f"<{(t := pick('div', 'section'))}{plain()}>{inner}</{t}>"

    def side() -> str:
        if r.random() < (0.6 if short else 0.1):  # prose as long as an article's
            return frame("side", (title("side") if r.random() < 0.8 else "") + "".join(f"<p>{sentences(some(1, 6))}</p>" for _ in range(some(1, 5))))
        return frame("side", (title("side") if r.random() < 0.7 else "") + "".join(pick(links("side", some(2, 7)), note("side")) for _ in range(some(1, 4))))

    def extra() -> str:
        return pick(lambda: frame("ad", note("ad")), lambda: frame("notice", note("notice")), side, lambda: frame("form", form()), lambda: frame("menu", links("menu", some(2, 6))))()

    def form() -> str:
        return pick("<label>", "<p>") + f"{says('form')}{phrase(some(1, 4))}" + pick('<input type="text">', "<input>", "<select><option>a<option>b</select>") + f"<button>{pick(*_SAYS['form'])}</button>" + (note("form") if r.random() < 0.4 else "")

    def comments() -> str:
        one = lambda: f"<{(t := pick('div', 'li', 'div'))}{plain()}>" + pick(f"<b>{phrase(some(1, 3))}</b><br>", f"<p>{phrase(some(1, 3))}</p>", f"<h4>{phrase(2)} {pick(*_SAYS['comments'])}</h4>", f"<span>{phrase(1)}, 2024-0{some(1, 9)}-11</span>", "") + f"<{(u := pick('p', 'p', 'div'))}>{sentences(some(1, 5))}</{u}></{t}>"
        if r.random() < 0.5:
            n = some(2, 9) if r.random() < 0.75 else some(9, 21)  # a thread: all entries of one form
            t, u, v, c = pick("div", "li", "div"), pick("b", "p", "span", "div", "strong"), pick("p", "p", "div"), plain()
            end = pick("", "", f"<a href='#'>{pick('Reply', 'Like', 'Report')}</a>")
            thread = "".join(f"<{t}{c}><{u}>{phrase(some(1, 3))}</{u}><{v}>{sentences(some(1, 6))}</{v}>{end}</{t}>" for _ in range(n))
            h = pick("h2", "h3", "h4", "div", "p")
            return frame("comments", pick(f"<{h}>{pick(f'{n} comments', f'Comments ({n})', f'{n} replies', 'Comments', 'Discussion')}</{h}>", f"<{h}>{n} {phrase(1)}</{h}>") + thread)
        return frame("comments", (title("comments") if r.random() < 0.8 else "") + "".join(one() for _ in range(some(1, 6))))

    body = [f"<{(t := pick('p', 'p', 'p', 'div'))}>{text(some(1, 4))}</{t}>" for _ in range(some(1, 3))] if short else [f"<p>{text(some(1, 7))}</p>" for _ in range(some(2, 9))] if r.random() < 0.25 else [body_part(0) for _ in range(some(1, 14))]
    if r.random() < 0.25:
        body.insert(0, f"<p{plain()}>{_MARK}{phrase(some(2, 6))}, {some(1, 29)} {phrase(1)} 2024</p>")
    if r.random() < (0.95 if short else 0.75):
        h = pick("h1", "h1", "h1", "h2")
        body.insert(0, f"<{h}>{_MARK}{phrase(some(1, 9))}</{h}>")
    if r.random() < 0.25 and not short:
        body.insert(some(1, len(body) + 1), extra())
    broken = r.random()
    if broken < 0.03:
        body.insert(some(1, len(body) + 1), '<svg viewBox="0 0 1 1"><path d="M0">')
    elif broken < 0.06:
        body.insert(0, f"<p title={phrase(1)}'s>{text(2)}</p>")
    article = "".join(body)

    top = [frame("notice", note("notice"))] * (r.random() < 0.2)
    top += [frame("header", f"<{(h := pick('h1', 'h2', 'div', 'p', 'b', 'a'))}>{says('header')}{phrase(some(1, 4))}</{h}>" + (f"<p>{phrase(some(2, 8))}</p>" if r.random() < 0.5 else ""))] * (r.random() < 0.5)
    top += [frame("menu", links("menu", some(3, 10)))] * (r.random() < 0.8)
    top += [frame("ad", note("ad"))] * (r.random() < 0.35)
    top += [frame("form", form())] * (r.random() < 0.15)
    left, right = [side() if r.random() < 0.5 else frame("menu", links("menu", some(3, 9))) for _ in range(some(0, 2))], [side() for _ in range(some(0, 3))]
    if short and not right:
        right = [side()]
    under = [comments()] * (r.random() < 0.4) + [side()] * (r.random() < 0.25) + [frame("form", form())] * (r.random() < 0.25) + [frame("ad", note("ad"))] * (r.random() < 0.2)
    foot = []
    if r.random() < 0.85:
        inner = [f"<{(t := pick('p', 'div', 'span'))}>{pick('&copy; ', '&copy; 2023 ', says('footer'))}{phrase(some(1, 9))}{pick('.', '', ' &middot; ' + phrase(2) + '.')}</{t}>"]
        if r.random() < 0.4:
            inner.insert(some(0, 2), links("menu", some(2, 6)))
        foot.append(frame("footer", "".join(inner)) if r.random() < 0.9 else inner[0])
    if r.random() < 0.2:  # little but the article and what stands beside or under it
        top, left, foot = [], [], foot if r.random() < 0.2 else []
        under = under if short or r.random() < 0.5 else [comments()]
    if r.random() < 0.2:  # a page laid out as a table
        cells = [frame("menu", x, "td") for x in left] + [frame("main", article + "".join(under if r.random() < 0.3 else []), "td")] + [frame("side", x, "td") for x in right]
        rows = [f"<tr><td colspan=3>{x}</td></tr>" for x in top] + ["<tr>" + "".join(cells) + "</tr>"] + [f"<tr><td colspan=3>{x}</td></tr>" for x in foot]
        page = f"<table{plain()}>{pick('', '<tbody>')}" + "".join(rows) + "</table>"
    else:
        main = frame("main", article) if r.random() < 0.9 else article
        middle = [*left, main, *under, *right] if r.random() < 0.5 else [*left, *right, main, *under]
        if r.random() < 0.5:
            middle = [f"<div{plain()}>", *middle, "</div>"]
        page = "".join([*top, *middle, *foot])
        if r.random() < 0.4:
            page = f"<div{plain()}>{page}</div>"
    if r.random() < 0.7:
        page = f"<html><head><title>{phrase(3)}</title></head><body>{page}</body></html>"
    blocks = leaf_blocks(page)
    labels = np.array([_MARK in b.text for b in blocks], bool)
    for b in blocks:
        b.text = b.text.replace(_MARK, "").strip()
    keep = [i for i, b in enumerate(blocks) if b.text]
    return [blocks[i] for i in keep], labels[keep]


def fit_labeller(pages: DataFrame, n_pages: int = FIT_PAGES, n_composed: int = FIT_COMPOSED, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights of the labeller, trained on at most n_pages pages of the table whose own elements tell their article
    from the rest, with and without the elements' names, and on n_composed invented ones over the words of these,
    in many other layouts.

    Pages are chosen by hash among those of at most FIT_BYTES, so the choice does not depend on partitions; of
    repeated rows one counts. They become vectors in tasks, and only those of pages with at most FIT_BLOCKS blocks
    come to the driver. A table that is empty, or holds no such page, leaves the composed pages, over three stand-in words.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    own = pages.select("page_id", F.xxhash64("html").alias("h"), "html").where(F.octet_length("html").between(1, FIT_BYTES))
    chosen = own.select("page_id", "h").distinct().orderBy(F.xxhash64("page_id", "h"), "h").limit(n_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for page in b.column("html").to_pylist():
                blocks = leaf_blocks(page)
                y = own_labels(blocks)
                if y is None or len(blocks) > FIT_BLOCKS:
                    out.append(([], [], []))
                    continue
                said = [w.strip(".,;!?") for x in blocks for w in x.text.split()[:60]]
                both = [vectors(blocks, named).astype("<f4").tobytes() for named in (True, False)]
                out.append((both, y.tolist(), said[:: max(1, len(said) // FIT_WORDS)]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("h"), *(pa.array(c, pa.list_(t)) for c, t in zip(zip(*out), (pa.binary(), pa.bool_(), pa.string())))], names=["page_id", "h", "x", "y", "words"])

    near = (F.col("h") == F.col("ch")) & F.col("page_id").eqNullSafe(F.col("cid"))
    rows = own.join(F.broadcast(chosen.select(F.col("page_id").alias("cid"), F.col("h").alias("ch"))), near).select("page_id", "h", "html")
    got = rows.mapInArrow(worker(run), f"page_id {kind}, h long, x array<binary>, y array<boolean>, words array<string>").dropDuplicates(["page_id", "h"]).collect()
    rng = np.random.default_rng(seed)
    seqs, labels, words = [], [], set()
    for r in sorted(got, key=lambda r: (str(r.page_id), r.h)):
        words |= {w for w in r.words if w}
        for x in r.x:
            seqs.append(np.frombuffer(x, "<f4").reshape(len(r.y), -1))
            labels.append(np.array(r.y, bool))
    words = sorted(words) or ["word", "page", "text"]
    for _ in range(n_composed):
        blocks, y = compose(rng, words)
        if len(blocks):
            seqs.append(vectors(blocks, rng.random() < 0.7))
            labels.append(y)
    return lstm.train(seqs, labels, hidden=32, seed=seed)


def page_texts(model: dict[str, np.ndarray], pages: list[str | None]) -> list[str]:
    """The article of each page: blocks labelled as such, in page order, joined by a space."""
    blocks = [leaf_blocks(p) for p in pages]
    scores = lstm.predict(model, [vectors(b) for b in blocks])
    return [" ".join(b.text for b, s in zip(bs, sc) if s > 0) for bs, sc in zip(blocks, scores)]


def extract_text(pages: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (its code points).

    Whole pages are read. A null or empty page, or one without an article, has an empty text; repeated
    rows give repeated results; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # fixed size
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "html", 1 << 20):
                texts = page_texts(shared.value, part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(worker(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit_labeller(pages))
