"""Pages cut into leaf blocks: runs of text between the edges of block elements, with the path of elements above them."""

from __future__ import annotations

import html
import re

#: Elements whose edges end a block.
BLOCK_TAGS = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html iframe legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
#: Elements without content, and those whose content is not text: up to their end tag, or the end of the page.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "head", "title", "textarea", "iframe")
#: Elements whose content is left out, but which end with their parent if they have no end tag of their own. Drawings
#: and formulas also end where one of _BREAKS begins.
MUTE_TAGS = frozenset(("noscript", "template", "svg", "math"))
_BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article aside footer header main nav section form".split())
#: A start of one of these ends an open paragraph; a start of the first ends an open one of its set.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Inside a tag, quotes count only right after an equals sign. Possessive throughout, so a scan is linear.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>|<[!?/][^>]*>|<[a-zA-Z/!?][^<>]*\Z", re.S)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW_TAGS}
_NAMES = re.compile(r"(?<![^\s/\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPACE = re.compile(r"\s+")


class Block:
    """A run of text: the elements above it as 'tag' or 'tag.name name', the number of each of these elements on its
    page, and how many characters stand inside links."""

    __slots__ = ("path", "text", "linked", "numbers")

    def __init__(self, path: tuple[str, ...], text: str, linked: int, numbers: tuple[int, ...]):
        self.path, self.text, self.linked, self.numbers = path, text, linked, numbers


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order. Path items are 'tag' or 'tag.name name' with its class, id and role words;
    linked is how many characters stand inside links. Comments, scripts and heads give no blocks;
    unclosed and crossed elements, and a page cut off anywhere, are read as far as they go."""
    if not page:
        return []
    out: list[Block] = []
    path: list[tuple[str, str, int]] = []
    mute = opened = 0
    held: list[str] = []
    links = 0
    linked = 0

    def close() -> None:
        nonlocal held, linked
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                out.append(Block(tuple(p[1] for p in path), text, linked, tuple(p[2] for p in path)))
        held, linked = [], 0

    def cut(k: int) -> None:
        nonlocal mute
        mute -= sum(p[0] in MUTE_TAGS for p in path[k:])
        del path[k:]

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece and not mute:
            held.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "a":
                links = 0
            elif tag in BLOCK_TAGS or tag in MUTE_TAGS:
                if not mute:
                    close()
                for k in range(len(path) - 1, -1, -1):
                    if path[k][0] == tag:
                        cut(k)
                        links = 0
                        break
            continue
        if mute and path[-1][0] in ("svg", "math") and tag in _BREAKS:
            cut(len(path) - 1)
        if tag in _RAW_END and not (mute and m.group(3).endswith("/")):
            end = _RAW_END[tag].search(page, at)
            if tag != "head":
                at = end.end() if end else len(page)
            elif end:
                at = end.end()
            if tag in BLOCK_TAGS and not mute:
                close()
            continue
        if tag in MUTE_TAGS:
            raw = tag in ("noscript", "template")
            if not mute:
                close() if raw else held.append(" ")
            if raw or not m.group(3).endswith("/"):
                mute += 1
                opened += 1
                path.append((tag, tag, opened))
            continue
        if tag == "br":
            if not mute:
                held.append(" ")
        elif tag == "a":
            links = 1
        elif tag in BLOCK_TAGS:
            if not mute:
                close()
            links = 0
            if path and path[-1][0] == "p":
                path.pop()
            closes = _CLOSES.get(tag)
            if closes:
                for k in range(len(path) - 1, -1, -1):
                    if path[k][0] in closes:
                        cut(k)
                        break
                    if path[k][0] in ("ul", "ol", "dl", "table", "select", "menu") or path[k][0] in MUTE_TAGS:
                        break
            if tag not in VOID_TAGS:
                names = " ".join(x for g in _NAMES.findall(m.group(3)) for x in g if x).lower() if m.group(3) else ""
                opened += 1
                path.append((tag, f"{tag}.{names}" if names else tag, opened))
    close()
    return out
