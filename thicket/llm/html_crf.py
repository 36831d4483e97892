"""Main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

A page is a sequence of leaf blocks: text between block-level tags, each with
its open ancestors.  A two-label chain (boilerplate, content) scores ancestor-tag
and text features; weights are fitted on labelled pages and a page is decoded by
Viterbi, many pages side by side.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.wordgrid import column
from thicket.scratch import small_batches

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is text up to their own end tag, and others whose content isn't shown.
RAW = "script style textarea title iframe noembed noframes xmp"
UNSEEN = frozenset("template noscript svg math object canvas audio video".split())
#: Start tags that end a drawing or formula that was left open.
_BREAKOUT = frozenset("b big blockquote body center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split())
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BREAKS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
#: Attributes: values in quotes may hold >, values without may hold quotes.
_ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)*+"""
_TOKEN = re.compile(
    r"<!--(?s:.*?)(?:--!?>|\Z)|<!\[CDATA\[(?s:.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?"
    rf"|<({'|'.join(RAW.split())})(?=[\s/>]){_ATTRS}(?<!/)>(?s:.*?)</\1(?=[\s/>])[^>]*+>"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRS})>|([^<]++)|(<)",
    re.I,
)
_RAW = frozenset(RAW.split())
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


@dataclass
class Block:
    text: str
    marks: tuple[str, ...]  # of its ancestors
    tag: str
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page that have text, white space made single spaces, references decoded."""
    out: list[Block] = []
    names: list[str] = []
    marks: list[tuple[str, ...]] = [()]
    text: list[str] = []
    linked = links = unseen = 0

    def flush() -> None:
        nonlocal linked
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            if said:
                k = len(names)
                while k and names[k - 1] in INLINE:
                    k -= 1
                out.append(Block(said, marks[k], names[k - 1] if k else "", linked))
            text.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal links, unseen
        links -= names[upto:].count("a")
        unseen -= sum(n in UNSEEN for n in names[upto:])
        del names[upto:], marks[upto + 1 :]

    for m in _TOKEN.finditer(page):
        _, slash, name, attrs, said, stray = m.groups()
        if said is not None or stray:
            if unseen:
                continue
            said = said or stray
            text.append(said)
            if links:
                linked += len(said)
        elif name:
            name = name.lower()
            if name == "br":
                text.append(" ")
                continue
            if name in _RAW:
                # one that has no end tag: what is behind a script or style isn't text
                if not slash and not attrs.endswith("/") and name in ("script", "style"):
                    break
                continue
            if name in UNSEEN and not slash and attrs.endswith("/"):
                continue
            if unseen and not slash and name in _BREAKOUT and names[-1:] and (open_ := [k for k, n in enumerate(names) if n in ("svg", "math")]):
                close(open_[0])
            if name not in INLINE:
                flush()
            if slash:
                if name in names:
                    close(len(names) - 1 - names[::-1].index(name))
            elif name not in VOID:
                implied = CLOSES.get(name, ("p",) if name in _BREAKS_P else ())
                k = len(names)
                while k and names[k - 1] in INLINE:
                    k -= 1
                if implied and k and names[k - 1] in implied:
                    while k and names[k - 1] in implied:
                        k -= 1
                        while k and names[k - 1] in INLINE:
                            k -= 1
                    # inline elements below what is closed stay open
                    keep = k
                    while keep < len(names) and names[keep] in INLINE:
                        keep += 1
                    close(keep)
                own = ["t:" + name]
                if attrs:
                    for a in _NAMED.finditer(attrs):
                        own += ["c:" + w for w in _PART.findall(_CAMEL.sub(" ", a[2] or a[3] or a[4] or "").lower())]
                    if _HIDDEN.search(attrs):
                        own.append("c:hidden")
                names.append(name)
                unseen += name in UNSEEN
                marks.append((*marks[-1], *own) if name not in INLINE else marks[-1])
                links += name == "a"
    flush()
    return out


#: How sites commonly name the parts of a page, for features and labelled pages.
PARTS = {
    "menu": (("nav", "ul", "div"), "nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs pagination toolbar skip links"),
    "head": (("header", "div"), "header masthead topbar branding banner site logo hero"),
    "foot": (("footer", "div"), "footer bottom copyright legal credits colophon imprint contentinfo"),
    "side": (("aside", "div", "section"), "sidebar aside widget related recommended trending popular more rail complementary teaser archive"),
    "note": (("div", "section", "p"), "cookie consent notice alert gdpr popup modal overlay privacy disclaimer warning message dialog newsletter"),
    "ad": (("div", "aside", "section", "ins", "p"), "ad ads advert adverts advertisement sponsor sponsored promo promotion commercial"),
    "form": (("form",), "form search login signup subscribe register contact newsletter poll"),
    "talk": (("section", "div", "ol", "article"), "comments comment discussion replies reply respond thread responses reader disqus feedback"),
    "share": (("div", "ul"), "share social sharing follow tools buttons tags"),
}
BODY = "content article post entry story text body main page articlebody copy prose single blog news detail"
_INSIDE = frozenset({"t:article", "t:main", *(f"c:{w}" for w in BODY.split())})
_OUTSIDE = frozenset({*(f"t:{t}" for t in "nav header footer aside form".split()), *(f"c:{w}" for _, words in PARTS.values() for w in words.split())})


_BINS = (1, 2, 4, 7, 12, 20, 40, 80)


def features(found: list[Block]) -> list[list[str]]:
    """Of each block: its ancestors' tags and names, its own and its parent's tag, and of its text the length, link share, punctuation and digits; and whether an ancestor is named like an article, or like another part of a page."""
    out = []
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        size = sum(words >= x for x in _BINS)
        link = min(3, 4 * b.linked // max(1, len(b.text)))
        stop = b.text[-1:] in ".!?…\"”»)"
        own = list(dict.fromkeys(b.marks))
        own += [f"tag:{b.tag}", f"size:{size}", f"link:{link}", f"stop:{stop}", f"size,stop,link:{size},{stop},{link}", f"tag,size:{b.tag},{size}"]
        inside, outside = not _INSIDE.isdisjoint(own), not _OUTSIDE.isdisjoint(own)
        own += [f"body:{inside},{outside}", f"body,tag:{inside},{outside},{b.tag}"]
        if "," in b.text:
            own.append("comma")
        if any(c.isdigit() for c in b.text):
            own.append("digit")
        if "©" in b.text:
            own.append("sign")
        if i and found[i - 1].marks == b.marks:
            own.append("like last")
        out.append(own)
    return out


@dataclass
class Chain:
    number: dict[str, int]
    emit: np.ndarray  # by feature and label
    step: np.ndarray  # by label and next label
    begin: np.ndarray

    def numbers(self, found: list[Block]) -> list[list[int]]:
        get = self.number.get
        return [[k for f in fs if (k := get(f, -1)) >= 0] for fs in features(found)]


@dataclass
class Laid:
    """Feature numbers of some pages' blocks, in one array, and where each block stands."""

    size: np.ndarray  # blocks of each page
    flat: np.ndarray
    owner: np.ndarray
    page: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, pages: list[list[list[int]]]) -> Laid:
        size = np.array([len(p) for p in pages])
        per = np.array([len(fs) for p in pages for fs in p])
        flat = np.array([k for p in pages for fs in p for k in fs], np.int64)
        page = np.repeat(np.arange(len(pages)), size)
        return cls(size, flat, np.repeat(np.arange(len(per)), per), page, np.arange(len(page)) - np.repeat(np.cumsum(size) - size, size))

    def scores(self, emit: np.ndarray) -> np.ndarray:
        """[page, place, label]"""
        out = np.zeros((len(self.size), int(self.size.max()), 2))
        for y in (0, 1):
            out[self.page, self.place, y] = np.bincount(self.owner, emit[self.flat, y], len(self.page))
        return out


def viterbi(chain: Chain, pages: list[list[list[int]]]) -> list[np.ndarray]:
    """The best labels of each page; pages of like length are decoded together."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and len(pages[order[to]]) <= 2 * len(pages[order[at]]) + 8:
            to += 1
        own = order[at:to]
        at = to
        laid = Laid.of([pages[i] for i in own])
        scores, size = laid.scores(chain.emit), laid.size
        best = chain.begin + scores[:, 0]
        back = np.zeros(scores.shape, np.int64)
        for t in range(1, scores.shape[1]):
            via = best[:, :, None] + chain.step[None]
            back[:, t] = via.argmax(1)
            now = via.max(1) + scores[:, t]
            best = np.where((t < size)[:, None], now, best)
        labels = np.zeros(scores.shape[:2], np.int64)
        y = best.argmax(1)
        for t in range(scores.shape[1] - 1, -1, -1):
            labels[:, t] = y
            y = np.where((t < size) & (t > 0), back[np.arange(len(own)), t, y], y)
        for k, i in enumerate(own):
            out[i] = labels[k, : size[k]]
    return out


def fit(pages: list[tuple[list[Block], list[int]]], rounds: int = 100, step: float = 0.3, decay: float = 1e-3) -> Chain:
    """Maximum conditional likelihood by adaptive gradient ascent over all pages at once, marginals by forward-backward."""
    number: dict[str, int] = {}
    for found, _ in pages:
        for fs in features(found):
            for f in fs:
                number.setdefault(f, len(number))
    chain = Chain(number, np.zeros((len(number), 2)), np.zeros((2, 2)), np.zeros(2))
    ids = [chain.numbers(found) for found, _ in pages]
    laid = Laid.of(ids)
    longest = int(laid.size.max())
    gold = np.full((len(ids), longest), -1)
    for i, (_, labels) in enumerate(pages):
        gold[i, : len(labels)] = labels
    live = gold >= 0
    hot = np.stack([(gold == y) for y in (0, 1)], 2).astype(float)
    pair_gold = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    squares = [np.full_like(x, 1e-6) for x in (chain.emit, chain.step, chain.begin)]
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
    for _ in range(rounds):
        scores = laid.scores(chain.emit)
        fwd, bwd = np.zeros(scores.shape), np.zeros(scores.shape)
        fwd[:, 0] = chain.begin + scores[:, 0]
        for t in range(1, longest):
            now = lse(fwd[:, t - 1, :, None] + chain.step[None], 1) + scores[:, t]
            fwd[:, t] = np.where(live[:, t, None], now, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            now = lse(chain.step[None] + (scores[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(live[:, t + 1, None], now, bwd[:, t + 1])
        z = lse(fwd[:, -1], 1)
        prob = np.exp(fwd + bwd - z[:, None, None]) * live[:, :, None]
        pair = np.zeros((2, 2))
        for t in range(1, longest):
            joint = np.exp(fwd[:, t - 1, :, None] + chain.step[None] + (scores[:, t] + bwd[:, t])[:, None, :] - z[:, None, None])
            pair += (joint * live[:, t, None, None]).sum(0)
        error = (hot - prob)[live]
        grads = [np.stack([np.bincount(laid.flat, error[laid.owner, y], len(number)) for y in (0, 1)], 1) - decay * len(ids) * chain.emit, pair_gold - pair, (hot[:, 0] - prob[:, 0]).sum(0)]
        for x, g, s in zip((chain.emit, chain.step, chain.begin), grads, squares, strict=True):
            s += g * g
            x += step * g / np.sqrt(s)
    return chain


def labelled_pages(n: int = 600, seed: int = 11, unnamed: float = 0.33) -> list[tuple[str, list[int]]]:
    """n invented pages of many layouts, with a label (1: content) for each leaf block, from a seed.

    On a share ``unnamed`` of the pages every class and id is an invented word or
    a code as build tools make them, so that the chain has to go by tags, text
    and neighbours there.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    syllables = "an be co da el fi go ha in jo ka lo mi no or pe qua ri so ta un ve wi ya zu éa öl ñu".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))

    def said(k: int, stop: bool = True) -> str:
        w = [word() for _ in range(max(1, k))]
        w = [x + "," if chance(0.08) else x for x in w]
        w = [x + "." if chance(0.1) and stop else x for x in w]
        return (" ".join(w)).capitalize() + ("." if stop else "")

    plain = [False]

    def named(words: str) -> str:
        if chance(0.25):
            return ""
        if plain[0]:
            return f' class="{pick([word(), word() + "-" + word(), "css-" + format(int(rng.integers(1 << 24)), "x"), pick("abcdefgh") + str(int(rng.integers(99)))])}"'
        w = pick(words.split())
        w = pick([w, f"{w}-{pick(['box', 'wrap', 'area', 'list', 'main', 'inner', 'top', 'block', 'section'])}", f"{pick(['site', 'page', 'the', 'js', 'l'])}-{w}", w.capitalize() + "Box"])
        return f' {pick(["class", "class", "id"])}="{w}"'

    def page() -> tuple[str, list[int]]:
        labels: list[int] = []

        def leaf(tag: str, text: str, label: int, extra: str = "") -> str:
            labels.append(label)
            return f"<{tag}{extra}>{text}</{tag}>"

        def links(k: int, tag: str = "li") -> str:
            return "".join(leaf(tag, f'<a href="/{word()}">{said(int(rng.integers(1, 6)), False)}</a>', 0) for _ in range(k))

        def part(kind: str) -> str:
            tags, words = PARTS[kind]
            tag = pick(tags)
            attrs = named(words)
            if not attrs and not plain[0] and tag in ("div", "p", "section", "ul", "ol", "article", "ins"):
                attrs = f' class="{pick(words.split())}"'
            if kind in ("menu", "share"):
                k = int(rng.integers(2, 8))
                inner = links(k) if tag == "ul" else f"<ul>{links(k)}</ul>" if chance(0.7) else links(k, "div")
            elif kind == "talk":
                rows = [leaf("p", said(int(rng.integers(2, 50))), 0) if chance(0.7) else leaf("div", said(int(rng.integers(2, 50))), 0) for _ in range(int(rng.integers(1, 6)))]
                wrap = pick(["li", "div", "article"])
                inner = leaf(pick(["h2", "h3"]), said(2, False), 0) + "".join(f"<{wrap}>{r}</{wrap}>" for r in rows)
            elif kind == "form":
                inner = leaf("label", said(2, False), 0) + '<input type="text">' + leaf("button", said(1, False), 0) + (leaf("p", said(int(rng.integers(4, 20))), 0) if chance(0.5) else "")
            elif kind == "foot":
                inner = leaf(pick(["p", "div"]), f"&copy; {said(int(rng.integers(2, 15)), chance(0.5))}", 0) + (f"<ul>{links(3)}</ul>" if chance(0.5) else "")
            elif kind == "head":
                inner = leaf(pick(["h1", "div", "p"]), said(int(rng.integers(1, 5)), False), 0) + (f"<nav><ul>{links(4)}</ul></nav>" if chance(0.5) else "")
            else:
                if tag == "p" or chance(0.5):
                    return leaf(tag, said(int(rng.integers(2, 60))), 0, attrs)
                inner = (leaf(pick(["h3", "h4", "h2"]), said(2, False), 0) if chance(0.5) else "") + "".join(leaf("p", said(int(rng.integers(2, 50))), 0) for _ in range(int(rng.integers(1, 4)))) + (f"<ul>{links(3)}</ul>" if chance(0.3) else "")
            return f"<{tag}{attrs}>{inner}</{tag}>"

        def story() -> str:
            out = [leaf(pick(["h1", "h1", "h2"]), said(int(rng.integers(2, 14)), False), 1)] if chance(0.85) else []
            for _ in range(int(rng.integers(1, 14))):
                r = rng.random()
                k = int(rng.integers(1, 8)) if chance(0.2) else int(rng.integers(8, 120))
                text = said(k, chance(0.85))
                if chance(0.12):  # tables and junk in running text
                    text = pick([" | ", "*** ", "&&& ", " - ", " / ", "... "]).join(word() for _ in range(k))
                if chance(0.15):
                    text = f"<b>{text}</b>"
                if chance(0.2):
                    text += f' <a href="/{word()}">{said(3, False)}</a> {said(4)}'
                if r < 0.75:
                    out.append(leaf("p", text, 1))
                elif r < 0.82:
                    out.append(leaf(pick(["h2", "h3", "h4"]), said(int(rng.integers(1, 8)), False), 1))
                elif r < 0.87:
                    out.append(f"<blockquote>{leaf('p', text, 1)}</blockquote>")
                elif r < 0.92:
                    tag = pick(["ul", "ol"])
                    out.append(f"<{tag}>{''.join(leaf('li', said(int(rng.integers(1, 20)), chance(0.6)), 1) for _ in range(3))}</{tag}>")
                elif r < 0.94:
                    out.append(f"<table><tr>{''.join(leaf('td', said(2, False), 1) for _ in range(3))}</tr></table>")
                elif r < 0.96:
                    out.append(leaf("div", text, 1))
                else:
                    out.append(leaf("pre", text, 1))
                if chance(0.06):
                    out.append(part(pick(["ad", "side", "share", "form", "note"])))
            return "".join(out)

        plain[0] = chance(unnamed)
        out = [part(k) for k in ("head", "menu", "note", "ad") if chance(0.5)]
        if chance(0.2):
            out.append(part("side"))
        shell = pick(["article", "article", "main", "div", "div", "section", "none"])
        inner = story()
        if shell != "none":
            attrs = named(BODY) if shell != "div" or plain[0] or chance(0.15) else f' class="{pick(BODY.split())}"'
            inner = f"<{shell}{attrs}>{inner}</{shell}>"
            if chance(0.4):
                outer = pick(["main", "div", "section"])
                inner = f"<{outer}{named(BODY)}>{inner}</{outer}>"
        out.append(inner)
        out += [part(k) for k in ("share", "side", "talk", "ad", "form", "note", "menu") if chance(0.35)]
        if chance(0.85):
            out.append(part("foot"))
        body = "".join(out)
        if chance(0.3):
            body = f'<div class="{pick(["wrapper", "container", "page", "site", "root"])}">{body}</div>'
        return f"<html><head><title>{said(4, False)}</title></head><body>{body}</body></html>", labels

    return [page() for _ in range(n)]


_FITTED: dict[tuple[int, int], Chain] = {}


def trained(n: int = 600, seed: int = 11) -> Chain:
    """The chain fitted on n labelled pages, once a process."""
    if (n, seed) not in _FITTED:
        pages = [(blocks(p), labels) for p, labels in labelled_pages(n, seed)]
        _FITTED[n, seed] = fit([(b, y) for b, y in pages if len(b) == len(y) and b])
    return _FITTED[n, seed]


def main_text(chain: Chain, pages: list[str | None]) -> list[str]:
    """The content blocks of each page, in order, joined by line breaks."""
    found = [blocks(p) if p else [] for p in pages]
    labels = viterbi(chain, [chain.numbers(b) for b in found])
    return ["\n".join(b.text for b, y in zip(bs, ys, strict=True) if y) for bs, ys in zip(found, labels, strict=True)]


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages(page_id, url, html).

    text is the page's content blocks, white space single and trimmed, in page
    order, joined by one line break; n_chars its code points.  A null or empty
    html, or one without text, gives an empty text.  Repeated rows each give a
    row; an empty table none.  Other columns are not read.  A line break tag is
    white space inside its block.  Nothing is cut off, however long a page is.
    """
    shared = pages.sparkSession.sparkContext.broadcast(chain or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = main_text(shared.value, column(part, "html").to_pylist())
                yield pa.RecordBatch.from_arrays([column(part, "page_id"), column(part, "url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
