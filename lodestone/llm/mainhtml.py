"""Main text of web pages by the maximum-scoring contiguous region.

A page is read once into blocks of text, the elements around them and the tags
between them. Words score by the kind of block they stand in (which tag, how long,
whether it ends as a sentence does), positive for what main text is made of; words in
links and tags score negative. One linear scan finds the contiguous region of the
largest score, which is then widened to the ends of the innermost element that it
fills. Advertisements and the like lie inside articles too, so an element that a
second model takes for boilerplate is left out of the result and costs the scan no
more than its tag. That model weighs everything an element shows: its tag, class and
id words, the share of its words in links, the share of the page's text that it holds,
its paragraphs and headings. No word cuts by itself: a container of most of the text
with the title in it stays, whatever its class is called.

All weights are learned from labelled pages (``labelled.LAYOUTS`` or others given to
``fit``): log odds of words and tags inside and outside the main text, and a logistic
regression for elements.

Character references are decoded, white space within a block becomes one space,
blocks are trimmed and joined by two line ends; ``<br>`` counts as white space. Reading
takes time in proportion to the page, however broken its markup is.

Defined results: a null or empty page, and one without words, gives an empty
text; cut-off tags, comments and elements run to the page's end; a page that
would be boilerplate only is read with no element taken for boilerplate but those
never shown. U+0000 is a character like others. Repeated rows are all returned; extra
columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import labelled

#: Elements whose content is never shown as text.
HIDDEN = "script style noscript template iframe textarea select button svg math title object canvas video audio".split()
#: Elements that begin and end a block of text, with the kind of block they make.
BLOCKS = dict.fromkeys("address article aside body center details dialog div dl fieldset figcaption figure footer form header hgroup html legend main menu nav ol section summary table tbody tfoot thead tr ul".split(), "div")
BLOCKS |= dict.fromkeys("p blockquote pre".split(), "p") | dict.fromkeys("li dd dt".split(), "li") | dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), "h") | {"hr": ""}
#: Elements that part words but no blocks.
CELLS = {"td", "th", "br", "caption", "option"}
#: Elements that can be boilerplate as a whole, and those of them that can be so without a class or id.
CONTAINERS = set("article aside blockquote dd details dialog div dl fieldset figure footer form header li menu nav ol p section span table tbody td tr ul center h2 h3 h4".split())
TELLING = {"aside", "dialog", "div", "footer", "form", "header", "nav", "section"}
#: Elements that end where the next of their kind begins.
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}}

_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in HIDDEN}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[\"'>]")
_CLASS = re.compile(r"(?:^|[\s\"'/])(class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"[.!?…:;。！？][\"'»”’)\]]*$")


def tokens(page: str):
    """(kind, name, attributes, text, position): "open", "close" or "text" in page order; comments and hidden elements left out."""
    at, n, from_, closed = 0, len(page), 0, {"'": True, '"': True}
    while at < n:
        lt = page.find("<", at)
        nxt = page[lt + 1 : lt + 2] if lt >= 0 else ""
        if lt >= 0 and not (nxt.isalpha() and nxt.isascii() or nxt in ("/", "!", "?") and nxt):
            at = lt + 1  # a bare < is text
            continue
        end = n if lt < 0 else lt
        if end > from_:
            yield "text", "", "", page[from_:end], from_
        if lt < 0:
            return
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = from_ = n if stop < 0 else stop + 3
            continue
        if nxt in "!?":
            stop = page.find(">", lt)
            at = from_ = n if stop < 0 else stop + 1
            continue
        close = nxt == "/"
        m = _NAME.match(page, lt + 1 + close)
        stop, i = n, (m.end() if m else lt + 2)
        while True:  # the next > outside quotes; a quote that is never closed is a character
            s = _STOP.search(page, i)
            if not s:
                break
            if s[0] == ">":
                stop = s.end()
                break
            j = page.find(s[0], s.end()) if closed[s[0]] else -1
            closed[s[0]] = j >= 0
            i = j + 1 if j >= 0 else s.end()
        at = from_ = stop
        if not m:
            continue
        name = m[0].lower()
        attrs = page[m.end() : stop].rstrip(">")
        if name in _RAW_END:
            if not close and not (attrs.endswith("/") and name in ("svg", "math")):
                shut = _RAW_END[name].search(page, stop)
                at = from_ = shut.end() if shut else n
            continue
        yield ("close" if close else "open"), name, "" if close else attrs, "", lt
    if at > from_ and from_ < n:
        yield "text", "", "", page[from_:], from_


def _names(attrs: str) -> list[str]:
    """Class words of an element as .word, those of its id as #word."""
    if not attrs.strip("/ "):
        return []
    if _UNSEEN.search(attrs):
        return [".unseen"]
    return [("#" if k.lower() == "id" else ".") + p for k, v in _CLASS.findall(attrs) for p in _PART.findall(_CAMEL.sub(" ", v.strip("\"'")).lower())]


class Page:
    """Blocks, elements and the row of tags and blocks of one page."""

    def __init__(self, page: str):
        self.texts: list[list[str]] = []  # runs of each block
        self.words: list[int] = []
        self.links: list[int] = []  # words in links
        self.kinds: list[str] = []
        self.owner: list[int] = []  # innermost element of each block
        self.at: list[int] = []  # position in the page
        self.names: list[str] = ["html"]
        self.classes: list[list[str]] = [[]]
        self.parent: list[int] = [-1]
        self.group: list[str] = ["div"]
        self.article: list[bool] = [False]
        self.lo: list[int] = [0]
        self.hi: list[int] = [0]
        self.row: list[tuple[str, int]] = []  # (tag, element) or ("", block)
        stack, count, fresh, linked, head = [0], Counter(), True, 0, False
        names, parent = self.names, self.parent

        def pop() -> None:
            e = stack.pop()
            count[names[e]] -= 1
            self.hi[e] = len(self.texts)
            self.row.append(("/" + names[e], e))

        for kind, name, attrs, text, at in tokens(page):
            if kind == "text":
                if head or fresh and not text.strip():
                    continue
                if fresh:
                    self.texts.append([])
                    self.words.append(0)
                    self.links.append(0)
                    self.kinds.append(self.group[stack[-1]])
                    self.owner.append(stack[-1])
                    self.at.append(at)
                    self.row.append(("", len(self.texts) - 1))
                    fresh = False
                text = _html.unescape(text) if "&" in text else text
                n = len(text.split())
                self.texts[-1].append(text)
                self.words[-1] += n
                self.links[-1] += n if linked else 0
                continue
            opening = kind == "open"
            if name == "head":
                head = opening
                continue
            if name == "body":
                head = False
            if name == "a":
                linked = opening
                continue
            block = name in BLOCKS
            if block:
                fresh = True
            elif name in CELLS and not fresh:
                self.texts[-1].append(" ")
            if not (block or name in CONTAINERS) or name in ("html", "body", "hr"):
                continue
            if not opening:
                if count[name]:
                    linked = 0
                    while names[stack[-1]] != name:
                        pop()
                    pop()
                continue
            if block and names[stack[-1]] == "p":
                pop()
            if names[stack[-1]] in SIBLINGS.get(name, ()):
                pop()
            up = stack[-1]
            names.append(name)
            self.classes.append(_names(attrs))
            parent.append(up)
            self.group.append(BLOCKS.get(name) or self.group[up])
            self.article.append(self.article[up] or names[up] in ("article", "main"))
            self.lo.append(len(self.texts))
            self.hi.append(-1)
            self.row.append((name, len(names) - 1))
            count[name] += 1
            stack.append(len(names) - 1)
        while len(stack) > 1:
            pop()
        self.hi[0] = len(self.texts)

    def block_kinds(self) -> list[str]:
        """Kind of each block: the tag's, how many words it has, and . where it ends as a sentence does."""
        out = []
        for kind, n, runs in zip(self.kinds, self.words, self.texts, strict=True):
            size = "1" if n < 4 else "4" if n < 10 else "10" if n < 25 else "25"
            out.append(f"{kind}{size}" + "." * bool(_SENTENCE.search("".join(runs[-2:]).rstrip()[-8:])))
        return out

    def features(self, kinds: list[str]) -> dict[int, list[str]]:
        """What speaks for or against each element that could be boilerplate as a whole."""
        sums = lambda xs: [0, *accumulate(xs)]
        words, links = sums(self.words), sums(self.links)
        full = sums(k in ("p10.", "p25.", "p25", "div25.") for k in kinds)
        first = [0] * len(kinds)
        for e, name in enumerate(self.names):
            if name == "h1" and self.hi[e] > self.lo[e]:
                first[self.lo[e]] = 1
        titles = sums(first)
        plain = max(1, words[-1] - links[-1])
        out = {}
        for e in range(1, len(self.names)):
            lo, hi, name, own = self.lo[e], self.hi[e], self.names[e], self.classes[e]
            n = words[hi] - words[lo]
            if name not in CONTAINERS or not n and own != [".unseen"] or name not in TELLING and not own:
                continue
            linked = links[hi] - links[lo]
            share, paras = (n - linked) / plain, full[hi] - full[lo]
            found = {"<" + name, *own, "in" if self.article[e] else "out", f"paras{min(paras, 3)}"}
            found.add("links2" if 2 * linked > n else "links1" if 5 * linked > n else "links0")
            found.add("share3" if share >= 0.6 else "share2" if share >= 0.3 else "share1" if share >= 0.1 else "share0")
            if titles[hi] > titles[lo]:
                found.add("title" if share >= 0.3 else "title-alone")
            out[e] = sorted(found)
        return out


def _learned(rows: list[list[str]], junk: list[bool], steps: int = 600, rate: float = 0.5, ridge: float = 4e-4) -> dict[str, float]:
    """Logistic regression of ``junk`` on features, by full gradient steps with momentum; an extra feature "" is the offset."""
    names = sorted({f for r in rows for f in r})
    spot = {f: i + 1 for i, f in enumerate(names)}
    row = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    col = np.array([x for r in rows for x in (0, *(spot[f] for f in r))])
    y, w, v = np.array(junk, float), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for _ in range(steps):
        p = 0.5 * (1 + np.tanh(0.5 * np.bincount(row, weights=w[col], minlength=y.size)))
        g = np.bincount(col, weights=(p - y)[row], minlength=w.size) / y.size + ridge * w
        v = 0.9 * v - rate * g
        w = w + v
    return {"": float(w[0])} | {f: float(w[i]) for f, i in spot.items()}


def fit(pages: list[list[tuple[str, bool]]] | None = None, smooth: float = 10.0) -> dict[str, dict[str, float]]:
    """Weights of words (by kind of block), tags and elements, from pages as parts (html, whether it is main text)."""
    rows, junk, read = [], [], []
    for parts in labelled.pages() if pages is None else pages:
        ends = list(accumulate(len(p) for p, _ in parts))
        page = Page("".join(p for p, _ in parts))
        main = [parts[bisect_right(ends, at)][1] for at in page.at]
        words, held = [0, *accumulate(page.words)], [0, *accumulate(n * m for n, m in zip(page.words, main, strict=True))]
        share = lambda e, page=page, words=words, held=held: (held[page.hi[e]] - held[page.lo[e]]) / max(1, words[page.hi[e]] - words[page.lo[e]])
        read.append((page, main, share))
        for e, found in page.features(page.block_kinds()).items():
            if not 0 < share(e) <= 0.3:
                rows.append(found)
                junk.append(share(e) == 0)
    element = _learned(rows, junk)
    # Words and tags are counted where the scan meets them: outside elements that are left out even if their names tell nothing.
    nameless = {f: x for f, x in element.items() if f[:1] not in (".", "#")}
    inside, outside = Counter(), Counter()
    for page, main, share in read:
        kinds = page.block_kinds()
        cut = _junk(page, kinds, {"element": nameless})
        for b, kind in enumerate(kinds):
            if cut[page.owner[b]] < 0:
                to = inside if main[b] else outside
                to[kind] += page.words[b] - page.links[b]
                to["link"] += page.links[b]
        # A tag counts as inside where the main text goes on behind it.
        before, open_ = False, []
        for tag, i in page.row:
            if tag:
                open_ += ["<" + tag.lstrip("/")] * (cut[i] < 0)
            elif cut[page.owner[i]] < 0:
                (inside if before and main[i] else outside).update(open_)
                before, open_ = main[i], []
        outside.update(open_)
    odds = lambda f: math.log((inside[f] + smooth) / (outside[f] + smooth))
    known = {*inside, *outside}
    return {
        "word": {f: max(-0.6, min(1.0, odds(f))) for f in known if f[0] != "<"},
        # A tag is never better than a small cost.
        "tag": {f[1:]: max(-2.0, min(-0.1, odds(f))) for f in known if f[0] == "<"},
        "element": element,
    }


@lru_cache(maxsize=1)
def default_weights() -> dict:
    return fit()


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run of the largest sum, in one scan; empty if no sum is positive."""
    best, found, here, lo = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if here <= 0:
            here, lo = 0.0, i
        here += s
        if here > best:
            best, found = here, (lo, i + 1)
    return found


#: Cost of a tag that the model doesn't know, and of an element left out.
PLAIN_TAG = -0.3
#: Words of a block go together, so each counts as part of one piece of evidence.
PER_WORD = 0.33


def _junk(page: Page, kinds: list[str], weights: dict) -> list[int]:
    """For each block the outermost element taken for boilerplate around it, or -1."""
    w = weights["element"]
    cut = [-1] * len(page.names)
    found = page.features(kinds)
    for e in range(1, len(page.names)):  # parents come before their children
        up = cut[page.parent[e]]
        if up >= 0:
            cut[e] = up
        elif e in found and (".unseen" in found[e] or w[""] + sum(w.get(f, 0.0) for f in found[e]) > 0):
            cut[e] = e
    return cut


def _widened(page: Page, lo: int, hi: int, keep: list[bool]) -> tuple[int, int]:
    """Blocks lo to hi, widened to the ends of the innermost element around them, unless that is the page.

    Blocks of the element that stand in other containers of their own are not taken in;
    a title right before is.
    """
    e, f = page.owner[lo], page.owner[hi - 1]
    chain = set()
    while e >= 0:
        chain.add(e)
        e = page.parent[e]
    while f not in chain:
        f = page.parent[f]
    while page.names[f] not in TELLING and page.names[f] not in ("article", "main", "td", "center", "html"):
        f = page.parent[f]
    if f <= 0:
        return _titled(page, lo, keep), hi

    def own(b: int) -> bool:
        x = page.owner[b]
        while x != f:
            if page.names[x] in TELLING or page.names[x] == "article":
                return False
            x = page.parent[x]
        return True

    while lo > page.lo[f] and (not keep[lo - 1] or own(lo - 1)):
        lo -= 1
    while hi < page.hi[f] and (not keep[hi] or own(hi)):
        hi += 1
    return _titled(page, lo, keep), hi


def _titled(page: Page, lo: int, keep: list[bool]) -> int:
    """``lo``, or the block of a first heading that stands right before it."""
    b = lo - 1
    while b >= 0 and not keep[b]:
        b -= 1
    return b if b >= 0 and page.names[page.owner[b]] == "h1" else lo


def _extract(page: Page, weights: dict, cutting: bool, flat: bool = False) -> str:
    """The best region, less elements taken for boilerplate if ``cutting``; ``flat`` gives every word outside links the same small score."""
    kinds = page.block_kinds()
    cut = _junk(page, kinds, weights) if cutting else [-1] * len(page.names)
    word, tag, link = weights["word"], weights["tag"], min(-0.2, weights["word"].get("link", -1.0))
    scores, blocks, keep = [], [], [cut[e] < 0 for e in page.owner]
    for name, i in page.row:
        if not name:
            each = 1.0 if flat else word.get(kinds[i], 0.4)
            scores.append(PER_WORD * (page.links[i] * link + (page.words[i] - page.links[i]) * each) if keep[i] else 0.0)
        elif cut[i] < 0:
            scores.append(0.1 * PLAIN_TAG if flat else tag.get(name.lstrip("/"), PLAIN_TAG))
        else:
            scores.append(PLAIN_TAG if cut[i] == i else 0.0)
        blocks.append(-1 if name else i)
    lo, hi = best_region(scores)
    held = [b for b in blocks[lo:hi] if b >= 0]
    if not held:
        return ""
    lo, hi = _widened(page, held[0], held[-1] + 1, keep)
    return "\n\n".join(t for t in (" ".join("".join(page.texts[b]).split()) for b in range(lo, hi) if keep[b]) if t)


def main_text(page: str | None, weights: dict | None = None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    read = Page(page)
    w = weights or default_weights()
    return _extract(read, w, True) or _extract(read, w, True, True) or _extract(read, w, False, True) or "\n\n".join(t for t in (" ".join("".join(x).split()) for x in read.texts) if t)


def extract(pages: DataFrame, weights: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    w = weights or default_weights()

    def run(batches):
        for batch in batches:
            texts = [main_text(h, w) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_main_text(spark, sf_dir):
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
