"""A small reading of HTML into block nodes in page order, and numbers about them. Malformed markup is read as far as it goes."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np

# Names of HTML elements.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())  # their content isn't markup
HIDDEN = frozenset("template svg select button datalist".split())  # form widgets, drawings, and what stands for no place in the page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What an opening tag closes, and the elements that this doesn't reach beyond.
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "tbody": ("thead tbody tr td th", {"table"}), "tfoot": ("tbody tr td th", {"table"})}
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[a-z]+")
TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "p", "h", "li", "list", "cell", "quote", "figure", "div", "#text")
KIND = {"menu": "nav", "ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "td": "cell", "th": "cell", "tr": "cell", "blockquote": "quote", "pre": "quote", "figcaption": "figure", "fieldset": "form", "legend": "form"} | {f"h{k}": "h" for k in range(1, 7)}
# Attribute words that page authors use, by what they tell.
WORDS = {
    "content": "content article post entry story text body articlebody main maincontent blog news page",
    "menu": "nav navigation menu menubar breadcrumb breadcrumbs crumbs topbar toolbar pagination pager tabs skip",
    "head": "header head masthead logo branding banner top",
    "foot": "footer foot copyright legal bottom imprint contentinfo",
    "side": "sidebar side aside widget widgets rail secondary complementary column",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted dfp outbrain taboola",
    "comment": "comment comments disqus reply replies respond discussion commentlist feedback",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall toast",
    "form": "form login signin search searchform register contact signup",
    "share": "share sharing social facebook twitter follow like tools",
    "related": "related recommend recommended recommendations more popular trending similar teaser teasers also tags tag author byline meta",
}
TELLS = {w: k for k, ws in enumerate(WORDS.values()) for w in ws.split()}


@dataclass
class Page:
    tag: list[str] = field(default_factory=list)  #: in page order; #text for runs of text
    parent: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    end: list[int] = field(default_factory=list)  #: number after the last node below
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  #: characters in links

    def add(self, tag: str, parent: int, names: str = "", text: str = "", linked: int = 0) -> int:
        for column, x in zip((self.tag, self.parent, self.names, self.end, self.text, self.linked), (tag, parent, names, len(self.tag) + 1, text, linked)):
            column.append(x)
        return len(self.tag) - 1


def read(source: str | None) -> Page:
    page = Page()
    source = source or ""
    stack = [page.add("html", -1)]
    held: list[str] = []
    linked, link = 0, -1  # link: the stack's depth where a link began
    unclosed: set[str] = set()  # elements that no end tag follows
    places: dict[str, list[int]] = {}  # of open elements in the stack, so that no tag is looked for along it

    def flush() -> None:
        nonlocal linked
        if held:
            if text := " ".join("".join(held).split()):
                page.add("#text", stack[-1], "", text, min(linked, len(text)))
            held.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal link
        flush()
        while len(stack) > max(to, 1):
            node = stack.pop()
            page.end[node] = len(page.tag)
            places[page.tag[node]].pop()
        if link > len(stack):
            link = -1

    at, n = 0, len(source)
    while at < n:
        m = MARKUP.match(source, at)
        at = m.end()
        if m[1]:  # an end tag
            tag = m[1].lower()
            if tag == "a":
                link = -1
            elif tag in BLOCKS:
                flush()
                if places.get(tag):
                    close(places[tag][-1])
        elif tag := (m[2] or m[4]):
            tag = tag.lower()
            rest = m[3] if m[2] else m[5]
            if tag in RAW or tag in HIDDEN:
                found = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
                if found:
                    at = found.end()
                elif tag in RAW:
                    at = n
                else:
                    unclosed.add(tag)
                held.append(" " if tag not in RAW else "")
            elif tag == "a":
                link = len(stack)
            elif tag in ("br", "img", "input"):
                held.append(" ")
            elif tag == "html":
                pass
            elif tag in BLOCKS or "-" in tag:
                flush()
                if page.tag[stack[-1]] == "p":
                    close(len(stack) - 1)
                if tag in CLOSES:
                    closed, walls = CLOSES[tag]
                    wall = max((places[w][-1] for w in walls if places.get(w)), default=0)
                    open_ = [places[c] for c in closed.split() if places.get(c)]
                    close(min((x[bisect_right(x, wall)] for x in open_ if x[-1] > wall), default=len(stack)))
                if tag not in VOID:
                    names = " ".join(a or b or c for a, b, c in NAMES.findall(rest)).lower() if rest and "=" in rest else ""
                    node = page.add(tag, stack[-1], names)
                    if not rest.endswith("/") or tag in BLOCKS:
                        places.setdefault(tag, []).append(len(stack))
                        stack.append(node)
        elif not m[0].startswith("<") or m[0] == "<":
            text = html.unescape(m[0]) if "&" in m[0] else m[0]
            held.append(text)
            if link >= 0:
                linked += len(text.strip())
    close(0)
    page.end[0] = len(page.tag)
    return page


def numbers(pages: list[Page]) -> np.ndarray:
    """A row of features for each node of the pages, one page after another."""
    sizes = np.array([len(p.tag) for p in pages])
    base = np.concatenate([[0], np.cumsum(sizes)])
    n = int(base[-1])
    shift = np.repeat(base[:-1], sizes)
    every = np.arange(n)
    join = lambda name: [x for p in pages for x in getattr(p, name)]
    parent = np.array(join("parent")) + shift
    parent[base[:-1]] = base[:-1]
    end = np.array(join("end")) + shift
    texts = join("text")
    kind = np.array([TAGS.index(k) if (k := KIND.get(t, t)) in TAGS else TAGS.index("div") for t in join("tag")])
    leaf = kind == TAGS.index("#text")
    chars = np.fromiter(map(len, texts), float, n)
    words = np.fromiter((t.count(" ") + 1 if t else 0 for t in texts), float, n)
    marks = np.fromiter((t.count(",") + t.count(".") for t in texts), float, n)
    linked = np.array(join("linked"), float)
    told = np.zeros((n, len(WORDS)))
    for i, names in enumerate(join("names")):
        if names:
            for w in TOKEN.findall(names):
                if w in TELLS:
                    told[i, TELLS[w]] = 1

    def below(x):
        sums = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)])
        return sums[end] - sums[every]

    def above(x):
        """Of the nodes that a node lies under."""
        steps = np.zeros((n + 1, *x.shape[1:]))
        np.add.at(steps, every + 1, x)
        np.add.at(steps, end, -x)
        return np.cumsum(steps, 0)[:n]

    own_tag = np.zeros((n, len(TAGS)))
    own_tag[every, kind] = 1
    depth = above(np.ones(n))
    t_chars, t_words, t_marks, t_links, t_leaves = (below(x) for x in (chars, words, marks, linked, leaf.astype(float)))
    page = np.repeat(np.arange(len(pages)), sizes)
    whole = np.maximum(t_chars[base[:-1]], 1)[page]
    before = np.concatenate([[0], np.cumsum(chars)])[every] - np.concatenate([[0], np.cumsum(chars)])[base[page]]
    in_p = below(np.where(leaf & (own_tag[parent, TAGS.index("p")] > 0), chars, 0))
    # siblings
    child = every != base[page]
    n_children = np.bincount(parent[child], minlength=n).astype(float)
    order = np.lexsort((every, parent))
    order = order[child[order]]
    rank = np.zeros(n)
    if len(order):
        new = np.append(True, parent[order][1:] != parent[order][:-1])
        rank[order] = np.arange(len(order)) - np.nonzero(new)[0][np.cumsum(new) - 1]
    siblings = n_children[parent]
    mean = t_chars[parent] / np.maximum(siblings, 1)
    density = t_links / np.maximum(t_chars, 1)
    # the text runs before and after
    runs = np.nonzero(leaf)[0]
    pad = np.concatenate([chars[runs], [0]])
    dense = np.concatenate([density[runs], [0]])
    owner = np.concatenate([page[runs], [-1]])
    last = np.searchsorted(runs, every) - 1
    nxt = np.searchsorted(runs, end)
    near = []
    for k in (last, nxt):
        ok = owner[k] == page
        near += [np.where(ok, np.log1p(pad[k]), 0), np.where(ok, dense[k], 0)]
    return np.column_stack([
        own_tag, above(own_tag), told, above(told), below(told) - told, np.log1p(t_chars), np.log1p(t_words), density, t_marks / np.maximum(t_words, 1), np.log1p(t_leaves),
        np.log1p(t_chars / np.maximum(end - every, 1)), t_chars / whole, in_p / np.maximum(t_chars, 1), depth, n_children, rank, rank / np.maximum(siblings - 1, 1), np.log1p(siblings),
        t_chars / np.maximum(t_chars[parent], 1), t_chars / np.maximum(mean, 1), before / whole, 1 - (before + t_chars) / whole, density[parent], *near,
    ]).astype(np.float32)
