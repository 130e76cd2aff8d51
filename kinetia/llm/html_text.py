"""Main text of web pages: gradient-boosted trees over DOM nodes, and a decoding that keeps ancestors and descendants in line.

Each block node and each run of text of a page gets features: its element, attribute words, depth, text density of its
subtree, links, punctuation, place among its siblings, and what it lies under. The trees say how likely it is that the node holds
article text. Decoding takes the most likely labelling of the page in which a node is kept only if its parent is and, if it has
nodes below, one of them; it is a dynamic programme over the tree. The text runs that are kept are the article's blocks.

The trees are fitted on a bounded sample: ``sample_pages`` pages of the table, labelled by their own article or main
elements (of each at most ``sample_nodes`` nodes, whatever its length), and ``made_pages`` generated ones whose truth is known. In half of the generated pages, and in a copy of each
sampled one, semantic elements and attributes are hidden, so that the trees don't lean on these alone. Scoring is one pass
over all pages and whole texts.

Defined results: null and empty pages, and pages without article text, give an empty text; repeated rows give equal rows; a
null page_id is kept, and page_id keeps its type; very long pages are read whole; of labellings that are equally likely the smaller is taken; extra columns are ignored by ``extract``; empty tables give no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetia.llm import dom
from kinetia.llm.common import few, table, typed

EXTRACTED = "page_id long, url string, text string, n_chars long"
MARK = ""  #: before article text of generated pages


@dataclass(frozen=True)
class Params:
    sample_pages: int = 300
    sample_nodes: int = 2_000  #: of a sampled page that are learned from, evenly spread over it
    made_pages: int = 700
    trees: int = 60
    depth: int = 4
    bins: int = 24
    rate: float = 0.25
    ridge: float = 3.0
    seed: int = 31


class Trees:
    """Boosted complete trees: at each inner node a feature and a threshold, at the end a weight."""

    def __init__(self, x: np.ndarray, y: np.ndarray, params: Params):
        self.depth = params.depth
        inner = (1 << params.depth) - 1
        self.feature = np.zeros((params.trees, inner), np.int64)
        self.limit = np.full((params.trees, inner), np.inf, np.float32)
        self.weight = np.zeros((params.trees, inner + 1))
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, params.bins + 1)[1:-1], method="higher")) for c in x.T]
        code = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])  # feature x row
        margin = np.full(len(y), self.bias)
        n_bins = params.bins
        for t in range(params.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(params.depth):
                width, first = 1 << level, (1 << level) - 1
                best, pick, where = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, n_bins)
                for f in range(len(code)):
                    if not len(cuts[f]):
                        continue
                    cell = node * n_bins + code[f]
                    gs = np.cumsum(np.bincount(cell, g, width * n_bins).reshape(width, n_bins), 1)
                    hs = np.cumsum(np.bincount(cell, h, width * n_bins).reshape(width, n_bins), 1)
                    tg, th = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + params.ridge) + (tg - gs) ** 2 / (th - hs + params.ridge) - tg**2 / (th + params.ridge)
                    k = gain[:, : len(cuts[f])].argmax(1)
                    got = gain[np.arange(width), k]
                    better = got > best
                    best[better], pick[better], where[better] = got[better], f, k[better]
                for j in range(width):
                    if where[j] < n_bins:
                        self.feature[t, first + j], self.limit[t, first + j] = pick[j], cuts[pick[j]][where[j]]
                node = 2 * node + (code[pick[node], np.arange(len(y))] > where[node])
            gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
            self.weight[t] = params.rate * gs / (hs + params.ridge)
            margin += self.weight[t][node]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        every = np.arange(len(x))
        for feature, limit, weight in zip(self.feature, self.limit, self.weight):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[every, feature[at]] > limit[at])
            out += weight[node]
        return out


def decode(page: dom.Page, margin: list[float]) -> list[bool]:
    """The labelling with the largest sum of margins in which no kept node has a parent that isn't kept, or only nodes below that aren't."""
    n = len(page.tag)
    gain, total, best = list(margin), [0.0] * n, [-1e18] * n
    for i in range(n - 1, -1, -1):
        if page.tag[i] != "#text":
            gain[i] = margin[i] + (total[i] if best[i] > 0 else best[i])
        if i:
            p = page.parent[i]
            total[p] += max(0.0, gain[i])
            best[p] = max(best[p], gain[i])
    kept = [False] * n
    for i in range(n):
        p = page.parent[i]
        if i == 0:
            kept[i] = gain[i] > 0
        elif kept[p]:
            kept[i] = gain[i] > 0 or (best[p] <= 0 and gain[i] == best[p])
    return kept


def labels(page: dom.Page, leaves: np.ndarray) -> np.ndarray:
    """Of all nodes, from those of the text runs: a node is article if a run below it is."""
    y = leaves.astype(float)
    sums = np.concatenate([[0], np.cumsum(y)])
    return (sums[np.array(page.end)] - sums[:-1] > 0).astype(float)


def semantic(page: dom.Page) -> np.ndarray | None:
    """Text runs of the page's own article: its largest article element, or main where it has none, less what lies in other parts. None: it has neither."""
    tag, end = np.array(page.tag), np.array(page.end)
    chars = np.concatenate([[0], np.cumsum([len(t) for t in page.text])])
    held = chars[end] - chars[:-1]
    for name in ("article", "main"):
        at = [i for i in np.nonzero(tag == name)[0] if "comment" not in page.names[i]]
        if at:
            i = max(at, key=lambda i: held[i])
            out = np.zeros(len(tag), bool)
            out[i : end[i]] = tag[i : end[i]] == "#text"
            for j in range(i + 1, end[i]):
                told = {dom.TELLS.get(w) for w in dom.TOKEN.findall(page.names[j])}
                if tag[j] in ("nav", "footer", "aside", "form") or told & {1, 5, 6, 7, 8, 9}:
                    out[j : end[j]] = False
            return out
    return None


def hidden(page: dom.Page) -> dom.Page:
    """The page without semantic elements and attributes."""
    plain = {"article", "main", "nav", "header", "footer", "aside", "section", "menu"}
    return dom.Page(["div" if t in plain else t for t in page.tag], page.parent, [""] * len(page.tag), page.end, page.text, page.linked)


def made(rng: random.Random) -> str:
    """A generated page in one of many layouts; article text begins with MARK."""
    syllables = "ka lo mi ter an os ré un ge sch tion ble en is do par el vu".split()

    def words(a: int, b: int) -> str:
        out = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", "", ",", ""]) for _ in range(rng.randint(a, b)))
        return out.capitalize() + (rng.choice([".", ".", "!", ""]) if b > 12 else "")

    def box(inner: str, tags: str, tell: str) -> str:
        tag = rng.choice(tags.split())
        name = rng.choice(dom.WORDS[tell].split())
        style = rng.random()
        attrs = "" if style < 0.25 or (tag != "div" and style < 0.5) else f' class="{name}"' if style < 0.7 else f' id="{name}-{rng.randint(1, 9)}"' if style < 0.85 else f' class="{rng.choice(["c1", "x-wrap", "row", "inner"])} {name}"'
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def links(a: int, b: int, form: str) -> str:
        found = [f'<a href="/{k}">{words(1, 3)}</a>' for k in range(rng.randint(a, b))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in found) + "</ul>" if form == "list" else rng.choice([" | ", " ", " &middot; "]).join(found)

    def good(inner: str, tag: str = "p") -> str:
        end = "" if tag in ("p", "li") and rng.random() < 0.1 else f"</{tag}>"
        return f"<{tag}>{MARK}{inner}{end}"

    def advert() -> str:
        return box(rng.choice([words(3, 25), f"<p>{words(5, 30)}</p>", f'<a href="#">{words(3, 12)}</a>']), "div div aside section", "advert")

    def teasers() -> str:
        return box(f"<h3>{words(1, 4)}</h3>" + "".join(f'<div><a href="#">{words(3, 9)}</a>{rng.choice(["", "<p>" + words(6, 18) + "</p>"])}</div>' for _ in range(rng.randint(2, 6))), "div section aside", "related")

    def paragraph() -> str:
        x = words(4, 90)
        if rng.random() < 0.25:
            x += f' <a href="#">{words(1, 4)}</a> {words(2, 20)}'
        return good(f"<b>{x}<br>" if rng.random() < 0.1 else x)

    blocks = [good(words(3, 10), rng.choice(["h1", "h1", "h2"]))] if rng.random() < 0.85 else []
    if rng.random() < 0.3:
        blocks.append(box(words(2, 6), "div", "share") if rng.random() < 0.6 else box(links(2, 5, "row"), "div", "share"))
    for _ in range(rng.choice([1, 2, 3, 4, 6, 10, 16])):
        r = rng.random()
        if r < 0.72:
            blocks.append(paragraph())
        elif r < 0.79:
            blocks.append(good(words(2, 7), rng.choice(["h2", "h3"])))
        elif r < 0.85:
            blocks.append("<ul>" + "".join(good(words(3, 20), "li") for _ in range(rng.randint(2, 6))) + "</ul>")
        elif r < 0.89:
            blocks.append(f"<blockquote>{paragraph()}</blockquote>")
        elif r < 0.92:
            blocks.append("<table>" + "".join(f"<tr>{good(words(1, 3), 'td')}{good(words(1, 5), 'td')}</tr>" for _ in range(rng.randint(2, 5))) + "</table>")
        elif r < 0.95:
            blocks.append(good(words(10, 60), "div"))
        elif r < 0.98:
            blocks.append(advert())
        else:
            blocks.append(teasers())
    body = "".join(blocks)
    tail = ""
    if rng.random() < 0.35:
        one = lambda: box(f"<b>{words(1, 2)}</b><p>{words(3, 50)}</p>", "div li article", "comment")
        tail += box(f"<h3>{words(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 6))), "div section", "comment")
    if rng.random() < 0.3:
        tail += teasers()
    if rng.random() < 0.25:
        tail += box(f'<p>{words(4, 16)}</p><label>{words(1, 3)}</label><input name="e"><button>{words(1, 2)}</button>', "form form div", "form")
    if rng.random() < 0.4:
        body += tail
        tail = ""
    article = box(body, "article article main div div section", "content") if rng.random() < 0.9 else body
    if rng.random() < 0.3:
        article = box(article + tail, "div main div", "content")
        tail = ""
    side = box("".join(rng.choice([lambda: links(3, 8, "list"), advert, teasers, lambda: f"<h4>{words(1, 3)}</h4><p>{words(5, 25)}</p>"])() for _ in range(rng.randint(1, 3))), "aside div div", "side") if rng.random() < 0.45 else ""
    middle = article + side if rng.random() < 0.6 else side + article
    if rng.random() < 0.08:
        middle = f"<table><tr><td>{side or links(4, 9, 'list')}</td><td>{article}</td></tr></table>"
    top = ""
    if rng.random() < 0.85:
        top += box(links(3, 9, rng.choice(["list", "list", "row"])), "nav nav div ul", "menu")
    if rng.random() < 0.5:
        top = box(rng.choice([f"<div>{words(1, 4)}</div>", f"<h1>{words(1, 3)}</h1>", f'<a href="/">{words(1, 3)}</a><p>{words(3, 9)}</p>']) + top, "header header div", "head")
    if rng.random() < 0.2:
        top += box(links(2, 4, "row"), "div nav", "menu")
    if rng.random() < 0.25:
        top += box(f"<p>{words(8, 30)}</p><button>{words(1, 2)}</button>", "div section aside", "notice")
    if rng.random() < 0.35:
        top += advert()
    foot = ""
    if rng.random() < 0.85:
        foot = box(rng.choice([f"&copy; {words(1, 4)} &middot; {words(3, 12)}", f"<p>{words(4, 20)}</p>" + links(2, 6, "row"), links(3, 9, "list") + f"<div>{words(2, 9)}</div>"]), "footer footer div", "foot")
    if rng.random() < 0.15:
        foot += box(f"<p>{words(8, 30)}</p>", "div", "notice")
    inner = top + middle + tail + foot
    for _ in range(rng.choice([0, 0, 1, 2])):
        inner = f"<div>{inner}</div>"
    if rng.random() < 0.06:
        inner = f"<form>{inner}</form>"
    return f"<html><head><title>{words(2, 6)}</title><script>var a='</p>';</script></head><body>{inner}" + ("</body></html>" if rng.random() < 0.9 else "")


def sampled(params: Params):
    """Features and labels of nodes of each page that has an article of its own, as it is and hidden."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, place in zip(b.column("html"), b.column("place")):
                page = dom.read(source.as_py())
                if (y := semantic(page)) is None or not y.any():
                    continue
                n = len(page.tag)
                at = np.arange(n) if n <= params.sample_nodes else np.linspace(0, n - 1, params.sample_nodes).astype(np.int64)
                for p in (page, hidden(page)):
                    cells = (x.tobytes() for x in (dom.numbers([p])[at], labels(page, y)[at].astype(np.float32)))
                    yield pa.RecordBatch.from_arrays([pa.array([place.as_py()], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], names=["place", "x", "y"])

    return run


def examples(found: list[tuple[np.ndarray, np.ndarray]], params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Nodes' features and labels: of sampled pages, and of generated ones."""
    rng = random.Random(params.seed)
    pages, ys = [], []
    for _ in range(params.made_pages):
        page = dom.read(made(rng))
        y = np.array([t.startswith(MARK) for t in page.text])
        page.text = [t.removeprefix(MARK).strip() for t in page.text]
        pages.append(page)
        ys.append(labels(page, y))
    shown = [hidden(p) if k % 2 else p for k, p in enumerate(pages)]
    xs = [*(x for x, _ in found), *([dom.numbers(shown)] if shown else [])]
    return np.concatenate(xs), np.concatenate([*(y for _, y in found), *ys])


def learn(pages: DataFrame, params: Params = Params()) -> Trees:
    some = few(pages.where("html != ''").select("html", F.xxhash64("page_id", "url").alias("place")), params.sample_pages, "place", "html")
    rows = some.mapInArrow(sampled(params), "place long, x binary, y binary").collect()  # of at most so many pages, so many nodes each
    found = [(np.frombuffer(y, np.float32), x) for _, x, y in sorted((r["place"], r["x"], r["y"]) for r in rows)]
    return Trees(*examples([(np.frombuffer(x, np.float32).reshape(len(y), -1), y) for y, x in found], params), params)


def _extract(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 256):
                b = whole.slice(lo, 256)
                pages = [dom.read(x.as_py()) for x in b.column("html")]
                margin = np.clip(trees.margins(dom.numbers(pages)), -6, 6).tolist()
                out, at = [], 0
                for p in pages:
                    kept = decode(p, margin[at : at + len(p.tag)])
                    at += len(p.tag)
                    out.append("\n".join(t for t, k in zip(p.text, kept) if k and t))
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """EXTRACTED: each page's main text."""
    held = pages.select("page_id", F.col("url").cast("string").alias("url"), "html")
    return held.mapInArrow(_extract(learn(pages, params)), typed(EXTRACTED, pages, "page_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
