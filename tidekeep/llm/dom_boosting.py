"""Main text of web pages by gradient-boosted trees over the nodes of the page's tree.

A page is parsed into its block elements (inline elements belong to the block around them). Each has features: sizes,
share of link text, punctuation and tags per text of its subtree, depth, position, siblings, its kind of element, and
words of its class, id, role and name attributes and of those above it. Boosted trees give the probability that a
node holds main text. The choice over the whole tree is then made at once: a node can only hold main text if its
parent does, and among all such choices the most probable one is taken (``decode``), so none contradicts another.

There are no labels, so the trees are fitted to weak ones, on a bounded sample: at most ``SAMPLE`` pages, those of
the smallest hashes of their ids. On these the article is known from its element (or taken as the node with most text
of its own paragraphs), and each page is also rebuilt in disguise, with neutral elements and with menus, notices,
adverts, forms and comments around and inside the article, of which it is known that they are none.

Text: character references are decoded, white space in a block becomes one space, blocks are joined in page order by
a line feed. Nulls: a null page is empty and has no text; null ids and urls are kept. Rows that repeat are extracted
each for itself. An empty table gives an empty result. Other columns of the input are not read.
"""

import random
import re
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekeep.llm.base import slices

SAMPLE, TREES, DEPTH, SEED = 200, 20, 4, 11

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template svg head title textarea select button iframe object".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i img ins kbd label mark q s samp small span strike "
             "strong sub sup time tt u var wbr br del".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
               "hr main nav ol p pre section table ul li dd dt body".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
KINDS = ["nav menu", "header", "footer", "aside", "form fieldset", "article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6",
         "ul ol dl", "li dt dd", "table tbody tr td th", "blockquote pre figure", "body html"]
KIND = {tag: i for i, tags in enumerate(KINDS) for tag in tags.split()}
GOOD = set("article articlebody content entry main post story text body".split())
BAD = set("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion "
          "footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pagination popup promo "
          "reader related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar "
          "widget".split())
MARKS = re.compile(r"[.,;:!?]")


class Page(HTMLParser):
    """Blocks of a page in order, and its runs of text with the block they stand in."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.attrs, self.inner = ["#"], [-1], [""], [0]
        self.runs: list[tuple[int, int, str]] = []  # block, number of the break before, text
        self.linked: list[bool] = []
        self.open: list[tuple[str, int]] = [("#", 0)]  # element, its block
        self.silent = self.links = self.breaks = 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close_to("p", CLOSES_P - {"p"})
        for other in SAME.get(tag, ()):
            self._close_to(other, {"ul", "ol", "dl", "table", "select"})
        block = self.open[-1][1]
        if tag not in INLINE:
            self.breaks += 1
            if tag not in VOID:
                self.tag.append(tag)
                self.parent.append(block)
                self.attrs.append(" ".join(v for k, v in attrs if v and k in ("class", "id", "role", "name", "itemprop", "aria-label")))
                self.inner.append(0)
                block = len(self.tag) - 1
        self.inner[block] += 1
        if tag not in VOID:
            self.open.append((tag, block))
            self.silent += tag in SILENT
            self.links += tag == "a"

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close_to(tag, set())

    def _close_to(self, tag, walls):
        """Closes the innermost open ``tag`` with all in it, unless one of ``walls`` stands before it."""
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i][0]
            if name == tag:
                for closed, _ in self.open[i:]:
                    self.silent -= closed in SILENT
                    self.links -= closed == "a"
                    self.breaks += closed not in INLINE
                del self.open[i:]
                return
            if name in walls:
                return

    def handle_data(self, data):
        if not self.silent and data:
            self.runs.append((self.open[-1][1], self.breaks, data))
            self.linked.append(self.links > 0)

    def text(self, chosen) -> str:
        """Blocks of the chosen nodes."""
        blocks: list[list] = []
        for node, at, data in self.runs:
            if chosen[node]:
                if not blocks or blocks[-1][0] != at:
                    blocks.append([at])
                blocks[-1].append(data)
        lines = (" ".join("".join(b[1:]).split()) for b in blocks)
        return "\n".join(line for line in lines if line)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        own = np.zeros((6, n))  # characters, words, marks, linked characters, tags, blocks with text
        for (node, _, data), linked in zip(self.runs, self.linked):
            size = len(data.strip())
            if size:
                own[:, node] += (size, data.count(" ") + 1, len(MARKS.findall(data)), size * linked, 0, 0)
        own[4], own[5] = self.inner, own[0] > 0
        kind = np.array([KIND.get(t, len(KINDS)) for t in self.tag])
        words = [set(re.split(r"[^a-z]+", a.lower())) if a else () for a in self.attrs]
        good = np.array([len(GOOD.intersection(w)) for w in words], float)
        bad = np.array([len(BAD.intersection(w)) for w in words], float)
        bad += np.isin(kind, (0, 1, 2, 3, 4))
        below, depth = own.copy(), np.zeros(n)
        above_good, above_bad, siblings, alike, place = (np.zeros(n) for _ in range(5))
        children: dict[int, list[int]] = {}
        for i in range(1, n):
            p = self.parent[i]
            depth[i] = depth[p] + 1
            above_good[i], above_bad[i] = above_good[p] + good[p], above_bad[p] + bad[p]
            children.setdefault(p, []).append(i)
        for i in range(n - 1, 0, -1):
            below[:, self.parent[i]] += below[:, i]
        for p, nodes in children.items():
            many = len(nodes)
            same: dict = {}
            for j, i in enumerate(nodes):
                siblings[i], place[i] = many, j / many
                same[kind[i]] = same.get(kind[i], 0) + 1
            for i in nodes:
                alike[i] = same[kind[i]] / many
        start = np.concatenate(([0], np.cumsum(own[0])[:-1])) / max(1, own[0].sum())
        held = np.maximum(below[0], 1)
        p_kids = np.bincount(parent[1:], kind[1:] == KIND["p"], minlength=n) if n > 1 else np.zeros(n)
        li_kids = np.bincount(parent[1:], kind[1:] == KIND["li"], minlength=n) if n > 1 else np.zeros(n)
        kinds = (kind[:, None] == np.arange(len(KINDS))).astype(float)
        up = kind[np.maximum(parent, 0)]
        columns = [np.log1p(below[0]), below[0] / max(1, own[0].sum()), below[3] / held, below[4] / held, below[2] / np.maximum(below[1], 1),
                   below[1] / np.maximum(below[5], 1), np.log1p(own[0]), own[3] / np.maximum(own[0], 1), depth, np.log1p(siblings), alike,
                   place, start, np.log1p(p_kids), np.log1p(li_kids), good, bad, above_good, above_bad, up, held[np.maximum(parent, 0)] / held]
        return np.column_stack([*columns, kinds])


def weak_labels(page: Page) -> np.ndarray:
    """Nodes that hold main text: the article (or the node with most text in paragraphs of its own), what is in it but
    for boilerplate, and what it is in."""
    n = len(page.tag)
    size = np.zeros(n)
    for node, _, data in page.runs:
        size[node] += len(data.strip())
    marked = [i for i in range(n) if page.tag[i] in ("article", "main") or page.tag[i] == "div" and "x-article" in page.attrs[i]]
    if marked:
        root = max(marked, key=lambda i: (page.tag[i] == "article", "x-article" in page.attrs[i], -i))
    else:
        mass = np.zeros(n)
        for i in range(1, n):
            if page.tag[i] == "p":
                mass[page.parent[i]] += size[i]
        root = int(mass.argmax())
    label = np.zeros(n, bool)
    bad = [bool(BAD.intersection(re.split(r"[^a-z]+", a.lower()))) or KIND.get(t, 9) < 5 for t, a in zip(page.tag, page.attrs)]
    for i in range(n):
        label[i] = i == root or i > 0 and label[page.parent[i]] and not bad[i]
    i = page.parent[root]
    while i >= 0:
        label[i] = True
        i = page.parent[i]
    return label


def disguised(page: Page, label: np.ndarray, seed: int) -> str:
    """The page's texts in a page of another make; elements of the article bear ``x-article`` for ``weak_labels``."""
    rng = random.Random(seed)
    chosen = page.text(label).split("\n")
    words = " ".join(chosen).split() or ["x"]

    def some(n):
        at = rng.randrange(len(words))
        return escape(" ".join((words[at:at + n] + words)[:n]))

    def links(n):
        return "".join(f"<li><a href='#'>{some(rng.randint(1, 3))}</a></li>" for _ in range(n))

    def prose(n):
        return "".join(f"<p>{some(rng.randint(6, 40))}.</p>" for _ in range(n))

    def box(name, inside, tag=None):
        return f"<{tag or 'div'} class='{name}'>{inside}</{tag or 'div'}>"

    before = [box(rng.choice(["nav", "menu", "navbar top"]), f"<ul>{links(rng.randint(3, 9))}</ul>", rng.choice(["div", "nav"])),
              box(rng.choice(["header", "site-header"]), f"<h1>{some(3)}</h1><p>{some(6)}</p>", rng.choice(["header", "div"])),
              box(rng.choice(["cookie-notice", "notice consent"]), prose(1)), box("breadcrumb", links(2)),
              box(rng.choice(["ad", "advert banner"]), f"<p>{some(8)}</p>"), f"<form>{some(4)}<input><label>{some(2)}</label></form>"]
    after = [box(rng.choice(["sidebar", "widget"]), f"<h3>{some(2)}</h3><ul>{links(5)}</ul>{prose(1)}", rng.choice(["aside", "div"])),
             box(rng.choice(["comments", "replies discussion"]), f"<h3>{some(1)}</h3>" + "".join(
                 box("comment", f"<p>{some(2)}</p>{prose(rng.randint(1, 2))}") for _ in range(rng.randint(1, 5))), rng.choice(["div", "section"])),
             box(rng.choice(["related", "share social"]), f"<ul>{links(4)}</ul>"), box("newsletter", f"<p>{some(9)}</p><form><input>{some(1)}</form>"),
             box(rng.choice(["footer", "site-footer"]), f"<p>{some(8)}</p><ul>{links(3)}</ul>", rng.choice(["footer", "div"])),
             box("ad promo", prose(1))]
    rng.shuffle(before)
    rng.shuffle(after)
    body = [f"<h1>{escape(chosen[0])}</h1>", *(f"<p>{escape(line)}</p>" for line in chosen[1:])]
    if rng.random() < 0.5:
        body.insert(rng.randint(1, len(body)), box(rng.choice(["ad", "related", "newsletter", "share"]), prose(1)))
    name = rng.choice(["", "content", "post", "entry", "c1", "wrap"])
    article = f"<div class='x-article {name}'>{''.join(body)}</div>"
    inside = "".join(before[:rng.randint(0, 5)]) + article + "".join(after[:rng.randint(0, 5)])
    return f"<html><body>{rng.choice([inside, f'<div>{inside}</div>', f'<div id=page><div>{inside}</div></div>'])}</body></html>"


def _training_rows(batches):
    """Label and features of the nodes of sampled pages and of their disguises."""
    for batch in batches:
        for number, html in zip(batch.column("seed").to_pylist(), batch.column("html").to_pylist()):
            page = Page(html)
            pages = [page, *(Page(disguised(page, weak_labels(page), number + k)) for k in range(3))]
            for page in pages:
                label = weak_labels(page)
                page.attrs = [a.replace("x-article", "") for a in page.attrs]
                features = page.features()
                yield pa.RecordBatch.from_arrays([pa.array(label.astype(float)), pa.array(list(features), pa.list_(pa.float64()))],
                                                 names=["label", "x"])


class Trees:
    """Boosted trees as arrays; scores many rows at once."""

    def __init__(self, text: str, weights):
        """``text`` is the printed form of the fitted model: one line for each branch and leaf."""
        self.trees = []
        for part, weight in zip(re.split(r"\n\s*Tree \d+ .*\n", text)[1:], weights):
            lines = [line.strip() for line in part.split("\n") if line.strip()]
            nodes: list[list] = []  # feature, threshold, left, right, value

            def read(at):
                line, me = lines[at], len(nodes)
                nodes.append([0, 0.0, me, me, 0.0])
                if line.startswith("Predict:"):
                    nodes[me][4] = float(line.split(":")[1]) * weight
                    return at + 1
                feature, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
                nodes[me][:2] = int(feature), float(limit)
                nodes[me][2] = len(nodes)
                at = read(at + 1)
                nodes[me][3] = len(nodes)
                return read(at + 1)  # behind the line that says Else

            read(0)
            self.trees.append([np.array(c) for c in zip(*nodes)])

    def chance(self, x: np.ndarray) -> np.ndarray:
        """Probability of main text for the rows of ``x``."""
        margin, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, limit, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                at = np.where(x[rows, feature[at]] <= limit[at], left[at], right[at])
            margin += value[at]
        return 1 / (1 + np.exp(-2 * np.clip(margin, -20, 20)))


def fit(pages: DataFrame, sample: int = SAMPLE, key: str = "page_id", html: str = "html") -> Trees | None:
    """Trees fitted to at most ``sample`` pages; None if there is no page with text."""
    seed = F.pmod(F.xxhash64(F.col(key).cast("string"), F.coalesce(F.col(html), F.lit(""))), F.lit(1 << 40))
    ids = pages.where(F.length(F.trim(html)) > 0).select(seed.alias("seed")).distinct().orderBy("seed").limit(sample)
    chosen = pages.select(seed.alias("seed"), F.col(html).alias("html")).join(F.broadcast(ids), "seed", "left_semi") \
        .dropDuplicates(["seed"]).repartition(4)
    rows = chosen.mapInArrow(_training_rows, "label double, x array<double>") \
        .select("label", array_to_vector("x").alias("features"))
    rows = rows.persist()
    try:
        if rows.select("label").distinct().count() < 2:
            return None
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=SEED).fit(rows)
    finally:
        rows.unpersist()
    return Trees(model.toDebugString, model.treeWeights)


def decode(parent, chance: np.ndarray) -> np.ndarray:
    """The most probable choice of nodes in which a chosen node's parent is chosen."""
    yes, no = np.log(np.clip(chance, 1e-6, 1)), np.log(np.clip(1 - chance, 1e-6, 1))
    n = len(parent)
    without, best = no.copy(), yes.copy()  # of the subtree: nothing chosen; the node chosen, and below it what is best
    for i in range(n - 1, 0, -1):
        without[parent[i]] += without[i]
        best[parent[i]] += max(best[i], without[i])
    chosen = np.zeros(n, bool)
    chosen[0] = best[0] > without[0]
    for i in range(1, n):
        chosen[i] = chosen[parent[i]] and best[i] > without[i]
    return chosen


def extract(pages: DataFrame, trees: Trees | None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row."""
    source = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    kind = source.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "html"):
            parsed = [Page(h) for h in batch.column("html").to_pylist()]
            found = [""] * len(parsed)
            if trees:
                features = [p.features() for p in parsed]
                chance = np.split(trees.chance(np.concatenate(features)), np.cumsum([len(f) for f in features])[:-1])
                found = [p.text(decode(p.parent, c)) for p, c in zip(parsed, chance)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()),
                                              pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
