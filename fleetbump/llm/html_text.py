"""Main text of web pages by a tree-structured graphical model over the DOM (operator 6).

Every block element is a binary node (content or not). A node's potential comes from its tag, class and id words, the
length, links and punctuation of its own text, and its place; an edge's from parent and child. Sum-product messages go up
from the leaves and down from the root, and give each node's exact marginal; text of nodes of 0.5 or more is the
article's, in page order.

Training: on at most ``sample`` pages (a documented bound; chosen by hash of the id) that mark their article by
``article`` or ``main``, nodes inside it are labelled as content unless they stand under an element that says it is
something else; a few written pages with known labels stand beside them. Each page counts twice, the second time with
its telling tags and words hidden, so that text and place are learned too. Counts of features and edges, one small
table, are summed over tasks.

A page is parsed and judged inside its row: nothing is shuffled. Edge cases: null or empty html gives empty text; broken
markup ends at the end of the page; repeated rows and null ids keep their rows; without training pages the written
pages alone are the labels.
"""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    sample: int = 2000
    smoothing: float = 0.5
    # Features of a node overlap in what they tell, so each counts for less than its full weight.
    trust: float = 0.6
    least: float = 0.5


# Elements by their part in the HTML standard.
BLOCKS = frozenset(
    "html head body title article section main nav aside header footer address div p h1 h2 h3 h4 h5 h6 blockquote pre "
    "ul ol li dl dt dd figure figcaption table caption thead tbody tfoot tr td th form fieldset legend details summary "
    "dialog hr menu search center".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template textarea select option button svg iframe object canvas title".split())
CLOSES_P = BLOCKS - {"html", "head", "body", "title"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
TELLING = frozenset("article main nav aside header footer form dialog menu search address".split())
NOT_ARTICLE = frozenset("nav aside header footer form dialog menu search".split())
HINT = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|advert\w*|adbox|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|alert|popup|modal|overlay|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|side|widget|related|recommended|share|sharing|"
    r"social|subscribe|newsletter|signup|login|comments?|reply|replies|respond|disqus|footer|header|masthead|copyright|"
    r"legal|toolbar|search)(?:$|[^a-z])"
)

GOOD = re.compile(r"(?:^|[^a-z])(?:article\w*|content|post|entry|story|main|prose|body)(?:$|[^a-z])")

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|object|canvas|select|button)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Node:
    tag: str
    parent: int
    words: str = ""
    label: str = ""
    depth: int = 0
    # Own text in runs, each ended by a nested block; and how much of it stands in links.
    runs: list[list[str]] = field(default_factory=list)
    linked: int = 0
    children: int = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, int]]]:
    """Block elements in page order, and the (node, run) pairs of their text in page order."""
    nodes, order = [Node("#page", -1)], []
    stack, links, fresh, at = [0], 0, True, 0

    def text(piece: str) -> None:
        nonlocal fresh
        if not piece:
            return
        own = nodes[stack[-1]]
        if fresh:
            if not piece.strip():
                return
            own.runs.append([])
            order.append((stack[-1], len(own.runs) - 1))
            fresh = False
        own.runs[-1].append(piece)
        if links:
            own.linked += len(piece)

    def close(to: int) -> None:
        nonlocal fresh
        del stack[to:]
        fresh = True

    for m in _TAG.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            text(" ")
        elif name == "a":
            links = 0 if m["end"] else 1
        if name not in BLOCKS:
            continue
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag == name:
                    close(i)
                    links = 0
                    break
            continue
        if name in CLOSES_P and nodes[stack[-1]].tag == "p":
            close(len(stack) - 1)
        if name in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[i]].tag
                if tag in SCOPES[name]:
                    break
                if tag in SIBLINGS[name]:
                    close(i)
                    break
        fresh = True
        if name in VOID:
            continue
        rest = m["rest"] or ""
        words = " ".join(a or b or c for a, b, c in _NAMED.findall(rest)).lower() if "=" in rest else ""
        label = re.search(r'data-label="(\d)"', rest)
        nodes[stack[-1]].children += 1
        nodes.append(Node(name, stack[-1], words, label[1] if label else "", len(stack)))
        stack.append(len(nodes) - 1)
    text(page[at:])
    return nodes, order


def _bucket(n: float) -> int:
    return int(math.log2(n + 1))


def features(nodes: list[Node], hidden: bool = False) -> list[list[str]]:
    """Named features of each node; ``hidden`` leaves out what tags and words tell."""
    out = []
    for i, node in enumerate(nodes):
        own = "".join("".join(run) for run in node.runs)
        size = len(own)
        tag = "div" if hidden and node.tag in TELLING else node.tag
        stops = own.count(". ") + own.count(", ") + own.rstrip().endswith((".", "!", "?"))
        told = [f"tag={tag}", f"size={min(_bucket(size), 9)}", f"stops={min(_bucket(stops), 4)}"]
        if size:
            told.append(f"linked={round(4 * min(1.0, node.linked / size))}")
        told.append(f"under={nodes[node.parent].tag if node.parent >= 0 and not hidden else ''}")
        if node.words and not hidden:
            told.append(f"hint={'other' if HINT.search(node.words) else 'own' if GOOD.search(node.words) else 'none'}")
        out.append(told)
    return out


def labels(nodes: list[Node]) -> list[int] | None:
    """Labels by the page's own marks: None if it does not mark its article."""
    given = any(node.label for node in nodes)
    if not given and not any(node.tag in ("article", "main") for node in nodes):
        return None
    out = [0] * len(nodes)
    for i, node in enumerate(nodes[1:], 1):
        if given:
            out[i] = int(node.label) if node.label else out[node.parent]
        elif node.tag in NOT_ARTICLE or HINT.search(node.words):
            # From here down nothing is content.
            out[i] = -1
        else:
            out[i] = 1 if out[node.parent] == 1 or (out[node.parent] == 0 and node.tag in ("article", "main")) else out[node.parent]
    return [max(x, 0) for x in out]


# Written pages with labels, for parts that a corpus may lack. A label holds for what is nested until another one is given.
EXAMPLES = (
    '<body data-label="0"><header class="site-header"><h1>Name</h1><form><p>Search this site</p></form></header><div class="wrap">'
    '<div class="post" data-label="1"><h1>A title of some words</h1><p>A first paragraph, with a comma, and of some length. It has'
    " two sentences.</p><p>The second one goes on for a while, as articles do. It ends here.</p><h2>More</h2><blockquote><p>A quoted"
    ' line, said by someone.</p></blockquote><ul><li>One point that matters, in short.</li><li>Another point, as long.</li>'
    "<li>A third one of them.</li></ul><section><h3>Part</h3><p>A part of its own, with text. It belongs here.</p></section>"
    '<section class="newsletter" data-label="0"><p>Sign up, and read us each week.</p></section></div>'
    '<div class="comments" data-label="0"><p>A reader says this is good, and long enough to be a paragraph of its own.</p><p>Another'
    ' reader says no. They go on, too.</p></div></div><aside class="sidebar"><ul><li><a href="/a">Other</a></li><li><a href="/b">Next'
    "</a></li></ul></aside><footer><p>All of this is ours, 2020.</p></footer></body>",
    '<body data-label="0"><div id="cookie-notice"><p>This site uses cookies, as all do. Please agree to them.</p></div><nav><ul><li><a'
    ' href="/">Home</a></li><li><a href="/x">About</a></li></ul></nav><main data-label="1"><h1>Head line</h1><section><p>Text of a'
    " section that is long enough, with commas, to look like an article. And one more sentence.</p><table><tr><td>Cell one</td><td>Cell"
    ' two</td></tr></table></section><ol><li>First do this, and wait.</li><li>Then do that.</li>'
    '<li>At last, look at it.</li></ol><div class="share" data-label="0"><a href="/f">Share</a></div><section id="comments"'
    ' data-label="0"><h2>Comments</h2><p>I like this, and say so at some length. Thank you.</p></section><form data-label="0"><p>Leave your'
    ' address here, and we write to you.</p></form></main><div class="related"><h3>Related</h3><ul><li><a href="/r">Read this</a></li>'
    '</ul></div><div class="footer"><p>Imprint and more.</p></div></body>',
    '<body data-label="0"><div><div><a href="/1">One</a> <a href="/2">Two</a></div><div data-label="1"><div>A page without any telling'
    " names, yet with a long text, commas, and stops. It is the article.</div><div>And goes on in a second block, which is as long as"
    ' the first one was.</div></div><div class="ad"><p>Buy this now, it is cheap. Really.</p></div></div></body>',
)


def kind(node: Node) -> int:
    """1 for an element that says it is not the article, so that its children follow it more strictly."""
    return int(node.tag in NOT_ARTICLE or bool(HINT.search(node.words)))


def count(page: str | None) -> dict[tuple[str, int], int]:
    """Counts of (feature, label) and of (edge, labels) of a page with labels."""
    nodes, _ = parse(page or "")
    given = labels(nodes)
    counts: dict[tuple[str, int], int] = {}
    if given is None:
        return counts
    for hidden in (False, True):
        for i, told in enumerate(features(nodes, hidden)):
            if i:
                for name in told:
                    counts[name, given[i]] = counts.get((name, given[i]), 0) + 1
    for i, node in enumerate(nodes[1:], 1):
        key = (f"#edge{kind(nodes[node.parent])}{given[node.parent]}", given[i])
        counts[key] = counts.get(key, 0) + 1
    return counts


@dataclass
class Model:
    weights: dict[str, float]
    # Log potentials by kind of the parent, its label, and the child's label.
    edges: tuple


def _counted(batches):
    for batch in batches:
        total: dict[tuple[str, int], int] = {}
        for page in batch.column("html").to_pylist():
            for key, n in count(page).items():
                total[key] = total.get(key, 0) + n
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([total[k] for k in keys], pa.int64())],
            ["feature", "label", "n"],
        )


def fitted(counts: dict[tuple[str, int], float], s: Settings) -> Model:
    # The written pages, which stand for other layouts, together weigh as much as the sample.
    pages = counts.get(("tag=body", 0), 0) / 2
    weight = max(1.0, pages / len(EXAMPLES))
    for page in EXAMPLES:
        for key, n in count(page).items():
            counts[key] = counts.get(key, 0) + n * weight
    names = {name for name, _ in counts if not name.startswith("#")}
    groups: dict[str, list[float]] = {}
    for name in names:
        own = groups.setdefault(name.split("=")[0], [0.0, 0.0])
        for label in (0, 1):
            own[label] += counts.get((name, label), 0) + s.smoothing
    weights = {}
    for name in names:
        own = groups[name.split("=")[0]]
        one, zero = ((counts.get((name, x), 0) + s.smoothing) / own[x] for x in (1, 0))
        weights[name] = s.trust * math.log(one / zero)
    def edge(of: int, parent: int) -> tuple[float, float]:
        both = [counts.get((f"#edge{of}{parent}", child), 0) + 1.0 for child in (0, 1)]
        return tuple(math.log(x / sum(both)) for x in both)

    edges = tuple(tuple(edge(of, parent) for parent in (0, 1)) for of in (0, 1))
    return Model(weights, edges)


def train(pages: DataFrame, settings: Settings = Settings()) -> Model:
    chosen = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(settings.sample)
    # At most `sample` ids.
    sample = pages.select("page_id", "html").join(F.broadcast(chosen), "page_id", "left_semi").select("html")
    counts = sample.mapInArrow(_counted, "feature string, label long, n long").groupBy("feature", "label").agg(F.sum("n").alias("n"))
    # Features are tags, buckets and hints: a small, fixed set of names.
    return fitted({(r.feature, r.label): float(r.n) for r in counts.collect()}, settings)


def _log_sum(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def marginals(nodes: list[Node], model: Model) -> list[float]:
    """P(content) of each node: messages up in reverse page order, then down in page order."""
    n = len(nodes)
    follow = [model.edges[kind(nodes[node.parent])] for node in nodes]
    zero, one = [0.0] * n, [0.0] * n
    for i, told in enumerate(features(nodes)):
        one[i] = sum(model.weights.get(name, 0.0) for name in told) if i else -20.0
    up = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):
        parent = nodes[i].parent
        (e00, e01), (e10, e11) = follow[i]
        up[i] = _log_sum(e00 + zero[i], e01 + one[i]), _log_sum(e10 + zero[i], e11 + one[i])
        zero[parent] += up[i][0]
        one[parent] += up[i][1]
    for i in range(1, n):
        parent = nodes[i].parent
        (e00, e01), (e10, e11) = follow[i]
        # The parent's belief without what came from this node.
        a, b = zero[parent] - up[i][0], one[parent] - up[i][1]
        zero[i] += _log_sum(a + e00, b + e10)
        one[i] += _log_sum(a + e01, b + e11)
    return [1 / (1 + math.exp(min(max(z - o, -700), 700))) for z, o in zip(zero, one, strict=True)]


def main_text(page: str | None, model: Model, least: float = 0.5) -> str:
    nodes, order = parse(page or "")
    found = marginals(nodes, model)
    out = []
    for node, run in order:
        if found[node] >= least and nodes[node].tag not in HIDDEN:
            block = " ".join(entities.unescape("".join(nodes[node].runs[run])).split())
            if block:
                out.append(block)
    return "\n".join(out)


def extract(pages: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""

    def extracted(batches):
        for batch in batches:
            texts = [main_text(page, model, settings.least) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = slim.mapInArrow(extracted, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
