"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page becomes its sequence of leaf blocks: runs of text that no block-level tag interrupts, each with the tags and
the class and id words of its ancestors. A two-label chain (content, other) reads features of ancestors and text; it
is trained by maximum likelihood (forward-backward) on labelled pages and decoded by Viterbi.

Labelled pages are a bounded sample (``PAGES``) of pages whose markup settles every block by itself: text inside one
article element and outside any part that the vocabulary below calls other. Each is also rewritten without that
markup (plain divisions, other class words, added notices, forms and comments from its own blocks), so that the
chain does not lean on one tag. All pages are then extracted by the model.

Defined results: null and empty html give the empty text; broken markup closes at the end of the page; a page whose
blocks are all judged other has the empty text; a missing sample (no page with an article) trains on the rewritten
forms of a built-in page alone; rows that repeat are extracted alike; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound of the sample of labelled pages, in pages.
PAGES = 300

# Tags that end a run of text, tags without content, tags whose content is not text.
BLOCK = frozenset("""address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure
 footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select
 summary table tbody td tfoot th thead title tr ul button""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object textarea audio video canvas head title select button".split())
# Silent tags whose content is no markup, so that only their own close tag ends them.
RAW = frozenset("script style textarea title iframe".split())
# A tag on the left is closed by the opening of one on the right.
CLOSES = {"p": BLOCK - {"button"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"},
          "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
# Words in tags, classes and ids that name parts of a page other than its article.
OTHER = frozenset("""nav menu header footer aside sidebar side ad ads advert advertisement banner sponsor sponsored promo notice cookie consent
 popup modal form login signup subscribe newsletter comment comments reply discussion share social related breadcrumb breadcrumbs pagination
 pager widget copyright disclaimer toolbar search masthead topbar""".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/<>]*)")
_STOP = re.compile("[<>\"']")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


#: Ancestors that a block lists, and those of them whose class and id words (so many each) are features. Farther ones
#: count by their kind alone, so that a page costs time in proportion to its length however deep it nests.
LISTED, NEAR, NAMES = 64, 6, 16


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]  # (tag, class and id words) of the LISTED innermost ancestors, outer first
    linked: int  # characters inside links
    said: frozenset[str] | None = None  # what all ancestors say; by default, what the listed ones do

    def __post_init__(self):
        if self.said is None:
            self.said = frozenset(kind for name, named in self.path for kind in kinds(name, named))


def kinds(name: str, named: tuple[str, ...]) -> list[str]:
    """What an ancestor says of the text in it."""
    own = [f"in={name}"] if name in BLOCK or name in OTHER else []
    if name in OTHER or OTHER.intersection(named):
        own.append("other")
    if name in ("article", "main") or "content" in named or "article" in named or "post" in named or "entry" in named:
        own.append("body")
    return own


class _Scanner:
    """Tags of a page from the left; no place is looked at more than a few times."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "<>\"'"}
        self.endless: set[str] = set()

    def _tag_end(self, at: int) -> int:
        """Behind the first > outside quotes; 0 if another tag begins before it or a quote stays open."""
        while m := _STOP.search(self.page, at):
            if m[0] == ">":
                return m.end()
            if m[0] == "<" or m.end() > self.last[m[0]]:
                return 0
            at = self.page.index(m[0], m.end()) + 1
        return 0

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the next tag; comments and declarations have no name."""
        page = self.page
        while 0 <= (start := page.find("<", at)):
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                return start, stop + 3 if stop >= 0 else len(page), False, "", ""
            if start > self.last[">"]:
                return None
            if page[start + 1] in "!?":
                return start, page.index(">", start) + 1, False, "", ""
            m = _NAME.match(page, start + 1)
            if m and (stop := self._tag_end(m.end())):
                return start, stop, bool(m[1]), m[2].lower(), page[m.end():stop - 1]
            at = start + 1
        return None

    def past(self, name: str, at: int) -> int:
        """Where the page goes on after the close tag of a silent element whose content begins at ``at``; -1 without one."""
        if name in self.endless:
            return -1
        found = -1
        if m := re.compile(rf"</{re.escape(name)}(?![^\s/>])", re.I).search(self.page, at):
            if name in RAW:
                found = self.page.find(">", m.end()) + 1 or len(self.page)
            else:
                while tag := self.next(at):
                    _, at, closing, inner, rest = tag
                    if closing and inner == name:
                        found = at
                        break
                    if not closing and inner in RAW and not rest.endswith("/"):
                        at = max(at, self.past(inner, at))
        if found < 0:
            self.endless.add(name)
        return found


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    said: list[frozenset[str]] = [frozenset()]  # of the ancestors up to each one
    opened: Counter[str] = Counter()
    run: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
        if text:
            out.append(Block(text, tuple(stack[-LISTED:]), linked, said[-1]))
        run.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        run.append(text)
        if opened["a"]:
            linked += len(text)

    def close(at: int) -> None:
        opened.subtract(name for name, _ in stack[at:])
        del stack[at:], said[at + 1:]

    at, scanner = 0, _Scanner(page)
    while tag := scanner.next(at):
        start, stop, closing, name, rest = tag
        add(page[at:start])
        at = stop
        if not name:
            continue
        if closing:
            if name in BLOCK:
                flush()
            if opened[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in BLOCK:
            flush()
            while stack and name in CLOSES.get(stack[-1][0], ()):
                close(len(stack) - 1)
            if opened["p"] and name in CLOSES["p"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        close(i)
                    if i >= len(stack) or stack[i][0] in BLOCK:
                        break
        elif name == "br":
            add(" ")
        if name in SILENT and not rest.endswith("/"):
            at = max(at, scanner.past(name, at))
            continue
        if name not in VOID and not rest.endswith("/"):
            words = tuple(w for g in _NAMED.findall(rest) for w in _WORD.findall("".join(g).lower()))
            stack.append((name, words))
            own = kinds(name, words)
            said.append(said[-1] if said[-1].issuperset(own) else said[-1].union(own))
            opened[name] += 1
    add(page[at:])
    flush()
    return out


# ---------------------------------------------------------------- features


def features(seq: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    n = len(seq)
    for i, b in enumerate(seq):
        text, size = b.text, len(b.text)
        words = text.count(" ") + 1
        own = [f"tag={b.path[-1][0]}" if b.path else "tag=", f"words={min(9, int(math.log2(words + 1)))}",
               f"links={min(4, int(4 * b.linked / size))}", f"end={text[-1] if not text[-1].isalnum() else 'x'}",
               f"stops={min(4, sum(map(text.count, '.!?')))}", f"commas={min(3, text.count(','))}",
               f"place={int(5 * i / n)}", f"first={text[0].isupper()}", "bias"]
        if i == 0:
            own.append("top")
        if i == n - 1:
            own.append("bottom")
        if "©" in text or "(c)" in text.lower():
            own.append("copyright")
        own += sorted(b.said)
        for name, named in b.path[-NEAR:]:
            own.append(f"in={name}")
            own += [f"name={w}" for w in named[:NAMES]]
        out.append(list(dict.fromkeys(own)))
    return out


# ---------------------------------------------------------------- chain


@dataclass
class Model:
    weight: dict[str, float]  # content against other
    stay: np.ndarray  # 2 x 2 transition scores
    start: np.ndarray

    def decode(self, seq: list[Block]) -> list[bool]:
        """Viterbi path: which blocks are content."""
        if not seq:
            return []
        get = self.weight.get
        (oo, oc), (co, cc) = self.stay.tolist()
        other, content = self.start.tolist()
        back: list[tuple[bool, bool]] = []
        for i, own in enumerate(features(seq)):
            gain = sum(get(f, 0.0) for f in own)
            if i:
                from_other = (other >= content + co - oo, other + oc > content + cc)
                back.append(from_other)
                other, content = (other + oo if from_other[0] else content + co), (other + oc if from_other[1] else content + cc)
            content += gain
        label = content > other
        path = [label]
        for to_other, to_content in reversed(back):
            label = not (to_content if label else to_other)
            path.append(label)
        return path[::-1]

    def extract(self, page: str | None) -> str:
        seq = blocks(page or "")
        return "\n\n".join(b.text for b, keep in zip(seq, self.decode(seq)) if keep)


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 120, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Maximum likelihood by forward-backward over all pages at once (padded to the longest), with Adam."""
    counts = Counter(f for seq, _ in pages for own in features(seq) for f in own)
    place = {f: i for i, f in enumerate(f for f, n in counts.items() if n > 1)}
    n, longest = len(pages), max(len(seq) for seq, _ in pages)
    cell, feature = [], []
    y, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for p, (seq, labels) in enumerate(pages):
        mask[p, : len(seq)] = True
        y[p, : len(seq)] = labels
        for i, own in enumerate(features(seq)):
            for f in own:
                if f in place:
                    cell.append(p * longest + i)
                    feature.append(place[f])
    cell, feature = np.array(cell), np.array(feature)
    flat = np.zeros(len(place) + 6)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    total = mask.sum()
    add = np.logaddexp
    for t in range(1, rounds + 1):
        w, stay, start = flat[:-6], flat[-6:-2].reshape(2, 2), flat[-2:]
        gain = np.bincount(cell, w[feature], minlength=n * longest).reshape(n, longest)
        node = np.stack([np.zeros_like(gain), gain], axis=2)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = start + node[:, 0]
        for i in range(1, longest):
            step = np.stack([add(alpha[:, i - 1, 0] + stay[0, k], alpha[:, i - 1, 1] + stay[1, k]) for k in (0, 1)], axis=1) + node[:, i]
            alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
        z = add(alpha[:, -1, 0], alpha[:, -1, 1])
        for i in range(longest - 2, -1, -1):
            ahead = node[:, i + 1] + beta[:, i + 1]
            step = np.stack([add(stay[k, 0] + ahead[:, 0], stay[k, 1] + ahead[:, 1]) for k in (0, 1)], axis=1)
            beta[:, i] = np.where(mask[:, i + 1, None], step, 0)
        chance = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        wrong = (chance[:, :, 1] - y) * mask
        g = np.zeros_like(flat)
        g[:-6] = np.bincount(feature, wrong.reshape(-1)[cell], minlength=len(place))
        pair = np.zeros((2, 2))
        inner = mask[:, 1:]
        for j in (0, 1):
            for k in (0, 1):
                both = alpha[:, :-1, j] + stay[j, k] + node[:, 1:, k] + beta[:, 1:, k] - z[:, None]
                pair[j, k] = (np.exp(np.minimum(both, 0)) * inner).sum() - ((y[:, :-1] == j) & (y[:, 1:] == k) & inner).sum()
        g[-6:-2] = pair.reshape(-1)
        g[-2:] = chance[:, 0].sum(axis=0) - np.bincount(y[:, 0], minlength=2)
        g = g / total + decay * flat
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        flat = flat - rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    return Model({f: float(flat[i]) for f, i in place.items()}, flat[-6:-2].reshape(2, 2).copy(), flat[-2:].copy())


# ---------------------------------------------------------------- labelled pages

# Fixed value: a page whose parts are labelled by hand, for a table without any labelled page.
SEED = """<body><header><h2>The Daily Page</h2></header><nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li></ul></nav>
<div class="ad">Buy one, get one free.</div><article><h1>A quiet harbour</h1><p>The boats came in before noon, and the market opened late.</p>
<p>Nobody minded. By evening, the nets were dry again, the lamps were lit, and the talk had turned to weather.</p></article>
<aside class="sidebar"><ul><li><a href="/a">Most read</a></li></ul></aside><footer>&copy; 2020 The Daily Page. All rights reserved.</footer></body>"""

# Short texts of parts that pages add around an article.
ASIDES = {
    ("div", "cookie notice"): ["We use cookies to improve your experience.", "Accept all", "This site uses cookies. Read our policy."],
    ("form", "newsletter signup"): ["Subscribe to our newsletter", "Your e-mail address", "Sign up now"],
    ("div", "comments"): ["3 comments", "Great article, thanks for sharing!", "I do not agree with this at all. The facts are different."],
    ("aside", "sidebar related"): ["Related articles", "Most read", "You may also like"],
    ("div", "share social"): ["Share on social media", "Follow us"],
    ("header", "site header masthead"): ["The Daily Page", "Sign in", "Search"],
}


# Leaves that an article may have besides paragraphs.
LEAVES = [(("h2", ()),), (("h3", ()),), (("ul", ()), ("li", ())), (("ol", ()), ("li", ())), (("blockquote", ()),), (("figcaption", ()),),
          (("table", ()), ("tr", ()), ("td", ())), (("div", ()),), (("pre", ()),)]


def labelled(page: str) -> tuple[list[Block], list[bool]] | None:
    """Blocks and labels of a page that has an article element and text outside it."""
    seq = blocks(page)
    labels = ["in=article" in b.said and "other" not in b.said for b in seq]
    return (seq, labels) if any(labels) and not all(labels) else None


def rewritten(seq: list[Block], labels: list[bool], draw: random.Random) -> tuple[list[Block], list[bool]]:
    """The page in other markup: renamed containers, and added parts whose texts are its own blocks or fixed ones."""
    holder = draw.choice([("div", ("content",)), ("main", ()), ("section", ("post", "body")), ("div", ("entry",)), ("article", ())])
    plain = draw.random() < 0.5
    out: list[Block] = []
    kept: list[bool] = []

    def part(kind, where) -> None:
        (tag, named), texts = kind
        tag = draw.choice([tag, "div", "section"])
        borrowed = [draw.choice(seq).text for _ in range(draw.randint(1, 3) if "comments" in named else draw.randint(0, 1))]
        for text in draw.sample(texts, draw.randint(1, len(texts))) + borrowed:
            leaf = draw.choice(["p", "div", "li", "label", "h3"])
            out.append(Block(text, (*where, (tag, tuple(_WORD.findall(named))), (leaf, ())), len(text) if draw.random() < 0.3 else 0))
            kept.append(False)

    body = (("html", ()), ("body", ()))
    before, after = draw.sample(list(ASIDES.items()), 2), draw.sample(list(ASIDES.items()), 3)
    inside = draw.choice(list(ASIDES.items()))
    for kind in before:
        part(kind, body)
    spot = draw.randrange(len(seq))
    for i, (b, label) in enumerate(zip(seq, labels)):
        if label:
            path = tuple(holder if name == "article" else (name, named) for name, named in b.path)
            if draw.random() < 0.15:
                path = (*path[:-1], *draw.choice(LEAVES))
        else:
            path = tuple(("div", named or (name,)) if plain and name in OTHER else (name, named) for name, named in b.path)
        out.append(Block(b.text, path, b.linked))
        kept.append(label)
        if i == spot and label and i + 1 < len(seq) and labels[i + 1]:
            part(inside, (*body, holder))
    for kind in after:
        part(kind, body)
    return out, kept


def bare(seq: list[Block], labels: list[bool]) -> tuple[list[Block], list[bool]]:
    """The article alone, right in the body."""
    own = [Block(b.text, (("html", ()), ("body", ()), (b.path[-1][0] if b.path else "p", ())), b.linked) for b, label in zip(seq, labels) if label]
    return own, [True] * len(own)


def fit(pages: DataFrame, bound: int = PAGES, seed: int = 11) -> Model:
    """Train on ``bound`` pages of the table, drawn by hash, and on their rewritten forms."""
    own = pages.filter("html is not null")
    drawn = F.xxhash64(*[F.col(c).cast("string") for c in ("page_id", "url", "html") if c in pages.columns])
    own = own.select("html", drawn.alias("drawn")).orderBy("drawn").limit(bound)
    sample = [x for r in own.collect() if (x := labelled(r["html"]))] or [labelled(SEED)] * 20
    draw = random.Random(seed)
    sample.sort(key=lambda x: x[0][0].text)
    return train([*sample, *(rewritten(*x, draw) for x in sample for _ in range(2)), *(bare(*x) for x in sample[::3])])


def text(model: Model, column: str = "html") -> Column:
    """Main text of a page column."""

    @F.arrow_udf(T.StringType())
    def extracted(pages: pa.Array) -> pa.Array:
        return pa.array([model.extract(page) for page in pages.to_pylist()], pa.string())

    return extracted(F.col(column))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = model or fit(pages)
    return pages.select("page_id", "url", text(model).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
