"""Main-text extraction: boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of its block elements (inline markup belongs to the block
around it, formulas and the fallback text of media too; scripts, styles, titles,
form controls and comments are dropped). Whether a block is hidden is a feature,
not a cut: article parts that open on a click stay.
Every node has features: what kind of tag it and its ancestors are, tokens of
its class, id and role attributes, depth, siblings, and the density of text,
links, punctuation and tags in its subtree. Gradient-boosted trees give the
probability that the node holds main text. Decoding takes the most likely
labelling in which a node may only hold main text if its parent does, by one
pass up and one pass down, so no ancestor contradicts a descendant.

Training is weakly supervised, with no hand labels: on pages that mark their
article (article, main, role=main), what lies in it, outside navigation,
notices and the like, is main text. The trees see every sampled page twice,
the second time without the tell-tale tags and attribute words, so they also
learn from density and position and carry over to pages without such marks; and
a third time as if every node stood in marked side matter, which is never main
text however dense it is. At
most about ``PAGES`` of the pages that mark an article are sampled, by a hash of
their ids (a documented bound), however few of all pages they are. Prediction is one pass over whole pages, without a shuffle.

Defined cases: null or empty html, and pages without main text, give an empty
text; rows that repeat are extracted row by row; null ids and urls pass; extra
columns are ignored; where no page of the table marks an article, a fixed rule of
link and text density takes the trees' place.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from shipwatch.llm import batches as B
from shipwatch.llm import boosting

PAGES = 800
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption nav header footer aside form fieldset details summary address center menu dialog".split())
DROPPED = frozenset("script style noscript template svg iframe head title textarea select option button datalist map".split())
RAW = frozenset("script style textarea title noscript iframe".split())      # their content is no markup
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset("article main".split())
SIDE = frozenset("nav header footer aside form menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_TAGS = frozenset("p pre blockquote li td dd figcaption".split()) | HEADINGS
SIDE_WORDS = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo promotion sidebar side menu nav navigation navbar breadcrumb "
    "breadcrumbs header footer foot masthead cookie cookies consent notice popup modal overlay newsletter subscribe signup "
    "login share sharing social related recommended comment comments disqus reply replies respond widget toolbar pagination "
    "pager tags copyright legal disclaimer form search skip".split())
MAIN_WORDS = frozenset("article content post entry story main body text page blog news".split())
#: a tag that closes an open element of these kinds
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
          "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
_SCOPES = frozenset("table ul ol dl td th div section article main body blockquote".split())
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>|[^<]++|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_NAMING = ("class", "id", "role", "itemprop")
_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
#: pages that may mark their article
_MARKED = r"""(?i)<(?:article|main)[\s/>]|role\s*=\s*["']?\s*main"""
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

FEATURES = ("article_tag side_tag heading text_tag list_tag inside_article inside_side main_words side_words "
            "inside_main_words inside_side_words depth children place siblings_alike log_text share_of_page link_share "
            "tag_density punctuation words_per_block parent_link_share before log_own hidden inside_hidden").split()
MARKS = [FEATURES.index(f) for f in ("article_tag side_tag inside_article inside_side main_words side_words "
                                     "inside_main_words inside_side_words").split()]
SIDE_MARKS = [FEATURES.index(f) for f in "side_words inside_side_words side_tag inside_side".split()]


def attributes_of(rest: str) -> dict[str, str]:
    """Attributes of a start tag by lower-case name; of repeated ones the first."""
    found: dict[str, str] = {}
    for name, x, y, z in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), x or y or z)
    return found


class Page:
    """The block tree of a page, parents before children."""

    def __init__(self, source: str):
        self.parent, self.tag, self.attributes, self.role_main, self.hidden = [-1], ["html"], [""], [False], [False]
        self.children, self.tags, self.links = [0], [1], [0]        # tags, link characters inside
        self.chunks: list[tuple[int, int, list[str]]] = []          # (node, chunk number, texts)
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]    # every open block, with its node; -1: dropped
        links, chunk, at, n = 0, 0, 0, len(source)
        current: list[str] | None = None
        while at < n:
            m = _TOKEN.match(source, at)
            at = m.end()
            text = m.group()
            if text[0] != "<" or len(text) == 1:
                node = stack[-1][1]
                if node >= 0:
                    if current is None:
                        current = []
                        self.chunks.append((node, chunk, current))
                    current.append(text)
                    if links > 0:
                        self.links[node] += len(text)
                continue
            close, tag, rest = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
            if not tag:
                continue
            tag = tag.lower()
            if tag in VOID:
                if tag in ("br", "hr") and current is not None:
                    current.append(" ")
                continue
            if tag == "a":
                links = max(0, links + (-1 if close else 1))
            if close:
                if tag in BLOCKS or tag in DROPPED:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == tag:
                            del stack[i:]
                            current, chunk = None, chunk + 1
                            break
                continue
            if tag in DROPPED:
                if tag in RAW:
                    end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                    at = end.end() if end else n
                elif not rest.rstrip().endswith("/"):
                    stack.append((tag, -1))
                continue
            if tag not in BLOCKS:
                if stack[-1][1] >= 0:
                    self.tags[stack[-1][1]] += 1
                continue
            if tag in ("html", "body") and any(t == tag for t, _ in stack):
                continue
            if tag == "body":
                stack = [s for s in stack if s[1] >= 0]              # an open head ends here
            shut = CLOSES.get(tag) or (frozenset(["p"]) if tag != "body" else frozenset())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in shut:
                    del stack[i:]
                    break
                if stack[i][0] in _SCOPES:
                    break
            current, chunk = None, chunk + 1
            up = stack[-1][1]
            if up < 0:
                stack.append((tag, -1))
                continue
            found = attributes_of(rest) if rest.strip(" /") else {}
            self.parent.append(up)
            self.tag.append(tag)
            self.attributes.append(" ".join(v for k, v in found.items() if k in _NAMING))
            self.hidden.append("hidden" in found or found.get("aria-hidden", "").lower() == "true"
                               or bool(_DISPLAY.search(found.get("style", ""))))
            self.role_main.append(tag in ARTICLE or found.get("role", "").lower() == "main")
            self.children.append(0)
            self.tags.append(1)
            self.links.append(0)
            self.children[up] += 1
            stack.append((tag, len(self.parent) - 1))

    def features(self) -> np.ndarray:
        n = len(self.parent)
        own, marks, blocks, before = [0] * n, [0] * n, [0] * n, [0] * n
        total = 0
        for node, _, texts in self.chunks:
            size = sum(map(len, texts))
            if not blocks[node]:
                before[node] = total
            total += size
            own[node] += size
            blocks[node] += 1
            marks[node] += sum(t.count(",") + t.count(".") + t.count(";") for t in texts)
        words = []
        for a in self.attributes:
            parts = set(_PART.findall(_CAMEL.sub(" ", a).lower())) if a else ()
            words.append((bool(MAIN_WORDS.intersection(parts)), bool(SIDE_WORDS.intersection(parts))))
        text, links, tags, signs, units = own[:], self.links[:], self.tags[:], marks, blocks[:]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            text[p] += text[i]
            links[p] += links[i]
            tags[p] += tags[i]
            signs[p] += signs[i]
            units[p] += units[i]
        depth, inside, place = [0] * n, [(False,) * 5] * n, [0] * n
        alike: dict[tuple[int, str], int] = {}
        seen = [0] * n
        for i in range(1, n):
            p = self.parent[i]
            depth[i] = depth[p] + 1
            a, s, mw, sw, h = inside[p]
            inside[i] = (a or self.role_main[p], s or self.tag[p] in SIDE, mw or words[p][0], sw or words[p][1], h or self.hidden[p])
            place[i] = seen[p]
            seen[p] += 1
            alike[p, self.tag[i]] = alike.get((p, self.tag[i]), 0) + 1
        rows = []
        for i in range(n):
            t, p = self.tag[i], self.parent[i]
            rows.append((
                self.role_main[i], t in SIDE, t in HEADINGS, t in TEXT_TAGS, t in ("ul", "ol", "li", "dl", "dt", "dd"),
                inside[i][0], inside[i][1], words[i][0], words[i][1], inside[i][2], inside[i][3], depth[i], self.children[i],
                place[i] / max(1, self.children[p]) if p >= 0 else 0, alike.get((p, t), 1), np.log1p(text[i]),
                text[i] / max(1, total), links[i] / max(1, text[i]), text[i] / tags[i], 100 * signs[i] / max(1, text[i]),
                text[i] / max(1, units[i]), links[p] / max(1, text[p]) if p >= 0 else 0, before[i] / max(1, total),
                np.log1p(own[i]), self.hidden[i], inside[i][4]))
        return np.array(rows, np.float64)

    def weak_labels(self) -> np.ndarray | None:
        """What the page's own article mark says; None if it has none."""
        if not any(self.role_main):
            return None
        n = len(self.parent)
        label, state = np.zeros(n), [0] * n             # 1: inside the article, -1: put aside
        for i in range(n):
            up = state[self.parent[i]] if i else 0
            words = set(_PART.findall(_CAMEL.sub(" ", self.attributes[i]).lower()))
            if up < 0 or (up > 0 or not self.role_main[i]) and (self.tag[i] in SIDE or words & SIDE_WORDS):
                state[i] = -1
            elif up > 0 or self.role_main[i]:
                state[i] = 1
            label[i] = state[i] > 0
        for i in range(n - 1, 0, -1):
            label[self.parent[i]] = max(label[self.parent[i]], label[i])
        return label

    def text(self, keep: np.ndarray) -> str:
        blocks, last = [], None
        for node, chunk, texts in self.chunks:
            if keep[node]:
                clean = "".join(entities.unescape(t) for t in texts)
                if chunk == last and blocks:
                    blocks[-1] += clean
                else:
                    blocks.append(clean)
                last = chunk
        return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def decoded(parent: list[int], p: np.ndarray) -> np.ndarray:
    """The most likely labels such that a node is main text only if its parent is."""
    inside, outside = np.log(np.clip(p, 1e-6, 1)), np.log(np.clip(1 - p, 1e-6, 1))
    yes, no = inside.tolist(), outside.tolist()
    for i in range(len(parent) - 1, 0, -1):
        yes[parent[i]] += max(yes[i], no[i])
        no[parent[i]] += no[i]
    keep = np.zeros(len(parent), bool)
    for i in range(len(parent)):
        keep[i] = yes[i] > no[i] and (i == 0 or keep[parent[i]])
    return keep


def by_rule(x: np.ndarray) -> np.ndarray:
    """Where there is nothing to learn from: text with few links, outside marked side matter."""
    f = {name: x[:, j] for j, name in enumerate(FEATURES)}
    side = (f["side_tag"] + f["inside_side"] + f["side_words"] + f["inside_side_words"]) > 0
    return np.where(side, 0.02, np.where((f["link_share"] < 0.4) & (f["log_text"] > 0), 0.9, 0.1))


def learned(pages: DataFrame, most: int = PAGES) -> boosting.Trees | None:
    """Trees fitted on the sampled pages that mark their article."""
    B.prepare(pages.sparkSession)
    marked = pages.where(F.col("html").rlike(_MARKED)).select("page_id", "url", "html")
    n = marked.count()
    hashed = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) / float(1 << 20)
    sample = marked.where(hashed < min(1.0, most / max(n, 1)))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for page_id, source in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                page = Page(source)
                label = page.weak_labels()
                if label is not None:
                    out.append((page_id, page.features().astype(np.float32).tobytes(), label.astype(np.int8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()),
                                              pa.array([o[2] for o in out], pa.binary())], names=["page_id", "x", "y"])

    got = sorted(sample.mapInArrow(rows, "page_id long, x binary, y binary").collect(),
                 key=lambda r: (r.page_id is None, r.page_id, r.x))
    if not got:
        return None
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, len(FEATURES)).astype(np.float64) for r in got]
    ys = [np.frombuffer(r.y, np.int8).astype(np.float64) for r in got]
    blind = [x.copy() for x in xs]
    for x in blind:
        x[:, MARKS] = 0
    aside = [x.copy() for x in blind]
    for x in aside:
        x[np.arange(len(x)), np.array(SIDE_MARKS)[np.arange(len(x)) % len(SIDE_MARKS)]] = 1
    return boosting.fit(np.concatenate([*xs, *blind, *aside]), np.concatenate([*ys, *ys, *[0 * y for y in ys]]))


def extracted(pages: DataFrame, model: boosting.Trees | None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    B.prepare(spark)
    sent = spark.sparkContext.broadcast(model)          # a few thousand numbers

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in B.slices(batch, "html"):
                read = [Page(h or "") for h in part.column("html").to_pylist()]
                x = [page.features() for page in read]
                p = (sent.value.probability if sent.value else by_rule)(np.concatenate(x))
                at, texts = 0, []
                for page, rows in zip(read, x):
                    texts.append(page.text(decoded(page.parent, p[at:at + len(rows)])))
                    at += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main_text(pages: DataFrame) -> DataFrame:
    return extracted(pages, learned(pages))
