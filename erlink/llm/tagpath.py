"""Main-text extraction by tag-path ratios.

A page is read into blocks: runs of text between block-level tags, each with
its full root-to-leaf path of elements (tag and class, digits left out).  Per
path the text length and punctuation of its blocks are added up and divided by
the number of blocks; the two ratios are smoothed along the page with a small
Gaussian.  A block's fused ratio is the geometric mean of its path's own and
its smoothed product of both, so that a neighbour's weight alone lifts nothing.
A path's weight is the mean over its blocks, times its odds; paths that reach a
share of the page's largest weight are content.

Marks are odds, never filters: a path inside an article or main element counts
``PRIOR`` times, a path through an element whose class or id holds a word that
often names page furniture counts 1 / ``PRIOR`` times.  Only tags, roles and
attributes whose meaning HTML defines (nav, footer, form, script, hidden, ...)
take parts away before the ratios.  Blocks beside or below the blocks of a
content path (an article's headings, lists and quotes among its paragraphs)
belong to it, unless an element between them is named as furniture; so do the
headings of a chosen article.

Paths are numbered as they are met, each by its parent's number and its own
label, so that work and memory are linear in the page whatever its depth.

Defined cases: null html counts as empty; pages without text blocks give '';
unclosed and stray tags follow HTML's rules for paragraphs and list items and
are otherwise closed with their parent; very long pages and very deep nesting
are read whole in one pass; ties of weight are content alike; repeated pages
are extracted each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erlink.llm.common import map_text, table

# Element kinds and name words.
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul caption".split()
)
_DROP = frozenset("nav header footer aside form script style noscript template iframe svg math object button select option input textarea label head title dialog menu canvas audio video map search xmp noembed noframes fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
_MARKS = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Leaves that hold prose, so that their place among content is enough.
_PROSE = _HEADINGS | frozenset("p li blockquote pre dt dd td th figcaption caption summary address center".split())
#: Words of class and id names that often name page furniture.
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners popup modal overlay cookie cookies consent gdpr notice notices notification "
    "alert alerts nav navbar navigation navigations menu menus breadcrumb breadcrumbs sidebar sidebars aside side rail footer foot footnav header masthead topbar toolbar "
    "comment comments commentlist respond reply replies disqus discussion share sharing social related recommend recommended recommendations newsletter subscribe subscription signup "
    "login search form pagination pager widget widgets tags tagcloud skip toc outbrain taboola legal copyright disclaimer teaser teasers readmore reader feedback".split()
)
#: Of these, words that the classes of a page's main article carry too (of its layout or parts).
_LAYOUT = frozenset("side sidebar sidebars rail header masthead nav navbar footer foot share sharing social tags widget widgets notice notices alert alerts legal copyright disclaimer search form newsletter reader".split())
#: Odds of paths in an article or main element, and against named furniture.
PRIOR = 8.0
#: Share of the largest weight that makes a path content.
SHARE = 0.25

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)|[^>=]|=)*+)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?![\w-])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_DIGITS = re.compile(r"[0-9]+")
_SPACE = re.compile("[ \\t\\n\\r\\f\\v\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
#: An opening tag here ends an open element of these kinds, unless one of the fences lies between.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_SCOPE = frozenset("article aside blockquote body button div dd details dl dt fieldset figure figcaption footer form header html li main nav ol section table td th tr ul".split())


@dataclass
class Paths:
    """Numbered element paths; 0 is the root.  Parents come before their children."""

    parent: list[int] = field(default_factory=lambda: [0])
    label: list[str] = field(default_factory=lambda: [""])
    tag: list[str] = field(default_factory=lambda: [""])
    depth: list[int] = field(default_factory=lambda: [0])
    root: list[int] = field(default_factory=lambda: [0])  # the path of the first article or main element around, 0 without
    named: list[int] = field(default_factory=lambda: [0])  # depth of the deepest element named as furniture, 0 without
    number: dict[tuple[int, str, bool, bool], int] = field(default_factory=dict)

    def child(self, parent: int, tag: str, label: str, marked: bool, named: bool) -> int:
        key = (parent, label, marked, named)
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.parent)
            depth = self.depth[parent] + 1
            self.parent.append(parent)
            self.label.append(label)
            self.tag.append(tag)
            self.depth.append(depth)
            self.root.append(self.root[parent] or (n if marked else 0))
            self.named.append(depth if named else self.named[parent])
        return n

    def odds(self, n: int) -> float:
        return (PRIOR if self.root[n] else 1.0) / (PRIOR if self.named[n] else 1.0)


def _read_names(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """(taken away by its meaning, named as furniture, path label) of an element; ``inside``: in an article or main."""
    gone, named, label = tag in _DROP and not (tag == "header" and inside), False, tag
    if "=" in attributes or "hidden" in attributes.lower():
        for m in _NAMES.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                gone = True
            elif name == "style":
                gone = gone or _UNSEEN.search(value) is not None
            elif name == "role":
                gone = gone or not _ROLES.isdisjoint(value.lower().split())
            elif name in ("class", "id"):
                if tag not in ("html", "body", "main"):
                    words = _WORDS.findall(_CAMEL.sub(r"\1 \2", value).lower())
                    named = named or not (_NOISE - _LAYOUT if tag == "article" else _NOISE).isdisjoint(words)
                if name == "class" and value:
                    label = f"{tag}.{_DIGITS.sub('', value.lower())}"
    return gone, named, label


class _Stack:
    """Open elements with the places of each kind, so that finding one needs no walk."""

    def __init__(self):
        self.tags: list[str] = []
        self.state: list[tuple[int, bool]] = []  # (path, taken away) from here on
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.blocks: list[int] = []

    def push(self, tag: str, path: int, gone: bool) -> None:
        i = len(self.tags)
        self.tags.append(tag)
        self.state.append((path, gone))
        self.at.setdefault(tag, []).append(i)
        if tag in _SCOPE:
            self.scopes.append(i)
        if tag in _BLOCK:
            self.blocks.append(i)

    def last(self, *kinds: str) -> int:
        return max((self.at[k][-1] for k in kinds if self.at.get(k)), default=-1)

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else -1

    def holds_block(self, index: int) -> bool:
        return bool(self.blocks) and self.blocks[-1] >= index

    def cut(self, index: int) -> None:
        while len(self.tags) > index:
            tag = self.tags.pop()
            self.state.pop()
            self.at[tag].pop()
            if tag in _SCOPE:
                self.scopes.pop()
            if tag in _BLOCK:
                self.blocks.pop()


def blocks(page: str) -> tuple[Paths, list[tuple[int, str]]]:
    """(paths, blocks as (path, text) in page order) outside of the parts taken away."""
    paths, out, stack, buffer = Paths(), [], _Stack(), []
    at, n = 0, len(page)

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", html_lib.unescape("".join(buffer))).strip(" ")
            buffer.clear()
            if text:
                out.append((stack.state[-1][0] if stack.state else 0, text))

    def close_to(index: int) -> None:
        if stack.holds_block(index):
            flush()
        stack.cut(index)

    def take(text: str) -> None:
        if text and not (stack.state and stack.state[-1][1]):
            buffer.append(text)

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                take(html_lib.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if tag == "br":
            take(" ")
            continue
        if m[1]:
            if tag == "p" and not stack.at.get("p"):
                flush()
            elif (i := stack.last(tag)) >= 0 and (tag in _BLOCK or i > stack.scope()):  # an inline end tag doesn't close blocks around it
                close_to(i)
            continue
        if tag in _BLOCK:
            flush()
            if (i := stack.last("p")) > stack.scope():  # a block ends an open paragraph
                close_to(i)
            if tag in _CLOSES:
                kinds, fences = _CLOSES[tag]
                fence = stack.last(*fences)
                while (i := stack.last(*kinds)) > fence:
                    close_to(i)
            if tag in _HEADINGS and stack.tags and stack.tags[-1] in _HEADINGS:
                close_to(len(stack.tags) - 1)
        if tag in _VOID:
            continue
        attributes = m[3] or ""
        path, gone = stack.state[-1] if stack.state else (0, False)
        drop, named, label = _read_names(tag, attributes, paths.root[path] > 0)
        if tag in ("script", "style"):
            take(" ")
        if tag in _RAW:
            end = _raw_end(tag).search(page, at)
            at = end.end() if end else n
            continue
        if tag in ("svg", "math", "path") and attributes.rstrip().endswith("/"):
            continue
        if tag in _BLOCK:
            path = paths.child(path, tag, label, tag in _MARKS and not named, named)
        stack.push(tag, path, gone or drop)
    flush()
    return paths, out


_RAW_END: dict[str, re.Pattern] = {}


def _raw_end(tag: str) -> re.Pattern:
    if tag not in _RAW_END:
        _RAW_END[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I)
    return _RAW_END[tag]


def _smooth(values: list[float]) -> list[float]:
    """A Gaussian of deviation 1 over two neighbours to either side."""
    kernel = [math.exp(-d * d / 2) for d in range(3)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d in range(-2, 3):
            if 0 <= i + d < len(values):
                total += kernel[abs(d)] * values[i + d]
                weight += kernel[abs(d)]
        out.append(total / weight)
    return out


def path_weights(found: list[tuple[int, str]]) -> dict[int, float]:
    """Fused weight of each path: own and smoothed text and punctuation ratios, averaged over its blocks."""
    length, marks, count = {}, {}, {}
    for path, text in found:
        length[path] = length.get(path, 0) + len(text)
        marks[path] = marks.get(path, 0) + len(_PUNCTUATION.findall(text))
        count[path] = count.get(path, 0) + 1
    text = [length[path] / count[path] for path, _ in found]
    punctuation = [marks[path] / count[path] for path, _ in found]
    total: dict[int, float] = {}
    for (path, _), t, p, near_t, near_p in zip(found, text, punctuation, _smooth(text), _smooth(punctuation)):
        total[path] = total.get(path, 0.0) + math.sqrt(t * (1.0 + p) * near_t * (1.0 + near_p))
    return {k: v / count[k] for k, v in total.items()}


def extract(page: str | None, share: float = SHARE) -> str:
    """The main text: blocks of content paths in page order, joined by blank lines."""
    paths, found = blocks(page or "")
    if not found:
        return ""
    weight = {k: v * paths.odds(k) for k, v in path_weights(found).items()}
    least = share * max(weight.values())
    content = {k for k, v in weight.items() if v >= least}
    homes = {paths.parent[k] for k in content}
    chosen = {paths.root[k] for k in content if paths.root[k]}
    # the nearest home around (or at) each path that is deep enough to speak for what is below it
    below = [0] * len(paths.parent)
    for k in range(1, len(below)):
        below[k] = k if k in homes and (paths.depth[k] > 2 or paths.root[k]) else below[paths.parent[k]]

    def belongs(k: int) -> bool:
        if k in content:
            return True
        home = paths.parent[k]
        if home in homes and (paths.tag[k] in _PROSE or paths.root[k] and paths.named[k] <= paths.depth[home]):
            return True
        if paths.tag[k] in _HEADINGS and paths.root[k] in chosen and paths.named[k] <= paths.depth[paths.root[k]]:
            return True
        return below[k] > 0 and below[k] != k and paths.named[k] <= paths.depth[below[k]]

    keep = {k: belongs(k) for k in weight}
    return "\n\n".join(text for k, text in found if keep[k])


def extract_pages(pages: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_text(pages.select("page_id", "url", F.col("html")), "html", run, "page_id bigint, url string, text string, n_chars bigint")


def op8_tag_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars."""
    return extract_pages(table(spark, sf_dir, "pages"))
