"""Main text of web pages by wrappers inferred per host.

A page is a stream of block tags and text slots; a group of tokens that follows itself is
folded to a repeated group. The distinct streams of a host are aligned one after another to
a union-free regular expression: what only one side has becomes an optional group, a single
group against a repeated one becomes repeated, texts become slots. In the wrapper stands
where the content is: its article or main element, else the container that holds most of the
paragraph text of the host's pages. Every page is then read along its wrapper, whole.

Streams are counted by host before anything meets in one task, and hosts are aligned in
salted parts first, so a host with a third of all pages is no single group.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm.common import batches, read, typed

PARTS = 32
LONGEST_GROUP = 12
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title|object)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q"
    " rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside form button select menu dialog head".split())
CONTENT = ("article", "main")
# An opening tag ends these elements if they are open, up to the given container.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
}
BOILERPLATE = re.compile(
    r"(?:^|[\s_\-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|menu|nav\w*|breadcrumbs?|footer|header|masthead"
    r"|cookies?|consent|notices?|popup|modal|newsletter|subscri\w*|signup|comments?|disqus|respond|repl(?:y|ies)"
    r"|shar(?:e|ing)|social|related|suggest\w*|widget|toolbar|login|search|copyright)(?:$|[\s_\-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open" | "close" | "text", tag, attributes or text) in page order; scripts, styles,
    comments and unfinished tags are left out."""
    at = 0
    for match in TOKEN.finditer(page):
        if match.start() > at:
            yield "text", "", page[at : match.start()]
        at = match.end()
        if match["tag"]:
            tag = match["tag"].lower()
            if match["end"]:
                yield "close", tag, ""
            else:
                yield "open", tag, match["attr"]
    if at < len(page):
        yield "text", "", page[at:]


def name_of(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's name in streams and paths, and whether its marks say it is no content."""
    if not attributes.strip():
        return tag, False
    aside, name = False, tag
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            aside |= bool(BOILERPLATE.search(value))
            name += ("." if key == "class" else "#") + re.sub(r"\d+", "0", value.strip())
        elif key == "role":
            aside |= value.lower() in ROLES
        elif key == "style":
            aside |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif key == "hidden":
            aside = True
        else:
            aside |= value.lower() == "true"
    return name, aside


class Reader:
    """Goes through a page once, keeping the open elements."""

    def __init__(self, key: str | None = None):
        self.key = key
        self.stack: list[tuple[str, str, bool, bool]] = []  # tag, name, aside, content
        self.buffer: list[str] = []
        self.blocks: list[str] = []
        self.stream: list[str] = []
        self.weight: Counter[str] = Counter()

    def path(self) -> str:
        return "/".join(item[1] for item in self.stack if item[0] not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6"))

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.buffer)).split())
        self.buffer.clear()
        if not text:
            return
        self.stream.append("#")
        aside, content = (self.stack[-1][2], self.stack[-1][3]) if self.stack else (False, False)
        if aside:
            return
        self.weight[self.path()] += len(text)
        if content or self.key is None:
            self.blocks.append(text)

    def pop(self, tags: set[str], stop: set[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in stop:
                return
            if self.stack[i][0] in tags:
                for item in reversed(self.stack[i:]):
                    self.stream.append("/" + item[0])
                del self.stack[i:]
                return

    def read(self, page: str) -> Reader:
        for kind, tag, rest in events(page):
            if kind == "text":
                self.buffer.append(rest)
                continue
            if tag in INLINE:
                if tag == "br":
                    self.buffer.append(" ")
                continue
            self.flush()
            if kind == "close":
                self.pop({tag}, {"table"} if tag in ("td", "tr", "th") else set())
                continue
            self.pop({"p"}, {"table", "blockquote", "li", "div", "article", "section"} - {tag})
            if tag in ENDS:
                self.pop(*ENDS[tag])
            if tag in VOID:
                self.stream.append(tag)
                continue
            name, marked = name_of(tag, rest)
            above = self.stack[-1] if self.stack else ("", "", False, False)
            self.stack.append((tag, name, False, False))
            here = tag in CONTENT if self.key in CONTENT else self.key is not None and self.path() == self.key
            here &= not (marked and tag == "article" and above[3])
            outer = tag == "header" and not above[3]
            aside = above[2] or (not here and (marked or outer or tag in ASIDE))
            self.stack[-1] = (tag, name, aside, above[3] or here)
            self.stream.append(name)
        self.flush()
        for item in reversed(self.stack):
            self.stream.append("/" + item[0])
        return self


def fold(stream: list[str]) -> list:
    """``stream`` with every group that follows itself as one ("+", group) item."""
    out: list = []
    for token in stream:
        out.append(token)
        again = True
        while again:
            again = False
            for k in range(1, min(LONGEST_GROUP, len(out) - 1) + 1):
                group, before = out[-k:], out[-k - 1]
                if isinstance(before, tuple) and list(before[1]) == group:
                    del out[-k:]
                    again = True
                    break
                if k * 2 <= len(out) and out[-2 * k : -k] == group and whole(group):
                    out[-2 * k :] = [("+", tuple(group))]
                    again = True
                    break
    return out


def whole(group: list) -> bool:
    """Whether a group opens and closes its elements itself."""
    depth = 0
    for item in group:
        if isinstance(item, tuple) or item == "#":
            continue
        depth += -1 if item.startswith("/") else 0 if item.split(".")[0].split("#")[0] in VOID else 1
        if depth < 0:
            return False
    return depth == 0 and group != ["#"]


def _repeat(items: list, other: list) -> list:
    """``items`` with groups that ``other`` repeats as repeated groups."""
    for item, _ in other:
        if not isinstance(item, tuple):
            continue
        group, at = list(item[1]), 0
        while at + len(group) <= len(items):
            if [x[0] for x in items[at : at + len(group)]] == group:
                items[at : at + len(group)] = [(item, items[at][1])]
            at += 1
    return items


def align(a: list, b: list) -> list:
    """The union-free expression of two: items (token or repeated group, optional group's
    number or 0)."""
    a, b = _repeat(list(a), b), _repeat(list(b), a)
    keys_a, keys_b = [json.dumps(x[0]) for x in a], [json.dumps(x[0]) for x in b]
    fresh = max([x[1] for x in a + b], default=0) + 1
    out: list = []
    for kind, i, j, k, m in SequenceMatcher(None, keys_a, keys_b, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [(x[0], x[1] or y[1]) for x, y in zip(a[i:j], b[k:m])]
            continue
        for side in (a[i:j], b[k:m]):
            out += [(x[0], x[1] or fresh) for x in side]
            fresh += 1
    return out


def expression(items: list) -> str:
    """The wrapper as text: slots as #, repeated groups (...)+, optional ones (...)?."""

    def token(item) -> str:
        if isinstance(item, tuple):
            return "(" + "".join(token(x) for x in item[1]) + ")+"
        return item if item == "#" else f"<{item}>"

    out, at = "", 0
    while at < len(items):
        to = at + 1
        while to < len(items) and items[at][1] and items[to][1] == items[at][1]:
            to += 1
        part = "".join(token(x[0]) for x in items[at:to])
        out += f"({part})?" if items[at][1] else part
        at = to
    return out


def _frozen(item):
    return (item[0], tuple(_frozen(x) for x in item[1])) if isinstance(item, list) else item


def _merge(pages: pd.DataFrame) -> tuple[list, Counter]:
    """The wrapper of some streams or wrappers (JSON), and the paths' weights."""
    votes: Counter[str] = Counter()
    wrapper: list | None = None
    for stream in sorted(set(pages["stream"])):
        items = [(_frozen(item), group) for item, group in json.loads(stream)]
        wrapper = items if wrapper is None else align(wrapper, items)
    for weights in pages["weights"]:
        votes.update(json.loads(weights))
    return wrapper or [], votes


def _content(wrapper: list, votes: Counter) -> str | None:
    """The content element of a wrapper: article, main, or the path with most text."""

    def names(items):
        for item in items:
            if isinstance(item, tuple):
                yield from names(item[1])
            else:
                yield item.split(".")[0].split("#")[0]

    tags = set(names(item for item, _ in wrapper))
    for tag in CONTENT:
        if tag in tags:
            return tag
    return min(votes, key=lambda path: (-votes[path], path)) if votes else None


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, content): the inferred expression of every host of ``pages`` (host, html)."""

    def streams(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batches_, 500):
            found: Counter[tuple[str, str, str]] = Counter()
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                reader = Reader().read(page or "")
                stream = json.dumps([(item, 0) for item in fold(reader.stream)])
                best = reader.weight.most_common(1)
                path, weight = best[0] if best else ("", 0)
                found[host, stream, path] += weight
            rows = [(*key, n) for key, n in found.items()]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.record_batch(
                [pa.array(columns[i], pa.string()) for i in range(3)] + [pa.array(columns[3], pa.int64())],
                ["host", "stream", "path", "weight"],
            )

    def part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wrapper, votes = _merge(rows)
        return pd.DataFrame({"host": [key[0]], "stream": [json.dumps(wrapper)], "weights": [json.dumps(votes)]})

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wrapper, votes = _merge(rows)
        return pd.DataFrame({"host": [key[0]], "wrapper": [expression(wrapper)], "content": [_content(wrapper, votes)]})

    # One row for each distinct stream of a host, then at most PARTS partial wrappers a host.
    distinct = (
        pages.select("host", "html")
        .mapInArrow(streams, "host string, stream string, path string, weight long")
        .groupBy("host", "stream", "path")
        .agg(F.sum("weight").alias("weight"))
        .withColumn("weights", F.to_json(F.create_map("path", "weight")))
        .withColumn("part", F.pmod(F.xxhash64("stream"), F.lit(PARTS)))
    )
    partial = distinct.groupBy("host", "part").applyInPandas(part, "host string, stream string, weights string")
    return partial.groupBy("host").applyInPandas(finish, "host string, wrapper string, content string")


def extract(pages: DataFrame) -> DataFrame:
    """Each row of ``pages`` (without its html) as ``row``, with ``host``, the host's
    ``wrapper`` and the main ``text``.

    Blocks are separated by an empty line, white space in a block is one space. A page where
    the wrapper's content element is missing gives all its text that is not marked as
    something else. Null html and pages without text give an empty text; pages without a
    host share one wrapper.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    rest = F.struct(*[c for c in pages.columns if c != "html"]).alias("row")
    rows = pages.select(host.alias("host"), rest, "html")
    kind = rows.schema["row"].dataType

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 500):
            texts = []
            for page, key in zip(batch.column("html").to_pylist(), batch.column("content").to_pylist()):
                blocks = Reader(key).read(page or "").blocks
                if not blocks and key is not None:
                    blocks = Reader(None).read(page or "").blocks
                texts.append("\n\n".join(blocks))
            yield pa.record_batch(
                [batch.column("row"), batch.column("host"), batch.column("wrapper"), pa.array(texts, pa.string())],
                ["row", "host", "wrapper", "text"],
            )

    joined = rows.join(wrappers(rows), "host", "left")
    return joined.mapInArrow(run, typed(row=kind, after="host string, wrapper string, text string"))


def op3_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op3_html_wrappers": op3_html_wrappers}
ORACLES = {}
