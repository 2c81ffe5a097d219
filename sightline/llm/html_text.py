"""Main-text extraction by consensus host paths.

First pass: each page's containers are scored by the text of their blocks, and the page votes for the generalised tag-class path
of its best container (digits of class names generalised). Votes are added up per host and path in Spark. Second pass: each
page is extracted again through the best-voted path of its host that it has; a page that has none of them uses its own best container.

Left out: scripts, styles and form controls; furniture, that is navigation, footers, asides, forms, page headers outside the
article, hidden elements, and elements one of whose class, id or role names is as a whole a name of furniture (`cookie-notice`, `main-nav`,
`share`; not `comments-open`, `category-social` or `ad-free`, which only hold such a word); and reader comments. An element named a comment
(`opinion comment`) is the article where it holds most of the page's running text and what stands outside it, headings and furniture aside, is next to nothing. Furniture is kept after all where
it holds most of the page's running text and no article stands outside it, so a form or a hidden element around a whole page loses nothing.
Names never take words out of the middle of a sentence. Blocks are what block-level tags delimit; `<br>` is white space inside a block.

Defined results: a null or empty html gives an empty text, as does a page without text outside what is left out. Pages without a readable host
vote together. Repeated rows vote as often as they come and get equal texts. Broken markup never fails: unclosed elements end with their parents,
an unclosed comment, script or tag runs to the end, a `<` that opens no tag is text, and after a tag whose quotes never close quotes are not
heeded any more. Time and memory are in proportion to the page: no `<` and no open element is searched for twice, and paths are kept as trees. The paths of
all hosts are broadcast only up to BROADCAST_BYTES; beyond that pages are joined to them by host and a salt, so that a host with a third of all
pages is spread. A host elects its PATHS best-voted paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES, SALTS, PATHS = 4 << 20, 16, 32
#: How many times the other running text of a page an element named a comment must hold to be its article.
NEXT_TO_NONE = 20
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Tags.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
UNSEEN = frozenset("script style textarea title iframe xmp noembed noframes noscript template head button select option input label svg canvas object audio video".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu".split())
CONTAINER = frozenset("article main section div td body center blockquote".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote figcaption caption summary address tr td th".split())
# Words that name page furniture, alone or with a word of PLACES.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices popup modal overlay menu nav "
    "navbar navigation breadcrumb breadcrumbs sidebar aside share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login footer masthead toolbar widget widgets pagination pager contentinfo complementary search alert skip".split()
)
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
# Words that say where or in what form furniture stands.
PLACES = frozenset(
    "area bar block blocks body box button buttons col column container content form group header heading holder icons inner item items label left line link links list main "
    "module outer page panel policy post posts articles stories primary region right row secondary section site slot space stories tab tabs text title to top bottom unit up "
    "us wrap wrapper zone author meta thread feed".split()
)
# First words of names that say what a text is about or what state it is in.
STATES = frozenset("category cat tag tags topic topics type format author keyword status state has is no not with without hide show supports single".split())
ABSENT = frozenset("has no not with without".split())
STORY = frozenset("article post entry story".split())
MAIN_NAMES = frozenset("article content post entry story main text body".split())
_ATTR = re.compile(r"""([a-zA-Z_:-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">]+)*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)([^>]*)>")
_HIDDEN = re.compile(r"display\s*:\s*none")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_CLOSES_P = BLOCK - {"html", "body", "head"}
_P_SCOPE = ("p", "div", "article", "td", "li", "section", "main", "body")
_LISTS = ("ul", "ol", "dl", "table", "select")
PLAIN, FURNISHED, REMARK = 0, 1, 2


class Name(NamedTuple):
    """What one class, id or role name says of its element."""

    remark: bool
    story: bool
    furniture: bool
    header: bool
    main: bool


def _is(parts: list[str], words: frozenset) -> bool:
    """Whether a name is as a whole one of words: as its last word, or as its first before words of PLACES."""
    if not parts or parts[0] in STATES or not ABSENT.isdisjoint(parts):
        return False
    return parts[-1] in words or (parts[0] in words and all(p in PLACES or p in FURNITURE or p in COMMENTS for p in parts[1:]))


@lru_cache(4096)
def _name(name: str) -> Name:
    parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
    story = bool(parts) and parts[0] in STORY
    return Name(
        _is(parts, COMMENTS),
        story and all(x in PLACES or x in MAIN_NAMES for x in parts),
        _is(parts, FURNITURE),
        bool(parts) and parts[-1] == "header" and not story and parts[0] not in STATES,
        not MAIN_NAMES.isdisjoint(parts),
    )


def _kind(tag: str, names: list[Name], article: bool) -> int:
    """What an element is by its names."""
    if any(x.remark for x in names):
        return REMARK
    if any(x.story for x in names):
        return PLAIN
    header = not article and tag in BLOCK and any(x.header for x in names)
    return FURNISHED if header or any(x.furniture for x in names) else PLAIN


def _text(raw: str) -> str:
    try:
        return unescape(raw)
    except ValueError:  # a character reference of thousands of digits
        return unescape(re.sub(r"&#[0-9]{9,};?", "�", raw))


class Page:
    """Elements and blocks of one page. Nodes are containers and furniture, parents first; node 0 is the page itself."""

    def __init__(self, html: str):
        self.parents = [-1]
        self.kinds = [PLAIN]
        self.paths = [0]  # of the nearest container
        self.holds = [False]  # whether the node is a container
        self.mains = [False]  # article and main elements
        self.named = [False]
        self.steps: list[tuple[int, str]] = [(-1, "")]  # path -> (parent path, label)
        self.known: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, str, int]] = []  # (node, tag, text, characters in links)
        self._read(html)
        self._drop()

    def _step(self, path: int, label: str) -> int:
        at = self.known.get((path, label))
        if at is None:
            at = self.known[path, label] = len(self.steps)
            self.steps.append((path, label))
        return at

    def _node(self, tag: str, parent: int, kind: int, attrs: dict, names: list[Name]) -> int:
        holds, path = tag in CONTAINER, self.paths[parent]
        if holds:
            label = ".".join([tag, *sorted(re.sub(r"\d+", "#", c.lower().replace(">", "_")) for c in (attrs.get("class") or "").split())])
            path = self._step(path, label)
        self.parents.append(parent)
        self.kinds.append(kind)
        self.paths.append(path)
        self.holds.append(holds)
        self.mains.append(tag in ("article", "main") or attrs.get("role") == "main")
        self.named.append(self.mains[-1] or any(x.main for x in names))
        return len(self.parents) - 1

    def _read(self, html: str) -> None:
        # open elements: tag ("" once an inline one is closed), node, unseen, in article, nearest block tag, blocks up to here
        stack: list[list] = [["", 0, False, False, "", 0]]
        where: dict[str, list[int]] = {}
        text: list[str] = []
        links, link_depth, at, n, tag_pattern = 0, 0, 0, len(html), _TAG

        def last(*tags: str) -> int:
            return max((where[t][-1] for t in tags if where.get(t)), default=0)

        def flush() -> None:
            nonlocal links
            if text:
                joined = " ".join("".join(text).split())
                if joined:
                    self.blocks.append((stack[-1][1], stack[-1][4], joined, links))
                text.clear()
            links = 0

        def close(to: int) -> None:
            nonlocal link_depth
            if stack[-1][5] > stack[to - 1][5]:
                flush()
            while len(stack) > to:
                tag = stack.pop()[0]
                if tag:
                    where[tag].pop()
                    link_depth -= tag == "a"

        def add(raw: str) -> None:
            nonlocal links
            if raw and not stack[-1][2]:
                s = _text(raw)
                text.append(s)
                if link_depth:
                    links += len(s.strip())

        while at < n:
            i = html.find("<", at)
            if i < 0:
                add(html[at:])
                break
            add(html[at:i])
            c = html[i + 1 : i + 3]
            if c[:1] in ("!", "?") or (c[:1] == "/" and c[1:] and not ("a" <= c[1].lower() <= "z")):
                comment = html.startswith("<!--", i)
                end = html.find("-->", i + 2) if comment else html.find(">", i + 1)
                at = n if end < 0 else end + (3 if comment else 1)
                continue
            if not ("a" <= c[-1:].lower() <= "z" if c[:1] == "/" else "a" <= c[:1].lower() <= "z"):
                add("<")
                at = i + 1
                continue
            m = tag_pattern.match(html, i)
            if m is None:
                tag_pattern = _LOOSE
                m = tag_pattern.match(html, i)
                if m is None:
                    break
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                to = last(tag)
                if to and (tag in BLOCK or stack[-1][5] == stack[to][5]):
                    close(to)
                elif to:  # an inline end tag inside a later block: only the element itself ends
                    link_depth -= tag == "a"
                    where[tag].pop()
                    stack[to][0] = ""
                elif tag in ("p", "br"):
                    flush()
                continue
            if tag in BLOCK:
                if tag in _CLOSES_P and (to := last(*_P_SCOPE)) and stack[to][0] == "p":
                    close(to)
                if tag in ("li", "dd", "dt", "tr", "option") and (to := last(tag, *_LISTS)) and stack[to][0] == tag:
                    close(to)
                flush()
            elif tag in ("br", "td", "th", "img"):
                text.append(" ")
                if tag in ("td", "th") and (to := last("td", "th", "tr", "table")) and stack[to][0] in ("td", "th"):
                    close(to)
            if tag in VOID:
                continue
            if tag in RAW:
                end = _ENDS[tag].search(html, at)
                at = n if end is None else html.find(">", end.start()) + 1 or n
                continue
            if m[3].endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "span", "td", "th"):
                continue
            _, node, unseen, article, block, blocks = stack[-1]
            attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m[3])} if m[3].strip(" /") else {}
            names = [_name(x) for k in ("class", "id", "role") for x in (attrs.get(k) or "").split()]
            inside = article or tag in ("article", "main") or attrs.get("role") == "main"
            unseen = unseen or tag in UNSEEN or (tag == "dialog" and "open" not in attrs)
            kind = PLAIN
            if not unseen and tag not in ("html", "body", "main"):
                kind = _kind(tag, names, inside)
                if kind == PLAIN and (tag in FURNITURE_TAGS and not (tag == "footer" and where.get("blockquote")) or (tag == "header" and not inside)):
                    kind = FURNISHED
                if kind == PLAIN and tag != "article" and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style") or "")):
                    kind = FURNISHED
                if tag not in BLOCK and tag != "td":
                    unseen, kind = kind != PLAIN and block not in TEXTUAL, PLAIN
            if not unseen and (kind != PLAIN or tag in CONTAINER):
                node = self._node(tag, node, kind, attrs, names)
            where.setdefault(tag, []).append(len(stack))
            stack.append([tag, node, unseen, inside, tag if tag in BLOCK else block, blocks + (tag in BLOCK)])
            link_depth += tag == "a"
        close(1)
        flush()

    def _drop(self) -> None:
        """Decides which nodes are left out: comments unless the page's article is in them, and furniture unless its running text is."""
        self._spare()
        size = len(self.parents)
        furnished, self.dropped = [False] * size, [False] * size
        for i in range(1, size):
            furnished[i] = furnished[self.parents[i]] or self.kinds[i] != PLAIN
        inner = [0] * size  # running text of a node, comments excepted
        in_main, main_text = [False] * size, 0
        for i in range(1, size):
            in_main[i] = in_main[self.parents[i]] or self.mains[i]
        for node, _, text, links in self.blocks:
            free = max(0, len(text) - 2 * links)
            inner[node] += free
            if in_main[node] and not furnished[node]:
                main_text += free
        for i in range(size - 1, 0, -1):
            if self.kinds[i] == REMARK:
                inner[i] = 0
            inner[self.parents[i]] += inner[i]
        for i in range(1, size):
            drop = self.kinds[i] == REMARK or (self.kinds[i] == FURNISHED and (main_text > 0 or inner[i] * 2 <= inner[0]))
            self.dropped[i] = drop or self.dropped[self.parents[i]]

    def _spare(self) -> None:
        """Makes a plain node of one that is named a comment but holds the page's article: more than half of all running text, where what is neither comment
        nor furniture has, headings aside, next to none."""
        if REMARK not in self.kinds:
            return
        size = len(self.parents)
        other, inner, plain = [False] * size, [0] * size, 0
        for i in range(1, size):
            other[i] = other[self.parents[i]] or self.kinds[i] != PLAIN
        for node, tag, text, links in self.blocks:
            free = max(0, len(text) - 2 * links)
            inner[node] += free
            if not other[node] and tag not in _HEADINGS:
                plain += free
        for i in range(size - 1, 0, -1):
            inner[self.parents[i]] += inner[i]
        for i in range(1, size):
            if self.kinds[i] == REMARK and inner[i] * 2 > inner[0] and plain * NEXT_TO_NONE <= inner[i]:
                self.kinds[i] = PLAIN

    def best(self) -> tuple[str, float]:
        """Path and score of the best container; an empty path where the page has none."""
        size = len(self.parents)
        scores, in_main = [0.0] * size, [False] * size
        for i in range(1, size):
            in_main[i] = self.mains[i] or in_main[self.parents[i]]
        for node, tag, text, links in self.blocks:
            if not self.dropped[node]:
                scores[node] += len(text) * (1 - min(1.0, links / len(text))) * (1.0 if tag in ("p", "pre", "blockquote") else 0.6)
        for i in range(size - 1, 0, -1):  # text counts in full up to the article that it stands in, and less with each level otherwise
            up = self.parents[i]
            scores[up] += scores[i] * (1.0 if not self.holds[i] or (in_main[up] and not self.mains[i]) else 0.75)
        rank = [s * 1.3 if named else s for s, named in zip(scores, self.named, strict=True)]
        i = max((k for k in range(1, size) if self.holds[k] and not self.dropped[k]), key=lambda k: (rank[k], -k), default=0)
        return (self.path_of(i), rank[i]) if i and rank[i] > 0 else ("", 0.0)

    def path_of(self, node: int) -> str:
        labels, path = [], self.paths[node]
        while path:
            path, label = self.steps[path]
            labels.append(label)
        return ">".join(reversed(labels))

    def text(self, path: str) -> str:
        """Blocks below the elements of a path, in page order; of the whole page for an empty path."""
        at = 0
        for label in path.split(">") if path else ():
            at = self.known.get((at, label), -1)
            if at < 0:
                return ""
        inside = [not path] + [False] * (len(self.parents) - 1)
        for i in range(1, len(inside)):
            inside[i] = (self.holds[i] and self.paths[i] == at) or inside[self.parents[i]]
        return "\n\n".join(b[2] for b in self.blocks if inside[b[0]] and not self.dropped[b[0]])


def extract(html: str | None, paths: list[str] | None) -> str:
    page = Page(html or "")
    for p in paths or ():
        if got := page.text(p):
            return got
    return page.text(page.best()[0])


def _host(url):
    return F.coalesce(F.lower(F.nullif(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))), F.lit(""))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, paths): each host's best-voted container paths, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes: dict[tuple[str, str], float] = {}
            for host, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path, score = Page(h or "").best()
                if path:
                    votes[host, path] = votes.get((host, path), 0.0) + score / (score + 1000)
            rows = [(h, p, int(v * 1e6)) for (h, p), v in votes.items()]  # whole numbers: sums do not depend on their order
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["host", "path", "votes"])

    votes = pages.select(_host(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, path string, votes long")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    top = votes.withColumn("k", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))).where(f"k <= {PATHS}")
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every row."""
    from sightline.sources.shared import written

    paths = written(host_paths(pages, url, html), "paths")
    size = paths.agg(F.coalesce(F.sum(F.length("host") + F.length(F.array_join("paths", "")) + 64), F.lit(0))).first()[0]
    p = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), _host(F.col(url)).alias("host"))
    if size <= BROADCAST_BYTES:
        joined = p.join(F.broadcast(paths), "host", "left")
    else:
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, q) for h, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    fields = joined.select("page_id", "url").schema
    kinds = f"page_id {fields['page_id'].dataType.simpleString()}, url string, text string"
    return joined.select("page_id", "url", "html", "paths").mapInArrow(run, kinds)


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    from sightline.sources.tables import table

    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
