"""Main text of web pages by consensus host paths.

Every page scores its containers by the text of the blocks just below them; the best ones vote, in Spark, for their
generalised tag-class path (digits in classes do not matter) within the page's host. Pages are then read again: the
elements on the host's highest-ranked path that the page has, those beside it on paths with at least a third of its votes,
and what else their article (or main element, where there is no article) holds give the page's text, without menus, headers,
footers, asides, notices, adverts, forms, scripts, styles and reader comments. Of an article's own header, headings and
paragraphs stay, unless they are named as bylines or dates. Outside the elements on winning paths, blocks that are mostly
links, and articles inside the article (readers' or other ones), stay out.

Names count as whole class tokens or in known compounds (``_out_name``). An element that is out by its name, or as a form,
stays in if it holds the page's main element, all its articles or most of its text; if nothing is left, the page is read
again without these rules.

Defined results: a null or empty page has an empty text; markup that never closes ends with its parent; a page whose host's
paths it does not have falls back to its own best container; line breaks inside a block are white space; every row gives one
row; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import short, stored

#: Ranked paths kept for each host.
HOST_PATHS = 8
PAGE_VOTES = 6
#: Paths beside the winning one belong to the text from this share of its votes on.
BESIDE_SHARE = 1 / 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img br wbr".split()
)
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dt dd figcaption caption".split())
_LEAD = frozenset("p blockquote".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_OUT_TAGS = frozenset("head nav footer aside form button select dialog menu object".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
_OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle banner promo promotion promoted sponsor sponsored cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations sidebar widget widgets menu nav navbar "
    "navigation breadcrumb breadcrumbs masthead footer comment comments discussion disqus reply replies respond login search toolbar pagination pager disclaimer".split()
)
#: Words that may stand beside an out-name: places before it, and what it is or has after it.
_PLACES = frozenset("site page main top bottom left right header footer head foot global primary secondary mobile desktop sticky fixed post article entry user inline video".split())
_PARTS = frozenset("area bar block box button buttons container form holder icons inner item items label links list menu message nav outer panel section slot text unit widget wrap wrapper posts articles stories content cards feed tools top bottom left right primary secondary mobile desktop sticky fixed".split())
#: Names of what readers wrote: often longer than the page's own text, so its length says nothing.
_READERS = frozenset("comment comments discussion disqus reply replies respond".split())
#: Names of what an article's own header says about the article.
_ABOUT = frozenset("byline author authors date dateline datetime timestamp published updated meta metadata credit credits".split())
_GOOD_NAMES = frozenset("article content entry post story main body text".split())
_KEEP_TAGS = frozenset("html body main article".split())
#: Elements that end an open paragraph of the same kind.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _named(tokens: list[str], wanted: frozenset[str]) -> bool:
    """Whether a class or id is one of ``wanted``, or a compound of one with places before it and parts after it."""
    for token in tokens:
        words = [re.sub(r"\d+$", "", w) for w in re.split(r"[-_]+", token) if w]
        words = [w for w in words if w]
        for k, w in enumerate(words):
            if w in wanted and all(x in _PLACES or x in wanted for x in words[:k]) and all(x in _PARTS or x in wanted for x in words[k + 1 :]):
                return True
    return False


class Page:
    """A page's elements and blocks. Elements have the same numbers each time the page is read."""

    def __init__(self, html: str):
        self.spare: set[int] = set()  # elements for which neither names nor being a form count
        self._start(html)
        self.spare = self._holders()
        if self.spare:
            self._start(html)
        if not self.blocks and any(self.soft):
            self.spare = set(range(len(self.tag)))
            self._start(html)

    def _start(self, html: str) -> None:
        self.parent, self.tag, self.path, self.bonus = [-1], ["#root"], [""], [0.5]
        self.out, self.head_only, self.lead = [False], [False], [False]
        self.region, self.inner = [0], [False]  # the article or main element around, and whether it is an article in another
        self.soft, self.hard, self.readers, self.mass = [False], [False], [False], [0]  # out by name, out otherwise, own characters outside links
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters inside links
        self._read(html)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        classes = found.get("class", "").lower().split()
        tokens = [*classes, *found.get("id", "").lower().split()]
        names = {x for c in tokens for x in (c, *re.split(r"[-_]+", c))}
        bare = re.sub(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", " ", attributes)
        hidden = "hidden" in bare.lower().rstrip("/").split() or "display:none" in found.get("style", "").replace(" ", "").lower()
        role, spared = found.get("role", "").lower(), len(self.tag) in self.spare
        named_head = tag not in _KEEP_TAGS and tag not in _HEADING and _named(tokens, frozenset({"header"}))
        form = tag == "form" or role == "form"
        soft = tag not in _KEEP_TAGS and (form or named_head or _named(tokens, _OUT_NAMES))
        hard = tag not in _KEEP_TAGS and ((tag in _OUT_TAGS and tag != "form") or hidden or (role in _OUT_ROLES and role != "form"))
        around = self.region[parent]
        lead = self.lead[parent] or (tag == "header" and around > 0 and not self.head_only[parent])
        head = (tag == "header" and not lead) or (named_head and not spared) or (lead and (tag == "address" or _named(tokens, _ABOUT)))
        out = hard or (soft and not spared and (form or _named(tokens, _OUT_NAMES)))
        self.soft.append(soft)
        self.hard.append(self.hard[parent] or hard)
        self.readers.append(_named(tokens, _READERS))
        self.mass.append(0)
        self.parent.append(parent)
        self.tag.append(tag)
        name = ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes})])
        self.path.append(self.path[parent] if tag in _INLINE else f"{self.path[parent]}>{name}")
        self.bonus.append({"article": 1.3, "main": 1.2, "body": 0.7}.get(tag, 1.0) * (1.25 if names & _GOOD_NAMES else 1.0))
        self.out.append(self.out[parent] or out)
        self.head_only.append(self.head_only[parent] or head)
        self.lead.append(lead)
        here = tag == "article" or ((tag == "main" or role == "main") and self.tag[around] != "article")
        self.inner.append(self.inner[parent] or (tag == "article" and self.tag[around] == "article"))
        self.region.append(len(self.tag) - 1 if here and self.tag[around] != "article" else around)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        stack, text, links, block, at = [0], [], 0, 0, 0
        link = 0

        def add(piece: str) -> None:
            nonlocal links
            if piece:
                text.append(piece)
                links += len(piece) if link else 0

        def flush() -> None:
            nonlocal text, links
            if text:
                whole = " ".join(unescape("".join(text)).split())
                self.mass[block] += 0 if self.hard[block] else max(0, len(whole) - links)
                if whole and not self.out[block] and (self._in_heading(block) or not (self.head_only[block] or (self.lead[block] and self.tag[block] not in _LEAD))):
                    self.blocks.append((block, whole, links))
            text, links = [], 0

        for m in _TOKEN.finditer(html):
            add(html[at : m.start()])
            at = m.end()
            if m[3] is None:
                continue
            tag = m[3].lower()
            if tag == "br":
                text.append(" ")
                continue
            inline = tag in _INLINE
            if m[2]:  # an end tag closes the nearest element of its kind
                k = next((i for i in range(len(stack) - 1, 0, -1) if self.tag[stack[i]] == tag), 0)
                if not k or (inline and any(self.tag[stack[i]] not in _INLINE for i in range(k, len(stack)))):
                    continue
                if not inline:
                    flush()
                link -= sum(self.tag[i] == "a" for i in stack[k:])
                if any(self.out[i] != self.out[self.parent[i]] for i in stack[k:]) and inline:
                    flush()
                del stack[k:]
            else:
                if not inline:
                    flush()
                    shut = _CLOSES.get(tag) or ({"p"} if tag not in _INLINE else set())
                    shut = shut | {"p"}
                    for i in range(len(stack) - 1, 0, -1):
                        t = self.tag[stack[i]]
                        if t in shut:
                            link -= sum(self.tag[j] == "a" for j in stack[i:])
                            del stack[i:]
                            break
                        if t not in _INLINE and t not in _LEAF:
                            break
                if tag in _VOID:
                    continue
                new = self._open(tag, m[4] or "", stack[-1])
                if inline and self.out[new] != self.out[stack[-1]]:
                    flush()
                if not (m[4] or "").rstrip().endswith("/") or inline:
                    stack.append(new)
                    link += tag == "a"
            block = next((i for i in reversed(stack) if self.tag[i] not in _INLINE or self.out[i]), 0)
        add(html[at:])
        flush()

    def _holders(self) -> set[int]:
        """Elements out by name or as a form that hold a main element, every article or most of the page's text."""
        if not any(self.soft):
            return set()
        n = len(self.tag)
        mass, mains, articles = self.mass[:], [0] * n, [0] * n
        for i in range(1, n):
            own = not self.hard[i] and not self.readers[i]
            mains[i], articles[i] = own and self.tag[i] == "main", own and self.tag[i] == "article"
        for i in range(n - 1, 0, -1):  # parents come before their children
            for x in (mass, mains, articles):
                x[self.parent[i]] += x[i]
        return {
            i for i in range(1, n)
            if self.soft[i] and (mains[i] or (articles[i] and articles[i] == articles[0]) or (2 * mass[i] > mass[0] and not self.readers[i]))
        }

    def _in_heading(self, i: int) -> bool:
        while i > 0:
            if self.tag[i] in _HEADING:
                return True
            i = self.parent[i]
        return False

    def scores(self) -> dict[int, float]:
        """Containers and the text just below them; text two levels down counts half."""
        out: dict[int, float] = {}
        for i, text, links in self.blocks:
            mass = max(0, len(text) - 2 * links) * (1 + min(0.5, text.count(",") / 20))
            while i > 0 and (self.tag[i] in _LEAF or self.tag[i] in _INLINE):
                i = self.parent[i]
            for share in (1.0, 0.5):
                out[i] = out.get(i, 0.0) + share * mass * self.bonus[i]
                if i == 0:
                    break
                i = self.parent[i]
        return out

    def votes(self) -> list[tuple[str, float]]:
        """The best paths with their share of the page's best score."""
        by: dict[str, float] = {}
        for i, s in self.scores().items():
            if s > 0:
                by[self.path[i]] = by.get(self.path[i], 0.0) + s
        best = sorted(by.items(), key=lambda kv: (-kv[1], kv[0]))[:PAGE_VOTES]
        return [(p, s / best[0][1]) for p, s in best]

    def text(self, paths: list[tuple[str, float]]) -> str:
        """The text by the first of ``paths`` (with their votes) that the page has; by its own best one if it has none."""
        have = set(self.path)
        for ranked in (paths, self.votes()):
            for path, votes in ranked:
                if path not in have:
                    continue
                above = path.rpartition(">")[0]
                win = {path} | {p for p, v in ranked if v >= BESIDE_SHARE * votes and p.rpartition(">")[0] == above}
                inside = [False] * len(self.tag)
                for i in range(len(self.tag)):
                    inside[i] = self.path[i] in win or (i > 0 and inside[self.parent[i]])
                if not any(inside[i] for i, _, _ in self.blocks):
                    continue
                regions = {self.region[i] for i, _, _ in self.blocks if inside[i]} - {0}
                return "\n".join(t for i, t, links in self.blocks if inside[i] or (self.region[i] in regions and not self.inner[i] and 2 * links <= len(t)))
        return ""


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def page_votes(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            out = [(h, p, v) for h, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True) for p, v in Page(html.as_py() or "").votes()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["host", "path", "vote"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string, vote double")


def host_paths(pages: DataFrame, most: int = HOST_PATHS) -> DataFrame:
    """``host, paths``: each host's paths and votes, highest first. Votes are summed before any group meets in a task."""
    tally = page_votes(pages).groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("votes"))
    ranked = tally.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))).where(F.col("place") <= most)
    return ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path", "votes"))), lambda x: F.struct(x["path"], x["votes"])).alias("paths"))


RESULT = "page_id long, url string, text string, n_chars long"


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id``, ``url``, ``html``)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host(F.col("url")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            texts = [Page(html.as_py() or "").text([(p["path"], p["votes"]) for p in paths or []]) for html, paths in zip(batch.column("html"), batch.column("paths").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[c.split()[0] for c in RESULT.split(", ")])

    # The table of paths is written: where its size shows that it is small it is broadcast and no page is moved; beyond that,
    # pages are shuffled by host, and a hot host is split by the adaptive join.
    paths, _ = stored(host_paths(pages))
    return pages.join(paths, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(run, RESULT)


def op3_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
