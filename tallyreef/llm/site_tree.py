"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: elements at the same path (tags with
their class, id and role) are one node. A node's presentations are its sequences
of children, its contents the texts of its branch; the entropy of either over the
pages of the host that have the node, in units of the largest that is possible,
is its importance, the larger of the two. A branch that looks or reads alike on
all pages of a site has low importance and is removed from each page.

What the markup says comes first, as what a site writes anew for each page (adverts,
reader comments, lists of links) has high importance all the same: elements and
roles for navigation, page header, footer, sidebar, form and dialog never reach
the bar; article, main and their paragraphs always do. Of a class or id, each name
is read as a whole, by its last part (``site-footer``, ``comment-list``, but not
``no-sidebar`` or ``social-history``). Other branches are judged by importance where
the host has at least LEAST_PAGES pages with the node, and kept otherwise. If a
page has articles, or else a main part, only these are read. A class or id name
removes no branch that holds the main part, nor one that holds the articles of a
page without other articles or main part.

Nodes travel as small rows of host, page digest and path; what is low on a host
meets the paths that a page has itself, so no page is sent its host's whole tree.

Defined cases: a null or empty html has an empty text; a null url belongs to a
host of its own, without a name; markup that ends early is read as far as it
goes, and a quote within an unquoted value is a character of it; repeated pages are
extracted alike, and those of one host and html count as one page of the tree;
a very long page is read whole, and work grows with its length however deep it nests;
an importance that equals the bar stays; an empty table gives no rows; extra columns pass
through, and one that is named like the new column keeps its name.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreef.llm import common

#: Importance that an element without a hint must reach, and pages of a host from which it is judged.
LEAST_IMPORTANCE, LEAST_PAGES = 0.5, 8

_VALUE = r"=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:{_VALUE}|[^=>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Fixed values of the markup language.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSED_BY_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
_SCOPE = frozenset("html body article section div table td th ul ol dl main aside nav header footer form blockquote button".split())
_NEVER = frozenset("head script style title noscript template iframe object embed svg math canvas audio video form button select textarea input fieldset nav footer aside menu dialog datalist".split())
_PROTECTED = frozenset("html body main article p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption".split())

# Names that mark a branch as no part of the article, roles that do, words that only say what kind of box a name is for, and words that turn a name round.
_NOISE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments respond disqus reply replies pagination pager toolbar".split()
)
_NOISE_OUTSIDE = frozenset("header masthead topbar".split())
_NOISE_ARTICLE = frozenset("comment comments reply replies ad ads advert advertisement promo related sponsored teaser".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())

_BOXES = frozenset("area bar block box button buttons container content group inner item items link links list menu panel row section slot unit widget widgets wrap wrapper".split())
_TURNED = frozenset("no not has with without hide hidden".split())

NOISE, NEUTRAL, CONTENT, NAMED = range(4)  # NAMED: noise by its class or id alone


@dataclass
class Page:
    """Elements in page order (tag, path hash, parent, hint) and texts (element, text; None is a break)."""

    tags: list[str] = field(default_factory=list)
    paths: list[int] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    hints: list[int] = field(default_factory=list)
    texts: list[tuple[int, str | None]] = field(default_factory=list)


def heads_of(names: str) -> frozenset[str]:
    """What each name of a class or id says: its last part that is no word for a box, unless a part turns it round.

    A box word itself counts where the name is nothing else.
    """
    found = set()
    for name in names.split():
        parts = [x.lower() for x in _NAME_PARTS.findall(name) if not x.isdigit()]
        if parts and parts[0] not in _TURNED:
            while len(parts) > 1 and parts[-1] in _BOXES:
                del parts[-1]
            found.add(parts[-1])
    return frozenset(found)


@lru_cache(maxsize=20_000)
def _described(tag: str, raw: str) -> tuple[str, frozenset[str], str, bool]:
    """Presentation key, heads of the names of class and id, role, and whether the element is hidden."""
    if "=" not in raw and "hidden" not in raw:
        return tag, frozenset(), "", False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    role = found.get("role", "").lower()
    hidden = "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
    shown = re.sub(r"\d+", "0", f"{tag}.{'.'.join(found.get('class', '').split())}#{found.get('id', '')}@{role}")
    return shown, heads_of(names), role, hidden


class _Stack:
    """Open elements, with the places at which each tag is open, so that no step looks through all of them."""

    def __init__(self, page: Page):
        self.page, self.elements = page, []
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def __len__(self) -> int:
        return len(self.elements)

    def top(self) -> int:
        return self.elements[-1] if self.elements else -1

    def push(self, element: int) -> None:
        tag = self.page.tags[element]
        self.at.setdefault(tag, []).append(len(self.elements))
        if tag in _SCOPE:
            self.scopes.append(len(self.elements))
        self.elements.append(element)

    def cut(self, place: int) -> None:
        """Close the elements from a place on."""
        while len(self.elements) > place:
            tag = self.page.tags[self.elements.pop()]
            self.at[tag].pop()
            if tag in _SCOPE:
                self.scopes.pop()

    def last(self, *tags: str) -> int:
        """Place of the last open element of some tags; -1 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def last_scope(self) -> int:
        return self.scopes[-1] if self.scopes else -1


def parse(text: str) -> Page:
    """The page's elements and texts; ends that the markup leaves out are put in."""
    page = Page()
    stack = _Stack(page)
    at, length = 0, len(text)

    def close_to(place: int) -> None:
        stack.cut(place)
        page.texts.append((stack.top(), None))

    while at < length:
        m = _TOKEN.search(text, at)
        if m is None:
            page.texts.append((stack.top(), text[at:]))
            break
        if m.start() > at:
            page.texts.append((stack.top(), text[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            place = stack.last(tag)
            if place >= 0 and tag not in _INLINE:
                close_to(place)
            elif place > stack.last_scope():
                stack.cut(place)
            continue
        if tag in _CLOSES_P and (place := stack.last("p")) > stack.last_scope():
            close_to(place)
        if tag in _CLOSED_BY_LIKE:
            if (place := stack.last(*_CLOSED_BY_LIKE[tag])) > stack.last("ul", "ol", "dl", "table", "select"):
                close_to(place)
            if tag == "tr" and (place := stack.last("tr")) > stack.last("table"):
                close_to(place)
        if tag == "body" and stack.last("body") >= 0 or tag == "html" and len(stack):
            continue
        raw = m[3] or m[6] or ""
        if tag == "body" and (place := stack.last("head")) >= 0:
            close_to(place)
        key, names, role, hidden = _described(tag, raw)
        parent = stack.top()
        inside = stack.last("article", "main") >= 0
        if hidden or tag in _NEVER or role in _NOISE_ROLES or tag == "header" and not inside:
            hint = NOISE
        elif tag in ("html", "body", "main"):
            hint = CONTENT
        elif tag == "article":
            hint = NOISE if names & _NOISE_ARTICLE else CONTENT
        elif names & _NOISE or not inside and names & _NOISE_OUTSIDE:
            hint = NAMED
        else:
            hint = CONTENT if tag in _PROTECTED and key == tag else NEUTRAL
        if tag in _INLINE and hint == NEUTRAL and not names:
            hint = CONTENT
        here = len(page.tags)
        page.tags.append(tag)
        page.parents.append(parent)
        page.hints.append(hint)
        page.paths.append(xxhash.xxh64_intdigest(f"{page.paths[parent] if parent >= 0 else 0}/{key}") >> 1)
        if tag not in _INLINE:
            page.texts.append((parent, None))
        if tag in _VOID or raw.endswith("/") and tag not in _RAW and tag not in _CLOSES_P:
            continue
        if tag in _RAW:
            end = _raw_end(tag).search(text, at)
            at = text.find(">", end.start()) + 1 or length if end else length
            continue
        stack.push(here)
    return page


@lru_cache(maxsize=32)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*(?:/?>|\s)", re.IGNORECASE)


def node_rows(page: Page) -> list[tuple[int, int, int]]:
    """(path, presentation hash, content hash) of each node of the page; elements at one path are one node."""
    looks: dict[int, int] = {}
    for path, parent in zip(page.paths, page.parents, strict=True):
        looks.setdefault(path, 0)
        if parent >= 0 and looks[page.paths[parent]] % (1 << 63) != path:
            looks[page.paths[parent]] = (looks[page.paths[parent]] * 0x9E3779B97F4A7C15 + path) % (1 << 63)
    # A branch reads as its own texts and those of its children in turn; children come after their parents.
    branch = [0] * len(page.tags)
    for element, text in page.texts:
        if text is not None and element >= 0 and (plain := text.strip()):
            branch[element] = (branch[element] * 31 + xxhash.xxh64_intdigest(plain)) % (1 << 63)
    for i in range(len(branch) - 1, -1, -1):
        if page.parents[i] >= 0 and branch[i]:
            branch[page.parents[i]] = (branch[page.parents[i]] * 31 + branch[i]) % (1 << 63)
    reads: dict[int, int] = {}
    for path, read in zip(page.paths, branch, strict=True):
        reads[path] = (reads.get(path, 0) * 31 + read) % (1 << 63) if read else reads.get(path, 0)
    return [(path, look, reads[path]) for path, look in looks.items()]


def main_text(page: Page, removed: frozenset[int]) -> str:
    """Text of what stays: noise and removed branches go, and articles, or else main parts, are read alone."""
    noise, named = [], []
    for i, parent in enumerate(page.parents):
        noise.append(page.hints[i] == NOISE or parent >= 0 and noise[parent])
        named.append(page.hints[i] == NAMED or parent >= 0 and named[parent])
    mains, articles = ([i for i, tag in enumerate(page.tags) if tag == name and not noise[i]] for name in ("main", "article"))
    around = mains or (articles if all(named[i] for i in articles) else [])
    text = _text(page, removed, _above(page, around))
    # A main part without text of its own has its articles in branches with such names.
    return text or (_text(page, removed, _above(page, mains + articles)) if mains and articles else text)


def _above(page: Page, elements: list[int]) -> set[int]:
    """The elements and all that hold them."""
    found: set[int] = set()
    for i in elements:
        while i >= 0 and i not in found:
            found.add(i)
            i = page.parents[i]
    return found


def _text(page: Page, removed: frozenset[int], spared: set[int]) -> str:
    n = len(page.tags)
    gone, in_article, in_main = [False] * n, [False] * n, [False] * n
    has_article = has_main = False
    for i in range(n):
        parent = page.parents[i]
        gone[i] = (parent >= 0 and gone[parent]) or page.hints[i] == NOISE or page.hints[i] == NAMED and i not in spared or page.hints[i] == NEUTRAL and page.paths[i] in removed
        if not gone[i]:
            in_article[i] = page.tags[i] == "article" or parent >= 0 and in_article[parent]
            in_main[i] = page.tags[i] == "main" or parent >= 0 and in_main[parent]
            has_article |= in_article[i]
            has_main |= in_main[i]
    chosen = in_article if has_article else in_main if has_main else None
    out = []
    for element, text in page.texts:
        if text is None:
            out.append(" ")
        elif (element < 0 and chosen is None) or element >= 0 and not gone[element] and (chosen is None or chosen[element]):
            out.append(markup.unescape(text))
    return " ".join("".join(out).split())


def host_of(url: Column) -> Column:
    """Host of a url in lower case, without port and user; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_nodes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, digest of the html, and nodes (path, look, read): one row for all copies of a page on a host."""
    narrow = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.md5(F.col(f"`{html_col}`").cast("binary")).alias("digest"), F.col(f"`{html_col}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends = [], [0]
            for text in batch.column(2).to_pylist():
                found += node_rows(parse(text or ""))
                ends.append(len(found))
            columns = [pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ((), (), ()))]
            nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["path", "look", "read"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes], names=["host", "digest", "nodes"])

    nodes = narrow.filter("html is not null").mapInArrow(run, "host string, digest string, nodes array<struct<path:bigint,look:bigint,read:bigint>>")
    return nodes.groupBy("host", "digest").agg(F.first("nodes").alias("nodes"))


def importances(nodes: DataFrame) -> DataFrame:
    """host, path, pages and importance of every node of every host's tree, from page_nodes."""
    # Kinds of presentation and content are counted apart, in one pass over the nodes.
    both = lambda n: F.array(F.struct(n["path"].alias("path"), F.lit(0).alias("kind"), n["look"].alias("value")), F.struct(n["path"].alias("path"), F.lit(1).alias("kind"), n["read"].alias("value")))
    kinds = nodes.select("host", F.explode(F.flatten(F.transform("nodes", both))).alias("x")).select("host", "x.*").groupBy("host", "path", "kind", "value").count()
    entropy = F.when(F.sum("count") > 1, F.log(F.sum("count")) - F.sum(F.col("count") * F.log("count")) / F.sum("count")).otherwise(F.lit(None))
    by_kind = kinds.groupBy("host", "path", "kind").agg(F.sum("count").alias("pages"), entropy.alias("entropy"))
    importance = F.coalesce(F.max(F.col("entropy") / F.log("pages")), F.lit(1.0))
    return by_kind.groupBy("host", "path").agg(F.max("pages").alias("pages"), importance.alias("importance"))


def site_trees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, pages and importance of every node of every host's tree."""
    return importances(page_nodes(pages, url_col, html_col))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """All columns of pages, and the page's main text in ``common.free_name(pages, "main_text")``."""
    out, host, digest, gone_col = (common.free_name(pages, n) for n in ("main_text", "__host", "__digest", "__removed"))
    nodes = common.written(page_nodes(pages, url_col, html_col), "site-nodes")
    low = common.written(importances(nodes).filter((F.col("pages") >= least_pages) & (F.col("importance") < least)).select("host", "path"), "site-low")
    removed = common.written(nodes.select("host", "digest", F.explode("nodes.path").alias("path")).join(low, ["host", "path"]).groupBy(F.col("host").alias(host), F.col("digest").alias(digest)).agg(F.collect_set("path").alias(gone_col)), "site-removed")
    rest = [F.col(f"`{c}`") for c in pages.columns]

    @F.pandas_udf("string")
    def text(htmls: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([main_text(parse(h or ""), frozenset(() if g is None else g)) for h, g in zip(htmls, gone, strict=True)])

    met = pages.withColumn(host, host_of(F.col(f"`{url_col}`"))).withColumn(digest, F.md5(F.col(f"`{html_col}`").cast("binary"))).join(removed, [host, digest], "left")
    return met.select(*rest, text.asNondeterministic()(F.col(f"`{html_col}`"), gone_col).alias(out))


def op3_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
