"""Rows of web pages by layouts: array columns made from a stream of balanced tags.

A layout is data: a selector of items and one of each field. Selectors are compiled once
to steps; while a page's tags go by, each open element knows how many steps of each field
its ancestors have matched, so a page is read once, whatever it nests. Items may hold lists
and items of their own; what a nested item holds is its own.

A selector is steps parted by blanks, each matching an element anywhere within the one
before: ``tag.class[attribute]`` with any part left out, ``[attribute=value]``, and
``[attribute*=part]``. A field ends in ``@attribute|other`` for the first attribute that is
filled, else it is the element's text on one line. ``dt=label + dd`` is the next dd after a
dt of that text. ``*`` is the text of the whole item, ``@attribute`` the item's own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence
from html import unescape
from html.parser import HTMLParser
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without content, elements that end when a sibling starts, and what ends that search.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())}
SCOPE = frozenset("ul ol dl table select div section article main body".split())
UNSHOWN = frozenset(("script", "style", "template"))
BLOCKS = frozenset("address article aside blockquote body caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())

Attributes = dict[str, str]
#: Elements that end another one when they start.
_ENDERS = frozenset().union(*ENDED_BY.values())

# Plain markup, which HTMLParser reads the same: text, tags of plain names and attributes, and the doctype.
_NAME, _BLANK = "[a-zA-Z][a-zA-Z0-9]*+", r"[ \t\n\r\f]"
_ATTRIBUTES = rf"""(?:{_BLANK}++[a-zA-Z][a-zA-Z0-9_:.-]*+(?:=(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`/]++))?+)*+"""
_RAW = r"(?i:script|style|xmp|iframe|noembed|noframes|noscript|plaintext|textarea)\b"
_PLAIN = re.compile(rf"(?:[^<]++|</{_NAME}{_BLANK}*+>|<(?!{_RAW}){_NAME}{_ATTRIBUTES}{_BLANK}*+/?+>|<!(?i:doctype)[^>]*+>)*+")
_TOKEN = re.compile(rf"""([^<]+)|</([a-zA-Z0-9]+){_BLANK}*>|<([a-zA-Z0-9]+)((?:{_BLANK}+[^\s"'=<>`/]+(?:=(?:"[^"]*"|'[^']*'|[^\s"'=<>`/]+))?)*){_BLANK}*(/?)>|<![^>]*>""")
_PAIR = re.compile(r"""([^\s"'=<>`/]+)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`/]+)))?""")
_NONE: Attributes = {}
#: One plain tag without its angle brackets, or the doctype; and how many tags a Python worker remembers, for pages of a site share most of theirs.
_TAG = re.compile(rf"(/)({_NAME}){_BLANK}*+|(?!{_RAW})({_NAME})({_ATTRIBUTES}){_BLANK}*+(/?+)|!(?i:doctype)[^>]*+")
KNOWN_TAGS = 4096
_known_tags: dict[str, tuple[str, str, Attributes, str]] = {}


def _attributes(text: str) -> Attributes:
    found = {name.lower(): one or two or bare for name, one, two, bare in _PAIR.findall(text)}
    return {name: unescape(value) for name, value in found.items()} if "&" in text else found


def _tag(markup: str) -> tuple[str, str, Attributes, str] | None:
    """Whether a plain tag ends an element, its name, attributes, and whether it is empty; no name for the doctype, None for what is not plain."""
    if (found := _TAG.fullmatch(markup)) is None:
        return None
    end, ended, tag, attrs, empty = found.groups("")
    return end, (ended or tag).lower(), _attributes(attrs) if attrs else _NONE, empty


class TagEvents(HTMLParser):
    """Calls ``opened``, ``shown`` and ``closed`` of a listener for balanced elements, whatever the markup leaves out."""

    def __init__(self, listener):
        super().__init__(convert_charrefs=True)
        self.listener = listener
        self.open: list[str] = []

    def handle_starttag(self, tag: str, attrs: Iterable[tuple[str, str | None]]) -> None:
        self._start(tag, {k: v or "" for k, v in attrs})

    def _start(self, tag: str, attrs: Attributes) -> None:
        if tag in _ENDERS:
            for at in range(len(self.open) - 1, -1, -1):
                if tag in ENDED_BY.get(self.open[at], ()):
                    self._close(at)
                    break
                if self.open[at] in SCOPE:
                    break
        self.listener.opened(tag, attrs)
        if tag in VOID:
            self.listener.closed(tag)
        else:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: Iterable[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        opened = self.open
        if opened and opened[-1] == tag:
            self.listener.closed(opened.pop())
        elif tag in opened:
            self._close(len(opened) - 1 - opened[::-1].index(tag))

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1] in UNSHOWN):
            self.listener.shown(data)

    def _close(self, at: int) -> None:
        while len(self.open) > at:
            self.listener.closed(self.open.pop())

    def read(self, html: str | None) -> None:
        if html and _PLAIN.fullmatch(html):
            self._read_plain(html)
        else:
            self.feed(html or "")
            self.close()
        self._close(0)

    def _read_plain(self, html: str) -> None:
        """Plain markup is cut by one expression, for HTMLParser takes several for each tag."""
        for text, end, tag, attrs, empty in _TOKEN.findall(html):
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
            elif end:
                self.handle_endtag(end.lower())
            elif tag:
                tag = tag.lower()
                self._start(tag, _attributes(attrs) if attrs else _NONE)
                if empty and tag not in VOID:
                    self.handle_endtag(tag)


_STEP = re.compile(r"(?P<tag>[a-zA-Z0-9]*)(?P<classes>(?:\.[\w-]+)*)(?P<attrs>(?:\[[^\]]*\])*)$")
_ATTRIBUTE = re.compile(r"\[([\w:-]+)(?:(\*?=)([^\]]*))?\]")


class Step:
    """One step of a selector."""

    def __init__(self, text: str):
        found = _STEP.match(text)
        if not found:
            raise ValueError(f"no step of a selector: {text!r}")
        self.tag = found["tag"].lower()
        self.classes = frozenset(filter(None, found["classes"].split(".")))
        self.attrs = _ATTRIBUTE.findall(found["attrs"])

    def matches(self, tag: str, classes: frozenset[str], attrs: Attributes) -> bool:
        return (
            (not self.tag or self.tag == tag)
            and self.classes <= classes
            and all(k in attrs and (not how or (attrs[k] == v if how == "=" else v in attrs[k])) for k, how, v in self.attrs)
        )


class Field:
    """A compiled field of a layout."""

    def __init__(self, text: str):
        path, _, attributes = text.partition("@")
        self.attributes = attributes.split("|") if attributes else []
        labelled = re.fullmatch(r"(\w+)=(.+) \+ (\w+)", path.strip())
        self.label = labelled.groups() if labelled else None
        self.whole = path.strip() == "*"
        self.steps = [] if self.label or self.whole else [Step(s) for s in path.split()]

    def value(self, attrs: Attributes) -> str:
        return next((attrs[a].strip() for a in self.attributes if attrs.get(a, "").strip()), "")


class Layout:
    """A compiled layout: the item's step, and fields by name."""

    def __init__(self, item: str, fields: Mapping[str, str]):
        self.item, self.fields = Step(item), {name: Field(text) for name, text in fields.items()}
        inner = {name: field for name, field in self.fields.items() if not field.whole}
        #: What an element's tag may begin: names of whole items, (name, field) of labelled ones and of others, and labels.
        self.whole = [name for name, field in self.fields.items() if field.whole]
        self.labelled = [(name, field, field.label) for name, field in inner.items() if field.label]
        self.stepped = [(name, field, field.steps) for name, field in inner.items() if field.steps]
        self.label_tags = {field.label[0] for field in inner.values() if field.label}
        self.own = [(name, field) for name, field in inner.items() if field.attributes and not field.steps and not field.label]


def on_one_line(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class _Item:
    def __init__(self, layout: Layout, attrs: Attributes, place: int):
        self.place, self.labels = place, {}
        self.values = {name: field.value(attrs) for name, field in layout.own}


_NO_CLASSES: frozenset[str] = frozenset()


class LayoutItems:
    """Listener that gathers the items of a page in the order in which they begin."""

    def __init__(self, layout: Layout):
        self.layout, self.found = layout, []
        #: Of each open element: its item, the steps matched by each field, and how many texts it gathers.
        self.open: list[tuple] = []
        #: Texts being gathered, the innermost last, as (item, field, parts).
        self.gathering: list[tuple] = []

    def opened(self, tag: str, attrs: Attributes) -> None:
        layout = self.layout
        item, matched, _ = self.open[-1] if self.open else (None, _NONE, 0)
        classes = frozenset(attrs["class"].split()) if "class" in attrs else _NO_CLASSES
        if self.gathering and (tag in BLOCKS or tag == "br"):
            self.shown(" ")
        begun = []
        if layout.item.matches(tag, classes, attrs):
            item, matched = _Item(layout, attrs, len(self.found)), _NONE
            self.found.append(item)
            begun = [(item, name, []) for name in layout.whole]
        elif item is not None:
            for name, _, (label, text, value) in layout.labelled:
                if tag == value and item.labels.get(label) == text and name not in item.values:
                    begun.append((item, name, []))
            for name, field, steps in layout.stepped:
                step = steps[matched.get(name, 0)]
                if (step.tag and step.tag != tag) or name in item.values or not step.matches(tag, classes, attrs):
                    continue
                at = matched.get(name, 0) + 1
                if at < len(steps):
                    matched = {**matched, name: at}
                elif not field.attributes:
                    begun.append((item, name, []))
                elif value := field.value(attrs):
                    item.values[name] = value
            if tag in layout.label_tags:
                begun.append((item, None, []))
        self.gathering += begun
        self.open.append((item, matched, len(begun)))

    def shown(self, data: str) -> None:
        if self.gathering:
            inner = self.open[-1][0]
            for item, _, parts in self.gathering:
                if item is inner:
                    parts.append(data)

    def closed(self, tag: str) -> None:
        _, _, begun = self.open.pop()
        if begun:
            for item, name, parts in self.gathering[-begun:]:
                text = on_one_line(parts)
                if name is None:
                    item.labels[tag] = text
                elif text and name not in item.values:
                    item.values[name] = text
            del self.gathering[-begun:]
        if self.gathering and tag in BLOCKS:
            self.shown(" ")


#: Fields that the layouts below give, all as text; a layout that lacks one leaves it empty.
STANDARD = ("name", "url", "date", "image", "kind", "price", "status", "code")
# Where the catalogs and shops have their items and what these tell.
LAYOUTS: dict[str, tuple[str, dict[str, str]]] = {
    "onepiece_list": ("li.linkListColBox[data-cat]", {"name": "h4.linkListColTitle", "url": "a.linkListColItem@href", "date": "time[datetime]@datetime", "image": "img@data-src|src", "kind": "@data-cat", "price": "*"}),
    "gundam_list": ("div.productsDetail[data-tags]", {"name": "div.cardTit", "url": "a.productsDetailInner@href", "date": "dt=発売日 + dd", "image": "img@src", "kind": "@data-tags", "price": "*"}),
    "union_arena_list": ("li.productsDetail[data-tags]", {"name": "dt.productsTit", "url": "a@href", "date": "*", "image": "img@src", "kind": "@data-tags", "price": "*"}),
    "fusion_world_list": ("li.prpductListItem.cardCol", {"name": "h3.cardText", "url": "a@href", "date": "dt=発売日 + dd", "image": "img@data-src|src", "price": "dt=メーカー希望小売価格 + dd"}),
    "duel_masters_list": ("div.itemList01_item", {"name": "h2.title", "url": "a[href*=/product/]@href", "date": "*", "image": "img@data-src|src", "kind": ".product_type", "price": "*"}),
    "weiss_list": ("a.products__link[href*=/products/]", {"name": ".products__name", "url": "@href", "date": "*", "image": "img@data-src|src", "kind": ".products__catItem", "price": "*"}),
    "mtg_list": ("a[href*=/products/]", {"name": "*", "url": "@href", "image": "img@src"}),
    "konami_list": ("li.grid-col5", {"name": ".item-name", "url": "a[href*=detail.php]@href", "image": "img.picture@data-src|src", "price": ".item-price", "status": ".item-tag"}),
    "bushiroad_list": ("div.product-item[data-handle]", {"name": "@data-title", "url": "a[href*=/products/]@href", "image": "img@data-src|src|data-original", "price": "*", "status": "@data-available", "code": "@data-handle"}),
    "konami_detail": ("html", {"name": "h2.hdg-text", "image": "meta[property=og:image]@content", "date": "*", "price": "*", "status": "*", "code": "*"}),
    "bushiroad_detail": ("html", {"image": "meta[property=og:image]@content", "price": "*", "status": "*"}),
    "yugioh_detail": ("html", {"name": "h1", "image": "meta[property=og:image]@content", "date": "*", "price": "*", "kind": "*"}),
}


def layout_of(layout: str) -> Layout:
    """A layout by its name, or by JSON of item and fields."""
    if layout in LAYOUTS:
        return Layout(*LAYOUTS[layout])
    given = json.loads(layout)
    return Layout(given["item"], given["fields"])


# Elements and classes that hold an article's own text.
CONTENT_TAGS, CONTENT_CLASSES = frozenset(("div", "section")), frozenset(("entry-content", "article-body", "post-content", "content"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class PageLines:
    """Listener that keeps the lines of a page, with the element that holds each, its headings and links."""

    def __init__(self):
        #: Names of open elements, and how many of them and of those around them hold an article's text.
        self.path: list[tuple[str, int]] = [("", 0)]
        self.rows: list[tuple] = []
        self.parts: list[str] = []
        self.heading, self.link, self.link_parts = "", None, []

    def _flush(self) -> str:
        if not self.parts:
            return ""
        text = on_one_line(self.parts)
        self.parts = []
        if text:
            tag, within = self.path[-1]
            self.rows.append(("text", tag, text, "", self.heading, within > 0))
        return text

    def opened(self, tag: str, attrs: Attributes) -> None:
        if tag in BLOCKS or tag == "br":
            self._flush()
            self.link_parts.append(" ")
        holds = tag == "article" or (tag in CONTENT_TAGS and "class" in attrs and not CONTENT_CLASSES.isdisjoint(attrs["class"].split()))
        self.path.append((tag, self.path[-1][1] + holds))
        if tag == "img":
            if attrs.get("alt", "").strip():
                self.shown(f" {attrs['alt']} ")
        elif tag == "a":
            self.link, self.link_parts = attrs.get("href", "").strip(), []
        elif tag == "meta":
            self.rows.append(("meta", attrs.get("property") or attrs.get("name", ""), attrs.get("content", ""), "", "", False))
        elif tag == "time" and attrs.get("datetime"):
            self.rows.append(("meta", "time", attrs["datetime"], "", "", False))

    def shown(self, data: str) -> None:
        self.parts.append(data)
        if self.link is not None:
            self.link_parts.append(data)

    def closed(self, tag: str) -> None:
        if tag in BLOCKS:
            text = self._flush()
            self.link_parts.append(" ")
            if text and tag in _HEADINGS:
                self.heading = text
        if tag == "a" and self.link is not None:
            self.rows.append(("link", "a", on_one_line(self.link_parts), self.link, self.heading, self.path[-1][1] > 0))
            self.link = None
        self.path.pop()


def lists_of(rows: Sequence[Sequence[tuple]], fields: pa.StructType) -> pa.Array:
    """For each page the list of its rows."""
    ends = pa.array([0, *_running(map(len, rows))], pa.int32())
    columns = list(zip(*chain.from_iterable(rows), strict=True)) or [()] * fields.num_fields
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=list(fields)))


def _running(sizes: Iterable[int]) -> Iterable[int]:
    total = 0
    for n in sizes:
        total += n
        yield total


_PAGE_ROW = pa.struct([("kind", pa.string()), ("tag", pa.string()), ("text", pa.string()), ("href", pa.string()), ("heading", pa.string()), ("within", pa.bool_())])


def lines_of(html: str | None) -> list[tuple]:
    """kind (text, link or meta), tag, text, href, the heading above, and whether an article holds it, of each row of a page."""
    if html and (rows := _plain_lines(html)) is not None:
        return rows
    lines = PageLines()
    TagEvents(lines).read(html)
    lines._flush()
    return lines.rows


def _plain_lines(html: str) -> list[tuple] | None:
    """What ``PageLines`` keeps, in one loop over plain markup without angle brackets in quotes; None for other markup.

    Most pages are so, and their events cost more than what they tell.
    """
    rows: list[tuple] = []
    parts: list[str] = []
    link_parts: list[str] = []
    heading, link = "", None
    # Open elements, and how many of each one and of those around it hold an article's text.
    names, within = [""], [0]

    def parted() -> str:
        nonlocal parts
        if link is not None:
            link_parts.append(" ")
        if not parts:
            return ""
        text, parts = on_one_line(parts), []
        if text:
            rows.append(("text", names[-1], text, "", heading, within[-1] > 0))
        return text

    def close(at: int) -> None:
        nonlocal heading, link
        while len(names) > at:
            tag = names[-1]
            if tag in BLOCKS:
                text = parted()
                if text and tag in _HEADINGS:
                    heading = text
            elif tag == "a" and link is not None:
                rows.append(("link", "a", on_one_line(link_parts), link, heading, within[-1] > 0))
                link = None
            names.pop()
            within.pop()

    def show(text: str) -> None:
        parts.append(text)
        if link is not None:
            link_parts.append(text)

    def start(tag: str, attrs: Attributes, empty: str) -> None:
        nonlocal link, link_parts
        if tag in _ENDERS:
            for at in range(len(names) - 1, 0, -1):
                if tag in ENDED_BY.get(names[at], ()):
                    close(at)
                    break
                if names[at] in SCOPE:
                    break
        if tag in BLOCKS or tag == "br":
            parted()
        holds = tag == "article" or (tag in CONTENT_TAGS and "class" in attrs and not CONTENT_CLASSES.isdisjoint(attrs["class"].split()))
        names.append(tag)
        within.append(within[-1] + holds)
        if tag == "a":
            link, link_parts = attrs.get("href", "").strip(), []
        elif tag == "img":
            if attrs.get("alt", "").strip():
                show(f" {attrs['alt']} ")
        elif tag == "meta":
            rows.append(("meta", attrs.get("property") or attrs.get("name", ""), attrs.get("content", ""), "", "", False))
        elif tag == "time" and attrs.get("datetime"):
            rows.append(("meta", "time", attrs["datetime"], "", "", False))
        if empty or tag in VOID:
            close(len(names) - 1)

    first, *pieces = html.split("<")
    if first:
        show(unescape(first))
    for piece in pieces:
        markup, ended, text = piece.partition(">")
        found = _known_tags.get(markup)
        if found is None:
            if (found := _tag(markup)) is None:
                return None
            if len(_known_tags) >= KNOWN_TAGS:
                _known_tags.clear()
            _known_tags[markup] = found
        end, tag, attrs, empty = found
        if not ended:
            return None
        if not end:
            if tag:
                start(tag, attrs, empty)
        elif names[-1] == tag:
            close(len(names) - 1)
        elif tag in names:
            close(len(names) - 1 - names[::-1].index(tag))
        if text and names[-1] not in UNSHOWN:
            show(unescape(text) if "&" in text else text)
    close(1)
    parted()
    return rows


def page_lines(html: Column) -> Column:
    """The rows of a page in order, as an array."""

    @F.arrow_udf(returnType="array<struct<kind:string,tag:string,text:string,href:string,heading:string,within:boolean>>")
    def read(pages: pa.Array) -> pa.Array:
        return lists_of([lines_of(page) for page in pages.to_pylist()], _PAGE_ROW)

    return read(html)


def items_of(html: str, layout: Layout, names: Sequence[str]) -> list[tuple]:
    """ord and the fields of each item of a page."""
    items = LayoutItems(layout)
    TagEvents(items).read(html)
    return [(item.place, *(item.values.get(name, "") for name in names)) for item in items.found]


def layout_rows(df: DataFrame, html: str, layout: str | Column) -> DataFrame:
    """df's other columns with ord and the fields of each item of each page, by a layout's name or JSON, or a column of names."""
    kept = [c for c in df.columns if c != html]
    named = STANDARD if not isinstance(layout, str) or layout in LAYOUTS else tuple(json.loads(layout)["fields"])
    fields = pa.struct([("ord", pa.int32()), *((name, pa.string()) for name in named)])

    @F.arrow_udf(returnType="array<struct<ord:int," + ",".join(f"`{name}`:string" for name in named) + ">>")
    def read(pages: pa.Array, layouts: pa.Array) -> pa.Array:
        compiled = {name: layout_of(name) for name in layouts.unique().to_pylist() if name is not None}
        return lists_of([[] if page is None or name is None else items_of(page, compiled[name], named) for page, name in zip(pages.to_pylist(), layouts.to_pylist(), strict=True)], fields)

    items = read(F.col(html), F.lit(layout) if isinstance(layout, str) else layout)
    return df.select(*kept, F.inline(items))


def page_rows(df: DataFrame, html: str) -> DataFrame:
    """df's other columns with ord and the columns of each row of each page."""
    kept = [c for c in df.columns if c != html]
    return df.select(*kept, F.posexplode(page_lines(F.col(html))).alias("ord", "__row")).select(*kept, "ord", "__row.*")
