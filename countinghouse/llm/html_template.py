"""Main text of web pages, with the removal of site templates.

Each page is parsed once: its blocks of text, the elements around each block, and a
hash of every element's subtree (names, classes, texts, in order). Spark counts in how
many articles of a host each subtree is found. A page's text is its article without
what names itself as something else (menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts), and without subtrees that recur across the host.

Any subtree can be template, in an article or not. Two counts tell it from a passage that
was copied: it is in ``MIN_PAGES`` articles of the host, or, if it is a paragraph or the
like of an article, in ``MIN_PAGES_OF_TEXT``; and in ``MIN_FIXED`` of these it has one
place, which is the names of the elements around it and its number among its siblings,
from the first or from the last. It goes at that place only. Neither bound grows with the host. Pages with one own
heading (one that their title holds) are copies of one article and count once, and so do
pages of one text without such a heading. An own heading is never template.

Defined results: a null or empty page has an empty text; a null address is a host of
its own; repeated rows count once and are returned each; an empty table gives an empty
result; further columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countinghouse.llm.arrow import sliced
from countinghouse.session import stored

MIN_PAGES = 10
MIN_PAGES_OF_TEXT = 21
MIN_FIXED = 0.8

# Element names of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q"
    " rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr".split()
)
NEVER_TEXT = set(
    "head script style noscript template iframe object svg canvas button select option"
    " textarea title nav footer aside form menu dialog audio video noembed noframes".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = set("div section aside ul ol dl table figure details fieldset center span".split())
WHOLE = set("html body main article".split())
#: Start tags that end an open element of these names.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr"}, "tbody": {"tr", "thead", "tbody"}, "tfoot": {"tr", "tbody"},
}
#: Elements that such a search does not go beyond.
BARRIERS = set("ul ol dl table article main section body html".split())
#: Words of a class, id or role that name something other than the article.
OTHER = set(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion"
    " cookie cookies consent gdpr notice notices comment comments disqus sidebar navbar"
    " breadcrumb breadcrumbs masthead contentinfo".split()
)
#: Words that do so for a box, though a paragraph may be about the thing.
OTHER_BOX = OTHER | set(
    "alert banner popup modal newsletter subscribe complementary widget menu nav navigation"
    " footer replies respond share sharing social related recommended login signup search"
    " pagination pager toolbar".split()
)
PARAGRAPHS = HEADINGS | set("p blockquote pre li dt dd figure figcaption table tr".split())
#: Words of layout, which a class name may add to one of the words above. With any other
#: word the name tells what the text is about: market-share, ad-hoc, related-work.
COMPANIONS = set(
    "site page post posts entry article articles story stories content contents main inner outer"
    " top bottom left right side global primary secondary fixed sticky floating small large"
    " box block area section sections wrapper wrap container group list lists item items row col"
    " column columns slot unit module component panel card bar strip link links button buttons"
    " btn icon icons image form field input label header heading title body message overlay"
    " layer text thread count counter more tools js".split()
)
#: How far an element is from being text of the article.
TEXT, HEADER, OTHERWISE = 0, 1, 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>|[^>]*(?:>|\Z))",
    re.S,
)
#: An attribute with its value; what stands in another attribute's value is none.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>"']+)))?""")
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


def _names(rest: str) -> dict[str, str]:
    """The class, id and role that a start tag gives, the first of each."""
    found: dict[str, str] = {}
    if "=" in rest:
        for name, *values in _ATTRIBUTE.findall(rest):
            if name.lower() in ("class", "id", "role"):
                found.setdefault(name.lower(), "".join(values))
    return found


def _names_other(name: str, named: str) -> bool:
    """Whether one of the names is that of something other than the article."""
    other = OTHER if name in PARAGRAPHS or name == "article" else OTHER_BOX
    for one in named.split():
        words = {word.lower() for word in _WORD.findall(one) if len(word) > 1}
        if words & other and words <= other | OTHER_BOX | COMPANIONS:
            return True
    return False


def _is_header(one: str) -> bool:
    words = {word.lower() for word in _WORD.findall(one) if len(word) > 1}
    return "header" in words and words <= COMPANIONS


class Element:
    """An open element while its page is read."""

    __slots__ = ("barred", "children", "contents", "inside", "name", "named", "number", "path")

    def __init__(
        self, name: str, named: str, number: int, inside: int, barred: int, path: int = 0
    ):
        self.name, self.named, self.number = name, named, number
        self.inside = inside  # 2: of an article, 1: of a main element, 0: neither
        self.barred = barred
        self.path = path  # of the names from the article on
        self.contents: list[bytes] = []
        self.children: list[int] = []


class Page:
    """The blocks of a page and the hashes and places of its subtrees."""

    def __init__(self, html: str):
        #: (text, inside, numbers of the elements that may be template) of each block
        self.blocks: list[tuple[str, int, tuple[int, ...]]] = []
        self.hashes: dict[int, int] = {}
        #: (place from the first sibling, from the last, whether it is text of an article)
        self.places: dict[int, tuple[int, int, bool]] = {}
        self.title = ""
        self.headings: dict[int, str] = {}
        self.open = [Element("html", "", 0, 0, TEXT)]
        self.names: Counter[str] = Counter()
        self.parts: list[str] = []
        self.count = 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            token = _TOKEN.search(html, at)
            stop = token.start() if token else end
            if stop > at:
                self.parts.append(unescape(html[at:stop]))
            if not token:
                break
            at = token.end()
            name = token[2]
            if not name:
                continue
            name = name.lower()
            if token[1]:
                self._end(name)
                continue
            self._start(name, token[3])
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = close.start() if close else end
                if name == "title" and not self.title:
                    self.title = " ".join(unescape(html[token.end() : at]).split())
        self._flush()
        while self.open:
            self._close()

    def _flush(self) -> None:
        """The text since the last border of a block."""
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if not text:
            return
        top = self.open[-1]
        top.contents.append(text.encode("utf-8", "replace"))
        if top.barred:
            return
        inside = top.inside
        under = tuple(
            x.number for x in self.open if x.name not in WHOLE and (not inside or x.inside == inside)
        )
        if top.name in HEADINGS:
            self.headings[len(self.blocks)] = text
        self.blocks.append((text, inside, under))

    def _start(self, name: str, rest: str) -> None:
        if name in INLINE:
            if name in ("br", "td", "th"):
                self.parts.append(" ")
            return
        self._flush()
        self._end_open(ENDS.get(name, {"p"}))
        if name in VOID:
            return
        above = self.open[-1]
        names = _names(rest)
        named = " ".join(names.values())
        inside, barred = above.inside, above.barred
        other = _names_other(name, named)
        if name == "article" and not other:
            inside = 2
        elif (name == "main" or names.get("role", "").lower() == "main") and inside < 1:
            inside = 1
        if name not in ("html", "body", "main"):
            if name in NEVER_TEXT or other:
                barred = OTHERWISE
            elif name == "header" or any(_is_header(x) for x in named.split()):
                barred = max(barred, HEADER)
            elif name in HEADINGS and inside == 2 and barred == HEADER:
                barred = TEXT  # the article's own heading
        self.count += 1
        self.names[name] += 1
        path = 0 if inside > above.inside else crc32(name.encode("utf-8", "replace"), above.path)
        self.open.append(Element(name, named, self.count, inside, barred, path))

    def _end_open(self, names: set[str]) -> None:
        if not any(self.names[name] for name in names):
            return
        for n in range(len(self.open) - 1, 0, -1):
            name = self.open[n].name
            if name in names:
                while len(self.open) > n:
                    self._close()
                return
            if name in BARRIERS:
                return

    def _end(self, name: str) -> None:
        if name in INLINE:
            return
        self._flush()
        if not self.names[name]:
            return
        for n in range(len(self.open) - 1, 0, -1):
            if self.open[n].name == name:
                while len(self.open) > n:
                    self._close()
                return

    def _close(self) -> None:
        element = self.open.pop()
        self.names[element.name] -= 1
        known = (element.name, element.named)
        whole = b"\x00".join([*(x.encode("utf-8", "replace") for x in known), *element.contents])
        digest = xxhash.xxh64_intdigest(whole)
        if self.open:
            self.open[-1].contents.append(digest.to_bytes(8, "little"))
        for n, number in enumerate(element.children):
            path, of_text = self.places[number][1:]
            ends = (n, len(element.children) - n)
            first, last = (crc32(end.to_bytes(4, "little"), path) for end in ends)
            self.places[number] = (first, last, of_text)
        if element.contents and element.name not in WHOLE:
            self.hashes[element.number] = digest - (digest >> 63 << 64)
            of_text = element.inside > 0 and element.name not in CONTAINERS
            self.places[element.number] = (0, element.path, of_text)
            if self.open and not element.barred:
                self.open[-1].children.append(element.number)

    def main(self) -> list[tuple[str, list[int]]]:
        """The article's blocks, each with the numbers of what may be template around it."""
        best = max((inside for _, inside, _ in self.blocks), default=0)
        return [
            (text, [n for n in under if n in self.hashes] if self._may_go(place) else [])
            for place, (text, inside, under) in enumerate(self.blocks)
            if inside == best
        ]

    def _may_go(self, place: int) -> bool:
        return place not in self.headings or self.headings[place] not in self.title

    def article(self, texts: list[str]) -> int:
        """What copies of one article have in common."""
        own = next((x for x in self.headings.values() if x in self.title), None)
        known = SEPARATOR.join(texts) if own is None else own
        digest = xxhash.xxh64_intdigest(known.encode("utf-8", "replace"), own is not None)
        return digest - (digest >> 63 << 64)


SEPARATOR = "\n\n"
MARKS = pa.list_(
    pa.struct(
        {name: pa.int64() for name in ("number", "hash", "first", "last")} | {"of_text": pa.bool_()}
    )
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = pa.struct({"text": pa.string(), "under": pa.list_(pa.int64())})
    for batch in batches:
        for part in sliced(batch, 500):
            texts, blocks, articles, marks = [], [], [], []
            for html in part["html"]:
                page = Page(html.as_py())
                main = page.main()
                numbers = sorted({n for _, under in main for n in under})
                texts.append(None if numbers else SEPARATOR.join(text for text, _ in main))
                blocks.append(
                    [{"text": text, "under": under} for text, under in main] if numbers else None
                )
                articles.append(page.article([text for text, _ in main]))
                marks.append(
                    [
                        dict(zip(MARKS.value_type.names, (n, page.hashes[n], *page.places[n])))
                        for n in numbers
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    part["page_id"],
                    part["url"],
                    part["host"],
                    pa.array(texts, pa.string()),
                    pa.array(blocks, pa.list_(block)),
                    pa.array(articles, pa.int64()),
                    pa.array(marks, MARKS),
                ],
                names=["page_id", "url", "host", "text", "blocks", "article", "marks"],
            )


def host_key(url: Column) -> Column:
    """A number for the host of an address."""
    rest = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*:", "")
    return F.xxhash64(F.regexp_extract(rest, r"^//([^/?#]*)", 1))


def parsed(pages: DataFrame) -> DataFrame:
    """Each page with its text, or with the blocks it may consist of; stored."""
    given = pages.select(
        "page_id",
        "url",
        host_key(F.col("url")).alias("host"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    kinds = {name: given.schema[name].dataType.simpleString() for name in ("page_id", "url")}
    return stored(
        given.mapInArrow(
            _parse,
            f"page_id {kinds['page_id']}, url {kinds['url']}, host bigint, text string,"
            " blocks array<struct<text: string, under: array<bigint>>>, article bigint,"
            " marks array<struct<number: bigint, hash: bigint, first: bigint, last: bigint,"
            " of_text: boolean>>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "parsed-pages",
    )


def recurring(
    rows: DataFrame,
    min_pages: int = MIN_PAGES,
    min_pages_of_text: int = MIN_PAGES_OF_TEXT,
    min_fixed: float = MIN_FIXED,
) -> DataFrame:
    """``host`` and ``hash`` of the subtrees that are template, ``at`` their places."""
    found = rows.select("host", "article", F.inline("marks"))
    bound = F.when(F.col("of_text"), min_pages_of_text).otherwise(min_pages)
    often = stored(
        found.groupBy("host", "hash", "article")
        .agg(F.min("of_text").alias("of_text"))
        .groupBy("host", "hash")
        .agg(F.count(F.lit(1)).alias("articles"), F.min("of_text").alias("of_text"))
        .filter(F.col("articles") >= bound)
        .drop("of_text"),
        "often",
    )
    return (
        found.join(often, ["host", "hash"])
        .select("host", "hash", "articles", "article", F.explode(_ends()).alias("at"))
        .groupBy("host", "hash", "articles", "at", "article")
        .agg(F.count(F.lit(1)).alias("times"))
        .groupBy("host", "hash", "articles", "at")
        .agg(F.count(F.lit(1)).alias("fixed"))
        .filter(F.col("fixed") >= F.col("articles") * min_fixed)
        .select("host", "hash", "at")
    )


def _ends() -> Column:
    """The two places of a mark."""
    return F.array(
        *(F.struct(F.lit(end).alias("end"), F.col(end).alias("place")) for end in ("first", "last"))
    )


def _without_templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for blocks, gone in zip(batch["blocks"].to_pylist(), batch["gone"].to_pylist()):
            gone = set(gone or ())
            texts.append(
                SEPARATOR.join(x["text"] for x in blocks if not gone.intersection(x["under"]))
            )
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string())],
            names=["page_id", "url", "text"],
        )


def main_text(
    pages: DataFrame,
    min_pages: int = MIN_PAGES,
    min_pages_of_text: int = MIN_PAGES_OF_TEXT,
    min_fixed: float = MIN_FIXED,
) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of each page."""
    rows = parsed(pages)
    template = stored(recurring(rows, min_pages, min_pages_of_text, min_fixed), "recurring")
    open_ = rows.filter("blocks is not null")
    gone = stored(
        open_.select("row", "host", F.inline("marks"))
        .select("row", "host", "number", "hash", F.explode(_ends()).alias("at"))
        .join(template, ["host", "hash", "at"])
        .groupBy("row")
        .agg(F.collect_set("number").alias("gone")),
        "gone",
    )
    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("page_id", "url")}
    rest = (
        open_.join(gone, "row", "left")
        .select("page_id", "url", "blocks", "gone")
        .mapInArrow(
            _without_templates, f"page_id {kinds['page_id']}, url {kinds['url']}, text string"
        )
    )
    return rows.filter("blocks is null").select("page_id", "url", "text").unionByName(rest)
