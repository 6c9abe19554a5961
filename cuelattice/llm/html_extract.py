"""Main text of web pages: what recurs across the pages of a site is its template and goes.

Every element is hashed with all that stands below it (tags and text, no
attributes).  Spark counts for each host in how many articles' pages a subtree
stands; one that stands in at least ``LEAST`` and at least ``SHARE`` of them is
deleted wherever it stands on that host.  Pages with the same article count
once, so copies of an article do not make it a template, and where recurring
subtrees are more than half of an article's words, that article is itself a
copy and keeps all.

Elements that HTML or their class or id declare to be no article (menus, site
headers, footers, sidebars, notices, adverts, forms, reader comments) go on any
site, however small.  The text is that of the page's ``article`` elements, or
else of ``main``, of an element named as the article's body, or of the body.
Inside an article's own header only headings stay.

Both passes read the pages once.  Only hashes are shuffled, and a host's
recurring subtrees are at most ``1 / SHARE`` times as many as its mean page has
elements.  They reach the pages by a join that Spark broadcasts if their
measured size allows.

Defined cases: null or empty html gives an empty text; a page without a url, or
with one that has no host, is of the host with the empty name; broken markup is
read as browsers do (open paragraphs end, unknown end tags are skipped, an open
comment or script runs to the end); equal rows give equal rows; an empty table
gives no rows.  A line break tag is white space, and so is all that Unicode
calls it.  Input columns named ``text``, ``n_chars`` or ``n_subtrees`` are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, column, materialise, slices

LEAST = 5
SHARE = 0.5

# Names of HTML, and words that sites use for parts beside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are not shown in place, or within a line.
NO_BREAK = INLINE | frozenset("button canvas iframe input link meta noscript object script select style svg template textarea".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Start tags that end an open element of these kinds, unless a border stands between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
BORDERS = frozenset("ul ol dl table select menu article body".split())
NO_ARTICLE = frozenset("nav footer aside form head script style noscript template menu dialog button select textarea title iframe noembed noframes object svg canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BESIDE = frozenset(
    "ad ads adbox adslot adunit adbanner advert adverts advertisement advertising advertisements adsense adsbygoogle affiliate sponsor sponsored sponsors promo promotion outbrain taboola banner "
    "nav navbar navigation navlinks mainnav topnav sidenav subnav menu menubar mainmenu submenu navmenu breadcrumb breadcrumbs topbar toolbar pagination pager "
    "sidebar sidebars sidepanel sidecol rail aside widget widgets footer sitefooter pagefooter colophon siteheader masthead copyright disclaimer "
    "cookie cookies consent gdpr notice notices notification alert announcement infobar popup modal overlay paywall newsletter subscribe subscription signup login optin "
    "comment comments commentlist commentbox commentsection usercomments disqus reply replies respond responses feedback related recommended recommendations share sharing social".split()
)
#: An ``article`` element of one of these exact classes is none.
NO_ARTICLE_CLASS = frozenset("comment comments reply teaser card related ad ads advert advertisement sponsored promo widget sidebar notice".split())
#: Names that only speak of a part elsewhere: has-sidebar, comments-open.
QUALIFIERS = frozenset("has with without no open closed enabled disabled".split())
BODY_NAMES = frozenset("article article-body articlebody article-content article-text post post-content post-body post-text entry entry-content story story-body content main main-content maincontent page-content".split())

TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*>?|</[^>]*>?""", re.S)
ATTRIBUTES = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

ALWAYS, NAMED, HEADER = 1, 2, 3


def _what(tag: str, attributes: str) -> tuple[int, int]:
    """Why an element is no article (0 if it may be one), and how it may be the article: 1 article, 2 main, 3 by name."""
    why = ALWAYS if tag in NO_ARTICLE else HEADER if tag == "header" else 0
    root = 1 if tag == "article" else 2 if tag == "main" else 0
    if not attributes or why == ALWAYS or not TELLING.search(attributes):
        return why, root
    found = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTES.findall(attributes)}
    if "hidden" in found or NOT_SHOWN.search(found.get("style", "")) or found.get("role", "").lower() in ROLES:
        return ALWAYS, root
    if found.get("role", "").lower() == "main":
        root = root or 2
    names = [*found.get("class", "").split(), *found.get("id", "").split()]
    if tag == "article":
        return (NAMED if any(n.lower() in NO_ARTICLE_CLASS for n in names) else why), root
    if not root and tag not in HEADINGS and ("articlebody" in found.get("itemprop", "").lower() or any(n.lower() in BODY_NAMES for n in names)):
        root = 3
    if tag not in ("html", "body", "main", *HEADINGS) and not why:  # ids of headings are made of their words
        for name in names:
            words = {w.lower() for w in [*WORDS.findall(name), *re.split(r"[-_:.]+", name)]}
            if words & BESIDE and not words & QUALIFIERS:
                return NAMED, root
            if "header" in words and not words & QUALIFIERS:
                why = HEADER
    return why, root


class Page:
    """A page as pieces of text in order (None: a border of blocks) and its elements as ranges of pieces."""

    def __init__(self, html: str):
        self.pieces: list[str | None] = []
        self.linked: list[bool] = []  # whether a piece is within a link
        #: start, end, hash, tag, why, root: elements that hold text, inner ones first.
        self.elements: list[tuple[int, int, int, str, int, int]] = []
        self._open: list[tuple[str, int, list[bytes], int, int]] = []
        self._n: dict[str, int] = {}  # open elements by kind
        at, n = 0, len(html)
        while at < n:
            token = TOKEN.search(html, at)
            if token is None:
                self._text(html[at:])
                break
            if token.start() > at:
                self._text(html[at : token.start()])
            at, tag = token.end(), token[2]
            if tag is None:
                continue
            tag = tag.lower()
            if token[1]:
                self._end(tag)
                continue
            self._start(tag, token[3])
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                self._close()
                at = close.end() if close else n
        while self._open:
            self._close()

    def _add(self, piece: str | None) -> None:
        self.pieces.append(piece)
        self.linked.append(self._n.get("a", 0) > 0)

    def _text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self._add(text)
        if self._open and (words := text.split()):
            self._open[-1][2].append(" ".join(words).encode("utf-8", "replace"))

    def _start(self, tag: str, attributes: str) -> None:
        if self._open:
            if self._open[-1][0] == "head" and tag not in IN_HEAD:
                self._close()
            if tag in ENDS_P:
                self._end("p", BORDERS)
            for other in ENDS.get(tag, ()):
                self._end(other, BORDERS)
        if tag == "br":
            self._add(" ")
        elif tag not in NO_BREAK:
            self._add(None)
        if tag not in VOID:
            self._n[tag] = self._n.get(tag, 0) + 1
            self._open.append((tag, len(self.pieces), [], *_what(tag, attributes)))

    def _end(self, tag: str, borders: frozenset = frozenset()) -> None:
        """Close the innermost open element of a kind, and all within.  An inline one ends no block that it is open around."""
        if not self._n.get(tag):
            return
        for i in range(len(self._open) - 1, -1, -1):
            other = self._open[i][0]
            if other == tag:
                while len(self._open) > i:
                    self._close()
                return
            if other in borders or tag in INLINE and other not in INLINE:
                return

    def _close(self) -> None:
        tag, start, parts, why, root = self._open.pop()
        self._n[tag] -= 1
        if parts:
            digest = xxhash.xxh3_64_intdigest(b"\0".join([tag.encode("utf-8", "replace"), *parts])) - (1 << 63)
            self.elements.append((start, len(self.pieces), digest, tag, why, root))
            if self._open:
                self._open[-1][2].append(b"\1" + digest.to_bytes(8, "little", signed=True))
        if tag not in NO_BREAK:
            self._add(None)

    def article(self) -> tuple[bytearray, bool]:
        """Which pieces are the article's by what the page itself says, and whether an element marks it."""
        n = len(self.pieces)
        main = min((e[0] for e in self.elements if e[5] == 2 and e[4] != ALWAYS), default=None)
        first = min((e[0] for e in self.elements if e[5] == 1 and not e[4]), default=None)
        gone = bytearray(n)
        for start, end, _, _, why, _ in self.elements:
            if why == ALWAYS or why == NAMED and not any(p is not None and start <= p < end for p in (main, first)):
                gone[start:end] = b"\1" * (end - start)
        kept, marked = bytearray(n), False
        for root in (1, 2, 3):
            for start, end, _, _, why, own in self.elements:
                if own == root and why in (0, HEADER) and not all(gone[start:end]):
                    kept[start:end], marked = b"\1" * (end - start), True
            if marked and any(kept[i] and not gone[i] and (p := self.pieces[i]) and not p.isspace() for i in range(n)):
                break
            kept, marked = bytearray(n), False
        if not marked:
            kept = bytearray(b"\1" * n)
            for start, end, _, tag, _, _ in self.elements:  # lists of links alone are menus
                if tag in ("ul", "ol"):
                    held = [self.linked[i] for i in range(start, end) if (p := self.pieces[i]) and not p.isspace()]
                    if len(held) >= 3 and all(held):
                        gone[start:end] = b"\1" * (end - start)
        for start, end, _, tag, why, _ in self.elements:
            if why == HEADER and tag != "article" and not (first is not None and start <= first < end):
                stays = bytearray(end - start)
                if marked:
                    for s, e, _, t, _, _ in self.elements:
                        if t in HEADINGS and start <= s and e <= end:
                            stays[s - start : e - start] = b"\1" * (e - s)
                for i in range(start, end):
                    kept[i] &= stays[i - start]
        for i in range(n):
            kept[i] &= not gone[i]
        return kept, marked

    def text(self, kept: bytearray) -> str:
        blocks, held = [], []
        for piece, stays in zip(self.pieces, kept, strict=True):
            if piece is None:
                if held:
                    blocks.append(" ".join("".join(held).split()))
                    held = []
            elif stays:
                held.append(piece)
        if held:
            blocks.append(" ".join("".join(held).split()))
        return "\n".join(b for b in blocks if b)

    def without(self, kept: bytearray, recurring: set[int]) -> tuple[bytearray, int]:
        """The pieces that stay once recurring subtrees are deleted, and how many outermost ones there are."""
        last, cut = len(self.pieces), bytearray(len(self.pieces))
        n, covered = 0, last
        for start, end, digest, *_ in reversed(self.elements):  # outer elements before inner ones, later ones first
            if end <= covered and digest in recurring:
                cut[start:end] = b"\1" * (end - start)
                n, covered = n + 1, start
        if not n:
            return kept, 0
        left = bytearray(k and not c for k, c in zip(kept, cut, strict=True))
        words = [sum(len(p.split()) for p, k in zip(self.pieces, which, strict=True) if p and k) for which in (kept, left)]
        return (left if 2 * words[1] >= words[0] else kept), n


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, subtree, article: the distinct subtrees of each page; 0 stands for the page itself."""
    for b in slices(batches, "html"):
        hosts, subtrees, articles = [], [], []
        for host, html in zip(column(b, "host"), column(b, "html"), strict=True):
            page = Page(as_text(html))
            found = {e[2] for e in page.elements}
            found.add(0)
            hosts += [host] * len(found)
            subtrees += found
            articles += [xxhash.xxh3_64_intdigest(page.text(page.article()[0]).encode("utf-8", "replace")) - (1 << 63)] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hosts, subtrees, articles)], names=["host", "subtree", "article"])


def host_key(url: str = "url"):
    """Hash of the host of a url."""
    return F.xxhash64(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))


def recurring_subtrees(pages: DataFrame, html: str = "html", url: str = "url", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """host, subtrees: the subtrees that make up each site's template."""
    seen = pages.select(host_key(url).alias("host"), F.col(html).alias("html")).mapInArrow(_subtrees, "host long, subtree long, article long")
    counts = seen.groupBy("host", "subtree").agg(F.countDistinct("article").alias("n")).where(F.col("n") >= least)
    counts, _ = materialise(counts, "html-counts")  # read twice
    totals = counts.where("subtree = 0").select("host", F.col("n").alias("total"))
    often = counts.where("subtree <> 0").join(totals, "host").where(F.col("n") >= share * F.col("total"))
    return often.groupBy("host").agg(F.collect_list("subtree").alias("subtrees"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html"):
        texts, deleted = [], []
        for html, recurring in zip(column(b, "html"), column(b, "subtrees"), strict=True):
            page = Page(as_text(html))
            kept, n = page.without(page.article()[0], set(recurring or ()))
            texts.append(page.text(kept))
            deleted.append(n)
        yield pa.RecordBatch.from_arrays(
            [b.column(b.schema.get_field_index("carried")), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(deleted, pa.int64())],
            names=["carried", "text", "n_chars", "n_subtrees"],
        )


def extract(pages: DataFrame, html: str = "html", url: str = "url", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """The columns of the pages but html, with text, n_chars (code points) and n_subtrees (recurring subtrees found on the page)."""
    templates, _ = materialise(recurring_subtrees(pages, html, url, least, share), "html-templates")
    carried = F.struct(*[F.col(c) for c in pages.columns if c.lower() not in ("text", "n_chars", "n_subtrees", html.lower())])
    rows = pages.select(carried.alias("carried"), F.col(html).alias("html"), host_key(url).alias("host")).join(templates, "host", "left").select("carried", "html", "subtrees")
    schema = T.StructType([rows.schema["carried"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_subtrees", T.LongType())])
    return rows.mapInArrow(_texts, schema).select("carried.*", "text", "n_chars", "n_subtrees")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
