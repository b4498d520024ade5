"""Main text of web pages, with the templates of each site removed.

1. Every block element with text is a subtree, hashed by its tag and texts and by where it stands: in an article or main
   element, or on a page without either. This comes before any list of tags or names. What stands beside an article or main
   is never part of the text, so it is not counted.
2. Spark counts for each host on how many different pages (by main text, so that copies of an article count once) a subtree
   occurs. One on at least MIN_PAGES pages is a template if it is on SHARE of the host's pages, or, on pages without article
   or main, on SECTION of them and SECTION_PAGES at least, if the block before it or behind it is the same wherever it stands:
   a section's notice stands next to the section's menu, a passage that many texts quote does not. Templates are deleted.
3. What no count can tell, as on hosts with few pages, goes by tag, role, visibility and by class or id: names count as whole
   words or in known forms (FORMS; a qualifier before a box, as site-footer), never on html, body, headings, article or main,
   nor on an element that holds an article or main. Where a page has an article or main element only that is kept.

The list of a host's templates has at most (subtrees of a page) / SECTION entries, whatever the host's size. If all lists
together are small (MAX_BROADCAST rows, counted), they are broadcast; otherwise pages and lists are joined by host and a salt.

Defined cases: null or empty html gives an empty text; without a host nothing counts as a template; markup that is
never closed ends with the page, stray end tags are ignored; an unquoted or unbalanced attribute ends at the next `>`;
a very long page is read in one pass, whatever is nested or left open in it (tests: 1 MB in under 3 s); a subtree at a threshold is a template; repeated rows give repeated results; an empty
table gives no rows; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table

MIN_PAGES, SHARE, SECTION, SECTION_PAGES = 6, 0.5, 0.05, 20
MAX_BROADCAST, SALTS = 100_000, 64
INSIDE, ALONE = range(2)  # an article or main; on a page without
#: Subtree hashes are polynomials over the hashes of their blocks, so that each takes two prefix sums however deep it stands.
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E681
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title noscript template textarea iframe svg object canvas audio video xmp".split())
DROPPED = frozenset("head nav footer aside form button select menu dialog noframes fieldset".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner sidebar sidebars "
    "menu menus nav navbar navigation breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices alert popup modal "
    "overlay comment comments commentlist respond reply replies disqus related share sharing social newsletter subscribe signup login search "
    "widget widgets pagination pager copyright disclaimer toolbar teaser recommended outbrain taboola skip paywall".split()
)
#: A name of several parts is boilerplate if it is a form, or all its parts but the last are qualifiers and the last is a box.
FORMS = frozenset(
    "ad-slot ad-unit ad-container ad-wrapper social-links social-icons social-share social-buttons share-buttons share-links share-bar sharing-buttons "
    "related-posts related-articles related-links related-stories comment-list comment-form comments-list comments-area cookie-notice cookie-consent "
    "cookie-bar gdpr-notice search-form search-box skip-link skip-links skip-to-content skip-to-main newsletter-signup newsletter-form widget-area login-form".split()
)
QUALIFIERS = frozenset("site page main global primary secondary top bottom header footer mobile desktop sticky cookie cookies consent gdpr user account language social ad ads".split())
BOXES = frozenset("nav navbar navigation menu menus sidebar breadcrumb breadcrumbs footer masthead toolbar pagination pager banner popup modal overlay widget widgets".split())
UNNAMED = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "caption", "option", "optgroup", "legend", "tbody", "thead", "tfoot"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = frozenset("ul ol dl table body html article main section div".split())
TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|[!?/][^>]*>)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def attributes_of(attributes: str) -> Iterator[tuple[str, str]]:
    for m in ATTRIBUTE.finditer(attributes):
        yield m[1].lower(), (m[2] or m[3] or m[4] or "").lower()


def is_boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    """By tag, role or visibility. inside: within an article or main element, where a header holds the title."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    for name, value in attributes_of(attributes):
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.strip() in ROLES) or (name == "style" and HIDDEN.search(value)):
            return True
    return False


def is_named(attributes: str) -> bool:
    """By class or id."""
    for name, value in attributes_of(attributes):
        if name in ("class", "id"):
            for word in value.replace("_", "-").split():
                *before, last = word.split("-")
                if word in NAMES or word in FORMS or (before and last in BOXES and QUALIFIERS.issuperset(before)):
                    return True
    return False


class Page:
    """blocks: all texts but those of head and RAW elements, in order. elements: (hash, place, first block, end block) of each block element with text."""

    def __init__(self, html: str) -> None:
        self.blocks: list[str] = []
        self.mains: list[bool] = []
        self.outs: list[bool] = []
        # of each block the doubt of its innermost named element; an article or main within that takes all doubts around it away
        self.doubts: list[list[bool] | None] = []
        self.subtrees: list[tuple[str, int, int]] = []
        self.held: list[str] = []
        # tag, whether left out, within a main element, first block, doubt
        self.stack: list[tuple[str, bool, bool, int, list[bool] | None]] = [("", False, False, 0, None)]
        self.open: dict[str, list[int]] = {}  # where each tag stands on the stack
        self.walls: list[int] = [0]
        self.doubted: list[list[bool]] = []  # doubts of open elements that still hold
        self._read(html)
        self.kept = [not out and (d is None or not d[0]) for out, d in zip(self.outs, self.doubts, strict=True)]
        one = any(m and k for m, k in zip(self.mains, self.kept, strict=True))
        if one:
            self.kept = [m and k for m, k in zip(self.mains, self.kept, strict=True)]
        self.elements = []
        sums, powers = [0], [1]
        for block in self.blocks:
            sums.append((sums[-1] * BASE + xxhash.xxh64_intdigest(block.encode("utf-8", "replace"))) % PRIME)
            powers.append(powers[-1] * BASE % PRIME)
        for tag, a, b in self.subtrees:
            if not one or self.mains[a]:
                place = INSIDE if one else ALONE
                content = (sums[b] - sums[a] * powers[b - a]) % PRIME
                self.elements.append((xxhash.xxh64_intdigest(f"{tag} {b - a} {content}".encode(), place) - (1 << 63), place, a, b))

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        # A tag ends at a `>`, so none is looked for behind the last one; only a comment may be open there.
        last = html.rfind(">") + 1
        tail = html.find("<!--", last)
        for_token = TOKEN.search
        while at < n:
            m = for_token(html, at, last) if at < last else None
            if m is None and tail >= 0:
                self._text(html[at:max(at, tail)])
                break
            if m is None:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._end(tag)
                continue
            attributes = m[3] or m[6] or ""
            if tag in RAW:
                if not attributes.endswith("/"):
                    close = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                    at = n if close is None else max(close.end(), html.find(">", close.end() - 1) + 1)
                continue
            self._start(tag, attributes)
        self._flush()
        while len(self.stack) > 1:
            self._pop()

    def _text(self, text: str) -> None:
        self.held.append(text)

    def _flush(self) -> None:
        if self.held:
            text = "".join(self.held)
            self.held = []
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                self.blocks.append(text)
                self.mains.append(self.stack[-1][2])
                self.outs.append(self.stack[-1][1])
                self.doubts.append(self.stack[-1][4])

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag == "wbr":
            self._text(" " if tag == "br" else "")
            return
        if tag in BLOCKS:
            self._flush()
            if tag in CLOSES_P and (self.open.get("p") or (0,))[-1] > max(0, len(self.stack) - 13):
                self._close("p", 0)
            for other in CLOSED_BY.get(tag, ()):
                self._close(other, self.walls[-1])
        if tag in VOID:
            return
        _, out, inside, _, doubt = self.stack[-1]
        main = tag in ("article", "main") or "main" in attributes and re.search(r"""role\s*=\s*["']?main\b""", attributes) is not None
        named = False
        if not out:
            out = is_boilerplate(tag, attributes, inside)
            named = not out and not main and tag not in UNNAMED and is_named(attributes)
            if out or named:
                self._flush()
            if main and not out:
                for held in self.doubted:
                    held[0] = False
                self.doubted.clear()
        if named:
            doubt = [True]
            self.doubted.append(doubt)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in WALLS:
            self.walls.append(len(self.stack))
        self.stack.append((tag, out, not out and (inside or main), len(self.blocks), doubt))

    def _close(self, tag: str, wall: int) -> None:
        """Ends the innermost such element unless a wall stands before it."""
        places = self.open.get(tag)
        if places and places[-1] > wall:
            i = places[-1]
            while len(self.stack) > i:
                self._pop()

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        self._close(tag, 0)

    def _pop(self) -> None:
        tag, out, _, first, doubt = self.stack[-1]
        if tag in BLOCKS or doubt is not self.stack[-2][4] or out != self.stack[-2][1]:
            self._flush()
        self.stack.pop()
        self.open[tag].pop()
        if tag in WALLS:
            self.walls.pop()
        if doubt is not self.stack[-1][4] and self.doubted and self.doubted[-1] is doubt:
            self.doubted.pop()
        if tag in BLOCKS and len(self.blocks) > first:
            self.subtrees.append((tag, first, len(self.blocks)))

    def text(self, templates: frozenset[int] | set[int] = frozenset()) -> str:
        left = self.kept
        if templates:
            gone = [0] * (len(left) + 1)
            for h, _, a, b in self.elements:
                if h in templates:
                    gone[a] += 1
                    gone[b] -= 1
            left = [k and not g for k, g in zip(left, accumulate(gone), strict=False)]
        return "\n\n".join(t for t, k in zip(self.blocks, left, strict=True) if k)


def host_of(url: str) -> str:
    return re.split(r"[/?#]", url.partition("://")[2], maxsplit=1)[0].lower()


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def subtrees(pages: DataFrame) -> DataFrame:
    """host, hash, place, page, before, behind: each subtree of a page; page is a hash of its kept text, before and behind of the blocks next to the subtree."""
    kinds = [("host", pa.string()), ("hash", pa.int64()), ("place", pa.int32()), ("page", pa.int64()), ("before", pa.int64()), ("behind", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host = host_of(url or "")
                page = Page(html) if html and host else None
                if page is None or not page.blocks:
                    continue
                whole, n, edges = digest(page.text()), len(page.blocks), {}
                # an element that holds the whole page is no part of a template; place -1 counts the page itself
                for h, place, a, b in page.elements:
                    if b - a < n and h not in edges:
                        edges[h] = (host, h, place, whole, digest(page.blocks[a - 1]) if a and place == ALONE else 0, digest(page.blocks[b]) if b < n and place == ALONE else 0)
                rows += edges.values()
                rows.append((host, 0, -1, whole, 0, 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [k for k, _ in kinds])

    return pages.select("url", "html").mapInArrow(run, "host string, hash long, place int, page long, before long, behind long")


def templates(pages: DataFrame) -> DataFrame:
    """host, hash of the subtrees that recur on many pages of their host."""
    # Neighbours are joined into extremes before pages are counted, so that both steps combine before their shuffles.
    each = subtrees(pages).groupBy("host", "hash", "place", "page").agg(F.min("before").alias("b0"), F.max("before").alias("b1"), F.min("behind").alias("n0"), F.max("behind").alias("n1"))
    same = (F.min("b0") == F.max("b1")) | (F.min("n0") == F.max("n1"))
    counts = table(each.groupBy("host", "hash", "place").agg(F.count("*").alias("pages"), same.alias("fixed")).filter(F.col("pages") >= MIN_PAGES), "subtrees")
    total = counts.filter("place = -1").select("host", F.col("pages").alias("total"))
    share = F.col("pages") / F.col("total")
    many = (share >= SHARE) | ((F.col("place") == ALONE) & F.col("fixed") & (share >= SECTION) & (F.col("pages") >= SECTION_PAGES))
    return counts.filter("place >= 0").join(total, "host").filter(many).select("host", "hash")


def extract(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html). found: templates(), as a table."""
    lists = found.groupBy("host").agg(F.collect_list("hash").alias("hashes"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    named = pages.select("page_id", "url", "html", host.alias("host"))
    if found.count() <= MAX_BROADCAST:
        joined = named.join(F.broadcast(lists), "host", "left")
    else:
        salted = named.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        joined = salted.join(lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long")), ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(html).text(frozenset(gone or ())) if html else "" for html, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "hashes").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, table(templates(pages), "templates"))
