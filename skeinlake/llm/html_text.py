"""Main text of web pages by site style trees."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import broadcast_if_small, materialize, tidy
from .url_filter import url_host

#: Elements whose content is no article text.
DROPPED = frozenset("nav header footer aside form script style noscript template svg math iframe object canvas button select textarea dialog menu audio video head title".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol option p pre section summary table tbody td tfoot th thead tr ul".split()) | DROPPED
#: What closes itself where the same begins.
REPEATED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Classes, ids and roles, as whole words, that mark menus, notices, adverts, sidebars and reader comments. `has-sidebar` or `comments-open` say what else a page has.
NOISE = re.compile(
    r"(?:(?:site|page|global|main|top|bottom|left|right|header|footer|reader|user|post|entry|article|cookie|social|in|primary|secondary|mobile|js|widget)[_-])*"
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|complementary|consent|contentinfo|cookies?|copyright|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|overlay|pagination|pager|popup|promo\w*|related|respond|search|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)"
    r"(?:[_-]?(?:area|bar|block|body|bottom|box|col|column|container|content|form|holder|icons?|inner|item|left|links?|list|main|media|outer|panel|posts?|primary|right|row|section|slot|text|thread|title|top|unit|widget|wrap|wrapper|[0-9]+))*",
    re.I,
)
MAIN = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story)(?:[_-](?:body|content|text))?(?=$|\s)", re.I)
#: Elements of an author's text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th dt dd figcaption caption".split())
#: A quote that never ends, or ends only in another tag, is part of the tag's text up to its >.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_DIGITS = re.compile(r"\d+")

#: A style node of a site is noise below this importance,
LOW = 0.2
#: if at least so many different pages of the site have it.
LEAST_PAGES = 3


class Block:
    """A run of text between block borders: its style path, its text, whether it is noise by its elements, whether it is in a main element, and whether that is the author's own prose."""

    __slots__ = ("main", "noise", "path", "prose", "text")

    def __init__(self, path: str, text: str, noise: bool, main: bool, prose: bool):
        self.path, self.text, self.noise, self.main, self.prose = path, text, noise, main, prose


class _Open:
    """An open element: its name and style, whether its kind or its marks say noise, and whether it begins a main element."""

    __slots__ = ("kind", "main", "marked", "name", "style")

    def __init__(self, name: str, style: str, kind: bool, marked: bool, main: bool):
        self.name, self.style, self.kind, self.marked, self.main = name, style, kind, marked, main


def _marked(said: dict[str, str]) -> bool:
    return any(NOISE.fullmatch(word) for a in ("class", "id", "role") for word in said.get(a, "").split())


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, references decoded, white space made one blank.

    Tolerant of missing end tags: a block closes an open paragraph, list items and cells close their like, an end tag closes what stands
    open inside, and one without a beginning is passed over. Tolerant of quotes that never end. Marks that say noise don't count on what
    holds the first article or main element, and the header of an article is its own, with the title.
    """
    out: list[Block] = []
    stack: list[_Open] = []
    held: list[str] = []
    article_seen = False

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                # inline elements are no part of the style
                own = [x for x in stack if x.name in BLOCKS]
                inside = next((i for i, x in enumerate(own) if x.main), None)
                bare = inside is not None and all(x.style == x.name for x in own[inside + 1 :])
                prose = inside is not None and (bare or (own[-1].name in PROSE and own[-1].style == own[-1].name))
                out.append(Block(">".join(x.style for x in own), text, any(x.kind or x.marked for x in stack), any(x.main for x in stack), prose))

    def close_to(i: int) -> None:
        if any(x.name in BLOCKS for x in stack[i:]):
            flush()
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    close_to(i)
                    break
                if stack[i].name in DROPPED | {"article"} and name not in BLOCKS:
                    break
            continue
        if name == "br" or name == "hr":
            if name == "hr":
                flush()
            held.append(" ")
            continue
        if name in VOID:
            continue
        if name in BLOCKS:
            if name in REPEATED:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name in REPEATED[name]:
                        close_to(i)
                        break
                    if stack[i].name in ("ul", "ol", "dl", "table", "select"):
                        break
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == "p":
                    close_to(i)
                    break
                if stack[i].name in BLOCKS:
                    break
            flush()
        said = {a.lower(): (v or "").strip("\"'") for a, v in _ATTRIBUTE.findall(rest)} if rest.strip() else {}
        marked = name not in ("html", "body") and _marked(said)
        marks = " ".join(said.get(a, "") for a in ("class", "id", "role"))
        own_header = name == "header" and any(x.name == "article" for x in stack)
        article = name in ("article", "main") or said.get("role") == "main"
        main = article or bool(marks.strip() and name in ("div", "section", "td") and MAIN.search(marks))
        if article and not marked and not article_seen:
            article_seen = True
            for x in stack:
                x.marked = False
        style = name + ("." + _DIGITS.sub("0", said["class"]).replace(" ", ".") if said.get("class") else "") + ("#" + _DIGITS.sub("0", said["id"]) if said.get("id") else "")
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if not rest.endswith("/") or name not in ("path", "g", "use"):
            stack.append(_Open(name, style, (name in DROPPED and not own_header) or "hidden" in said, marked and not own_header, main))
    flush()
    return out


def _pages(batch: pa.RecordBatch, i: int) -> Iterator[str]:
    for x in batch.column(i):
        yield x.as_py() or ""


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of the style nodes of each site.

    The pages of a host are merged: equal style paths are one node. Its features are the texts of its blocks. Over the m different pages
    of a node (equal copies count once) a feature that k pages have has the entropy log k / log m, and importance is 1 less the mean entropy
    of the features, by their occurrences: 1 where every page says something else, 0 where all say the same. Counts are grouped by host,
    path and feature, then by host and path, both with partial sums before the shuffle, so that no site is gathered in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path, feature, copy = [], [], [], []
            for h, page in zip(batch.column(0).to_pylist(), _pages(batch, 1), strict=True):
                name = xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass")) - (1 << 63)
                for p, f in {(b.path, xxhash.xxh3_64_intdigest(b.text) - (1 << 63)) for b in blocks(page)}:
                    host.append(h)
                    path.append(p)
                    feature.append(f)
                    copy.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(feature, pa.int64()), pa.array(copy, pa.int64())], names=["host", "path", "feature", "copy"])

    found = pages.select(url_host(F.col("url")).alias("host"), "html").mapInArrow(tidy(run), "host string, path string, feature long, copy long").distinct()
    counts = found.groupBy("host", "path", "feature").agg(F.count("*").alias("k"))
    # a page in which a node has several texts counts for each of them in n, but for m no text can stand on more pages than there are
    sums = counts.groupBy("host", "path").agg(F.sum(F.col("k") * F.log("k")).alias("e"), F.sum("k").alias("n"), F.max("k").alias("most"))
    sites = pages.groupBy(url_host(F.col("url")).alias("h")).agg(F.approx_count_distinct(F.xxhash64("html"), 0.02).alias("m"))
    both = sums.join(sites, F.col("host").eqNullSafe(F.col("h")))
    m = F.greatest(F.least("m", "n"), "most")
    return both.select("host", "path", m.alias("pages"), F.when(m > 1, 1 - F.col("e") / F.col("n") / F.log(m)).otherwise(1.0).alias("importance"))


def page_text(page: str, low: frozenset[str] | set[str] = frozenset()) -> str:
    """The article of a page: the blocks of its main elements, or of the whole page if none has text, without noise and without low branches.

    low are the style paths that the site's tree calls unimportant. In a main element the author's prose stays all the same (a paragraph
    without marks of its own, or blocks with none around them): pages that share paragraphs, as edited copies do, are no template.
    """
    own = [b for b in blocks(page) if not b.noise]
    main = [b for b in own if b.main]
    return "\n".join(b.text for b in (main or own) if b.prose or b.path not in low)


def extract(pages: DataFrame, low: float = LOW, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html).

    First the sites' style trees (see style_tree()), then the text of each page, without elements that never hold an article (menus,
    headers, footers, asides, forms, scripts, styles), without those whose class, id or role says so, and without branches below
    low importance in a tree of least_pages different pages or more, in main elements as outside (but see page_text()).

    Null or empty html: text is empty. Null url: a site of its own, with all other null urls. Cut-off or unclosed markup is
    read to its end. Repeated rows are extracted each. Empty table: no rows. Other columns are ignored.
    """
    ship(pages.sparkSession)
    slim = pages.select("page_id", "url", "html")
    tree = style_tree(slim).where((F.col("importance") < low) & (F.col("pages") >= least_pages))
    noise = materialize(tree.groupBy("host").agg(F.collect_set("path").alias("low")).withColumnRenamed("host", "h"), "styles")
    joined = slim.join(broadcast_if_small(noise, limit=20_000), url_host(F.col("url")) == F.col("h"), "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[tuple, frozenset] = {}
            text = []
            for page, l in zip(_pages(batch, 2), batch.column(3), strict=True):
                key = tuple(l.as_py() or ())
                text.append(page_text(page, sets.setdefault(key, frozenset(key))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
