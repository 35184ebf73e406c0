"""Main text of pages by deduced templates.

Tokens of a page are its structural tags, told apart by their path of containers, and its blocks of text. The occurrence
vector of a token over the pages of its host is folded into an order-free sum of hashes, so that vectors of any length
meet in partial sums; tokens of one host with the same vector form an equivalence class. Pages of a host with the same
main text are one page there. A class is laid over the pages, from the class on most pages down. It is valid if

* it has two tokens or more, one of them text, and is found on two pages or more, be they all pages of the host or not;
  on half of the host's pages or fewer it must hold a tag too, as sentences that two pages share are no template;
* it is ordered: each page repeats its tokens in whole rounds, in one order that is the same on all pages;
* it is nested: each round lies in one slot between the tokens of the classes laid before;
* its text is not that of near copies: where its pages hold less text of their own than they hold of the class, its
  text stays. This is asked of text inside articles, and of text elsewhere if the class is not on most pages of the host.

Valid classes form the host's template. A page is then read against the template: template text is left out, inside
articles too, and what stands in the remaining slots is kept if the slot lies in the article (or, on a page without text in
an article, in no container of menus, headers, footers, sidebars, notices, adverts, forms or comments).

No host is gathered anywhere: tokens meet their classes by host and token, and come together again page by page.

Defined results: null html is an empty page with empty text; a page of no host (null or odd URL) shares its template
with all pages of no host; unclosed and misplaced tags end with the container around them; equal rows get equal texts; a
page of any length is one row, read in time linear in its length; null ids pass through; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, store

_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: A tag with neither < nor > in its quotes, which most tags are.
_PLAIN = re.compile(r"""(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
#: What ends, breaks off or quotes a part of a tag.
_MARK = re.compile(r"[\"'<>]")
#: Elements whose content is no text.
RAW = frozenset("script style noscript template textarea svg iframe select button".split())
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WHITE = re.compile(r"[ \t\n\x0b\f\r]+")
CONTAINERS = frozenset("html head body div section article main nav header footer aside form ul ol dl table tbody thead tfoot tr td th figure fieldset dialog menu title".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd br hr pre blockquote address figcaption caption details summary option legend label input".split())
#: Containers whose text is not main text, by tag or by a part of a class, id or role.
OUTSIDE_TAGS = frozenset("head nav footer aside form dialog menu title".split())
OUTSIDE_NAMES = frozenset(
    "nav navbar navigation menu sidebar aside ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notices alert popup modal overlay "
    "footer breadcrumb breadcrumbs share sharing social related recommended newsletter subscribe signup login search comment comments disqus respond replies pagination pager toolbar widget masthead".split()
)
ARTICLE_NAMES = frozenset(("article", "main", "articlebody"))


def _label(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Name of a container in paths, whether its text is outside the main text, whether it is an article."""
    parts: set[str] = set()
    label, article = tag, tag in ("article", "main")
    for groups in _NAMES.findall(attributes):
        value = "".join(groups).lower()
        label += "." + re.sub(r"\d+", "#", value)
        parts.update(re.split(r"[\s_-]+", value))
        article = article or value in ARTICLE_NAMES
    outside = tag in OUTSIDE_TAGS or (tag not in ("html", "body") and bool(parts & OUTSIDE_NAMES))
    return label, outside, article and not outside


def _markup(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, slash, tag, attributes) of every tag of ``BLOCKS``, and the text after the last one with an empty tag.

    It only ever goes forward: a tag ends at the first > outside quotes, and is dropped up to a < outside quotes that comes before it; a quote that nothing
    closes is a character like others. Comments and the content of ``RAW`` elements are left out.
    """
    at, size = 0, len(page)
    last = {c: page.rfind(c) for c in "\"'>"}
    held: list[str] = []
    while (begin := page.find("<", at)) >= 0:
        if begin > at:
            held.append(page[at:begin])
        at = begin + 1
        if m := _PLAIN.match(page, at):
            slash, tag, attributes = m.groups()
            at = m.end()
        else:
            if page.startswith("!--", at):
                end = page.find("-->", at + 3)
                at = size if end < 0 else end + 3
                continue
            if page.startswith(("!", "?"), at):
                if at > last[">"]:
                    held.append("<")
                else:
                    at = page.find(">", at) + 1
                continue
            m = _TAG.match(page, at)
            if m is None or m.end() > last[">"]:
                held.append("<")
                continue
            place = m.end()
            while (mark := _MARK.search(page, place)) is not None:
                place = mark.end()
                if (c := mark.group()) in "<>":
                    break
                if place <= last[c]:
                    place = page.index(c, place) + 1
            if mark is None or mark.group() == "<":
                at = size if mark is None else mark.start()
                continue
            slash, tag, attributes, at = m.group(1), m.group(2), page[m.end() : place - 1], place
        tag = tag.lower()
        if tag in RAW and not slash:
            end = _END[tag].search(page, at)
            at = size if end is None else end.end()
        elif tag in BLOCKS:
            yield "".join(held), slash, tag, attributes
            held = []
    held.append(page[at:])
    yield "".join(held), "", "", ""


def scan(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(path, text, outside, article) of every opened container (text "") and every block of text; a path is a hash of the containers' labels. Linear in the page, whatever is left open or closed twice."""
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]
    opened: Counter[str] = Counter()
    for before, slash, tag, attributes in _markup(page):
        if before and (text := _WHITE.sub(" ", entities.unescape(before)).strip(" ")):
            yield stack[-1][1], text, stack[-1][2], stack[-1][3]
        if tag not in CONTAINERS:
            continue
        if slash:
            while opened[tag]:
                name = stack.pop()[0]
                opened[name] -= 1
                if name == tag:
                    break
        elif not attributes.endswith("/"):
            label, outside, article = _label(tag, attributes)
            _, path, out, art = stack[-1]
            if tag == "header" and not art:
                outside = True
            if article and out:
                article = False
            stack.append((tag, hashlib.blake2b(f"{path}/{label}".encode("utf-8", "surrogatepass"), digest_size=8).hexdigest(), out or outside, art or article))
            opened[tag] += 1
            yield stack[-1][1], "", stack[-1][2], stack[-1][3]


def _id(path: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\t{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: What a token is: a tag, or text in an article, in no container of menus and the like, or in one.
TAG, ARTICLE, OPEN, OUTSIDE = range(4)
_OCCURRENCES = "host string, page long, pk long, at int, token long, kind int, chars long, times int"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every token of a page: host, page (a hash of its main text), pk (of the whole page), place, token, kind, characters, times on the page."""
    names = [c.split()[0] for c in _OCCURRENCES.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    kinds = [types[c.split()[1]] for c in _OCCURRENCES.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for h, pk, html in zip(batch["host"].to_pylist(), batch["pk"].to_pylist(), batch["html"].to_pylist(), strict=True):
            # The root, on every page, counts the pages of the host.
            found = [(_id("", ""), TAG, 0)]
            body = []
            for path, text, outside, article in scan(html):
                found.append((_id(path, text), TAG if not text else OUTSIDE if outside else ARTICLE if article else OPEN, len(text)))
                if text and not outside:
                    body.append(text)
            times: dict[int, int] = {}
            for token, _, _ in found:
                times[token] = times.get(token, 0) + 1
            own = _id("", "\n".join(body))
            rows += [(h, own, pk, at, token, kind, chars, times[token]) for at, (token, kind, chars) in enumerate(found)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=names)


def _order(places: list[tuple[int, int]], tokens: int) -> tuple[int, ...] | None:
    """The order of a class's tokens on a page, if the page repeats it in whole rounds; ``places`` are (place, token), sorted."""
    order = tuple(t for _, t in places)
    first = order[:tokens]
    return first if len(set(first)) == tokens and order == first * (len(order) // tokens) else None


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every page and class on it: host, class, hash of the order, whether ordered and nested, characters of the class and of no class, in articles and elsewhere."""
    names = ["host", "class", "order", "fits", "class_in", "class_out", "own_in", "own_out"]
    for batch in batches:
        rows: list[tuple] = []
        for h, tokens in zip(batch["host"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
            places: dict[tuple[int, int], list[tuple[int, int]]] = {}
            size: dict[tuple[int, int], int] = {}
            chars: dict[tuple[int, int], list[int]] = {}
            own = [0, 0]
            for t in sorted(tokens, key=lambda t: t["at"]):
                # Classes are told apart, and put in order, by falling number of pages and then by name.
                c = (-t["pages"], t["class"]) if t["class"] is not None else None
                if c is not None:
                    places.setdefault(c, []).append((t["at"], t["token"]))
                    size[c] = t["size"]
                if t["kind"] in (ARTICLE, OPEN):
                    (own if c is None else chars.setdefault(c, [0, 0]))[t["kind"] - ARTICLE] += t["chars"]
            laid: list[int] = []
            for c in sorted(places):
                order = _order(places[c], size[c])
                fits = order is not None
                if fits:
                    for r in range(0, len(places[c]), size[c]):
                        fits = fits and bisect.bisect(laid, places[c][r][0]) == bisect.bisect(laid, places[c][r + size[c] - 1][0])
                if fits:
                    for at, _ in places[c]:
                        bisect.insort(laid, at)
                rows.append((h, c[1], _id("", repr(order)), fits, *chars.get(c, (0, 0)), *own))
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _inputs(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html")).withColumn("pk", F.xxhash64("html"))


#: Rows of tokens or page keys (some 60 bytes each) that may be broadcast; beyond it the same join shuffles.
BROADCAST_TOKENS = 300_000


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_TOKENS else df.hint("merge")


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tokens of pages, and the hosts' templates: host, token, and whether a valid class leaves it out of articles (inside) and of other pages (elsewhere)."""
    kernel.small_batches(pages.sparkSession, 256)
    found = store.written(_inputs(pages).select("host", "pk", "html").mapInArrow(_occurrences, _OCCURRENCES), "occurrences")
    on_page = found.groupBy("host", "token", "page").agg(F.max("times").alias("times"), F.max((F.col("kind") != TAG).cast("int")).alias("text"))
    vector = F.xxhash64("page", "times")
    token = on_page.groupBy("host", "token").agg(
        F.count("*").alias("pages"),
        F.sum("times").alias("times"),
        F.sum(F.shiftright(vector, 24)).alias("v1"),
        F.sum(vector.bitwiseAND(F.lit((1 << 24) - 1))).alias("v2"),
        F.max("text").alias("text"),
    )
    token = store.written(token.where("pages > 1").withColumn("class", F.xxhash64("pages", "times", "v1", "v2")), "tokens")
    root = F.col("token") == _id("", "")
    host_pages = token.where(root).select("host", F.col("pages").alias("host_pages"))
    classes = token.where(~root).groupBy("host", "class").agg(F.first("pages").alias("pages"), F.count("*").cast("int").alias("size"), F.max("text").alias("texts"), F.min("text").alias("no_tag"))
    classes = store.written(classes.where("texts = 1 and size > 1"), "classes")
    member = store.written(token.where(~root).select("host", "token", "class").join(classes.select("host", "class", "pages", "size"), ["host", "class"]), "members")
    # A page's tokens meet their classes, and the page is then one row: equal pages fall into one by the set.
    placed = found.where(F.col("token") != _id("", "")).join(_side(member), ["host", "token"], "left")
    laid = placed.groupBy("host", "pk").agg(F.collect_set(F.struct("at", "token", "kind", "chars", "class", "pages", "size")).alias("tokens"), F.max(F.col("class").isNotNull()).alias("any")).where("any")
    judged = laid.select("host", "tokens").mapInArrow(_laid, "host string, class long, order long, fits boolean, class_in long, class_out long, own_in long, own_out long")
    judged = judged.groupBy("host", "class").agg(
        F.min("order").alias("o1"), F.max("order").alias("o2"), F.min("fits").alias("fits"), F.expr("sum(own_in) >= sum(class_in)").alias("own_in"), F.expr("sum(own_out) >= sum(class_out)").alias("own_out")
    ).where("fits and o1 = o2")
    valid = classes.join(judged, ["host", "class"]).join(host_pages, "host")
    common = F.col("pages") * 2 > F.col("host_pages")
    valid = valid.where(common | (F.col("no_tag") == 0)).select("host", "class", F.col("own_in").alias("inside"), (F.col("own_out") | common).alias("elsewhere"))
    return found, store.written(member.join(valid, ["host", "class"]).where("inside or elsewhere").select("host", "token", "inside", "elsewhere"), "templates")


def _main(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, inside, elsewhere in zip(batch["html"].to_pylist(), batch["inside"].to_pylist(), batch["elsewhere"].to_pylist(), strict=True):
            blocks = [(path, text, article) for path, text, outside, article in scan(html) if text and not outside]
            has_article = any(article for _, _, article in blocks)
            fixed = frozenset((inside if has_article else elsewhere) or ())
            texts.append(" ".join(text for path, text, article in blocks if article == has_article and not (fixed and _id(path, text) in fixed)))
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    kernel.small_batches(pages.sparkSession, 256)
    found, template = templates(pages)
    fixed = found.where(F.col("kind").isin(ARTICLE, OPEN)).select("host", "pk", "token").join(_side(template), ["host", "token"])
    fixed = fixed.groupBy(F.col("host").alias("h"), F.col("pk").alias("p")).agg(F.collect_set(F.when(F.col("inside"), F.col("token"))).alias("inside"), F.collect_set(F.when(F.col("elsewhere"), F.col("token"))).alias("elsewhere"))
    fixed = _side(store.written(fixed, "fixed"))
    joined = _inputs(pages).join(fixed, F.expr("host = h and pk = p"), "left").select("page_id", "url", "html", "inside", "elsewhere")
    return joined.mapInArrow(_main, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
