"""Main text of web pages by site template removal.

Each page is read into elements, and every element subtree that may be template
is hashed. Spark counts, per host, the distinct contents of the pages that hold
a subtree; those that recur under many contents of the host are deleted. Copies
of a page have one content, so their body is not template. What the markup itself names as
menus, headers, footers, sidebars, notices, adverts, forms or comments goes too,
so that hosts with few pages are served. An article's own plain paragraphs and
headings are never template, however often the article is copied.

Defined results: null or empty html gives an empty text; a null URL, or one
without a host, belongs to the empty host; pages that repeat are extracted
alike and count as one; an empty table gives an empty result.
"""

from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import html_tree
from parlance.llm.common import by_slices, stored
from parlance.llm.html_tree import Element
from parlance.llm.urls import host_of


@dataclass(frozen=True)
class Template:
    """A subtree is template on a host if it is on pages of `min_pages` distinct contents
    and on `min_permille` of the host's distinct contents."""

    min_pages: int = 3
    min_permille: int = 5


NEVER_TEXT = frozenset((
    "head script style noscript template iframe object svg canvas math select button textarea input nav footer"
    " aside form dialog menu map audio video title"
).split())
ROLES = frozenset((
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar",
))
NAMES = frozenset((
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav menu"
    " nav navbar navigation breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices alert"
    " popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended"
    " comment comments respond disqus pagination pager widget skip"
).split())
ROOTS = ("article", "main")
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tr td th figure figcaption".split())


def _is_named_boilerplate(element: Element, in_article: bool) -> bool:
    if element.tag in NEVER_TEXT:
        return True
    if element.tag == "header":
        return not in_article
    if not element.attributes or element.tag in ("html", "body", "main"):
        return False
    values = element.values()
    if "hidden" in values or values.get("aria-hidden") == "true" or values.get("role") in ROLES:
        return True
    names = html_tree.names_of(values)
    return bool(names & NAMES) or ("header" in names and not in_article)


def _marked(html: str) -> tuple[list[Element], set[int], set[int], dict[int, int]]:
    """Elements; ids of those that the markup names as boilerplate (topmost only); ids of
    all that may be template; and the digest of each of these."""
    elements = html_tree.read(html)
    html_tree.add_digests(elements)
    named: set[int] = set()
    below: set[int] = set()
    articles: set[int] = set()
    digests: dict[int, int] = {}
    for element in elements[1:]:
        me, parent = id(element), id(element.parent)
        if parent in named or parent in below:
            below.add(me)
            continue
        in_article = parent in articles
        if in_article or element.tag in ROOTS:
            articles.add(me)
        if _is_named_boilerplate(element, in_article):
            named.add(me)
        own = in_article and element.tag in PROSE and not element.attributes
        if element.has_text and not own and element.tag not in html_tree.INLINE and element.tag not in (
            "html", "body", "head", "script", "style", "title", *ROOTS,
        ):
            digests[me] = int.from_bytes(element.digest, "big", signed=True)
    return elements, named, below, digests


def template_digests(html: str | None) -> list[int]:
    """Distinct digests of a page's subtrees that may be template."""
    return _counted(html)[0]


def _counted(html: str | None) -> tuple[list[int], int]:
    """Distinct digests of a page's subtrees that may be template, and the digest of its
    content: its text without what the markup names as boilerplate, which may differ
    between copies of a page."""
    if not html:
        return [], 0
    elements, named, _, digests = _marked(html)
    dropped = {id(e) for e in elements[1:] if id(e) in named and e.tag not in ROOTS}
    text = html_tree.blocks(elements[:1], dropped) or html_tree.blocks(elements[:1], set())
    content = blake2b("\n".join(text).encode("utf-8", "replace"), digest_size=8).digest()
    return sorted(set(digests.values())), int.from_bytes(content, "big", signed=True)


def main_text(html: str | None, recurring: frozenset[int] = frozenset()) -> str:
    """The blocks of a page's article, joined by line feeds, without the recurring subtrees."""
    if not html:
        return ""
    elements, named, below, digests = _marked(html)
    dropped = named | {me for me, digest in digests.items() if digest in recurring}
    inside: set[int] = set()
    for element in elements[1:]:
        if id(element.parent) in dropped or id(element.parent) in inside:
            inside.add(id(element))
    gone = dropped | inside
    for root in ROOTS:
        found: list[Element] = []
        within: set[int] = set()
        for element in elements[1:]:
            if id(element.parent) in within:
                within.add(id(element))
            elif element.tag == root and id(element) not in gone:
                found.append(element)
                within.add(id(element))
        text = html_tree.blocks(found, dropped)
        if text:
            return "\n".join(text)
    return "\n".join(html_tree.blocks(elements[:1], dropped))


def site_templates(pages: DataFrame, html: str = "html", url: str = "url", how: Template = Template()) -> DataFrame:
    """(host, recurring): the digests of each host's template subtrees.

    A host has no more of them than its mean number of subtrees a page times
    1000 / min_permille, so the array is bounded however large the host is.
    """
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_counted(h) for h in batch["html"].to_pylist()]
        digests, contents = pa.array([d for d, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.int64())
        return pa.RecordBatch.from_arrays([batch["host"], digests, contents], ["host", "digests", "content"])

    # Each page also counts itself, as a null digest.
    each = by_slices(rows, "html", "host string, digests array<long>, content long", work).select(
        "host", F.explode(F.concat("digests", F.array(F.lit(None).cast("long")))).alias("digest"), "content"
    )
    counts = stored(
        each.groupBy("host", "digest").agg(F.count_distinct("content").alias("n"))
        .where((F.col("n") >= how.min_pages) | F.col("digest").isNull())
    )
    sizes = counts.where("digest IS NULL").select("host", F.col("n").alias("pages"))
    return (
        counts.where("digest IS NOT NULL").join(sizes, "host")
        .where(1000 * F.col("n") >= how.min_permille * F.col("pages"))
        .groupBy("host").agg(F.collect_list("digest").alias("recurring"))
    )


def extract(
    pages: DataFrame, html: str = "html", url: str = "url", id: str = "page_id", how: Template = Template()
) -> DataFrame:
    """Per page: id, url, text and n_chars.

    The templates are stored first; their size decides whether they are broadcast.
    A hot host is left to the skew join.
    """
    templates = stored(site_templates(pages, html, url, how))
    rows = pages.select(
        F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host")
    ).join(templates, "host", "left").select("id", "url", "html", "host", "recurring")
    kind = pages.schema[id].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[str, frozenset[int]] = {}
        texts = []
        for at, (host, page) in enumerate(zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True)):
            if host not in known:
                known[host] = frozenset(batch["recurring"][at].as_py() or ())
            texts.append(main_text(page, known[host]))
        return pa.RecordBatch.from_arrays(
            [batch["id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["id", "url", "text", "n_chars"],
        )

    return by_slices(rows, "html", f"id {kind}, url string, text string, n_chars long", work).withColumnRenamed("id", id)
