"""Main text of web pages by a maximum-scoring contiguous token region.

A page is a sequence of words and tags. Each has a weight: words count for the
content, tags against it, by how often their class stands inside and outside
the content of labelled pages. The words of ``class`` and ``id`` attributes are
weighed in the same way. One linear scan finds the contiguous region with the
greatest sum; inside it, blocks are left out whose element, or whose learnt
weight, speaks against them.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import table

#: Labelled pages that the weights are counted on, chosen by a hash of the page.
MAX_LABELLED = 400
#: Attributes of a tag up to its end; quotes count only behind an equals sign. Nothing is ever given back, so scans are linear.
_REST = r"(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^<>=]++|=)*+"
_END = r"(?:>|(?=<)|\Z)"  # a tag that is not closed ends at the next one
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|template|noscript|textarea|iframe|svg|title)(?=[\s/><]|\Z){_REST}{_END}.*?(?:</(?P=raw)\s*+>|\Z)"
    rf"|<(?P<close>/?+)(?P<tag>[a-z][^\s/><]*+)(?P<rest>{_REST}){_END}"
    r"|<[!?][^>]*+(?:>|\Z)|</[^>]*+(?:>|\Z)",
    re.I | re.S,
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = BLOCKS - frozenset("p hr dd dt li td th tr tbody thead tfoot caption".split()) | frozenset(("button", "select"))
BOILERPLATE = frozenset("nav header footer aside form menu button select fieldset dialog head".split())
#: Class words that labelled pages say nothing about count against small blocks only; see :func:`tokens`.
DOUBTFUL = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead"
    " menu modal nav navbar navigation newsletter notice notices popup promo promotion related share sharing sidebar signup skip social sponsor sponsored"
    " subscribe toolbar widget".split()
)
ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
NO_DISPLAY = re.compile(r"display\s*+:\s*+none", re.I)
#: Class words kept of the labelled pages, and pages that must have one; words in a doubtful block from which it stays.
MAX_CLASSES, EVIDENCE, LARGE = 1000, 3, 50
INTRO = ("article", "main")
#: Elements with a class of their own; names that a page makes up share the class ``x``, so classes are few.
KNOWN = BLOCKS | CONTAINERS | BOILERPLATE | frozenset(
    "a abbr audio b bdi bdo br canvas cite code col colgroup data del dfn em embed font i img input ins kbd label link map mark meta meter object option"
    " output picture progress q rp rt ruby s samp small source span strike strong sub sup time title track tt u var video wbr".split()
)


def _attributes(rest: str) -> dict[str, str]:
    return {name.lower(): "".join(values) for name, *values in ATTRIBUTE.findall(rest)}


def class_words(attributes: dict[str, str]) -> set[str]:
    """Lower-case words of ``class`` and ``id``."""
    return set(re.split(r"[^a-z]+", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())) - {""}


@lru_cache(maxsize=4096)
def _said(rest: str) -> tuple[bool, tuple[str, ...]]:
    """Whether a tag's attributes hide it, and its class words in order."""
    if "=" not in rest and "hidden" not in rest.lower():
        return False, ()
    attributes = _attributes(rest)
    return _hidden(attributes), tuple(sorted(class_words(attributes)))


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("role", "").lower() in ROLES or attributes.get("aria-hidden", "").lower() == "true" or bool(NO_DISPLAY.search(attributes.get("style", "")))


def tokens(page: str, weights: dict[str, float] | None = None) -> list[tuple[str, str, bool, int]]:
    """(class, text, boilerplate, content element) of each tag and text run.

    Classes: ``/p`` or ``p`` for tags, ``w`` for words and ``w.a`` for words of
    a link, ``w.x`` for words under a boilerplate element. The content element
    is the number of the innermost ``article`` or ``main``, 0 outside.

    An element is boilerplate by its name or role, or if the ``weights`` of its
    class words (``c.<word>``) sum to less than 0. Class words without a weight
    that are in ``DOUBTFUL`` make it boilerplate unless it has ``LARGE`` words,
    or half of those that the page has otherwise: such a block is the text.
    """
    return [x[:4] for x in _tokens(page, weights or {})]


def _tokens(page: str, weights: dict[str, float]) -> list[tuple[str, str, bool, int, tuple[str, ...]]]:
    """:func:`tokens`, with the class words around each."""
    out, blocks = [], []
    stack: list[tuple] = []  # name, boilerplate, content element, number of the doubtful block, class words
    at = link = seen = doubtful = 0
    top = ("", False, 0, 0, ())

    def text_run(text):
        _, bad, inside, doubt, words = top
        out.append(("w.x" if bad else "w.a" if link else "w", text, bad, inside, words))
        blocks.append(doubt)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            text_run(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        name = tag if tag in KNOWN else "x"
        if m["close"]:
            out.append(("/" + name, "", top[1], top[2], top[4]))
            blocks.append(top[3])
            if tag in CONTAINERS and any(x[0] == tag for x in stack):
                while stack.pop()[0] != tag:
                    pass
                top = stack[-1] if stack else ("", False, 0, 0, ())
            link = 0 if tag == "a" else link
            continue
        link = 1 if tag == "a" else link
        _, bad, inside, doubt, words = top
        if tag in INTRO:
            seen += 1
            inside = seen
        bad = bad or tag in BOILERPLATE
        if len(m["rest"]) > 1 and tag not in ("body", "html", *INTRO):
            hidden, own = _said(m["rest"])
            bad = bad or hidden
            if own:
                words = (*words, *(w for w in own if w not in words))
                known = [weights[f"c.{w}"] for w in own if f"c.{w}" in weights]
                bad = bad or sum(known) < 0
                if not known and not doubt and not DOUBTFUL.isdisjoint(own):
                    doubtful += 1
                    doubt = doubtful
        if tag in CONTAINERS and not m["rest"].endswith("/"):
            top = (tag, bad, inside, doubt, words)
            stack.append(top)
        out.append((name, "", bad, inside, words))
        blocks.append(doubt)
    if at < len(page):
        text_run(page[at:])
    if doubtful:
        size = Counter()
        for x, block in zip(out, blocks, strict=True):
            if x[0][0] == "w" and not x[2]:
                size[block] += _amount(x[0], x[1])
        total = sum(size.values())
        small = {block for block in range(1, doubtful + 1) if size[block] < LARGE and 2 * size[block] < total}
        out = [x if block not in small else ("w.x" if x[0] in ("w", "w.a") else x[0], x[1], True, *x[3:]) for x, block in zip(out, blocks, strict=True)]
    return out


def _amount(kind: str, text: str) -> int:
    return len(text.split()) if kind[0] == "w" and kind[:2] in ("w", "w.") else 1


def count_classes(page: str | None) -> list[tuple[str, int, int]]:
    """(class, tokens inside, tokens outside) of a page whose ``article`` or ``main`` labels its content; none without it.

    Class words (``c.<word>``) count once where words stand under them inside,
    and once where outside.
    """
    inside, outside, held = Counter(), Counter(), {True: set(), False: set()}
    for kind, text, bad, element, words in _tokens(page or "", {}):
        (inside if element and not bad else outside)[kind] += _amount(kind, text)
        if kind[0] == "w" and text.strip():
            held[bool(element)].update(words)
    if not inside:
        return []
    return [(k, inside[k], outside[k]) for k in inside | outside] + [(f"c.{w}", int(w in held[True]), int(w in held[False])) for w in sorted(held[True] | held[False])]


def learn_weights(pages: DataFrame, html_col: str = "html", max_labelled: int = MAX_LABELLED) -> dict[str, float]:
    """Weights of token classes: log odds of standing inside the content.

    Words never weigh less than 0.05 unless they stand in a link or under a
    boilerplate element, tags never more than -0.02. Counted on at most
    ``max_labelled`` pages with an ``article`` or ``main`` element; of the class
    words the ``MAX_CLASSES`` most frequent that ``EVIDENCE`` pages have.
    """

    def rows(batches):
        for batch in batches:
            found = [x for page in batch.column(0).to_pylist() for x in count_classes(page)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], type=t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["kind", "inside", "outside"])

    labelled = pages.select(F.col(html_col).alias("html")).filter(F.rlike(F.col("html"), F.lit("(?i)<(article|main)"))).withColumn("h", F.xxhash64("html"))
    # Hashes alone are compared, so that no task gathers pages; copies of a page count once.
    last = labelled.select("h").distinct().orderBy("h").limit(max_labelled).agg(F.max("h")).first()[0]
    chosen = labelled.filter(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.min("html").alias("html")).select("html")
    counted = chosen.mapInArrow(rows, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    found = [tuple(r) for r in counted.collect()]  # classes of max_labelled pages
    words = sorted((x for x in found if x[0].startswith("c.") and x[1] + x[2] >= EVIDENCE), key=lambda x: (-x[1] - x[2], x[0]))
    found = [x for x in found if not x[0].startswith("c.")] + words[:MAX_CLASSES]
    return weights_from(sorted(found))


def weights_from(counts: list[tuple[str, int, int]]) -> dict[str, float]:
    tags = [x for x in counts if not x[0].startswith("c.")]
    total_in, total_out = 1 + sum(x[1] for x in tags), 1 + sum(x[2] for x in tags)
    out = {"w": 1.0, "w.a": 0.2, "w.x": -1.0}
    for kind, a, b in tags:
        odds = math.log((a + 0.5) / total_in) - math.log((b + 0.5) / total_out)
        out[kind] = max(0.05, odds) if kind == "w" else min(-0.02, odds) if kind not in ("w.a", "w.x") else odds
    return out | {kind: math.log((a + 0.5) / (b + 0.5)) for kind, a, b in counts if kind.startswith("c.")}


def best_region(page_tokens: list, weights: dict[str, float]) -> tuple[int, int]:
    """Half-open range of the tokens with the greatest sum of weights; empty if no token weighs more than 0."""
    best, total, start, region = 0.0, 0.0, 0, (0, 0)
    for i, (kind, text, _, _) in enumerate(page_tokens):
        if total <= 0:
            total, start = 0.0, i
        total += weights.get(kind, -0.5) * _amount(kind, text)
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best region, joined by one newline; empty for null, empty and wordless pages.

    A region that lies in an ``article`` or ``main`` element grows to the whole
    element, so that its first and last blocks are not cut.
    """
    seq = tokens(page or "", weights)
    a, b = best_region(seq, weights)
    elements = {x[3] for x in seq[a:b] if x[0][:1] == "w" and not x[2] and x[1].strip()}
    if elements and 0 not in elements:
        own = [i for i, x in enumerate(seq) if x[3] in elements]
        a, b = min(a, own[0]), max(b, own[-1] + 1)
    blocks, run = [], []
    for kind, text, bad, element in seq[a:b]:
        if kind in ("w", "w.a", "w.x"):
            if not bad and (element or 0 in elements):
                run.append(text)
        elif kind.lstrip("/") in BLOCKS:
            blocks.append(run)
            run = []
        elif kind == "br":
            run.append(" ")
    blocks.append(run)
    return "\n".join(x for run in blocks if (x := " ".join(html.unescape("".join(run)).split())))


def extract(pages: DataFrame, weights: dict[str, float], html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text_col`` in place of ``html_col``; every row stays, nulls in other columns too.

    Pages are taken whole whatever their length. Null, empty and wordless pages
    have an empty text; repeated rows get the same text each; an empty table
    stays empty. Without labelled pages, ``weights`` are the built-in ones and
    class words are judged as doubtful at most. A column of ``pages`` that is
    already named ``text_col`` is replaced.
    """
    kept = [f for f in pages.schema.fields if f.name not in (html_col, text_col)]

    def rows(batches):
        for batch in batches:
            text = pa.array([main_text(x.as_py(), weights) for x in batch.column(html_col)], type=pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), text], [*(f.name for f in kept), text_col])

    return pages.select(*(F.col(f"`{f.name}`") for f in kept), html_col).mapInArrow(rows, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{text_col}` string"]))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract(pages, learn_weights(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


ORACLE: dict[str, str] = {}
