"""The main text of HTML pages: the densest part of the block tree, without segments that a site repeats.

A page is read once, in a task, into segments of running text. An element is a range of segments, so that the
element with the greatest sum of segment weights is found from prefix sums. A segment weighs its characters, less twice those
in links, less BLOCK_COST: menus, teasers and crumbs weigh less than nothing, and the best element ends where they begin.
Elements that are boilerplate by their tag or class name are not read at all.

Segments of `min_dup_check` characters or more that stand on more than `max_repetitions` pages of a site are dropped from
all of them. They are counted by site and hash, pages once each, added up in each task before they shuffle. Texts shuffle
once, by page, and both the counts and the result read that shuffle.

Null pages and pages out of the size bounds have null content and a reason; broken markup gives what could be read. Repeated
page ids are pages of their own only if their rows differ in site or text; a page without URL belongs to the site "".
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import url_domain
from .pages import BLOCKS, VOID, main_text


@dataclass(frozen=True)
class Options:
    """The sizes in characters that extraction asks for, and how often a site may repeat a segment."""

    min_file_size: int = 10
    max_file_size: int = 20_000_000
    min_extracted_size: int = 250
    min_output_size: int = 1
    min_dup_check: int = 100
    max_repetitions: int = 2
    #: Pages with more elements are not extracted; None: any number.
    max_tree_size: int | None = None


#: What a segment must have besides links to be worth reading, in characters.
BLOCK_COST = 30
#: An element that says that it is the main text counts for a quarter more.
MAIN, MAIN_BONUS = frozenset({"article", "main"}), 1.25
UNREAD = frozenset("script style nav header footer aside form noscript template title iframe button select svg figure head menu dialog".split())
CONTAINERS = BLOCKS | frozenset("body main html ul ol table tbody thead td th dl dd dt pre".split()) - frozenset({"br"})
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
BOILERPLATE = re.compile(r"(?i)(?:^|[\s_-])(?:nav|navbar|menu|footer|sidebar|cookies?|consent|banner|promo|ads?|advert\w*|sponsor\w*|share|social|related|comments?|breadcrumbs?|newsletter|pagination)(?:$|[\s_-])")


class Segments(HTMLParser):
    """segments: (text, characters in links, heading) in order; elements: (tag, first, last) as ranges of them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.segments: list[tuple[str, int, bool]] = []
        self.elements: list[tuple[str, int, int]] = []
        self.open: list[tuple[str, int, bool]] = []  # tag, first segment, unread
        self.unread = self.links = self.count = 0
        self.parts: list[str] = []
        self.linked = 0
        self.heading = False

    def flush(self) -> None:
        text = "\n".join(filter(None, (" ".join(x.split()) for x in "".join(self.parts).split("\n"))))
        if text:
            self.segments.append((text, min(self.linked, len(text)), self.heading))
        self.parts, self.linked = [], 0

    def shut(self, tag: str) -> None:
        while self.open:
            name, first, unread = self.open.pop()
            self.unread -= unread
            self.links -= name == "a"
            if name in CONTAINERS and not unread and first < len(self.segments):
                self.elements.append((name, first, len(self.segments)))
            if name == tag:
                return

    def handle_starttag(self, tag, attrs):
        self.count += 1
        if tag == "br":
            self.parts.append("\n")
        if tag in VOID:
            return
        if tag in CONTAINERS:
            self.flush()
            self.heading = tag in HEADINGS
            if tag == "p" and self.open and any(t == "p" for t, _, _ in self.open[-3:]):  # a paragraph ends where the next begins
                self.shut("p")
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        unread = tag in UNREAD or bool(BOILERPLATE.search(named)) and tag not in MAIN and tag not in ("body", "html")
        self.open.append((tag, len(self.segments), unread))
        self.unread += unread
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in CONTAINERS:
            self.flush()
            self.heading = False
        if any(t == tag for t, _, _ in self.open):
            self.shut(tag)

    def handle_data(self, data):
        if not self.unread:
            # outside of inline elements runs of white space are one blank
            self.parts.append(re.sub(r"\s+", " ", data))
            if self.links:
                self.linked += len(data.strip())

    def finish(self) -> None:
        self.flush()
        self.shut("")


def weight(segment: tuple[str, int, bool]) -> int:
    text, linked, heading = segment
    return 0 if heading else len(text) - 2 * linked - BLOCK_COST


def best_segments(html: str, options: Options = Options()) -> tuple[list[str] | None, str | None]:
    """The segments of the best element, or none and why not."""
    if len(html) < options.min_file_size:
        return None, "file too small"
    if len(html) > options.max_file_size:
        return None, "file too large"
    parser = Segments()
    try:
        parser.feed(html)
        parser.close()
    except (ValueError, AssertionError):
        pass
    parser.finish()
    if options.max_tree_size is not None and parser.count > options.max_tree_size:
        return None, "too many elements"
    sums = [0, *accumulate(map(weight, parser.segments))]
    ranges = [*parser.elements, ("", 0, len(parser.segments))]
    tag, first, last = max(ranges, key=lambda r: ((sums[r[2]] - sums[r[1]]) * (MAIN_BONUS if r[0] in MAIN else 1), r[1] - r[2]))
    told = lambda part: [text for text, linked, _ in part if 2 * linked <= len(text)]
    found = told(parser.segments[first:last])
    if sum(map(len, found)) < options.min_extracted_size:  # no element says enough: the whole page, or all that can be seen
        found = told(parser.segments) or [x for x in main_text(html).split("\n") if x]
    return (found, None) if sum(map(len, found)) >= options.min_output_size else (None, "no content")


def extract(pages: DataFrame, page_id: str, url: str, html: str, options: Options = Options()) -> DataFrame:
    """(page_id, site, content, reason, n_dropped): a line a segment; n_dropped counts segments that the site repeats."""

    @F.pandas_udf("segments array<string>, reason string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([best_segments(x, options) if x is not None else (None, "no page") for x in b], columns=["segments", "reason"])

    site = F.coalesce(url_domain(F.col(url)), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), site.alias("site"), read(F.col(html)).alias("x"))
    rows = rows.select("page_id", "site", "x.segments", "x.reason").repartition("page_id", "site")
    long = F.array_distinct(F.transform(F.filter("segments", lambda s: F.length(s) >= options.min_dup_check), lambda s: F.xxhash64(s)))
    each = rows.select("page_id", "site", F.explode(long).alias("h"))
    often = each.groupBy("site", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > options.max_repetitions).select("site", "h")
    dropped = each.join(often, ["site", "h"]).groupBy("page_id", "site").agg(F.collect_set("h").alias("hs"))  # hashes of one page
    both = rows.join(dropped, ["page_id", "site"], "left")
    gone = lambda s: (F.length(s) >= options.min_dup_check) & F.array_contains("hs", F.xxhash64(s))
    kept = F.when(F.col("hs").isNull(), F.col("segments")).otherwise(F.filter("segments", lambda s: ~gone(s)))
    out = both.select("page_id", "site", F.array_join(kept, "\n").alias("content"), "reason", (F.size("segments") - F.size(kept)).alias("n_dropped"))
    enough = F.length("content") >= options.min_output_size
    return out.select(
        "page_id",
        "site",
        F.when(enough, F.col("content")).alias("content"),
        F.when(F.col("reason").isNull() & ~enough, "no content").otherwise(F.col("reason")).alias("reason"),
        F.when(F.col("content").isNotNull(), F.col("n_dropped").cast("long")).otherwise(F.lit(0)).alias("n_dropped"),
    )
