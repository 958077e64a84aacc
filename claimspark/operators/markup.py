"""Answers with statement and citation markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.sequences import merge_ranges

BLOCK = r"(?s)<statement>(.*?)</statement>"


def cited_ranges(text: Column, n: Column, most: int = 3) -> Column:
    """array<struct<lo,hi>> of the `[a-b]` marks in a text: clamped, joined, the first few."""
    pattern = r"\[(\d{1,9})-(\d{1,9})\]"
    lo, hi = (F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), lambda x: x.cast("int")) for g in (1, 2))
    return merge_ranges(F.zip_with(lo, hi, lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))), n, most)


def statements(answer: Column, n: Column) -> Column:
    """array<struct<text, cited, ranges>> in reading order.

    Text between blocks with more than five stripped characters is a statement without citation
    (cited null); inside a block, ranges come from its <cite> element.
    """
    parts = F.split(F.replace(F.coalesce(answer, F.lit("")), F.lit("</statement>"), F.lit("<statement>")), "<statement>")
    inside = lambda i: i % 2 == 1
    cite = lambda p: F.regexp_extract(p, r"(?s)<cite>(.*?)</cite>", 1)
    bare = lambda p: F.trim(F.regexp_replace(p, r"(?s)<cite>.*?</cite>", ""))
    none = F.lit(None).cast("array<struct<lo:int,hi:int>>")
    rows = F.transform(parts, lambda p, i: F.struct(bare(p).alias("text"), inside(i).alias("cited"), F.when(inside(i), cited_ranges(cite(p), n)).otherwise(none).alias("ranges")))
    return F.filter(rows, lambda r: r["cited"] | (F.length(r["text"]) > 5))


def range_indices(ranges: Column) -> Column:
    """array<int>: every index in the ranges."""
    return F.flatten(F.transform(F.coalesce(ranges, F.array().cast("array<struct<lo:int,hi:int>>")), lambda r: F.sequence(r["lo"], r["hi"])))


def range_scores(ranges: Column, n: Column) -> Column:
    """array<double>: 1 at cited indices, else 0."""
    cited = range_indices(ranges)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains(cited, i).cast("double"))).otherwise(F.array().cast("array<double>"))
