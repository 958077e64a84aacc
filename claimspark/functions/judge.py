"""Scores from judge and model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BRACKETED = r"\[\[([^\]]*)\]\]"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def need_citation(text: Column) -> Column:
    """1 if the last verdict says yes, 0 otherwise, null without one."""
    last = F.try_element_at(_found(text, r"Need Citation:\s*\[\[([^\]]*)\]\]"), F.lit(-1))
    return F.when(last.isNull(), None).otherwise(F.lower(last).contains("yes").cast("double"))


def support(text: Column) -> Column:
    """Of the first verdict: fully 1, partially a half, else 0; null without one."""
    first = F.lower(F.get(_found(text, BRACKETED), F.lit(0)))
    return F.when(first.isNull(), None).when(first.contains("fully"), 1.0).when(first.contains("partially"), 0.5).otherwise(0.0)


def relevance(text: Column) -> Column:
    first = F.lower(F.get(_found(text, BRACKETED), F.lit(0)))
    return F.when(first.isNull(), None).when(first.contains("irrelevant"), 0.0).otherwise(1.0)


def rating(text: Column, low: float, span: float) -> Column:
    """(first whole number of the last verdict - low) / span; a half where there is none or it is no whole number."""
    last = F.try_element_at(_found(text, BRACKETED), F.lit(-1))
    number = F.regexp_extract(F.coalesce(last, F.lit("")), r"\d+(?:\.\d+)?", 0)
    return F.when(number.rlike(r"^\d{1,9}$"), (F.try_to_number(number, F.lit("999999999")).cast("double") - low) / span).otherwise(0.5)


def sentence_indices(text: Column, k: int, n: Column, stop: str = "<eos>") -> Column:
    """array<int>: the first k distinct `[i]` of a finished output; null if it isn't finished, has under k, or any is outside 1..n."""
    ids = F.array_distinct(F.transform(_found(text, r"\[(\d{1,9})\]"), lambda x: x.cast("int")))
    cut = F.slice(ids, 1, k)
    bad = F.exists(cut, lambda x: (x <= 0) | (x > n))
    return F.when(text.endswith(stop) & (F.size(ids) >= k) & ~bad, cut)


def query_list(text: Column, most: int = 5, stop: str = "<eos>") -> Column:
    """array<string>: the first few entries of a JSON list of strings, code fences removed; null for any other content."""
    bare = F.trim(F.regexp_replace(F.replace(text, F.lit(stop), F.lit("")), r"```(?:json)?", ""))
    strings = bare.rlike(r'^\[\s*("(?:[^"\\]|\\.)*"\s*(,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]$')
    return F.when(strings, F.slice(F.from_json(bare, "array<string>"), 1, most))


def verdict_distribution(logits: Column, labels: tuple[str, ...]) -> Column:
    """Softmax over the labels' entries of a map; a missing label has no mass, no label at all gives null."""
    values = F.array(*[F.try_element_at(logits, F.lit(x)) for x in labels])
    top = F.array_max(values)
    weights = F.transform(values, lambda v: F.coalesce(F.exp(v - top), F.lit(0.0)))
    return F.when(top.isNotNull(), normalised(weights))


def normalised(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(values, lambda v: v / total))


def renormalised(distribution: Column, n: int = 3) -> Column:
    """The first n classes, scaled to one."""
    return normalised(F.slice(distribution, 1, n))


def one_hot(label: Column, labels: tuple[str, ...]) -> Column:
    """null for a label outside the list."""
    return F.when(label.isin(*labels), F.array(*[(label == x).cast("double") for x in labels]))


def argmax(values: Column) -> Column:
    """0-based; of equal values the first."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def rps(truth: Column, distribution: Column, classes: int = 3) -> Column:
    """Ranked probability score of one item."""
    total = F.lit(0.0)
    for c in range(1, classes):
        cdf = F.aggregate(F.slice(distribution, 1, c), F.lit(0.0), lambda a, x: a + x)
        total = total + F.pow(F.when(truth < c, 1.0).otherwise(0.0) - cdf, F.lit(2.0))
    return total / (classes - 1)


def f1(recall: Column, precision: Column) -> Column:
    return F.when(recall + precision == 0, 0.0).otherwise(2 * recall * precision / (recall + precision))
