"""Masks, splits, windows and vectors as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def indices(n: Column) -> Column:
    """0 .. n-1; empty for n = 0 (a bare sequence would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def split_evenly(n: Column, k: Column) -> Column:
    """k sizes that differ by one at most, larger ones first."""
    return F.transform(indices(k), lambda i: (F.floor(n / k) + F.when(i < n % k, 1).otherwise(0)).cast("int"))


def split_words(words: Column, most: int) -> Column:
    """array<array<string>>: near-equal groups of at most `most` words."""
    n = F.size(words)
    k = F.greatest(F.ceil(n / F.lit(most)).cast("int"), F.lit(1))
    at = lambda i: (i * F.floor(n / k) + F.least(i, n % k)).cast("int")
    return F.transform(indices(k), lambda i: F.slice(words, at(i) + 1, at(i + 1) - at(i)))


def leave_one_out(n: Column) -> Column:
    """n + 1 masks: all kept, then each index left out."""
    return F.transform(F.concat(F.array(F.lit(-1)), indices(n)), lambda i: F.transform(indices(n), lambda j: j != i))


def topk_mask(scores: Column, k: int) -> Column:
    """True except at the k largest scores; of equal scores the later index goes first."""
    ranked = F.transform(F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), (-i).alias("i")))), lambda x: -x["i"])
    return F.transform(scores, lambda s, i: ~F.array_contains(F.slice(ranked, 1, k), i))


def windows(items: Column, length: int) -> Column:
    """Sliding windows over items, clipped at both ends: size + 2 * (length // 2) of them."""
    pad = length // 2
    n = F.size(items)
    starts = F.transform(indices(n + 2 * pad), lambda i: i - 2 * pad if length % 2 else i - (length - 1))
    lo = lambda s: F.greatest(s, F.lit(0))
    return F.when(n > 0, F.transform(starts, lambda s: F.slice(items, lo(s) + 1, F.greatest(F.least(s + length, n) - lo(s), F.lit(0))))).otherwise(F.slice(F.array(items), 1, 0))


def kept_text(parts: Column, separators: Column, mask: Column) -> Column:
    """Kept parts, each but the last followed by its own separator."""
    rows = F.filter(F.arrays_zip(parts.alias("p"), separators.alias("s"), mask.alias("m")), lambda x: x["m"])
    n = F.size(rows)
    return F.array_join(F.transform(rows, lambda x, i: F.when(i < n - 1, F.concat(x["p"], x["s"])).otherwise(x["p"])), "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """null where a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def chained_find(text: Column, parts: Column) -> Column:
    """array<struct<start,end>>: each part is sought from the previous one's end; null where it isn't found."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, part):
        at = F.locate_from(text, part, acc["at"] + 1) if hasattr(F, "locate_from") else F.call_function("locate", part, text, acc["at"] + 1)
        hit = at > 0
        span = F.when(hit, F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(part)).cast("int").alias("end")))
        return F.struct(F.when(hit, at - 1 + F.length(part)).otherwise(acc["at"]).cast("int").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(parts, state, step, lambda acc: acc["out"])


def merge_ranges(ranges: Column, n: Column, most: int = 3) -> Column:
    """Ranges struct<lo,hi> in order: clamped to n, invalid ones dropped, joined where one begins right after the last kept one; the first few."""
    empty = F.slice(ranges, 1, 0)

    def step(acc, r):
        hi = F.least(r["hi"], n - 1)
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), hi.alias("hi"))))
        fresh = F.concat(acc, F.array(F.struct(r["lo"].alias("lo"), hi.alias("hi"))))
        return F.when((r["lo"] < 0) | (r["lo"] > hi), acc).when((F.size(acc) > 0) & (last["hi"] + 1 == r["lo"]), joined).otherwise(fresh)

    return F.slice(F.aggregate(ranges, empty, step), 1, most)


def index_runs(ids: Column) -> Column:
    """array<struct<lo,hi>>: neighbours in list order that count up by one, joined; the list isn't sorted."""
    empty = F.slice(F.transform(ids, lambda x: F.struct(x.alias("lo"), x.alias("hi"))), 1, 0)

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), x.alias("hi"))))
        return F.when((F.size(acc) > 0) & (last["hi"] + 1 == x), joined).otherwise(F.concat(acc, F.array(F.struct(x.alias("lo"), x.alias("hi")))))

    return F.aggregate(ids, empty, step)
