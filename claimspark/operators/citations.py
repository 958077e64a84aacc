"""Discrete citations from attribution scores, and what is read off them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import index_runs


@dataclass(frozen=True)
class CitationParams:
    """threshold, nucleus mass, most spans, longest span (None: any length)."""

    t: float
    p: float = 0.7
    k: int = 4
    n: int | None = None


#: The thresholds that belong to each family of attribution methods, or to a variant of one.
PARAMS = {
    "surrogate": CitationParams(1.5),
    "semantic_similarity": CitationParams(0.7),
    "entailment": CitationParams(0.95),
    "entailment_window_3": CitationParams(0.95, p=0.4, n=3),
    "entailment_window_5": CitationParams(0.95, p=0.3, n=3),
}


def _spans(rows: DataFrame, keys: list[str], t: Column, n: Column, index: str, score: str) -> DataFrame:
    over = Window.partitionBy(*keys).orderBy(index)
    kept = rows.filter(F.col(score) >= t).withColumn("island", F.col(index) - F.row_number().over(over))
    place = F.row_number().over(Window.partitionBy(*keys, "island").orderBy(index)) - 1
    cut = F.coalesce(F.floor(place / n), F.lit(0).cast("long"))
    return kept.withColumn("cut", cut).groupBy(*keys, "island", "cut").agg(F.min(index).alias("lo"), F.max(index).alias("hi"), F.max(score).alias("span_score")).drop("island", "cut")


def _nucleus(found: DataFrame, keys: list[str], p: Column, k: Column) -> DataFrame:
    whole = Window.partitionBy(*keys)
    order = Window.partitionBy(*keys).orderBy(F.desc("prob"), F.desc("lo"))
    weighed = found.withColumn("w", F.exp(F.col("span_score") / F.max("span_score").over(whole)))
    shares = weighed.withColumn("prob", F.col("w") / F.sum("w").over(whole)).drop("w")
    before = F.coalesce(F.sum("prob").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = shares.withColumns({"span_rank": F.row_number().over(order).cast("long"), "before": before})
    return ranked.filter((F.col("before") < p) & (F.col("span_rank") <= k)).drop("before")


def spans(scores: DataFrame, keys: list[str], params: CitationParams, index: str = "source_idx", score: str = "score") -> DataFrame:
    """Indices at or above the threshold, neighbours joined: (keys, lo, hi, span_score = the largest score).

    Gaps and islands: index minus row number is constant in a run; a longest length cuts runs evenly.
    """
    return _spans(scores, keys, F.lit(params.t), F.lit(params.n).cast("int"), index, score)


def nucleus(found: DataFrame, keys: list[str], params: CitationParams) -> DataFrame:
    """Spans in falling order of their softmax until the mass reaches p, at most k: adds prob and span_rank.

    Scores are divided by the largest before the softmax. Of equal scores the later span goes first.
    """
    return _nucleus(found, keys, F.lit(params.p), F.lit(params.k))


def select_citations(scores: DataFrame, keys: list[str], params: CitationParams, **columns) -> DataFrame:
    """Threshold, merge, softmax, nucleus and top k: (keys, span_rank, lo, hi, span_score, prob)."""
    return nucleus(spans(scores, keys, params, **columns), keys, params)


def select_by_method(scores: DataFrame, keys: list[str], params: dict[str, CitationParams], index: str = "source_idx", score: str = "score") -> DataFrame:
    """(keys, method, span_rank, lo, hi, span_score, prob): citations of many methods in one plan, each by its own parameters.

    scores has a column method; methods without parameters give no citations. The parameters are a dimension of
    a row a method, which windows read row by row.
    """
    rows = [(m, x.t, x.p, x.k, x.n) for m, x in params.items()]
    own = F.broadcast(scores.sparkSession.createDataFrame(rows, "method string, t double, p double, k int, n int"))
    held = [*keys, "method", "p", "k"]  # p and k belong to the method
    found = _spans(scores.join(own, "method"), held, F.col("t"), F.col("n"), index, score)
    return _nucleus(found, held, F.col("p"), F.col("k")).drop("p", "k")


def neighbourhood(lo: Column, hi: Column, n: Column, width: int = 2) -> dict[str, Column]:
    """0-based bounds of the context around a span: up to `width` before, up to `width` after; the last sentence never counts as context after."""
    return {
        "pre_lo": F.greatest(lo - width, F.lit(0)),
        "pre_hi": lo - 1,
        "post_lo": hi + 1,
        "post_hi": F.least(hi + width, n - 2),
    }


def spaced_text(xs: Column) -> Column:
    """Sources struct<s, sep> as text: each but the last with its own separator."""
    n = F.size(xs)
    return F.array_join(F.transform(xs, lambda x, i: F.when(i < n - 1, F.concat(x["s"], x["sep"])).otherwise(x["s"])), "")


def span_texts(xs: Column, lo: Column, hi: Column) -> Column:
    """struct<cite, pre, post>: the text of a span of sources and of the context around it."""
    b = neighbourhood(lo, hi, F.size(xs))
    part = lambda a, z: spaced_text(F.slice(xs, (a + 1).cast("int"), F.greatest(z - a + 1, F.lit(0)).cast("int")))
    return F.struct(part(lo, hi).alias("cite"), part(b["pre_lo"], b["pre_hi"]).alias("pre"), part(b["post_lo"], b["post_hi"]).alias("post"))


def evidence_context(ids: Column, xs: Column, extra: Column) -> Column:
    """Source indices, neighbours in list order joined, as snippets with an empty line between them; with `extra`
    each between the last paragraph before it and the first after it."""

    def snippet(run: Column) -> Column:
        t = span_texts(xs, run["lo"], run["hi"])
        around = F.array_join(F.array(F.substring_index(t["pre"], "\n\n", -1), t["cite"], F.substring_index(t["post"], "\n\n", 1)), " ")
        return F.when(extra, around).otherwise(t["cite"])

    return F.array_join(F.transform(index_runs(ids), snippet), "\n\n")


def citation_label(lo: Column, hi: Column) -> Column:
    one = F.concat(F.lit("["), lo.cast("string"), F.lit("]"))
    return F.when(lo == hi, one).otherwise(F.concat(F.lit("["), lo.cast("string"), F.lit("-"), hi.cast("string"), F.lit("]")))


def first_seen_numbers(citations: DataFrame, doc: str, key: str, position: str) -> DataFrame:
    """(doc, key, number): 1, 2, ... in the order in which each key first appears in its document."""
    first = citations.groupBy(doc, key).agg(F.min(position).alias("first_at"))
    return first.select(doc, key, F.row_number().over(Window.partitionBy(doc).orderBy("first_at", key)).cast("long").alias("number"))
