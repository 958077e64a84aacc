"""Tokens and characters: spans of tokens, and the slice of tokens that a span of characters has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokenizers import BLANK, Tokenizer


def token_spans(texts: DataFrame, keys: list[str], text: str, tokenizer: Tokenizer) -> DataFrame:
    """(keys, token_idx, token, start, end): every token with its characters [start, end). Keys name one text each;
    null and empty texts have no rows. Offsets are running sums, spilled and not folded, however long a text is."""
    pieces = texts.select(*keys, F.posexplode(tokenizer.pieces(F.col(text))).alias("__i", "token"))
    before = Window.partitionBy(*keys).orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    is_token = ~F.col("token").rlike(f"^{BLANK}*$")
    placed = pieces.withColumn("__t", is_token).withColumns(
        {"start": F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)).cast("long"), "token_idx": F.coalesce(F.sum(F.col("__t").cast("int")).over(before), F.lit(0)).cast("long")}
    )
    return placed.filter("__t").select(*keys, "token_idx", "token", "start", (F.col("start") + F.length("token")).cast("long").alias("end"))


def span_slices(tokens: DataFrame, spans: DataFrame, keys: list[str], span: str, *sums: str) -> DataFrame:
    """(keys, span, first, last, n, sums): of each span of characters (keys, span, start, end) the tokens [first, last)
    that begin in it, with sums of their columns (log-probabilities). Spans of a text don't overlap; one in which no token begins has null
    for first and last, and zeros.

    Tokens and spans of a text are sorted into one sequence, in which each token sees the last span that began:
    no pairs of tokens and spans are made.
    """
    none = {c: F.lit(None).cast("double") for c in sums}
    begun = spans.select(*keys, F.col("start").alias("__at"), F.lit(0).alias("__kind"), F.struct(F.col(span).alias("id"), F.col("end").alias("end")).alias("__s"), F.lit(None).cast("long").alias("token_idx"), *[v.alias(c) for c, v in none.items()])
    seen = tokens.select(*keys, F.col("start").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(begun.schema["__s"].dataType).alias("__s"), "token_idx", *[F.col(c).cast("double").alias(c) for c in sums])
    order = Window.partitionBy(*keys).orderBy("__at", "__kind", "token_idx").rowsBetween(Window.unboundedPreceding, 0)
    held = begun.unionByName(seen).withColumn("__s", F.last("__s", ignorenulls=True).over(order)).filter("__kind = 0 OR __at < __s.end")
    return held.groupBy(*keys, F.col("__s.id").alias(span)).agg(
        F.min("token_idx").alias("first"),
        (F.max("token_idx") + 1).alias("last"),
        F.count("token_idx").alias("n"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums],
    )
