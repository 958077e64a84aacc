"""Formatted results and their HTML, as nested columns and string expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import html_escape
from .citations import citation_label, span_texts
from .methods import METHODS

#: Colours of supported, partly supported and unsupported statements, of relevant and irrelevant citations.
SUPPORT_COLOURS = ((1.0, "#c8f7c5"), (0.5, "#fdf7c3"), (0.0, "#f7c5c5"))
RELEVANCE_COLOURS = ((1, "#1b8d36"), (0, "#cc1414"))


def methods(spark: SparkSession) -> DataFrame:
    """(name, label, place): the dimension of METHODS."""
    return spark.createDataFrame([(m.name, m.label, i) for i, m in enumerate(METHODS)], "name string, label string, place long")


def in_display_order(results: DataFrame, name: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """results with label and display (1, 2, ... in the fixed order); excluded methods go, absent ones leave no gap.

    One row a method, so that the window has a dozen rows.
    """
    dim = F.broadcast(methods(results.sparkSession).filter(~F.col("name").isin(*excluded)).withColumnRenamed("name", "__name"))
    found = results.join(dim, F.col(name) == F.col("__name")).drop("__name")
    return found.withColumn("display", F.row_number().over(Window.orderBy("place")).cast("long")).drop("place")


def method_of(path: Column) -> dict[str, Column]:
    """method and label: of the longest registered name that the path contains; null without one."""
    method = label = None
    for m in sorted(METHODS, key=lambda m: (-len(m.name), m.name)):
        hit = path.contains(m.name)
        method = F.when(hit, m.name) if method is None else method.when(hit, m.name)
        label = F.when(hit, m.label) if label is None else label.when(hit, m.label)
    return {"method": method, "label": label}


def lookup(value: Column, table: tuple[tuple[object, str], ...]) -> Column:
    """The text that belongs to a value; null for any other value."""
    out = None
    for key, found in table:
        out = F.when(value == key, found) if out is None else out.when(value == key, found)
    return out


def formatted_results(statements: DataFrame, cited: DataFrame, sources: DataFrame, unit: str) -> DataFrame:
    """(idx, statements array<struct<statement, citation array<struct<cite, span, score, pre_context, post_context>>>>).

    statements(unit, sent_idx, s), cited(unit, sent_idx, span_rank, lo, hi, span_score) and sources(unit, xs)
    with xs array<struct<s, sep>>; statements without citation keep an empty list. A unit's rows are one
    answer's statements.
    """
    texts = cited.join(sources, unit).select(unit, "sent_idx", "span_rank", "lo", "hi", "span_score", span_texts(F.col("xs"), F.col("lo"), F.col("hi")).alias("t"))
    one = F.struct(F.col("t.cite").alias("cite"), F.array("lo", "hi").alias("span"), F.col("span_score").alias("score"), F.col("t.pre").alias("pre_context"), F.col("t.post").alias("post_context"))
    packed = texts.select(unit, "sent_idx", "span_rank", one.alias("c")).groupBy(unit, "sent_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("span_rank", "c"))), lambda x: x["c"]).alias("citation"))
    rows = statements.join(packed, [unit, "sent_idx"], "left")
    none = F.array().cast(packed.schema["citation"].dataType)
    each = rows.select(unit, "sent_idx", F.struct(F.col("s").alias("statement"), F.coalesce("citation", none).alias("citation")).alias("st"))
    return each.groupBy(unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "st"))), lambda x: x["st"]).alias("statements")).withColumnRenamed(unit, "idx")


def with_scores(results: DataFrame, support: Callable[[Column], Column], relevance: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds support_score to statements (by their index) and relevant_score to citations (by index and citation)."""

    def scored(st: Column, i: Column) -> Column:
        cited = F.transform(st["citation"], lambda c: c.withField("relevant_score", relevance(i, c)))
        return st.withField("support_score", support(i).cast("double")).withField("citation", cited)

    return results.withColumn("statements", F.transform("statements", scored))


def label_of(c: Column) -> Column:
    return citation_label(F.get(c["span"], F.lit(0)), F.get(c["span"], F.lit(1)))


def span(style: str, colour: Column, body: Column) -> Column:
    return F.concat(F.lit(f"<span style='{style}: "), colour, F.lit(";'>"), body, F.lit("</span>"))


def answer_html(statements: Column) -> Column:
    def part(st: Column) -> Column:
        marks = F.array_join(F.transform(st["citation"], lambda c: span("color", lookup(c["relevant_score"], RELEVANCE_COLOURS), label_of(c))), "")
        return F.concat(span("background-color", lookup(st["support_score"], SUPPORT_COLOURS), html_escape(st["statement"])), F.lit(" "), marks, F.lit("\n\n"))

    return F.concat(F.lit("\n"), F.array_join(F.transform(statements, part), ""))


def evidence_html(statements: Column) -> Column:
    def card(c: Column) -> Column:
        seal = span("color", lookup(c["relevant_score"], RELEVANCE_COLOURS), F.when(c["relevant_score"] == 1, "Relevant").otherwise("Irrelevant"))
        score = F.concat(F.lit("<span>Score: "), F.when(c["score"] != 0, F.format_string("%.2f", F.round(c["score"], 2))).otherwise("-"), F.lit("</span>"))
        title = F.concat(F.lit('<div class="evidence-card"><div class="evidence-title">'), seal, score, F.lit('</div><div class="evidence-title"><span>Evidence snippet '), label_of(c))
        return F.concat(title, F.lit('</span></div><div class="evidence-content">'), html_escape(c["cite"]), F.lit("</div></div>"))

    def part(st: Column, i: Column) -> Column:
        head = F.concat(F.lit('<div class="statement-header">Statement '), (i + 1).cast("string"), F.lit(":</div>"))
        return F.when(F.size(st["citation"]) > 0, F.concat(head, F.array_join(F.transform(st["citation"], card), ""))).otherwise("")

    return F.concat(F.lit('<div class="evidence-container">'), F.array_join(F.transform(statements, part), ""), F.lit("</div>"))
