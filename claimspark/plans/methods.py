"""Attribution by name: scores of many methods in one table, and their citations by each method's own parameters."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import attribution, citations, methods
from . import facts, faithfulness
from .registry import ORACLE_SQL, query

INSTANCE = ["conv_id", "sent_idx"]

methods.runs("surrogate")(lambda spark, d: faithfulness.surrogate_attr(spark, d).withColumnRenamed("budget", "variant"))
methods.runs("entailment_window")(lambda spark, d: facts.entailment_window_fact_attr(spark, d).withColumnRenamed("window_length", "variant"))
methods.runs("direct")(faithfulness.direct_citation_attr)
methods.runs("entailment")(facts.entailment_fact_attr)
methods.runs("entailment_greedy")(facts.greedy_fact_selection)
methods.runs("leave_one_out")(faithfulness.leave_one_out_scores)
methods.runs("semantic_similarity")(facts.semantic_attr)

#: How each method's scores are to be had in SQL, from the SQL of its own query.
_rows = lambda name, sql, where="": f"SELECT '{name}' AS method, conv_id, sent_idx, source_idx::BIGINT AS source_idx, score FROM ({sql}) {where}"
METHOD_SQL = {
    "direct": _rows("direct", ORACLE_SQL["direct_citation_attr"]),
    **{f"surrogate_{b}": _rows(f"surrogate_{b}", ORACLE_SQL["surrogate_attr"], f"WHERE budget = {b}") for b in attribution.BUDGETS},
    **{f"entailment_window_{n}": _rows(f"entailment_window_{n}", ORACLE_SQL["entailment_window_fact_attr"], f"WHERE window_length = {n}") for n in facts.WINDOW_LENGTHS},
    "entailment": _rows("entailment", ORACLE_SQL["entailment_fact_attr"]),
    "entailment_greedy": _rows("entailment_greedy", ORACLE_SQL["greedy_fact_selection"]),
    "leave_one_out": _rows("leave_one_out", ORACLE_SQL["leave_one_out_scores"]),
    "semantic_similarity": _rows("semantic_similarity", ORACLE_SQL["semantic_attr"]),
}
#: The stand-ins' scores are shares of words: their thresholds fit these, all else is each method's own.
THRESHOLDS = {"surrogate": 0.05, "semantic_similarity": 0.3, "entailment": 0.3, "entailment_window": 0.2}
SELECTED = {m.name: replace(m.params, t=THRESHOLDS[m.family]) for m in methods.METHODS if m.params}
PARAMS_SQL = ", ".join(f"('{m}', {x.t}::DOUBLE, {x.p}::DOUBLE, {x.k}, {'NULL' if x.n is None else x.n}::INT)" for m, x in SELECTED.items())
BY_METHOD_SQL = f"""pa AS (SELECT * FROM (VALUES {PARAMS_SQL}) v(method, t, p, k, n)), al AS ({" UNION ALL ".join(METHOD_SQL[m] for m in SELECTED)}),
c0 AS (SELECT al.*, p, k, n, source_idx - row_number() OVER (PARTITION BY al.method, conv_id, sent_idx ORDER BY source_idx) AS island FROM al JOIN pa ON pa.method = al.method WHERE score >= t),
c1 AS (SELECT *, coalesce((row_number() OVER (PARTITION BY method, conv_id, sent_idx, island ORDER BY source_idx) - 1) // n, 0) AS cut FROM c0),
c2 AS (SELECT method, conv_id, sent_idx, p, k, min(source_idx) AS lo, max(source_idx) AS hi, max(score) AS span_score FROM c1 GROUP BY method, conv_id, sent_idx, p, k, island, cut),
c3 AS (SELECT *, exp(span_score / max(span_score) OVER (PARTITION BY method, conv_id, sent_idx)) AS w FROM c2),
c4 AS (SELECT *, w / sum(w) OVER (PARTITION BY method, conv_id, sent_idx) AS prob FROM c3),
c5 AS (SELECT *, row_number() OVER z AS span_rank, coalesce(sum(prob) OVER (PARTITION BY method, conv_id, sent_idx ORDER BY round(prob, 9) DESC, lo DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c4 WINDOW z AS (PARTITION BY method, conv_id, sent_idx ORDER BY round(prob, 9) DESC, lo DESC))"""


@query(f"SELECT method, count(*) AS n, round(sum(score), 2) AS total, count(*) FILTER (WHERE score > 0) AS positive FROM ({' UNION ALL '.join(METHOD_SQL.values())}) GROUP BY method")
def attribution_by_method(spark, d):
    """Every registered method run by its name; what each gives in sum."""
    rows = methods.scores(list(METHOD_SQL), spark, d)
    return rows.groupBy("method").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"), F.count_if(F.col("score") > 0).alias("positive"))


@query(f"WITH {BY_METHOD_SQL} SELECT method, conv_id, sent_idx, span_rank, lo, hi, round(span_score, 6) AS span_score, round(prob, 6) AS prob FROM c5 WHERE round(before, 6) < p AND span_rank <= k")
def citations_by_method(spark, d):
    """Citations of all methods that select them from scores, in one plan, each by its own threshold, mass, number and length."""
    found = citations.select_by_method(methods.scores(list(SELECTED), spark, d), INSTANCE, SELECTED)
    return found.select("method", *INSTANCE, "span_rank", "lo", "hi", F.round("span_score", 6).alias("span_score"), F.round("prob", 6).alias("prob"))
