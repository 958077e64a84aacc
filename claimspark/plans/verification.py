"""Verdicts: classification and ordinal agreement, abstention, evidence contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import judge
from ..operators import metrics
from .bindings import SCORES_SQL, SENTENCES_SQL, overlap_scores, sources, table
from .registry import query
from .scalars import SOFT_SQL, verdicts

#: Truth: twice the quality plus the toxicity label; prediction: a bucket of the text's length.
PAIRS_SQL = "pr AS (SELECT l.doc_id, (2 * quality + toxic)::INT AS t, (n_chars % 4)::INT AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
REPORT_SQL = f"""{PAIRS_SQL}, cl AS (SELECT unnest([0, 1, 2, 3])::INT AS cls),
cn AS (SELECT cls, sum(CASE WHEN t = cls AND p = cls THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN t <> cls AND p = cls THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN t = cls AND p <> cls THEN 1 ELSE 0 END)::BIGINT AS fn FROM cl, pr GROUP BY cls),
rp AS (SELECT cls, tp, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM cn)"""


def pairs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 4).cast("int").alias("p"))
    return table(spark, d, "labels").select("doc_id", (2 * F.col("quality") + F.col("toxic")).cast("int").alias("t")).join(docs, "doc_id")


def _report(spark, d):
    return metrics.classification_report(pairs(spark, d), "t", "p", [0, 1, 2, 3])


@query(f"WITH {REPORT_SQL} SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, tp FROM rp")
def classification_report(spark, d):
    return _report(spark, d).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""WITH {REPORT_SQL} SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
round(sum(precision * support) / sum(CASE WHEN precision IS NOT NULL THEN support END), 6) AS weighted_precision, round(sum(recall * support) / sum(CASE WHEN recall IS NOT NULL THEN support END), 6) AS weighted_recall,
round(sum(f1 * support) / sum(CASE WHEN f1 IS NOT NULL THEN support END), 6) AS weighted_f1 FROM rp""")
def classification_averages(spark, d):
    out = metrics.report_averages(_report(spark, d))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"WITH {PAIRS_SQL} SELECT t AS truth, p AS predicted, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY t), 6) AS ratio FROM pr GROUP BY t, p")
def confusion_matrix(spark, d):
    return metrics.confusion(pairs(spark, d), "t", "p").select("truth", "predicted", "n", F.round("ratio", 6).alias("ratio"))


@query(f"WITH {PAIRS_SQL} SELECT round(avg((t - p) * (t - p)::DOUBLE), 6) AS mse, count(*) AS n FROM pr WHERE t <> 3 AND p <> 3")
def ordinal_mse(spark, d):
    """Over items with an ordinal truth and prediction; the last class is none."""
    kept = pairs(spark, d).filter("t <> 3 AND p <> 3")
    return kept.agg(F.round(F.avg(F.pow(F.col("t") - F.col("p"), F.lit(2.0))), 6).alias("mse"), F.count("*").alias("n"))


@query(f"""WITH {PAIRS_SQL}, k0 AS (SELECT t, p FROM pr WHERE t <> 3 AND p <> 3), cs AS (SELECT c, row_number() OVER (ORDER BY c) AS i FROM (SELECT t AS c FROM k0 UNION SELECT p FROM k0)),
o AS (SELECT t, p, count(*)::DOUBLE AS o FROM k0 GROUP BY ALL), r AS (SELECT t, sum(o) AS r FROM o GROUP BY t), k AS (SELECT p, sum(o) AS k FROM o GROUP BY p), n AS (SELECT sum(o) AS n FROM o)
SELECT round(1 - sum((a.i - b.i) * (a.i - b.i) * coalesce(o, 0)) / sum((a.i - b.i) * (a.i - b.i) * r.r * k.k / n.n), 6) AS kappa FROM r, k, n, cs a, cs b LEFT JOIN o ON o.t = r.t AND o.p = k.p WHERE a.c = r.t AND b.c = k.p""")
def quadratic_kappa(spark, d):
    return metrics.quadratic_kappa(pairs(spark, d).filter("t <> 3 AND p <> 3"), "t", "p").select(F.round("kappa", 6).alias("kappa"))


@query(f"""WITH {SOFT_SQL}, z AS (SELECT doc_id, (doc_id % 4)::INT AS t, p0 / (p0 + p1 + p2) AS a, p1 / (p0 + p1 + p2) AS b FROM q)
SELECT doc_id, round((power(CASE WHEN t < 1 THEN 1 ELSE 0 END - a, 2) + power(CASE WHEN t < 2 THEN 1 ELSE 0 END - (a + b), 2)) / 2, 6) AS rps FROM z WHERE t <> 3""")
def rps(spark, d):
    """Ranked probability score of each item with an ordinal truth."""
    rows = verdicts(spark, d).select("doc_id", (F.col("doc_id") % 4).cast("int").alias("t"), judge.renormalised(F.col("dist")).alias("r")).filter("t <> 3")
    return rows.select("doc_id", F.round(judge.rps(F.col("t"), F.col("r")), 6).alias("rps"))


@query(f"""WITH {SOFT_SQL}, z AS (SELECT doc_id % 4 = 3 AS truth, round(p3, 6) >= 0.35 AS pred FROM q) SELECT sum(pred::INT)::BIGINT AS predicted, sum(truth::INT)::BIGINT AS actual, sum((pred OR truth)::INT)::BIGINT AS either, count(*) AS n FROM z""")
def abstention_metrics(spark, d):
    """Abstained, rightly unanswerable, either; the threshold fits the stand-in scores."""
    rows = verdicts(spark, d).select((F.col("doc_id") % 4 == 3).alias("truth"), (F.round(F.get("dist", F.lit(3)), 6) >= 0.35).alias("pred"))
    return rows.agg(F.count_if("pred").alias("predicted"), F.count_if("truth").alias("actual"), F.count_if(F.col("pred") | F.col("truth")).alias("either"), F.count("*").alias("n"))


@query(f"""WITH {SCORES_SQL}, m AS (SELECT conv_id, source_idx, round(max(score), 6) AS score FROM sc GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, source_idx DESC) AS rk FROM m),
g AS (SELECT k, r.conv_id, source_idx FROM r, (SELECT unnest([1, 3, 1000000])::INT AS k) WHERE rk <= k)
SELECT g.conv_id, k, string_agg(s, chr(10) || chr(10) ORDER BY g.source_idx) AS evidence FROM g JOIN src ON src.conv_id = g.conv_id AND src.source_idx = g.source_idx GROUP BY ALL""")
def evidence_by_k(spark, d):
    """The evidence that is left for each k: the k best sources, or all, in document order."""
    from pyspark.sql import Window

    pooled = overlap_scores(spark, d).groupBy("conv_id", "source_idx").agg(F.round(F.max("score"), 6).alias("score"))
    rk = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("source_idx")))
    grid = pooled.withColumn("rk", rk).select("*", F.explode(F.array(*map(F.lit, (1, 3, 1_000_000)))).alias("k")).filter("rk <= k")
    rows = grid.join(sources(spark, d), ["conv_id", "source_idx"]).groupBy("conv_id", "k").agg(F.array_sort(F.collect_list(F.struct("source_idx", "s"))).alias("xs"))
    return rows.select("conv_id", "k", F.array_join(F.transform("xs", lambda x: x["s"]), "\n\n").alias("evidence"))


@query(f"""WITH {SENTENCES_SQL} SELECT label, ordinal, short, count(pr.doc_id) AS n FROM (VALUES ('Supported', 0, 'SUP'), ('Conflicting', 1, 'CONF'), ('Refuted', 2, 'REF'), ('Not Enough Evidence', 3, 'NEE')) v(label, ordinal, short)
LEFT JOIN (SELECT l.doc_id, 2 * quality + toxic AS t FROM labels l JOIN documents d ON d.doc_id = l.doc_id) pr ON pr.t = ordinal GROUP BY ALL""")
def label_ordinals(spark, d):
    """Labels, their ordinals and short forms, with what carries them."""
    rows = [("Supported", 0, "SUP"), ("Conflicting", 1, "CONF"), ("Refuted", 2, "REF"), ("Not Enough Evidence", 3, "NEE")]
    dim = spark.createDataFrame(rows, "label string, ordinal int, short string")
    return dim.join(pairs(spark, d).select("doc_id", "t"), F.col("t") == F.col("ordinal"), "left").groupBy("label", "ordinal", "short").agg(F.count("doc_id").alias("n"))
