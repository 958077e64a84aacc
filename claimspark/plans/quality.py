"""Citation and answer quality: recall, precision, correctness, lengths, usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import n_tokens
from ..operators import metrics
from .bindings import SENTENCES_SQL, statements, table, tok_sql
from .registry import query
from .sequence import SELECT_SQL, _citations

#: Judge scores as functions of the keys: support and need of statements, relevance of citations.
JUDGED_SQL = f"""{SELECT_SQL}, st AS (SELECT conv_id, sent_idx, ((conv_id + sent_idx) % 3) / 2.0::DOUBLE AS support, ((conv_id * 7 + sent_idx) % 2)::DOUBLE AS need FROM stm),
ci AS (SELECT conv_id, sent_idx, ((conv_id + sent_idx + span_rank) % 2)::DOUBLE AS relevance FROM ct),
nc AS (SELECT conv_id, sent_idx, count(*) AS n FROM ci GROUP BY ALL),
rc AS (SELECT st.conv_id, coalesce(avg(CASE WHEN coalesce(n, 0) > 0 THEN support ELSE 1 - need END), 0) AS recall FROM st LEFT JOIN nc ON nc.conv_id = st.conv_id AND nc.sent_idx = st.sent_idx GROUP BY st.conv_id),
pc AS (SELECT conv_id, avg(relevance) AS p FROM ci GROUP BY conv_id),
qu AS (SELECT rc.conv_id, recall, coalesce(p, 0) AS precision, CASE WHEN recall + coalesce(p, 0) = 0 THEN 0 ELSE 2 * recall * coalesce(p, 0) / (recall + coalesce(p, 0)) END AS f1 FROM rc LEFT JOIN pc ON pc.conv_id = rc.conv_id)"""
#: Datasets whose names contain each other: the group of a short name counts the longer ones too.
NAMES = ("multi_a", "multi_a_long", "news", "news_hard", "wiki")
NAMES_SQL = f"""{JUDGED_SQL}, nm AS (SELECT *, list_element(['multi_a', 'multi_a_long', 'news', 'news_hard', 'wiki'], (conv_id % 5)::INT + 1) AS dataset FROM qu),
ds AS (SELECT unnest(['multi_a', 'multi_a_long', 'news', 'news_hard', 'wiki']) AS name),
mc AS (SELECT name, count(*) AS n, avg(recall) AS recall, avg(precision) AS precision, avg(f1) AS f1 FROM ds JOIN nm ON contains(dataset, name) GROUP BY name)"""


def judged(spark, d):
    rows = statements(spark, d).select("conv_id", "sent_idx", (((F.col("conv_id") + F.col("sent_idx")) % 3) / 2.0).alias("support"), ((F.col("conv_id") * 7 + F.col("sent_idx")) % 2).cast("double").alias("need"))
    cited = _citations(spark, d).select("conv_id", "sent_idx", ((F.col("conv_id") + F.col("sent_idx") + F.col("span_rank")) % 2).cast("double").alias("relevance"))
    return metrics.citation_quality(rows, cited, "conv_id", "sent_idx")


def macro(spark, d):
    """Means over items for each dataset; names match as substrings."""
    named = judged(spark, d).withColumn("dataset", F.get(F.array(*map(F.lit, NAMES)), (F.col("conv_id") % 5).cast("int")))
    # a row for each name in it, made where the item is: a join by substring would be a Cartesian product
    held = F.filter(F.array(*map(F.lit, NAMES)), lambda n: F.contains("dataset", n))
    return named.select("*", F.explode(held).alias("name")).groupBy("name").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("recall", "precision", "f1")])


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {JUDGED_SQL} SELECT conv_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM qu")
def citation_recall_precision_f1(spark, d):
    return rounded(judged(spark, d), "recall", "precision", "f1")


@query(f"WITH {NAMES_SQL} SELECT name, n, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM mc")
def dataset_macro_scores(spark, d):
    return rounded(macro(spark, d), "recall", "precision", "f1")


@query(f"WITH {NAMES_SQL} SELECT round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(f1), 6) AS f1 FROM mc WHERE name NOT LIKE 'multi%'")
def cross_dataset_avg(spark, d):
    """The mean of the datasets' means, without the excluded family."""
    kept = macro(spark, d).filter(~F.col("name").startswith("multi"))
    return kept.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "f1")])


@query("SELECT source, sum(n_chars)::BIGINT AS prompt_tokens, sum(doc_id % 50)::BIGINT AS completion_tokens FROM documents GROUP BY source")
def token_usage(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("prompt_tokens"), F.sum(F.col("doc_id") % 50).alias("completion_tokens"))


@query("SELECT d.doc_id, max(r)::DOUBLE AS score FROM (SELECT doc_id, unnest([doc_id % 3, doc_id % 5, doc_id % 2]) / 4.0 AS r FROM documents) d GROUP BY d.doc_id")
def correctness_max_ref(spark, d):
    """The best rating over several reference answers."""
    k = F.col("doc_id")
    refs = table(spark, d, "documents").select("doc_id", F.explode(F.array(k % 3, k % 5, k % 2)).alias("r"))
    return refs.groupBy("doc_id").agg(F.max(F.col("r") / 4.0).alias("score"))


@query(f"""WITH {SELECT_SQL}, c AS (SELECT ct.conv_id, ct.sent_idx, span_rank, sum(len({tok_sql("s")})) AS toks, count(*) AS sents FROM ct JOIN src ON src.conv_id = ct.conv_id AND source_idx BETWEEN lo AND hi GROUP BY ALL),
t AS (SELECT sum(toks)::DOUBLE AS toks, sum(sents)::DOUBLE AS sents, count(*)::DOUBLE AS spans, count(DISTINCT (conv_id, sent_idx))::DOUBLE AS with_cit FROM c)
SELECT round(toks / with_cit, 6) AS tokens_per_statement, round(toks / spans, 6) AS tokens_per_span, round(toks / n, 6) AS tokens_per_statement_all,
round(sents / with_cit, 6) AS sentences_per_statement, round(sents / spans, 6) AS sentences_per_span, round(sents / n, 6) AS sentences_per_statement_all FROM t, (SELECT count(*)::DOUBLE AS n FROM stm)""")
def citation_length_stats(spark, d):
    from .bindings import sources

    src = sources(spark, d).select("conv_id", "source_idx", n_tokens(F.col("s")).alias("k"))
    each = _citations(spark, d).select("conv_id", "sent_idx", "span_rank", F.explode(F.sequence("lo", "hi")).alias("source_idx")).join(src, ["conv_id", "source_idx"])
    spans = each.groupBy("conv_id", "sent_idx", "span_rank").agg(F.sum("k").alias("toks"), F.count("*").alias("sents"))
    by = spans.groupBy("conv_id", "sent_idx").agg(F.sum("toks").alias("toks"), F.sum("sents").alias("sents"), F.count("*").alias("spans"))
    total = by.agg(F.sum("toks").alias("toks"), F.sum("sents").alias("sents"), F.sum("spans").alias("spans"), F.count("*").alias("with_cit"))
    n = statements(spark, d).agg(F.count("*").alias("n"))
    ratio = lambda a, b, name: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias(name)
    ways = (("with_cit", "statement"), ("spans", "span"), ("n", "statement_all"))
    return total.crossJoin(n).select(*[ratio("toks", b, f"tokens_per_{x}") for b, x in ways], *[ratio("sents", b, f"sentences_per_{x}") for b, x in ways])


@query(f"WITH {SENTENCES_SQL} SELECT round(count(*)::DOUBLE / count(DISTINCT conv_id), 6) AS statements_per_answer, round(sum(len({tok_sql('s')}))::DOUBLE / count(DISTINCT conv_id), 6) AS tokens_per_answer FROM stm")
def answer_length_stats(spark, d):
    by = statements(spark, d).groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(n_tokens(F.col("s"))).alias("k"))
    return by.agg(F.round(F.avg("n"), 6).alias("statements_per_answer"), F.round(F.avg("k"), 6).alias("tokens_per_answer"))


@query(f"WITH {SENTENCES_SQL} SELECT conv_id, sent_idx, s FROM stm WHERE sent_idx < 40")
def statement_cap(spark, d):
    """At most forty statements of an item are judged."""
    return statements(spark, d).filter("sent_idx < 40")
