"""Evidence contexts, verdicts in one and two stages, and what they are measured by; formatted results and their HTML."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import judge, text
from ..operators import citations, metrics, presentation
from ..sources import scorers
from .bindings import overlap_scores, sent_sql, statements, table, tok_sql
from .registry import query
from .sequence import SELECT_SQL, _citations

#: Sources with what separates each from the next: a blank, or an empty line at the end of a turn.
SPACED_SQL = f"""sp0 AS (SELECT conv_id, turn, s, i, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS source_idx, CASE WHEN i = n - 1 THEN chr(10) || chr(10) ELSE ' ' END AS sep
FROM (SELECT conv_id, turn, len(xs) AS n, unnest(xs) AS s, unnest(range(len(xs))) AS i FROM (SELECT conv_id, turn, {sent_sql("text")} AS xs FROM conversations WHERE role = 'user'))),
nn AS (SELECT conv_id, count(*) AS n FROM sp0 GROUP BY conv_id)"""
#: The picked sources of each k in their own order, as runs of neighbours: of the cited ones by index, of the best three by rising score.
RUNS_SQL = f"""{SELECT_SQL}, {SPACED_SQL},
pk AS (SELECT conv_id, 'cite' AS k, i AS source_idx, i AS place FROM (SELECT DISTINCT conv_id, unnest(range(lo, hi + 1)) AS i FROM ct)
UNION ALL SELECT conv_id, '3', source_idx, -rk FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, source_idx DESC) AS rk FROM (SELECT conv_id, source_idx, round(max(score), 6) AS score FROM sc GROUP BY ALL)) WHERE rk <= 3),
rn AS (SELECT *, sum(f) OVER (PARTITION BY conv_id, k ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN source_idx = lag(source_idx) OVER (PARTITION BY conv_id, k ORDER BY place) + 1 THEN 0 ELSE 1 END AS f FROM pk)),
rg AS (SELECT conv_id, k, run, min(source_idx) AS lo, max(source_idx) AS hi FROM rn GROUP BY ALL),
sn AS (SELECT rg.conv_id, k, run, lo, hi, string_agg(CASE WHEN source_idx < lo OR source_idx > hi THEN NULL WHEN source_idx < hi THEN s || sep ELSE s END, '' ORDER BY source_idx) AS cite,
coalesce(string_agg(CASE WHEN source_idx < greatest(lo - 2, 0) OR source_idx >= lo THEN NULL WHEN source_idx < lo - 1 THEN s || sep ELSE s END, '' ORDER BY source_idx), '') AS pre,
coalesce(string_agg(CASE WHEN source_idx <= hi OR source_idx > least(hi + 2, n - 2) THEN NULL WHEN source_idx < least(hi + 2, n - 2) THEN s || sep ELSE s END, '' ORDER BY source_idx), '') AS post
FROM rg JOIN sp0 ON sp0.conv_id = rg.conv_id JOIN nn ON nn.conv_id = rg.conv_id GROUP BY rg.conv_id, k, run, lo, hi, n)"""
CONTEXT_SQL = f"""{RUNS_SQL}, ev AS (SELECT conv_id, k, FALSE AS extra, string_agg(cite, chr(10) || chr(10) ORDER BY run) AS evidence FROM sn GROUP BY conv_id, k
UNION ALL SELECT conv_id, k, TRUE, string_agg(string_split(pre, chr(10) || chr(10))[-1] || ' ' || cite || ' ' || string_split(post, chr(10) || chr(10))[1], chr(10) || chr(10) ORDER BY run) FROM sn GROUP BY conv_id, k
UNION ALL SELECT conv_id, 'all', FALSE, string_agg(CASE WHEN source_idx < n - 1 THEN s || sep ELSE s END, '' ORDER BY source_idx) FROM sp0 JOIN nn USING (conv_id) GROUP BY conv_id)"""


def spaced_sources(spark, d):
    """(conv_id, xs): one conversation's sources in order, struct<s, sep>; sep is what stands before the next one."""
    turns = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", text.sentences(F.col("text")).alias("ss"))
    each = turns.select("conv_id", "turn", F.size("ss").alias("n"), F.posexplode("ss").alias("i", "s")).withColumn("sep", F.when(F.col("i") == F.col("n") - 1, "\n\n").otherwise(" "))
    return each.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "i", "s", "sep"))), lambda x: F.struct(x["s"].alias("s"), x["sep"].alias("sep"))).alias("xs"))


def picked(spark, d):
    """(conv_id, k, ids): the cited sources by index, and the three best pooled ones by rising score."""
    cited = _citations(spark, d).select("conv_id", F.explode(F.sequence("lo", "hi")).alias("i")).groupBy("conv_id").agg(F.array_sort(F.collect_set("i")).alias("ids"))
    pooled = overlap_scores(spark, d).groupBy("conv_id", "source_idx").agg(F.round(F.max("score"), 6).alias("score"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("source_idx"))
    top = pooled.withColumn("rk", F.row_number().over(order)).filter("rk <= 3").groupBy("conv_id")
    best = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rk")).alias("k"), "source_idx"))), lambda x: x["source_idx"]).alias("ids"))
    return cited.select("conv_id", F.lit("cite").alias("k"), "ids").unionByName(best.select("conv_id", F.lit("3").alias("k"), "ids"))


def evidence(spark, d):
    """(conv_id, k, extra, evidence)."""
    packed = spaced_sources(spark, d)
    rows = picked(spark, d).join(packed, "conv_id")
    whole = packed.select("conv_id", F.lit("all").alias("k"), F.lit(False).alias("extra"), citations.spaced_text(F.col("xs")).alias("evidence"))
    return whole.unionByName(rows.select("conv_id", "k", F.explode(F.array(F.lit(False), F.lit(True))).alias("extra"), "ids", "xs").select("conv_id", "k", "extra", citations.evidence_context(F.col("ids"), F.col("xs"), F.col("extra")).alias("evidence")))


@query(f"WITH {CONTEXT_SQL} SELECT conv_id, k, extra, evidence FROM ev")
def evidence_context(spark, d):
    """The evidence that goes on: all, the cited or the best sources, runs as snippets, with their context or without."""
    return evidence(spark, d)


@query(f"WITH {CONTEXT_SQL} SELECT conv_id, evidence FROM ev WHERE k = 'cite' AND NOT extra")
def evidence_cited(spark, d):
    """The cited sources of all statements, flattened, distinct and joined as snippets."""
    return evidence(spark, d).filter("k = 'cite' AND NOT extra").select("conv_id", "evidence")


#: Prompts; {label} is another checker's verdict, which the second stage leaves out where it is a lack of evidence.
VERIFY = "Verify the verdict for the claim.\nClaim: {claim}\nVerdict: {label}\n\nEvidence:\n{evidence}\n\nYour verdict:"
CLASSIFY = "Classify the claim.\nClaim: {claim}\n\nEvidence:\n{evidence}\n\nYour verdict:"
ABSTAIN = "Is the evidence relevant to the claim?\nClaim: {claim}\n\nEvidence:\n{evidence}\n\nVerdict: {label}\n\nYour answer:"
VERDICTS = ("Supported", "Conflicting", "Refuted", "Not Enough Evidence")
LABEL_SQL = "CASE conv_id % 4 WHEN 0 THEN 'Supported' WHEN 1 THEN 'Conflicting' WHEN 2 THEN 'Refuted' ELSE 'Not Enough Evidence' END"
#: From which share of "not enough evidence" on an answer abstains: of four classes, and of the yes/no stage.
ONE_STAGE, TWO_STAGE = 0.7, 0.9


def _prompt_sql(template: str) -> str:
    rest = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return rest.replace("{claim}", "' || claim || '").replace("{label}", "' || label || '").replace("{evidence}", "' || evidence || '")


def _lp_sql(i: int, n: str) -> str:
    return f"CASE WHEN {n} % 11 <> {i + 5} THEN -(({n} * {i + 2}) % 17) / 4.0::DOUBLE END"


def _soft_sql(n: str, labels: int, name: str) -> str:
    raw = ", ".join(f"{_lp_sql(i, n)} AS l{i}" for i in range(labels))
    weights = ", ".join(f"coalesce(exp(l{i} - m), 0::DOUBLE) AS w{i}" for i in range(labels))
    total, most = " + ".join(f"w{i}" for i in range(labels)), ", ".join(f"l{i}" for i in range(labels))
    return f"(SELECT * EXCLUDE ({', '.join(f'w{i}' for i in range(labels))}, {most}, m), {', '.join(f'w{i} / ({total}) AS {name}{i}' for i in range(labels))} FROM (SELECT *, {weights} FROM (SELECT *, greatest({most}) AS m FROM (SELECT *, {raw} FROM {{}}))))"


INSTANCES_SQL = f"""{CONTEXT_SQL}, iv AS (SELECT ev.conv_id, k, claim, {LABEL_SQL.replace("conv_id", "ev.conv_id")} AS label, evidence FROM ev JOIN (SELECT conv_id, s AS claim FROM stm WHERE sent_idx = 0) c ON c.conv_id = ev.conv_id WHERE NOT extra),
ip AS (SELECT conv_id, k, label, len({tok_sql(_prompt_sql(VERIFY).replace("label", "CASE WHEN label = 'Not Enough Evidence' THEN 'Insufficient Evidence' ELSE label END"))}) AS n1, len({tok_sql(_prompt_sql(ABSTAIN))}) AS na,
len({tok_sql(f"CASE WHEN label = 'Not Enough Evidence' THEN {_prompt_sql(CLASSIFY)} ELSE {_prompt_sql(VERIFY)} END")}) AS n2 FROM iv),
one AS {_soft_sql("n1", 4, "p").format("ip")}, two AS {_soft_sql("n2", 3, "q").format(_soft_sql("na", 2, "a").format("ip"))}"""


def instances(spark, d):
    """(conv_id, k, claim, label, evidence): each claim, the first statement, with the evidence of each k."""
    claims = statements(spark, d).filter("sent_idx = 0").select("conv_id", F.col("s").alias("claim"))
    label = F.get(F.array(*map(F.lit, VERDICTS)), (F.col("conv_id") % 4).cast("int"))
    return evidence(spark, d).filter("NOT extra").join(claims, "conv_id").select("conv_id", "k", "claim", label.alias("label"), "evidence")


def one_stage(rows, provider="logprobs"):
    """Adds dist, the four classes' distribution (null where the provider refused), and share, that of the first three."""
    shown = F.when(F.col("label") == VERDICTS[3], "Insufficient Evidence").otherwise(F.col("label"))
    prompt = text.render(VERIFY, claim=F.col("claim"), label=shown, evidence=F.col("evidence"))
    said = rows.withColumn("said", scorers.score_column(scorers.registered(provider, "verdict"), "map<string,double>", prompt))
    out = said.withColumn("dist", judge.verdict_distribution(F.col("said"), ("SUP", "CON", "REF", "NEE"))).drop("said")
    return out.withColumn("share", judge.renormalised(F.col("dist")))


def two_stage(rows, provider="logprobs"):
    """Adds abstain, the yes/no distribution, and share, the three verdicts' by a prompt without the label where that is a lack of evidence."""
    fill = {c: F.col(c) for c in ("claim", "label", "evidence")}
    second = F.when(F.col("label") == VERDICTS[3], text.render(CLASSIFY, claim=fill["claim"], evidence=fill["evidence"])).otherwise(text.render(VERIFY, **fill))
    ask = lambda name, prompt, by="logprobs": scorers.score_column(scorers.registered(by, name), "map<string,double>", prompt)
    out = rows.withColumns({"said_a": ask("abstain", text.render(ABSTAIN, **fill)), "said_v": ask("verdict_3", second, provider)})
    return out.withColumns({"abstain": judge.verdict_distribution(F.col("said_a"), ("yes", "no")), "share": judge.verdict_distribution(F.col("said_v"), ("SUP", "CON", "REF"))}).drop("said_a", "said_v")


@query(f"""WITH {INSTANCES_SQL} SELECT conv_id, k, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p0 / (p0 + p1 + p2), 6) AS r0, round(p1 / (p0 + p1 + p2), 6) AS r1, round(p2 / (p0 + p1 + p2), 6) AS r2,
round(p3, 9) >= {ONE_STAGE} AS abstains FROM one""")
def verdict_one_stage(spark, d):
    rows = one_stage(instances(spark, d))
    return rows.select("conv_id", "k", *[F.round(F.get("dist", F.lit(i)), 6).alias(f"p{i}") for i in range(4)], *[F.round(F.get("share", F.lit(i)), 6).alias(f"r{i}") for i in range(3)], (F.round(F.get("dist", F.lit(3)), 9) >= ONE_STAGE).alias("abstains"))


@query(f"""WITH {INSTANCES_SQL} SELECT conv_id, k, round(a1, 6) AS no, round(q0, 6) AS r0, round(q1, 6) AS r1, round(q2, 6) AS r2, round(a1, 9) >= {TWO_STAGE} AS abstains FROM two""")
def verdict_two_stage(spark, d):
    """First whether to abstain, then one of three verdicts."""
    rows = two_stage(instances(spark, d))
    return rows.select("conv_id", "k", F.round(F.get("abstain", F.lit(1)), 6).alias("no"), *[F.round(F.get("share", F.lit(i)), 6).alias(f"r{i}") for i in range(3)], (F.round(F.get("abstain", F.lit(1)), 9) >= TWO_STAGE).alias("abstains"))


#: Stands for the true label.
TRUTH = "((conv_id * 7 + 1) % 4)"
JUDGED_SQL = f"""{INSTANCES_SQL}, vj AS (SELECT 'one_stage' AS method, k, {TRUTH}::INT AS t, n1 % {scorers.REFUSED} <> 0 AS ok, round(p3, 9) >= {ONE_STAGE} AS ab, round(p0 / (p0 + p1 + p2), 9) AS x0, round(p1 / (p0 + p1 + p2), 9) AS x1, round(p2 / (p0 + p1 + p2), 9) AS x2 FROM one
UNION ALL SELECT 'two_stage', k, {TRUTH}::INT, n2 % {scorers.REFUSED} <> 0, round(a1, 9) >= {TWO_STAGE}, round(q0, 9), round(q1, 9), round(q2, 9) FROM two),
vb AS (SELECT *, CASE WHEN ab THEN 3 WHEN x0 >= x1 AND x0 >= x2 THEN 0 WHEN x1 >= x2 THEN 1 ELSE 2 END::INT AS p FROM vj),
cc AS (SELECT method, k, cls, count(*) FILTER (WHERE ok AND t = cls AND p = cls) AS tp, count(*) FILTER (WHERE ok AND t <> cls AND p = cls) AS fp, count(*) FILTER (WHERE ok AND t = cls AND p <> cls) AS fn FROM vb, (SELECT unnest([0, 1, 2, 3]) AS cls) GROUP BY ALL),
cr AS (SELECT method, k, cls, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, tp + fn AS support FROM cc)"""


def judged(spark, d):
    """(method, k, t, p, ab, x): truth, prediction, whether it abstains, and the three classes' distribution; refused answers are null."""
    rows, truth, provider = instances(spark, d), F.expr(TRUTH).cast("int"), "logprobs_filtered"
    rounded = F.transform("share", lambda x: F.round(x, 9))
    a = one_stage(rows, provider).select(F.lit("one_stage").alias("method"), "k", truth.alias("t"), (F.round(F.get("dist", F.lit(3)), 9) >= ONE_STAGE).alias("ab"), rounded.alias("x"))
    b = two_stage(rows, provider).select(F.lit("two_stage").alias("method"), "k", truth.alias("t"), (F.round(F.get("abstain", F.lit(1)), 9) >= TWO_STAGE).alias("ab"), rounded.alias("x"))
    return a.unionByName(b).withColumn("p", F.when(F.col("ab"), 3).otherwise(judge.argmax(F.col("x"))))


MEANS = [f"{how}_{c}" for how in ("macro", "weighted") for c in ("precision", "recall", "f1")]


@query(f"""WITH {JUDGED_SQL}, o AS (SELECT * FROM vb WHERE ok AND NOT ab AND t <> 3), m AS (SELECT method, k, count(*) FILTER (WHERE ok) AS n, count(*) FILTER (WHERE ok AND ab) AS abstained, count(*) FILTER (WHERE ok AND t = 3) AS unanswerable,
count(*) FILTER (WHERE ok AND (ab OR t = 3)) AS either, count(*) FILTER (WHERE NOT ok) AS invalid, round(avg((t = p)::INT) FILTER (WHERE ok), 6) AS accuracy FROM vb GROUP BY ALL),
e AS (SELECT method, k, round(avg((t - p) * (t - p)::DOUBLE), 6) AS mse, round(avg((power((t < 1)::INT - x0, 2) + power((t < 2)::INT - (x0 + x1), 2)) / 2), 6) AS mean_rps FROM o GROUP BY ALL),
g AS (SELECT method, k, {", ".join(f"round(avg({c}), 6) AS macro_{c}, round(CASE WHEN sum(support) > 0 THEN sum({c} * support) / sum(support) END, 6) AS weighted_{c}" for c in ("precision", "recall", "f1"))} FROM cr GROUP BY ALL),
ka AS (SELECT method, k, c, row_number() OVER (PARTITION BY method, k ORDER BY c) AS i FROM (SELECT method, k, t AS c FROM o UNION SELECT method, k, p FROM o)),
kt AS (SELECT o.method, o.k, i, count(*)::DOUBLE AS n FROM o JOIN ka ON ka.method = o.method AND ka.k = o.k AND c = t GROUP BY ALL), kp AS (SELECT o.method, o.k, i, count(*)::DOUBLE AS n FROM o JOIN ka ON ka.method = o.method AND ka.k = o.k AND c = p GROUP BY ALL),
kx AS (SELECT kt.method, kt.k, sum(kt.n * kp.n * (kt.i - kp.i) * (kt.i - kp.i)) AS expected FROM kt JOIN kp ON kp.method = kt.method AND kp.k = kt.k GROUP BY ALL),
ks AS (SELECT o.method, o.k, sum((a.i - b.i) * (a.i - b.i))::DOUBLE * count(*) AS seen FROM o JOIN ka a ON a.method = o.method AND a.k = o.k AND a.c = t JOIN ka b ON b.method = o.method AND b.k = o.k AND b.c = p GROUP BY ALL),
kk AS (SELECT kx.method, kx.k, CASE WHEN expected > 0 THEN round(1 - seen / expected, 6) END AS kappa FROM kx JOIN ks ON ks.method = kx.method AND ks.k = kx.k)
SELECT m.method, m.k, n, invalid, abstained, unanswerable, either, accuracy, {", ".join(MEANS)}, kappa, mse, mean_rps FROM m LEFT JOIN e ON e.method = m.method AND e.k = m.k JOIN g ON g.method = m.method AND g.k = m.k LEFT JOIN kk ON kk.method = m.method AND kk.k = m.k""")
def verification_metrics(spark, d):
    """Per method and k: refused answers dropped and counted, abstention, accuracy, macro and weighted means over four classes, kappa and ordinal metrics over the rest."""
    shown = [F.round(c, 6).alias(c) for c in ("accuracy", *MEANS, "kappa", "mse", "mean_rps")]
    return metrics.verification_report(judged(spark, d), ["method", "k"]).select("method", "k", "n", "invalid", "abstained", "unanswerable", "either", *shown)


@query(f"WITH {JUDGED_SQL} SELECT method, k, cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM cr")
def verification_classes(spark, d):
    """Per method, k and class: precision, recall, F1 and support of the answers that weren't refused."""
    rounded = {c: F.round(c, 6) for c in ("precision", "recall", "f1")}
    return metrics.class_report(judged(spark, d), ["method", "k"]).withColumns(rounded)


@query(f"""WITH {RUNS_SQL} SELECT conv_id, CASE len({tok_sql("j")}) % 4 WHEN 0 THEN 'Supported' WHEN 1 THEN 'Conflicting' WHEN 2 THEN 'Refuted' ELSE 'Not Enough Evidence' END AS label FROM (SELECT conv_id, string_agg(s, ' ' ORDER BY sent_idx) AS j FROM stm GROUP BY conv_id)""")
def veracity_label(spark, d):
    """The label that a model reads from a justification, one of the allowed four or null."""
    whole = statements(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "s"))), lambda x: x["s"]), " ").alias("j"))
    said = scorers.score_column(scorers.label_writer(VERDICTS), "string", F.col("j"))
    return whole.select("conv_id", said.alias("said")).select("conv_id", F.when(F.col("said").isin(*VERDICTS), F.col("said")).alias("label"))


CITED_SQL = f"""{SELECT_SQL}, {SPACED_SQL}, fm AS (SELECT m.conv_id, m.sent_idx, m.s AS statement, ct.span_rank, ct.lo, ct.hi, round(ct.span_score, 6) AS score,
string_agg(CASE WHEN x.source_idx < lo OR x.source_idx > hi THEN NULL WHEN x.source_idx < hi THEN x.s || sep ELSE x.s END, '' ORDER BY x.source_idx) AS cite,
coalesce(string_agg(CASE WHEN x.source_idx < greatest(lo - 2, 0) OR x.source_idx >= lo THEN NULL WHEN x.source_idx < lo - 1 THEN x.s || sep ELSE x.s END, '' ORDER BY x.source_idx), '') AS pre_context,
coalesce(string_agg(CASE WHEN x.source_idx <= hi OR x.source_idx > least(hi + 2, n - 2) THEN NULL WHEN x.source_idx < least(hi + 2, n - 2) THEN x.s || sep ELSE x.s END, '' ORDER BY x.source_idx), '') AS post_context
FROM stm m LEFT JOIN ct ON ct.conv_id = m.conv_id AND ct.sent_idx = m.sent_idx LEFT JOIN sp0 x ON x.conv_id = ct.conv_id LEFT JOIN nn ON nn.conv_id = ct.conv_id GROUP BY m.conv_id, m.sent_idx, m.s, ct.span_rank, ct.lo, ct.hi, ct.span_score, n)"""


def formatted(spark, d):
    """(idx, dataset, claim, label, statements): the nested document that evaluation starts from."""
    cited = _citations(spark, d).withColumn("span_score", F.round("span_score", 6))
    label = F.get(F.array(*map(F.lit, VERDICTS)), (F.col("idx") % 4).cast("int"))
    return presentation.formatted_results(statements(spark, d), cited, spaced_sources(spark, d), "conv_id").withColumns({"dataset": F.lit("conversations"), "label": label})


@query(f"""WITH {CITED_SQL} SELECT conv_id AS idx, {LABEL_SQL} AS label, sent_idx, statement, coalesce(span_rank - 1, -1) AS cite_pos, cite, coalesce(lo, -1) AS lo, coalesce(hi, -1) AS hi, score, CASE WHEN lo IS NOT NULL THEN pre_context END AS pre_context, CASE WHEN lo IS NOT NULL THEN post_context END AS post_context FROM fm""")
def formatted_results(spark, d):
    """Statements with their citations: text, span, score and the context around it; shown a row a citation, statements without one kept (with -1 for place and span)."""
    rows = formatted(spark, d).select("idx", "label", F.posexplode("statements").alias("sent_idx", "st"))
    each = rows.select("idx", "label", F.col("sent_idx").cast("long").alias("sent_idx"), "st.statement", F.posexplode_outer("st.citation").alias("cite_pos", "c"))
    return each.select("idx", "label", "sent_idx", "statement", F.coalesce(F.col("cite_pos").cast("long"), F.lit(-1)).alias("cite_pos"), "c.cite", F.coalesce(F.get("c.span", F.lit(0)), F.lit(-1)).alias("lo"), F.coalesce(F.get("c.span", F.lit(1)), F.lit(-1)).alias("hi"), "c.score", "c.pre_context", "c.post_context")


#: Stands for the judge's scores: support of a statement, relevance of a citation.
SUPPORT, RELEVANT = "(sent_idx % 3) / 2.0", "((lo + sent_idx) % 2)"
ESCAPE_SQL = "replace(replace(replace(replace(replace(replace(replace({}, '&', '&amp;'), '''', '&apos;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>'), '$', '&#36;')"
SPAN_SQL = "CASE WHEN lo = hi THEN '[' || lo || ']' ELSE '[' || lo || '-' || hi || ']' END"


@query(f"""WITH {CITED_SQL}, h AS (SELECT conv_id, sent_idx, '<span style=''background-color: ' || CASE sent_idx % 3 WHEN 2 THEN '#c8f7c5' WHEN 1 THEN '#fdf7c3' ELSE '#f7c5c5' END || ';''>' || {ESCAPE_SQL.format("statement")} || '</span> ' ||
coalesce(string_agg(CASE WHEN lo IS NOT NULL THEN '<span style=''color: ' || CASE {RELEVANT} WHEN 1 THEN '#1b8d36' ELSE '#cc1414' END || ';''>' || {SPAN_SQL} || '</span>' END, '' ORDER BY span_rank), '') AS part FROM fm GROUP BY conv_id, sent_idx, statement)
SELECT conv_id AS idx, chr(10) || string_agg(part || chr(10) || chr(10), '' ORDER BY sent_idx) AS html FROM h GROUP BY conv_id""")
def answer_html(spark, d):
    """The answer with statements coloured by support and citation marks by relevance."""
    scored = presentation.with_scores(formatted(spark, d), lambda i: (i % 3) / 2.0, lambda i, c: (F.get(c["span"], F.lit(0)) + i) % 2)
    return scored.select("idx", presentation.answer_html(F.col("statements")).alias("html"))


@query(f"""WITH {CITED_SQL}, c AS (SELECT conv_id, sent_idx, span_rank, '<div class="evidence-card"><div class="evidence-title"><span style=''color: ' || CASE {RELEVANT} WHEN 1 THEN '#1b8d36' ELSE '#cc1414' END || ';''>' || CASE {RELEVANT} WHEN 1 THEN 'Relevant' ELSE 'Irrelevant' END || '</span><span>Score: ' || CASE WHEN score <> 0 THEN printf('%.2f', round(score, 2)) ELSE '-' END ||
'</span></div><div class="evidence-title"><span>Evidence snippet ' || {SPAN_SQL} || '</span></div><div class="evidence-content">' || {ESCAPE_SQL.format("cite")} || '</div></div>' AS card FROM fm WHERE lo IS NOT NULL)
SELECT conv_id AS idx, '<div class="evidence-container">' || string_agg(CASE WHEN span_rank = 1 THEN '<div class="statement-header">Statement ' || (sent_idx + 1) || ':</div>' ELSE '' END || card, '' ORDER BY sent_idx, span_rank) || '</div>' AS html FROM c GROUP BY conv_id""")
def evidence_html(spark, d):
    """A card for each citation under its statement's heading; answers without citations have no rows."""
    scored = presentation.with_scores(formatted(spark, d), lambda i: (i % 3) / 2.0, lambda i, c: (F.get(c["span"], F.lit(0)) + i) % 2)
    return scored.filter(F.exists("statements", lambda s: F.size(s["citation"]) > 0)).select("idx", presentation.evidence_html(F.col("statements")).alias("html"))
