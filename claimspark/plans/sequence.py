"""Statements and sources: sentences, spans, windows, citation selection, context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequences, text, tokenizers
from ..operators import alignment, attribution, boundaries, citations, metrics
from .bindings import HOLDS_SQL, SCORES_SQL, SENTENCES_SQL, cut_sql, held_sql, overlap_scores, sent_sql, sources, statements, table, tok_sql
from .registry import query

INSTANCE = ["conv_id", "sent_idx"]
#: Lexical scores are shares of a statement's words; these thresholds fit them.
LEXICAL = citations.CitationParams(t=0.1, p=0.7, k=4, n=3)
SPANS_SQL = f"""{SCORES_SQL},
k0 AS (SELECT *, source_idx - row_number() OVER (PARTITION BY conv_id, sent_idx ORDER BY source_idx) AS island FROM sc WHERE score >= 0.1),
k1 AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, sent_idx, island ORDER BY source_idx) - 1) // 3 AS cut FROM k0),
sp AS (SELECT conv_id, sent_idx, min(source_idx) AS lo, max(source_idx) AS hi, max(score) AS span_score FROM k1 GROUP BY conv_id, sent_idx, island, cut)"""
SELECT_SQL = f"""{SPANS_SQL},
p0 AS (SELECT *, exp(span_score / max(span_score) OVER (PARTITION BY conv_id, sent_idx)) AS w FROM sp),
p1 AS (SELECT conv_id, sent_idx, lo, hi, span_score, round(w / sum(w) OVER (PARTITION BY conv_id, sent_idx), 9) AS prob FROM p0),
p2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, sent_idx ORDER BY prob DESC, lo DESC) AS span_rank,
 coalesce(sum(prob) OVER (PARTITION BY conv_id, sent_idx ORDER BY prob DESC, lo DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p1),
ct AS (SELECT conv_id, sent_idx, span_rank, lo, hi, span_score, prob FROM p2 WHERE round(before, 6) < 0.7 AND span_rank <= 4)"""


def _citations(spark, d):
    return citations.select_citations(overlap_scores(spark, d), INSTANCE, LEXICAL)


@query(f"WITH {SENTENCES_SQL} SELECT conv_id, sent_idx, s FROM stm")
def sentence_split(spark, d):
    return statements(spark, d)


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest({sent_sql('text')}) AS s FROM documents) GROUP BY doc_id HAVING count(*) >= 5")
def sentence_count_filter(spark, d):
    """Documents of five sentences or more."""
    return text.once(table(spark, d, "documents"), "n", F.size(text.sentences(F.col("text"))).cast("long")).select("doc_id", "n").filter("n >= 5")


#: A word as `operators.boundaries` sees it: other signs off its ends, one mark off its end, small letters.
BARE_SQL = "regexp_replace(t, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}.!?]+$', '', 'g')"
TIMES_SQL = "CASE WHEN {k} = 0 THEN 0 ELSE ({k}) * ln({p}) END"


def association_sql(a: str, b: str, both: str, total: str) -> str:
    a, b, both, total = (f"({x})::DOUBLE" for x in (a, b, both, total))
    times = lambda k, p: TIMES_SQL.format(k=k, p=p)
    ks = (both, f"{a} - {both}", f"{b} - {both}", f"{total} - {a} - {b} + {both}")
    p, p1, p2 = f"{b} / {total}", f"{both} / {a}", f"({b} - {both}) / ({total} - {a})"
    chance = [times(k, q) for k, q in zip(ks, (p, f"1 - {p}", p, f"1 - {p}"), strict=True)]
    bound = [times(k, q) for k, q in zip(ks, (p1, f"1 - {p1}", p2, f"1 - {p2}"), strict=True)]
    return f"round(-2 * ({' + '.join(chance)} - ({' + '.join(bound)})), 6)"


BOUNDARIES_SQL = f"""w0 AS (SELECT doc_id, list_transform({tok_sql("text")}, lambda t: {BARE_SQL}) AS ts FROM documents),
w1 AS (SELECT unnest(ts) AS t, unnest(list_append(ts[2:], NULL)) AS f FROM w0),
w2 AS (SELECT lower(regexp_replace(t, '[.!?]$', '')) AS word, t LIKE '%.' AS period, regexp_matches(t, '[.!?]$') AS ends, lower(regexp_replace(f, '[.!?]$', '')) AS follower FROM w1),
w3 AS (SELECT * FROM w2 WHERE regexp_matches(word, '{boundaries.WORD}')),
wc AS (SELECT word, count(*) AS n, count(*) FILTER (WHERE period) AS k, length(replace(word, '.', '')) AS letters FROM w3 GROUP BY word),
tt AS (SELECT sum(n)::DOUBLE AS total, sum(k)::DOUBLE AS periods FROM wc),
ab AS (SELECT * FROM (SELECT word, round(-2 * (k * ln(periods / total) + (n - k) * ln(1 - periods / total) - k * ln(0.99::DOUBLE) - (n - k) * ln(0.01::DOUBLE)) * exp(-letters) * (length(word) - letters + 1) * pow(letters, -(n - k)), 6) AS score FROM wc, tt WHERE k > 0 AND periods < total) WHERE score >= {boundaries.ABBREVIATION}),
en AS (SELECT w3.*, period AND (ab.word IS NOT NULL OR length(w3.word) = 1) AS short FROM w3 LEFT JOIN ab ON ab.word = w3.word WHERE ends),
s0 AS (SELECT follower AS word, count(*) AS first FROM en WHERE NOT short AND regexp_matches(follower, '{boundaries.WORD}') GROUP BY ALL),
st AS (SELECT word, score FROM (SELECT s0.word, {association_sql("e", "n", "first", "total")} AS score FROM s0 JOIN wc ON wc.word = s0.word, tt, (SELECT count(*) AS e FROM en WHERE NOT short) WHERE total * first > n * e) WHERE score >= {boundaries.STARTER}),
b0 AS (SELECT word, follower, count(*) AS met FROM en WHERE short AND regexp_matches(follower, '{boundaries.WORD}') GROUP BY ALL HAVING count(*) > 1),
pr AS (SELECT word, follower, score FROM (SELECT b0.word, b0.follower, {association_sql("x.n", "y.n", "met", "total")} AS score FROM b0 JOIN wc x ON x.word = b0.word JOIN wc y ON y.word = b0.follower, tt WHERE total * met > x.n * y.n) WHERE score >= {boundaries.PAIR})"""
LEARNED = ("abbreviations", "starters", "pairs")


@query(f"WITH {BOUNDARIES_SQL} SELECT 'abbreviations' AS kind, word, NULL AS follower, score FROM ab UNION ALL SELECT 'starters', word, NULL, score FROM st UNION ALL SELECT 'pairs', word, follower, score FROM pr")
def boundary_model(spark, d):
    """What the documents teach about sentence ends: abbreviations, words that begin sentences, pairs around a period."""
    found = boundaries.learn(table(spark, d, "documents"))
    out = None
    for kind in LEARNED:
        rows = found[kind].select(F.lit(kind).alias("kind"), "word", (F.col("follower") if kind == "pairs" else F.lit(None).cast("string")).alias("follower"), "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def trained_sql() -> str:
    held = held_sql("coalesce(text, '')", "pa")
    held = f"regexp_replace({held}, ps, '.\\1\\2\\3', 'g')"
    held = f"list_reduce(list_concat([{held}], pp), lambda t, p: {held_sql('t', 'p')})"
    for pattern in HOLDS_SQL:
        held = held_sql(held, pattern)
    return cut_sql(held)


@query(rf"""WITH {BOUNDARIES_SQL}, m AS (SELECT coalesce((SELECT '(^|[^\p{{L}}\p{{N}}.])((?i:' || string_agg(replace(word, '.', '\.'), '|' ORDER BY word) || '))\.(\s)' FROM ab), chr(31) || chr(31)) AS pa,
coalesce((SELECT chr(30) || '(\s+)(' || string_agg(upper(word[1]) || replace(word, '.', '\.')[2:], '|' ORDER BY word) || ')([^\p{{L}}]|$)' FROM st), chr(31) || chr(31)) AS ps,
coalesce((SELECT list('(^|[^\p{{L}}\p{{N}}.])((?i:' || replace(word, '.', '\.') || '))\.(\s+(?i:' || replace(follower, '.', '\.') || ')(?:[^\p{{L}}]|$))') FROM pr WHERE follower IN (SELECT word FROM st)), []::VARCHAR[]) AS pp),
z AS (SELECT doc_id, string_split({trained_sql()}, chr(31)) AS ps FROM documents, m),
y AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM z),
x AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) - length(p) + length(p) - length(regexp_replace(p, '^\s+', '')) AS start, regexp_replace(p, '^\s+|\s+$', '', 'g') AS s FROM y)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sent_idx, start::INT AS start, (start + length(s))::INT AS "end", s FROM x WHERE s <> ''""")
def trained_sentences(spark, d):
    """Sentences of the documents by boundaries learned from all of them, and their places."""
    docs = table(spark, d, "documents")
    model = boundaries.patterns(*boundaries.learn(docs).values())
    rows = boundaries.placed(docs.select("doc_id", "text"), "text", model, "xs")
    found = rows.select("doc_id", F.posexplode_outer("xs").alias("sent_idx", "x")).filter("sent_idx IS NOT NULL")
    return found.select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), "x.start", "x.end", "x.s")


@query(f"WITH {SCORES_SQL} SELECT conv_id, sent_idx, source_idx, round(score, 6) AS score FROM sc")
def entailment_attr(spark, d):
    """Naive attribution: each statement against each source of its instance."""
    return overlap_scores(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH {SPANS_SQL} SELECT conv_id, sent_idx, lo, hi, round(span_score, 6) AS span_score FROM sp")
def citation_spans(spark, d):
    return citations.spans(overlap_scores(spark, d), INSTANCE, LEXICAL).withColumn("span_score", F.round("span_score", 6))


@query(f"WITH {SELECT_SQL} SELECT conv_id, sent_idx, span_rank, lo, hi, round(span_score, 6) AS span_score, round(prob, 6) AS prob FROM ct")
def citation_select(spark, d):
    """The flagship: scores to discrete cited spans."""
    return _citations(spark, d).select(*INSTANCE, "span_rank", "lo", "hi", F.round("span_score", 6).alias("span_score"), F.round("prob", 6).alias("prob"))


@query(f"WITH {SELECT_SQL} SELECT m.conv_id, m.sent_idx, count(span_rank) AS n_spans, coalesce(sum(hi - lo + 1), 0)::BIGINT AS n_cited FROM stm m LEFT JOIN ct ON ct.conv_id = m.conv_id AND ct.sent_idx = m.sent_idx GROUP BY ALL")
def citation_counts(spark, d):
    """Statements without citation stay, with zero."""
    found = _citations(spark, d).groupBy(*INSTANCE).agg(F.count("*").alias("n"), F.sum(F.col("hi") - F.col("lo") + 1).alias("c"))
    return statements(spark, d).select(*INSTANCE).join(found, INSTANCE, "left").select(*INSTANCE, F.coalesce("n", F.lit(0)).alias("n_spans"), F.coalesce("c", F.lit(0)).alias("n_cited"))


@query(f"""WITH {SELECT_SQL}, n AS (SELECT conv_id, count(*) AS n FROM src GROUP BY conv_id),
b AS (SELECT ct.conv_id, sent_idx, span_rank, lo, hi, greatest(lo - 2, 0) AS plo, least(hi + 2, n - 2) AS phi FROM ct JOIN n ON n.conv_id = ct.conv_id)
SELECT b.conv_id, sent_idx, span_rank, string_agg(CASE WHEN source_idx BETWEEN lo AND hi THEN s END, ' ' ORDER BY source_idx) AS cite,
string_agg(CASE WHEN source_idx >= plo AND source_idx < lo THEN s END, ' ' ORDER BY source_idx) AS pre, string_agg(CASE WHEN source_idx > hi AND source_idx <= phi THEN s END, ' ' ORDER BY source_idx) AS post
FROM b JOIN src ON src.conv_id = b.conv_id GROUP BY b.conv_id, sent_idx, span_rank""")
def citation_neighbourhood(spark, d):
    """Cited text and the context around it; the last source never counts as context after."""
    src = sources(spark, d)
    packed = src.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("source_idx", "s"))).alias("xs"))  # one conversation's sentences
    rows = _citations(spark, d).join(packed, "conv_id")
    b = citations.neighbourhood(F.col("lo"), F.col("hi"), F.size("xs"))
    part = lambda lo, hi: F.nullif(F.array_join(F.transform(F.filter("xs", lambda x: (x["source_idx"] >= lo) & (x["source_idx"] <= hi)), lambda x: x["s"]), " "), F.lit(""))
    return rows.select(*INSTANCE, "span_rank", part(F.col("lo"), F.col("hi")).alias("cite"), part(b["pre_lo"], b["pre_hi"]).alias("pre"), part(b["post_lo"], b["post_hi"]).alias("post"))


@query(f"""WITH {SELECT_SQL} SELECT conv_id, label, row_number() OVER (PARTITION BY conv_id ORDER BY first_at, label) AS number FROM (SELECT conv_id, CASE WHEN lo = hi THEN '[' || lo || ']' ELSE '[' || lo || '-' || hi || ']' END AS label, min(sent_idx * 10 + span_rank) AS first_at FROM ct GROUP BY ALL)""")
def first_seen_citation_numbers(spark, d):
    rows = _citations(spark, d).select("conv_id", citations.citation_label(F.col("lo"), F.col("hi")).alias("label"), (F.col("sent_idx") * 10 + F.col("span_rank")).alias("at"))
    return citations.first_seen_numbers(rows, "conv_id", "label", "at")


@query(f"""WITH {SCORES_SQL}, m AS (SELECT conv_id, source_idx, max(score) AS score FROM sc GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 6) DESC, source_idx DESC) AS rk FROM m)
SELECT conv_id, string_agg(source_idx::VARCHAR, ',' ORDER BY rk DESC) AS picked FROM r WHERE rk <= 5 GROUP BY conv_id""")
def pooled_top_sources(spark, d):
    """The five best sources over all statements, in rising score."""
    pooled = overlap_scores(spark, d).groupBy("conv_id", "source_idx").agg(F.round(F.max("score"), 6).alias("score"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("source_idx"))
    top = pooled.withColumn("rk", F.row_number().over(order)).filter("rk <= 5")
    return top.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rk")).alias("k"), F.col("source_idx").cast("string").alias("i")))), lambda x: x["i"]), ",").alias("picked"))


@query(f"""WITH {SELECT_SQL}, n AS (SELECT conv_id, count(*) AS n FROM src GROUP BY conv_id), c AS (SELECT DISTINCT conv_id, unnest(range(lo, hi + 1)) AS i FROM ct)
SELECT conv_id, source_idx FROM src WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = src.conv_id AND c.i = source_idx)""")
def uncited_sources(spark, d):
    cited = _citations(spark, d).select("conv_id", F.explode(F.sequence("lo", "hi")).alias("source_idx")).distinct()
    return sources(spark, d).select("conv_id", "source_idx").join(cited, ["conv_id", "source_idx"], "left_anti")


@query(f"""WITH {SENTENCES_SQL}, p AS (SELECT conv_id, count(*) AS n, list(s ORDER BY source_idx) AS xs FROM src GROUP BY conv_id)
SELECT conv_id, w::BIGINT AS w, array_to_string(xs[greatest(w - 2, 0) + 1 : least(w + 1, n)], ' ') AS win FROM (SELECT conv_id, n, xs, unnest(range(n + 2)) AS w FROM p)""")
def context_windows(spark, d):
    """Windows of three sources, clipped at both ends."""
    packed = sources(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_idx", "s"))), lambda x: x["s"]).alias("xs"))
    return packed.select("conv_id", F.posexplode(sequences.windows(F.col("xs"), 3)).alias("w", "win")).select("conv_id", F.col("w").cast("long").alias("w"), F.array_join("win", " ").alias("win"))


@query(f"""WITH {SENTENCES_SQL}, p AS (SELECT conv_id, count(*) AS n, list(s ORDER BY source_idx) AS xs FROM src GROUP BY conv_id),
w AS (SELECT conv_id, n, w, array_to_string(xs[greatest(w - 2, 0) + 1 : least(w + 1, n)], ' ') AS win FROM (SELECT conv_id, n, xs, unnest(range(n + 2)) AS w FROM p)),
sw AS (SELECT m.conv_id, m.sent_idx, w.w, n, CASE WHEN len({tok_sql("m.s")}) = 0 THEN 0::DOUBLE ELSE len(list_intersect(list_distinct({tok_sql("m.s")}), {tok_sql("w.win")}))::DOUBLE / len(list_distinct({tok_sql("m.s")})) END AS score FROM stm m JOIN w ON w.conv_id = m.conv_id)
SELECT conv_id, sent_idx, w AS source_idx, round(a, 6) AS score FROM (SELECT *, avg(score) OVER (PARTITION BY conv_id, sent_idx ORDER BY w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS a FROM sw) WHERE w < n""")
def entailment_window_attr(spark, d):
    """A source's score is the mean over the three windows that hold it."""
    packed = sources(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_idx", "s"))), lambda x: x["s"]).alias("xs"))
    wins = packed.select("conv_id", F.size("xs").alias("n"), F.posexplode(sequences.windows(F.col("xs"), 3)).alias("w", "win")).withColumn("win", text.tokens(F.array_join("win", " ")))
    rows = statements(spark, d).select(*INSTANCE, text.tokens(F.col("s")).alias("st")).join(wins, "conv_id").withColumn("score", text.overlap(F.col("st"), F.col("win")))
    return attribution.window_means(rows, INSTANCE, "w", "score", 3, "n").select(*INSTANCE, F.col("w").cast("long").alias("source_idx"), F.round("score", 6).alias("score"))


@query(f"""WITH {SENTENCES_SQL}, j AS (SELECT conv_id, string_agg(s, ' ' ORDER BY source_idx) AS t FROM src GROUP BY conv_id),
o AS (SELECT conv_id, source_idx, s, coalesce(sum(length(s) + 1) OVER (PARTITION BY conv_id ORDER BY source_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM src)
SELECT conv_id, source_idx, start::INT AS start, (start + length(s))::INT AS "end" FROM o""")
def statement_char_spans(spark, d):
    """Each source found in the joined text from the previous one's end on."""
    packed = sources(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_idx", "s"))), lambda x: x["s"]).alias("xs"))
    found = packed.select("conv_id", F.posexplode(sequences.chained_find(F.array_join("xs", " "), F.col("xs"))).alias("i", "x"))
    return found.select("conv_id", F.col("i").cast("long").alias("source_idx"), "x.start", "x.end")


@query(f"""WITH {SENTENCES_SQL} SELECT conv_id, string_agg('<C' || source_idx || '>' || s, ' ' ORDER BY source_idx) AS context FROM src GROUP BY conv_id""")
def marked_context(spark, d):
    packed = sources(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("source_idx", "s"))).alias("xs"))
    return packed.select("conv_id", F.array_join(F.transform("xs", lambda x: F.concat(F.lit("<C"), x["source_idx"].cast("string"), F.lit(">"), x["s"])), " ").alias("context"))


@query(f"""WITH {SENTENCES_SQL} SELECT conv_id, coalesce(string_agg(CASE WHEN source_idx % 3 <> 1 THEN s END, ' ' ORDER BY source_idx), '') AS kept FROM src GROUP BY conv_id""")
def masked_context(spark, d):
    """The context without the masked sources; kept parts keep their separators."""
    packed = sources(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("source_idx", "s"))).alias("xs"))
    part = lambda f: F.transform("xs", f)
    return packed.select("conv_id", sequences.kept_text(part(lambda x: x["s"]), part(lambda x: F.lit(" ")), part(lambda x: x["source_idx"] % 3 != 1)).alias("kept"))


#: The tokens of each answer, its statements joined by blanks, and the log-probability of one, here of its length and place.
TOKENS_SQL = rf"""{SENTENCES_SQL}, an AS (SELECT conv_id, string_agg(s, ' ' ORDER BY sent_idx) AS t FROM stm GROUP BY conv_id),
pc AS (SELECT conv_id, unnest(ps) AS token, unnest(range(len(ps))) AS i FROM (SELECT conv_id, regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_ \t\n\f\r]|[ \t\n\f\r]+') AS ps FROM an)),
po AS (SELECT *, regexp_matches(token, '^[^ \t\n\f\r]') AS is_token, sum(length(token)) OVER (PARTITION BY conv_id ORDER BY i) - length(token) AS start FROM pc),
tn AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS token_idx, token, start::BIGINT AS start, (start + length(token))::BIGINT AS "end" FROM po WHERE is_token)"""


def answers(spark, d):
    """(conv_id, t): the answer of each instance."""
    packed = statements(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "s"))).alias("xs"))
    return packed.select("conv_id", F.array_join(F.transform("xs", lambda x: x["s"]), " ").alias("t"))


@query(f"WITH {TOKENS_SQL} SELECT * FROM tn")
def token_spans(spark, d):
    """The characters of every token of an answer."""
    return alignment.token_spans(answers(spark, d), ["conv_id"], "t", tokenizers.REGISTRY["marks"])


@query(f"""WITH {TOKENS_SQL}, sx AS (SELECT conv_id, sent_idx, length(s) AS w, sum(length(s) + 1) OVER (PARTITION BY conv_id ORDER BY sent_idx) - length(s) - 1 AS start FROM stm)
SELECT sx.conv_id, sent_idx, min(token_idx) AS first, max(token_idx) + 1 AS last, count(token_idx) AS n, round(coalesce(sum(-ln(1 + exp(-(length(token) % 5 - (token_idx % 3) / 2.0::DOUBLE)))), 0), 6) AS log_prob
FROM sx LEFT JOIN tn ON tn.conv_id = sx.conv_id AND tn.start >= sx.start AND tn.start < sx.start + w GROUP BY ALL""")
def statement_token_slices(spark, d):
    """The tokens of every statement in its answer, and their log-probability."""
    logit = F.length("token") % 5 - (F.col("token_idx") % 3) / 2.0
    tokens = token_spans(spark, d).withColumn("log_prob", metrics.log_prob(logit))
    packed = answers(spark, d).join(statements(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "s"))), lambda x: x["s"]).alias("xs")), "conv_id")
    found = packed.select("conv_id", F.posexplode(sequences.chained_find(F.col("t"), F.col("xs"))).alias("sent_idx", "x"))
    spans = found.select("conv_id", F.col("sent_idx").cast("long").alias("sent_idx"), F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"))
    return alignment.span_slices(tokens, spans, ["conv_id"], "sent_idx", "log_prob").withColumn("log_prob", F.round("log_prob", 6))


@query(f"""WITH {SCORES_SQL} SELECT conv_id AS instance_idx, method, sent_idx, k, source_idx, CASE WHEN k = 'any' THEN (score > 0)::INT::DOUBLE ELSE round(score, 6) END AS score
FROM sc, (VALUES ('entailment', NULL), ('posthoc', 'raw'), ('posthoc', 'any')) v(method, k)""")
def nested_documents(spark, d):
    """Scores of instances written as nested documents, a method's with an array and another's with an object of arrays a statement, and read by one reader."""
    from ..sources import results, web

    scores = overlap_scores(spark, d).select("conv_id", "sent_idx", "source_idx", F.round("score", 6).alias("score"))
    vector = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("source_idx", x.alias("x")))), lambda y: y["x"])
    rows = scores.groupBy("conv_id", "sent_idx").agg(vector(F.col("score")).alias("raw"), vector((F.col("score") > 0).cast("double")).alias("any"))
    packed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "raw", "any"))).alias("xs"))  # one instance's statements
    methods = F.struct(
        F.struct(F.transform("xs", lambda x: x["raw"]).alias("attr_scores")).alias("entailment"),
        F.struct(F.transform("xs", lambda x: F.struct(x["raw"].alias("raw"), x["any"].alias("any"))).alias("attr_scores")).alias("posthoc"),
    )
    documents = packed.select(F.to_json(F.struct(F.array(F.struct(F.col("conv_id").alias("instance_idx"), methods.alias("methods"))).alias("results"))).alias("value"))
    path = f"{web.shared_folder(spark)}/documents"
    documents.write.text(path)
    return results.nested_scores(spark.read.text(path), "value")
