"""Attribution at the grain of atomic facts, and by scorers: cosine, entailment windows, greedy sets, post-hoc citation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import judge, sequences, text
from ..operators import attribution
from ..sources import scorers
from .bindings import SCORES_SQL, SENTENCES_SQL, sources, statements, tok_sql
from .faithfulness import COUNTS_SQL, direct_counts
from .registry import query

INSTANCE = ["conv_id", "sent_idx"]
FACT = [*INSTANCE, "fact_idx"]
#: A statement's atomic facts, as `scorers.fact_writer` gives them; a statement may have none.
FA_SQL = f"""fa AS (SELECT conv_id, sent_idx, fs, unnest(fs) AS fact, unnest(range(len(fs))) AS fact_idx FROM (SELECT conv_id, sent_idx,
list_filter(list_transform(regexp_split_to_array(s, '[,;:]'), lambda x: array_to_string({tok_sql("x")}, ' ')), lambda x: contains(x, ' ')) AS fs FROM stm))"""
FACTS_SQL = f"{SENTENCES_SQL}, {FA_SQL}"


def overlap_sql(a: str, b: str) -> str:
    """Share of a's distinct tokens that b has."""
    return f"CASE WHEN len({tok_sql(a)}) = 0 THEN 0::DOUBLE ELSE len(list_intersect(list_distinct({tok_sql(a)}), {tok_sql(b)}))::DOUBLE / len(list_distinct({tok_sql(a)})) END"


def facts(spark, d):
    """(conv_id, sent_idx, fact_idx, fact): by the registered decomposition scorer."""
    found = scorers.score_column(scorers.registered("facts", "clauses"), "array<string>", F.col("s"))
    return statements(spark, d).select(*INSTANCE, F.posexplode(found).alias("fact_idx", "fact")).withColumn("fact_idx", F.col("fact_idx").cast("long"))


def fact_tokens(spark, d):
    """(conv_id, sent_idx, fs): the distinct tokens of each fact of every statement, no list without facts."""
    found = scorers.score_column(scorers.registered("facts", "clauses"), "array<string>", F.col("s"))
    rows = statements(spark, d).select(*INSTANCE, F.coalesce(found, F.array().cast("array<string>")).alias("facts"))
    return rows.select(*INSTANCE, F.transform("facts", lambda f: F.array_distinct(text.tokens(f))).alias("fs"))


def packed_sources(spark, d):
    """(conv_id, xs): one conversation's sources in order."""
    return sources(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_idx", "s"))), lambda x: x["s"]).alias("xs"))


def grid(spark, d):
    """Every statement with every source of its instance: what scores are laid over, so that statements without facts stay."""
    return statements(spark, d).select(*INSTANCE).join(sources(spark, d).select("conv_id", "source_idx"), "conv_id")


@query(f"WITH {FACTS_SQL} SELECT conv_id, sent_idx, fact_idx, fact FROM fa")
def atomic_facts(spark, d):
    return facts(spark, d)


@query(f"""WITH {FACTS_SQL}, fx AS (SELECT fa.conv_id, sent_idx, source_idx, max({overlap_sql("fact", "src.s")}) AS score FROM fa JOIN src ON src.conv_id = fa.conv_id GROUP BY ALL)
SELECT m.conv_id, m.sent_idx, r.source_idx, round(coalesce(fx.score, 0), 6) AS score FROM stm m JOIN src r ON r.conv_id = m.conv_id LEFT JOIN fx ON fx.conv_id = m.conv_id AND fx.sent_idx = m.sent_idx AND fx.source_idx = r.source_idx""")
def entailment_fact_attr(spark, d):
    """Naive attribution: the largest entailment of a statement's facts by each source; zeros without facts."""
    right = sources(spark, d).select("conv_id", "source_idx", F.array_distinct(text.tokens(F.col("s"))).alias("t"))
    return attribution.fact_grid(fact_tokens(spark, d), right, "conv_id", "sent_idx", "source_idx", "fs", "t").withColumn("score", F.round("score", 6))


WINDOW_LENGTHS = (3, 5)
WINDOWS_SQL = f"""{FACTS_SQL}, p AS (SELECT conv_id, count(*) AS n, list(s ORDER BY source_idx) AS xs FROM src GROUP BY conv_id), wl AS (SELECT unnest([{", ".join(map(str, WINDOW_LENGTHS))}]) AS wlen),
w AS (SELECT conv_id, n, wlen, w, array_to_string(xs[greatest(w - 2 * (wlen // 2), 0) + 1 : least(w - 2 * (wlen // 2) + wlen, n)], ' ') AS win FROM (SELECT conv_id, n, xs, wlen, unnest(range(n + 2 * (wlen // 2))) AS w FROM p, wl)),
sw AS (SELECT fa.conv_id, sent_idx, fact_idx, wlen, w.w, n, {overlap_sql("fact", "win")} AS score FROM fa JOIN w ON w.conv_id = fa.conv_id)"""


@query(f"""WITH {WINDOWS_SQL}, m AS (SELECT a.conv_id, a.sent_idx, a.fact_idx, a.wlen, a.w AS source_idx, avg(b.score) AS score FROM sw a JOIN sw b ON b.conv_id = a.conv_id AND b.sent_idx = a.sent_idx AND b.fact_idx = a.fact_idx AND b.wlen = a.wlen AND b.w BETWEEN a.w AND a.w + a.wlen - 1
WHERE a.w < a.n GROUP BY ALL), x AS (SELECT conv_id, sent_idx, wlen, source_idx, max(score) AS score FROM m GROUP BY ALL)
SELECT s.conv_id, s.sent_idx, wl.wlen::INT AS window_length, r.source_idx, round(coalesce(x.score, 0), 6) AS score FROM stm s JOIN src r ON r.conv_id = s.conv_id CROSS JOIN wl LEFT JOIN x ON x.conv_id = s.conv_id AND x.sent_idx = s.sent_idx AND x.wlen = wl.wlen AND x.source_idx = r.source_idx""")
def entailment_window_fact_attr(spark, d):
    """Windows of three and of five sources: a source's mean over the windows that hold it, then the largest over facts."""
    packed, left, out = packed_sources(spark, d), fact_tokens(spark, d), None
    for length in WINDOW_LENGTHS:
        wins = packed.select("conv_id", F.posexplode(sequences.windows(F.col("xs"), length)).alias("source_idx", "win"))
        right = wins.select("conv_id", F.col("source_idx").cast("long").alias("source_idx"), F.array_distinct(text.tokens(F.array_join("win", " "))).alias("t"))
        scores = attribution.fact_grid(left, right, "conv_id", "sent_idx", "source_idx", "fs", "t", length)
        kept = scores.select(*INSTANCE, F.lit(length).alias("window_length"), "source_idx", F.round("score", 6).alias("score"))
        out = kept if out is None else out.unionByName(kept)
    return out


@query(f"""WITH RECURSIVE {COUNTS_SQL}, {FA_SQL}, p AS (SELECT conv_id, list(list_distinct({tok_sql("s")}) ORDER BY source_idx) AS ts FROM src GROUP BY conv_id),
f0 AS (SELECT fa.conv_id, fa.sent_idx, fact_idx, list_distinct({tok_sql("fact")}) AS want, ts, greatest(coalesce(direct, 0), 5) AS most FROM fa JOIN p ON p.conv_id = fa.conv_id LEFT JOIN dc ON dc.conv_id = fa.conv_id AND dc.sent_idx = fa.sent_idx),
g AS (SELECT conv_id, sent_idx, fact_idx, want, ts, most, []::BIGINT[] AS chosen, 0 AS step, 0::DOUBLE AS value, 0::DOUBLE AS gain, TRUE AS cited, want AS missing FROM f0
UNION ALL SELECT conv_id, sent_idx, fact_idx, want, ts, most, list_append(chosen, pick), step + 1, 1 - len(rest)::DOUBLE / len(want), (len(missing) - len(rest))::DOUBLE / len(want), cited AND round((len(missing) - len(rest))::DOUBLE / len(want), 9) >= 0.1, rest FROM (
 SELECT *, list_filter(missing, lambda t: NOT list_contains(ts[pick + 1], t)) AS rest FROM (
 SELECT *, list_filter(range(len(ts)), lambda i: NOT list_contains(chosen, i) AND len(list_intersect(missing, ts[i + 1])) = list_max(list_transform(list_filter(range(len(ts)), lambda j: NOT list_contains(chosen, j)), lambda j: len(list_intersect(missing, ts[j + 1])))))[1] AS pick
 FROM g WHERE step < least(most, len(ts))))),
z AS (SELECT conv_id, sent_idx, fact_idx, chosen[step] AS source_idx, gain, cited FROM g WHERE step > 0),
x AS (SELECT conv_id, sent_idx, source_idx, max(gain) AS score, bool_or(cited) AS cited FROM z GROUP BY ALL), hf AS (SELECT DISTINCT conv_id, sent_idx FROM fa)
SELECT m.conv_id, m.sent_idx, r.source_idx, round(CASE WHEN hf.conv_id IS NULL THEN 0 ELSE coalesce(x.score, -1) END, 6) AS score, coalesce(x.cited, FALSE) AS cited FROM stm m JOIN src r ON r.conv_id = m.conv_id
LEFT JOIN x ON x.conv_id = m.conv_id AND x.sent_idx = m.sent_idx AND x.source_idx = r.source_idx LEFT JOIN hf ON hf.conv_id = m.conv_id AND hf.sent_idx = m.sent_idx""")
def greedy_fact_selection(spark, d):
    """Sources added one at a time for each fact, five or as many as the direct method cites; the largest gain over facts, and whether some fact cites the source.

    Sources that no fact reaches score -1; statements without facts score 0.
    """
    left = facts(spark, d).withColumnRenamed("fact", "hypothesis")
    rows = left.join(packed_sources(spark, d), "conv_id").join(direct_counts(spark, d), INSTANCE, "left")
    found = attribution.covering_sets(rows, FACT, F.col("direct"))
    pooled = found.groupBy(*INSTANCE, "source_idx").agg(F.max("score").alias("score"), F.max("cited").alias("cited"))
    has = left.select(*INSTANCE).distinct().withColumn("facts", F.lit(True))
    rows = grid(spark, d).join(pooled, [*INSTANCE, "source_idx"], "left").join(has, INSTANCE, "left")
    score = F.when(F.col("facts").isNull(), 0.0).otherwise(F.coalesce("score", F.lit(-1.0)))
    return rows.select(*INSTANCE, "source_idx", F.round(score, 6).alias("score"), F.coalesce("cited", F.lit(False)).alias("cited"))


EMBED_SQL = """em AS (SELECT {key}, dim, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM (SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS dim, sum(CASE WHEN ('0x' || substr(h, 9, 1))::INT > 7 THEN 1 ELSE -1 END)::DOUBLE AS x
FROM (SELECT {key}, md5(w) AS h FROM (SELECT {key}, unnest({words}) AS w FROM {rows})) GROUP BY ALL) WHERE x <> 0)"""


def embed_sql(name: str, key: str, rows: str, column: str) -> str:
    return EMBED_SQL.format(key=key, words=tok_sql(column), rows=rows).replace("em AS", f"{name} AS", 1)


@query(f"WITH {embed_sql('em', 'doc_id', 'documents', 'text')} SELECT doc_id, dim, round(x, 6) AS x FROM em")
def embed_scorer(spark, d):
    """Embeddings of whole texts by the local stand-in; a row for each dimension that isn't zero."""
    from .bindings import table

    vectors = table(spark, d, "documents").select("doc_id", scorers.score_column(scorers.registered("embed", "hash"), "array<double>", F.col("text")).alias("v"))
    return vectors.select("doc_id", F.posexplode("v").alias("dim", "x")).filter("x <> 0").select("doc_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query(f"""WITH {SENTENCES_SQL}, {embed_sql("ea", "conv_id, sent_idx", "stm", "s")}, {embed_sql("eb", "conv_id, source_idx", "src", "s")},
dt AS (SELECT ea.conv_id, sent_idx, source_idx, sum(ea.x * eb.x) AS score FROM ea JOIN eb ON eb.conv_id = ea.conv_id AND eb.dim = ea.dim GROUP BY ALL), na AS (SELECT DISTINCT conv_id, sent_idx FROM ea), nb AS (SELECT DISTINCT conv_id, source_idx FROM eb)
SELECT na.conv_id, na.sent_idx, nb.source_idx, round(coalesce(score, 0), 5) + 0 AS score FROM na JOIN nb ON nb.conv_id = na.conv_id LEFT JOIN dt ON dt.conv_id = na.conv_id AND dt.sent_idx = na.sent_idx AND dt.source_idx = nb.source_idx""")
def semantic_attr(spark, d):
    """Cosine of each statement's embedding with each source's; vectors without length give no score."""
    packed = lambda rows, index, name: rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(index, "s"))), lambda x: x["s"]).alias(name))  # noqa: E731  one conversation's
    both = packed(statements(spark, d), "sent_idx", "statements").join(packed(sources(spark, d), "source_idx", "sources"), "conv_id")
    scored = attribution.embedded_pairs(both, scorers.registered("embed", "hash"))
    return scored.withColumn("score", F.round("score", 5) + 0.0)


KS = (1, 3, 5)
POST_SQL = f"""{COUNTS_SQL}, {FA_SQL}, p AS (SELECT conv_id, list(list_distinct({tok_sql("s")}) ORDER BY source_idx) AS ts FROM src GROUP BY conv_id),
q0 AS (SELECT conv_id, sent_idx, list_distinct(regexp_extract_all(string_agg(fact, ' '), '\\S+')) AS want FROM fa GROUP BY ALL),
ks AS (SELECT conv_id, sent_idx, unnest(['1', '3', '5', 'free']) AS label, unnest([1, 3, 5, NULL])::INT AS k FROM q0 UNION ALL SELECT conv_id, sent_idx, 'direct', direct FROM dc WHERE direct > 0),
q1 AS (SELECT q0.conv_id, q0.sent_idx, want, len(ts) AS n, label, k, list_transform(list_sort(list_transform(range(len(ts)), lambda i: [-len(list_intersect(want, ts[i + 1])), i])), lambda x: x[2])[1 : coalesce(k, 3)] AS ids
FROM q0 JOIN p ON p.conv_id = q0.conv_id JOIN ks ON ks.conv_id = q0.conv_id AND ks.sent_idx = q0.sent_idx),
q2 AS (SELECT *, array_to_string(list_transform(ids, lambda i: '[' || (i + 1) || ']'), '') AS body, NOT (k IS NOT NULL AND len(ids) < k) AS valid, CASE WHEN len(want) % 3 = 0 OR (k IS NOT NULL AND len(ids) < k) THEN 2 ELSE 1 END AS t FROM q1)"""


@query(f"""WITH {POST_SQL} SELECT conv_id, sent_idx, label AS k, CASE WHEN valid THEN t ELSE 5 END::INT AS tries, body || '<eos>' AS generation,
CASE WHEN valid THEN array_to_string(list_transform(range(n), lambda i: CASE WHEN list_contains(ids, i) THEN '1' ELSE '0' END), '') END AS scores FROM q2""")
def posthoc_attr(spark, d):
    """Citations that a model gives after the fact: for k of 1, 3, 5, as many as the direct method cites, if any, and
    without a number, 0/1 scores, null where no try was valid; the generated text is kept. Statements without facts have no rows."""
    packed = facts(spark, d).groupBy(*INSTANCE).agg(F.transform(F.array_sort(F.collect_list(F.struct("fact_idx", "fact"))), lambda x: x["fact"]).alias("facts"))
    kind = lambda label, k: F.struct(F.lit(label).alias("label"), k.cast("int").alias("k"))
    fixed = F.array(*[kind(str(k), F.lit(k)) for k in KS], kind("free", F.lit(None)))
    every = F.when(F.col("direct") > 0, F.concat(fixed, F.array(kind("direct", F.col("direct"))))).otherwise(fixed)
    rows = packed.join(packed_sources(spark, d), "conv_id").join(direct_counts(spark, d), INSTANCE, "left").withColumn("kinds", every)
    said = scorers.score_each(scorers.registered("cite", "overlap"), "struct<text:string,ids:array<int>,tries:int>", F.transform("kinds", lambda x: x["k"]), F.col("facts"), F.col("xs"))
    each = rows.select(*INSTANCE, F.size("xs").alias("n"), F.explode(F.arrays_zip("kinds", said.alias("said"))).alias("x"))
    found = each.select(*INSTANCE, "n", F.col("x.kinds.label").alias("label"), F.col("x.said").alias("said"))
    marks = F.when(F.col("said.ids").isNotNull(), F.array_join(F.transform(sequences.indices(F.col("n")), lambda i: F.array_contains(F.col("said.ids"), i + 1).cast("int").cast("string")), ""))
    return found.select(*INSTANCE, F.col("label").alias("k"), F.col("said.tries").alias("tries"), F.col("said.text").alias("generation"), marks.alias("scores"))


@query(f"""WITH {SENTENCES_SQL} SELECT conv_id, sent_idx, pos::INT AS pos, q FROM (SELECT conv_id, sent_idx, unnest(xs) AS q, unnest(range(len(xs))) AS pos FROM (SELECT conv_id, sent_idx,
list_transform(range(0, least(len(w), 15), 3), lambda k: array_to_string(w[k + 1 : k + 3], ' ')) AS xs FROM (SELECT conv_id, sent_idx, {tok_sql("s")} AS w FROM stm)))""")
def generated_queries(spark, d):
    """Search queries that a model writes for a claim, parsed and cut to five."""
    said = scorers.score_column(scorers.registered("queries", "triples"), "string", F.col("s"))
    parsed = statements(spark, d).select(*INSTANCE, judge.query_list(F.regexp_replace(said, r"\n", " ")).alias("xs"))
    return parsed.select(*INSTANCE, F.posexplode("xs").alias("pos", "q"))


@query(f"""WITH {SCORES_SQL} SELECT m.conv_id, m.sent_idx, r.source_idx, 'Rating: [[' || g || ']]' AS said, CASE g WHEN 'Fully supported' THEN 1::DOUBLE WHEN 'Partially supported' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS support,
(len({tok_sql("m.s")}) + len({tok_sql("r.s")}))::BIGINT AS prompt_tokens, len({tok_sql("g")})::BIGINT + 1 AS completion_tokens
FROM stm m JOIN src r ON r.conv_id = m.conv_id JOIN (SELECT *, CASE WHEN score > 0.6 THEN 'Fully supported' WHEN score > 0.2 THEN 'Partially supported' ELSE 'No support' END AS g FROM sc) x
ON x.conv_id = m.conv_id AND x.sent_idx = m.sent_idx AND x.source_idx = r.source_idx""")
def judge_scorer(spark, d):
    """A judge run over statement and evidence pairs, retried where it fails; its text parsed to a score, its tokens counted."""
    pairs = statements(spark, d).withColumnRenamed("s", "st").join(sources(spark, d).withColumnRenamed("s", "so"), "conv_id")
    make = scorers.registered("judge", "lexical_usage")
    said = scorers.score_column(lambda: scorers.with_retries(make()), "struct<text:string,prompt_tokens:bigint,completion_tokens:bigint>", F.col("so"), F.col("st"))
    rows = pairs.select(*INSTANCE, "source_idx", said.alias("x")).select(*INSTANCE, "source_idx", F.col("x.text").alias("said"), "x.prompt_tokens", "x.completion_tokens")
    return rows.withColumn("support", judge.support(F.col("said")))
