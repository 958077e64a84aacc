"""Steps between the stages: page text to paragraphs, ranges and partitions, replication, merges, method tables, token slices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, citations, dedup, metrics, presentation
from .bindings import SCORES_SQL, overlap_scores, sent_sql, statements, table, tok_sql
from .evidence import LINES_SQL, TOP_SQL, line_words
from .faithfulness import COUNTS_SQL, direct_counts
from .facts import POST_SQL, posthoc_attr
from .registry import query
from .sequence import SELECT_SQL, _citations
from .verdicts import INSTANCES_SQL, SPACED_SQL, instances, one_stage, spaced_sources
from .verification import PAIRS_SQL, pairs

INSTANCE = ["conv_id", "sent_idx"]
#: Lines of a document that stand for one page.
PAGE_LINES = 8

PDF_SQL = f"""{LINES_SQL}, {TOP_SQL}, g AS (SELECT *, i // {PAGE_LINES} AS page, CASE WHEN abs(top - lag(top) OVER (PARTITION BY doc_id, i // {PAGE_LINES} ORDER BY seq)) >= 3 THEN 1 ELSE 0 END AS f FROM wd),
h AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, page ORDER BY seq ROWS UNBOUNDED PRECEDING) AS line FROM g),
l AS (SELECT doc_id, page, line, string_agg(w, ' ' ORDER BY seq) AS txt, arg_min(top, seq) AS top FROM h GROUP BY ALL),
s AS (SELECT *, top - lag(top) OVER (PARTITION BY doc_id, page ORDER BY line) AS gap, count(*) OVER (PARTITION BY doc_id, txt) AS times FROM l),
m AS (SELECT doc_id, page, coalesce(1.5 * gaps[len(gaps) // 2 + 1], 20) AS least FROM (SELECT doc_id, page, list(gap ORDER BY gap) FILTER (WHERE gap IS NOT NULL) AS gaps FROM s GROUP BY ALL)),
k AS (SELECT s.doc_id, s.page, line, txt, CASE WHEN gap > least THEN 1 ELSE 0 END AS cut FROM s JOIN m ON m.doc_id = s.doc_id AND m.page = s.page
WHERE NOT (regexp_full_match(txt, '\\d+') OR (length(txt) <= 5 AND NOT regexp_matches(txt, '\\p{{L}}')) OR (length(txt) >= 10 AND times >= 5))),
p0 AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, page ORDER BY line ROWS UNBOUNDED PRECEDING) AS para FROM k),
p1 AS (SELECT doc_id, page, para, string_agg(txt, ' ' ORDER BY line) AS txt FROM p0 GROUP BY ALL),
p2 AS (SELECT doc_id, page, para, coalesce(p1.txt, '') AS txt FROM p1 FULL JOIN (SELECT DISTINCT doc_id, page, 0::HUGEINT AS para FROM l) z USING (doc_id, page, para)),
p3 AS (SELECT doc_id, txt, para = 0 AS head, row_number() OVER (PARTITION BY doc_id ORDER BY page, para) AS n FROM p2),
fo AS (SELECT doc_id, n, txt, 1 AS grp FROM p3 WHERE n = 1 UNION ALL SELECT p3.doc_id, p3.n,
CASE WHEN p3.head AND (trim(fo.txt) = '' OR right(trim(fo.txt), 1) NOT IN ('.', '!', '?', ':')) THEN fo.txt || ' ' || p3.txt ELSE p3.txt END,
CASE WHEN p3.head AND (trim(fo.txt) = '' OR right(trim(fo.txt), 1) NOT IN ('.', '!', '?', ':')) THEN fo.grp ELSE fo.grp + 1 END FROM fo JOIN p3 ON p3.doc_id = fo.doc_id AND p3.n = fo.n + 1)"""


@query(rf"WITH RECURSIVE {PDF_SQL} SELECT doc_id, string_agg(regexp_replace(t, '\s+', ' ', 'g'), chr(10) || chr(10) ORDER BY grp) AS content FROM (SELECT doc_id, grp, arg_max(txt, n) AS t FROM fo GROUP BY ALL) WHERE length(t) > 5 GROUP BY doc_id")
def pdf_text(spark, d):
    """Words with heights to lines, lines to paragraphs by one and a half times the page's median spacing, across
    pages, without noise, recurring lines and short paragraphs."""
    docs = text.once(table(spark, d, "documents"), "lines", F.transform(F.split("text", "\n"), lambda line, i: line_words(line, i)))
    first = F.sequence(F.lit(0), F.greatest(F.size("lines") - 1, F.lit(0)), F.lit(PAGE_LINES))
    pages = F.transform(first, lambda i: F.flatten(F.slice("lines", i + 1, PAGE_LINES)))
    return chunking.pages_to_text(text.once(docs.select("doc_id", "lines"), "pages", pages), "doc_id", F.col("pages"))


@query("SELECT item_id, text FROM benchmark WHERE item_id >= 5 AND item_id < 25")
def claim_range(spark, d):
    """The claims from a start to an end position; the filter reaches the scan."""
    return dedup.position_range(table(spark, d, "benchmark").select("item_id", "text"), "item_id", 5, 25)


@query("""SELECT claim, page_id, ok FROM (SELECT page_id % 6 AS claim, page_id, page_id % 7 <> 3 AS ok, row_number() OVER (PARTITION BY page_id % 6, page_id % 7 <> 3 ORDER BY page_id) AS rn FROM pages) WHERE NOT ok OR rn <= 5""")
def scrape_partition(spark, d):
    """Pages that were read, the first five of a claim, and those that failed."""
    rows = table(spark, d, "pages").select((F.col("page_id") % 6).alias("claim"), "page_id", F.when(F.col("page_id") % 7 == 3, "timeout").alias("error"))
    read, failed = dedup.success_failure(rows, "claim", "error", "page_id", 5)
    return read.withColumn("ok", F.lit(True)).unionByName(failed.withColumn("ok", F.lit(False))).select("claim", "page_id", "ok")


STANCE = "CASE doc_id % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'refutes' ELSE 'neutral' END"
FOUND = "CASE doc_id % 5 WHEN 0 THEN 'Mixed' WHEN 1 THEN 'True' ELSE 'False' END"


@query(f"SELECT doc_id FROM (SELECT doc_id, {STANCE} AS stance, {FOUND} AS verdict, len({sent_sql('text')}) AS n FROM documents) WHERE stance IN ('supports', 'refutes') AND verdict IN ('True', 'False') AND n >= 5")
def stance_filter(spark, d):
    """Documents that take a side, with a plain verdict and five sentences or more."""
    n = F.size(text.sentences(F.col("text")))
    return table(spark, d, "documents").filter(F.expr(STANCE).isin("supports", "refutes") & F.expr(FOUND).isin("True", "False") & (n >= 5)).select("doc_id")


METHODS_SQL = ", ".join(f"('{m.name}', '{m.label}', {i})" for i, m in enumerate(presentation.METHODS))
EXCLUDED = ("surrogate_32", "surrogate_64")


@query(f"""WITH me AS (SELECT * FROM (VALUES {METHODS_SQL}) v(name, label, place)), v AS (SELECT name, avg(n_chars) AS mean FROM documents JOIN me ON place = doc_id % {len(presentation.METHODS)} WHERE source <> 'src1' GROUP BY name)
SELECT me.name, label, row_number() OVER (ORDER BY place) AS display, round(mean, 6) AS mean FROM me JOIN v ON v.name = me.name WHERE me.name NOT IN ({", ".join(f"'{x}'" for x in EXCLUDED)})""")
def method_order(spark, d):
    """Results of methods in their fixed order, with their labels; excluded and absent methods leave no gap."""
    named = table(spark, d, "documents").filter("source <> 'src1'").join(presentation.methods(spark), F.col("doc_id") % len(presentation.METHODS) == F.col("place"))
    means = named.groupBy("name").agg(F.round(F.avg("n_chars"), 6).alias("mean"))
    return presentation.in_display_order(means, "name", EXCLUDED).select("name", "label", "display", "mean")


PATH = "concat('results/', source, '/', CASE doc_id % 4 WHEN 0 THEN 'surrogate_256' WHEN 1 THEN 'entailment_window_5' WHEN 2 THEN 'direct' ELSE 'other' END, '_scores.json')"
BY_LENGTH = sorted(presentation.METHODS, key=lambda m: (-len(m.name), m.name))
NAMES_SQL = "[" + ", ".join(f"'{m.name}'" for m in BY_LENGTH) + "]"
SHOWN_SQL = "[" + ", ".join(f"'{m.label}'" for m in BY_LENGTH) + "]"


@query(f"SELECT doc_id, {NAMES_SQL}[i] AS method, {SHOWN_SQL}[i] AS label FROM (SELECT doc_id, list_position(list_transform({NAMES_SQL}, lambda x: contains(p, x)), TRUE) AS i FROM (SELECT doc_id, {PATH} AS p FROM documents))")
def method_lookup(spark, d):
    """The registered method with the longest name that stands in a path, and its label; null for other paths."""
    return table(spark, d, "documents").select("doc_id", F.expr(PATH).alias("p")).select("doc_id", *[c.alias(n) for n, c in presentation.method_of(F.col("p")).items()])


@query(f"WITH {INSTANCES_SQL}, mt AS (SELECT unnest(['surrogate', 'entailment', 'direct']) AS method) SELECT conv_id, method, 'all' AS k, round(p0, 6) AS p0, round(p3, 6) AS p3 FROM one, mt WHERE k = 'all'")
def baseline_replication(spark, d):
    """The verdict on all evidence is asked for once a claim and counts for every method."""
    once = one_stage(instances(spark, d).filter("k = 'all'")).select("conv_id", "k", *[F.round(F.get("dist", F.lit(i)), 6).alias(f"p{i}") for i in (0, 3)])
    return once.withColumn("method", F.explode(F.array(*map(F.lit, ("surrogate", "entailment", "direct"))))).select("conv_id", "method", "k", "p0", "p3")


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS chunk, unnest(range(len(string_split(text, chr(10))))) AS chunk_pos FROM documents)
SELECT doc_id, chunk_pos, chunk, url, 'q' || (page_id % 7) AS search_string FROM c LEFT JOIN pages ON page_id = doc_id""")
def chunk_provenance(spark, d):
    """Every chunk carries what its page was found by; chunks of pages without a record keep none."""
    chunks = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_pos", "chunk")).withColumn("chunk_pos", F.col("chunk_pos").cast("long"))
    found = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.struct("url", F.concat(F.lit("q"), (F.col("page_id") % 7).cast("string")).alias("search_string")).alias("info"))
    return dedup.with_provenance(chunks, found, "doc_id").select("doc_id", "chunk_pos", "chunk", "info.url", "info.search_string")


@query("""SELECT l.doc_id AS pos, d.doc_id = l.doc_id + CASE WHEN l.doc_id % 50 = 1 THEN 1 ELSE 0 END AS same_idx, d.source IS NOT NULL AND d.source = CASE WHEN l.doc_id % 30 = 2 THEN 'other' ELSE d.source END AS same_dataset,
CASE WHEN d.doc_id = l.doc_id + CASE WHEN l.doc_id % 50 = 1 THEN 1 ELSE 0 END AND d.source = CASE WHEN l.doc_id % 30 = 2 THEN 'other' ELSE d.source END THEN quality::VARCHAR END AS pred_label FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")
def merge_by_position(spark, d):
    """Two result lists side by side: rows whose index or dataset differs are told, the rest take the other's label."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    left = docs.select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("idx"), F.col("source").alias("dataset"))
    dataset = docs.select(F.col("doc_id").alias("i"), "source")
    right = labels.join(dataset, F.col("doc_id") == F.col("i")).select(
        F.col("doc_id").alias("pos"), (F.col("doc_id") + F.when(F.col("doc_id") % 50 == 1, 1).otherwise(0)).alias("idx"), F.when(F.col("doc_id") % 30 == 2, "other").otherwise(F.col("source")).alias("dataset"), F.col("quality").cast("string").alias("pred_label")
    )
    return dedup.merge_by_position(left, right, "pos", ["idx", "dataset"], "pred_label").select("pos", "same_idx", "same_dataset", "pred_label")


@query(f"""WITH {SELECT_SQL}, vf AS (SELECT conv_id, sent_idx FROM sc GROUP BY ALL HAVING bool_or(score > 0)), cn AS (SELECT vf.conv_id, vf.sent_idx, count(span_rank) AS n FROM vf LEFT JOIN ct ON ct.conv_id = vf.conv_id AND ct.sent_idx = vf.sent_idx GROUP BY ALL)
SELECT conv_id, count(*) AS n, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation FROM cn GROUP BY conv_id""")
def citation_count_stats(spark, d):
    """Mean and deviation of the number of citations, over the statements that are measured at all."""
    valid = overlap_scores(spark, d).groupBy(*INSTANCE).agg(F.max("score").alias("best")).filter("best > 0").select(*INSTANCE)
    n = _citations(spark, d).groupBy(*INSTANCE).agg(F.count("*").alias("n"))
    rows = valid.join(n, INSTANCE, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("deviation"))


#: Logit of token t of a statement: that of its kept sources, a little higher for two of three tokens.
LP_SQL = "list_sum(list_transform(range(w), lambda t: -ln(1 + exp(-(2 * {f} - {q} - 1 + (t % 3) * 0.1)))))"
SLICE_SQL = f"""{COUNTS_SQL}, r0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, sent_idx ORDER BY round(score, 6) DESC, source_idx DESC) AS rk FROM sc), ck AS (SELECT conv_id, sent_idx, sum(hi - lo + 1)::BIGINT AS c FROM ct GROUP BY ALL),
kk AS (SELECT m.conv_id, m.sent_idx, greatest(len({tok_sql("m.s")}), 1) AS w, unnest(['1', '3', '5', 'self', 'direct']) AS k, unnest([1, 3, 5, coalesce(c, 0), coalesce(direct, 0)]) AS n FROM stm m LEFT JOIN ck ON ck.conv_id = m.conv_id AND ck.sent_idx = m.sent_idx LEFT JOIN dc ON dc.conv_id = m.conv_id AND dc.sent_idx = m.sent_idx),
tk AS (SELECT kk.conv_id, kk.sent_idx, k, n, w, sum(score) AS s, sum(score * score) AS q, sum(CASE WHEN rk > n THEN score ELSE 0 END) AS sk, sum(CASE WHEN rk > n THEN score * score ELSE 0 END) AS qk FROM kk JOIN r0 ON r0.conv_id = kk.conv_id AND r0.sent_idx = kk.sent_idx GROUP BY ALL)"""


@query(f"WITH {SLICE_SQL} SELECT conv_id, sent_idx, k, round(CASE WHEN s = 0 THEN NULL WHEN n = 0 THEN 0 ELSE ({LP_SQL.format(f='s', q='q')} - {LP_SQL.format(f='sk', q='qk')}) / w END, 6) AS drop FROM tk")
def topk_drop_tokens(spark, d):
    """The drop a token of the statement's slice when its k best sources go: k of 1, 3, 5, as many as it cites itself and as the direct method cites.

    Statements without a score above zero aren't measured; where nothing is cited the drop is 0.
    """
    rank = F.row_number().over(Window.partitionBy(*INSTANCE).orderBy(F.desc(F.round("score", 6)), F.desc("source_idx")))
    cited = _citations(spark, d).groupBy(*INSTANCE).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("c"))
    ks = statements(spark, d).select(*INSTANCE, F.greatest(text.n_tokens(F.col("s")), F.lit(1)).alias("w")).join(cited, INSTANCE, "left").join(direct_counts(spark, d), INSTANCE, "left")
    each = ks.select(*INSTANCE, "w", F.explode(F.array(*[F.struct(F.lit(str(k)).alias("k"), F.lit(k).cast("long").alias("n")) for k in (1, 3, 5)], F.struct(F.lit("self").alias("k"), F.coalesce("c", F.lit(0)).cast("long").alias("n")), F.struct(F.lit("direct").alias("k"), F.coalesce("direct", F.lit(0)).cast("long").alias("n")))).alias("x")).select(*INSTANCE, "w", "x.*")
    rows = overlap_scores(spark, d).withColumn("rk", rank).join(each, INSTANCE)
    x, left = F.col("score"), F.when(F.col("rk") > F.col("n"), F.col("score")).otherwise(0.0)
    sums = rows.groupBy(*INSTANCE, "k", "n", "w").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.sum(left).alias("sk"), F.sum(left * left).alias("qk"))
    logits = lambda f, q: F.transform(F.sequence(F.lit(0), (F.col("w") - 1).cast("int")), lambda t: 2 * F.col(f) - F.col(q) - 1 + (t % 3) * 0.1)
    drop = (metrics.slice_log_prob(logits("s", "q")) - metrics.slice_log_prob(logits("sk", "qk"))) / F.col("w")
    return sums.select(*INSTANCE, "k", F.round(F.when(F.col("s") == 0, None).when(F.col("n") == 0, 0.0).otherwise(drop), 6).alias("drop"))


@query(f"WITH {PAIRS_SQL} SELECT t AS truth, p AS predicted, n || ' (' || round(100 * n::DOUBLE / sum(n) OVER (PARTITION BY t), 1) || '%)' AS annotation FROM (SELECT t, p, count(*) AS n FROM pr GROUP BY t, p)")
def confusion_annotation(spark, d):
    return metrics.confusion(pairs(spark, d), "t", "p").select("truth", "predicted", "annotation")


@query(f"WITH {SCORES_SQL} SELECT conv_id, string_agg(s, '|' ORDER BY s) AS shots FROM stm GROUP BY conv_id")
def few_shot_shuffle(spark, d):
    """Examples in random order, shown sorted: a shuffle keeps every one."""
    packed = statements(spark, d).groupBy("conv_id").agg(F.collect_list("s").alias("xs"))  # one conversation's statements
    return packed.select("conv_id", F.array_join(F.array_sort(F.shuffle("xs")), "|").alias("shots"))


@query(f"WITH {POST_SQL} SELECT conv_id, sent_idx, bool_and(coalesce(valid AND len(ids) > 0, FALSE)) AS valid FROM q2 WHERE label <> 'free' GROUP BY ALL")
def validity_by_k(spark, d):
    """A statement is measured if the vector of every k exists and isn't all zero."""
    rows = posthoc_attr(spark, d).filter("k <> 'free'")
    return rows.groupBy(*INSTANCE).agg(F.bool_and(F.coalesce(F.col("scores").contains("1"), F.lit(False))).alias("valid"))


@query(f"""WITH {SPACED_SQL} SELECT conv_id, source_idx, start, CASE WHEN source_idx = n - 1 THEN start + length(s) ELSE start + length(s) + length(sep) END AS stop FROM (SELECT *, coalesce(sum(length(s) + length(sep)) OVER (PARTITION BY conv_id ORDER BY source_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sp0 JOIN nn USING (conv_id))""")
def source_extents(spark, d):
    """Where each source begins and, with its separator, where the next one does; the last one ends with its own text."""
    packed = spaced_sources(spark, d)
    begun = F.transform(F.sequence(F.lit(0), F.size("xs")), lambda i: F.aggregate(F.slice("xs", 1, i), F.lit(0).cast("long"), lambda a, x: a + F.length(x["s"]) + F.length(x["sep"])))
    rows = packed.withColumns({"at": begun, "whole": F.length(citations.spaced_text(F.col("xs"))).cast("long")})
    each = rows.select("conv_id", "at", "whole", F.posexplode("xs").alias("i", "x"))
    return each.select("conv_id", F.col("i").cast("long").alias("source_idx"), F.get("at", F.col("i")).alias("start"), F.least(F.get("at", F.col("i") + 1), F.col("whole")).alias("stop"))
