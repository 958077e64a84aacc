"""Documents to paragraphs and chunks; answers with citation markup; sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.sequences import index_runs
from ..functions.text import n_tokens
from ..operators import chunking, markup
from ..sources import main_content as main_content_source
from ..sources import pages as page_source
from ..sources import scorers
from .bindings import sent_sql, table, tok_sql
from .registry import query

LINES_SQL = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"


def lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", F.col("i").cast("long"))


@query(rf"WITH {LINES_SQL} SELECT doc_id, i, line FROM ln WHERE NOT (regexp_full_match(line, '\d+') OR (length(line) <= 5 AND NOT regexp_matches(line, '\p{{L}}')))")
def noise_line_filter(spark, d):
    return lines(spark, d).filter(~chunking.is_noise(F.col("line")))


@query(f"WITH {LINES_SQL}, r AS (SELECT doc_id, line FROM ln WHERE length(line) >= 10 GROUP BY ALL HAVING count(*) >= 5) SELECT ln.doc_id, i, line FROM ln WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = ln.doc_id AND r.line = ln.line)")
def recurring_line_filter(spark, d):
    rows = lines(spark, d)
    return rows.join(chunking.recurring(rows, "doc_id", "line").select("doc_id", "line"), ["doc_id", "line"], "left_anti").select("doc_id", "i", "line")


@query(f"WITH {LINES_SQL} SELECT doc_id, line, count(*) AS n FROM ln WHERE length(line) > 5 GROUP BY ALL")
def line_frequency(spark, d):
    """Lines of more than five characters with their count in the document."""
    return lines(spark, d).filter(F.length("line") > 5).groupBy("doc_id", "line").agg(F.count("*").alias("n"))


TOP_SQL = f"wd AS (SELECT doc_id, i * 100000 + j AS seq, w, i * 10.0::DOUBLE + (j % 3) * 0.5 + CASE WHEN i % 4 = 3 THEN 25 ELSE 0 END AS top, i FROM (SELECT doc_id, i, unnest({tok_sql('line')}) AS w, unnest(range(len({tok_sql('line')}))) AS j FROM ln))"


def line_words(line, i):
    """array<struct<word, top>>: a line's words with a height on the page: lines stand for printed lines, and every fourth has a gap before it."""
    top = lambda j: i * 10.0 + (j % 3) * 0.5 + F.when(i % 4 == 3, 25).otherwise(0)
    return F.transform(F.filter(F.split(line, r"\s+"), lambda w: w != ""), lambda w, j: F.struct(w.alias("word"), top(j).alias("top")))


@query(f"""WITH {LINES_SQL}, {TOP_SQL}, g AS (SELECT *, CASE WHEN abs(top - lag(top) OVER o) >= 3 THEN 1 ELSE 0 END AS f FROM wd WINDOW o AS (PARTITION BY doc_id ORDER BY seq)),
h AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS line FROM g)
SELECT doc_id, line::BIGINT AS line, string_agg(w, ' ' ORDER BY seq) AS txt, min(top) AS top FROM h GROUP BY doc_id, line""")
def line_grouping(spark, d):
    every = F.flatten(F.transform(F.split("text", "\n"), lambda line, i: line_words(line, i)))
    found = chunking.page_lines(every, height=F.array_min)
    each = table(spark, d, "documents").select("doc_id", F.posexplode(found).alias("line", "x"))
    return each.select("doc_id", F.col("line").cast("long").alias("line"), "x.txt", F.col("x.at").alias("top"))


@query(f"""WITH {LINES_SQL}, l AS (SELECT doc_id, i, length(line) - lag(length(line)) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM ln),
s AS (SELECT doc_id, list(gap ORDER BY gap) FILTER (WHERE gap IS NOT NULL) AS g FROM l GROUP BY doc_id) SELECT doc_id, coalesce(g[len(g) // 2 + 1], -1)::INT AS spacing FROM s""")
def median_spacing(spark, d):
    """The upper median of the differences between neighbouring lines' lengths."""
    gap = F.length("line") - F.lag(F.length("line")).over(Window.partitionBy("doc_id").orderBy("i"))
    return lines(spark, d).withColumn("gap", gap).groupBy("doc_id").agg(F.coalesce(chunking.upper_median(F.collect_list("gap")), F.lit(-1)).alias("spacing"))


@query(f"""WITH {LINES_SQL}, p AS (SELECT doc_id, i, line, i // 3 AS page, lag(line) OVER o AS pv, lag(i // 3) OVER o AS pp FROM ln WHERE length(line) > 5 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT *, CASE WHEN pp <> page AND right(rtrim(pv), 1) NOT IN ('.', '!', '?', ':') THEN 0 ELSE 1 END AS f FROM p),
n AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS para FROM m)
SELECT doc_id, para::BIGINT AS para, string_agg(line, ' ' ORDER BY i) AS text FROM n GROUP BY doc_id, para""")
def paragraph_merge(spark, d):
    """Lines of more than five characters stand for paragraphs, three to a page."""
    rows = lines(spark, d).filter(F.length("line") > 5).select("doc_id", F.col("i").alias("seq"), F.floor(F.col("i") / 3).alias("page"), F.col("line").alias("text"))
    return chunking.merge_paragraphs(rows, "doc_id", "seq", "page", "text")


#: The fold in SQL: paragraphs by their place, long ones apart, whose sentences (or even groups of a long sentence's words) are folded likewise.
CHUNKS_SQL = rf"""l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda p: trim(p) <> '') AS ps FROM documents),
z AS (SELECT doc_id, i, p, len({tok_sql("p")}) AS n FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM l)),
s0 AS (SELECT doc_id, i, j, s, {tok_sql("s")} AS ws FROM (SELECT doc_id, i, unnest(ss) AS s, unnest(range(len(ss))) AS j FROM (SELECT doc_id, i, {sent_sql("p")} AS ss FROM z WHERE n >= 800))),
s1 AS (SELECT doc_id, i, j, s, ws, len(ws) AS n, CASE WHEN len(ws) > 600 THEN (len(ws) + 599) // 600 ELSE 1 END AS k FROM s0),
s2 AS (SELECT doc_id, i, j, g, CASE WHEN n > 600 THEN array_to_string(ws[g * (n // k) + least(g, n % k) + 1 : (g + 1) * (n // k) + least(g + 1, n % k)], ' ') ELSE s END AS piece FROM (SELECT *, unnest(range(k)) AS g FROM s1)),
s3 AS (SELECT doc_id, i, piece, len({tok_sql("piece")}) AS n, row_number() OVER (PARTITION BY doc_id, i ORDER BY j, g) AS m FROM s2),
sf AS (SELECT doc_id, i, m, n AS size, 0 AS sub FROM s3 WHERE m = 1 UNION ALL
SELECT s3.doc_id, s3.i, s3.m, CASE WHEN size + n > 600 THEN n ELSE size + n END, CASE WHEN size + n > 600 THEN sub + 1 ELSE sub END FROM sf JOIN s3 ON s3.doc_id = sf.doc_id AND s3.i = sf.i AND s3.m = sf.m + 1),
f AS (SELECT doc_id, i, CASE WHEN n >= 800 THEN 0 ELSE n END AS size, n >= 800 AS lng, 0 AS grp FROM z WHERE i = 0 UNION ALL
SELECT z.doc_id, z.i, CASE WHEN z.n >= 800 THEN 0 WHEN lng OR size + z.n > 600 THEN z.n ELSE size + z.n END, z.n >= 800, CASE WHEN z.n >= 800 OR lng OR size + z.n > 600 THEN grp + 1 ELSE grp END FROM f JOIN z ON z.doc_id = f.doc_id AND z.i = f.i + 1),
ch AS (SELECT f.doc_id, grp, 0 AS sub, string_agg(p, chr(10) ORDER BY f.i) AS chunk FROM f JOIN z ON z.doc_id = f.doc_id AND z.i = f.i WHERE NOT lng GROUP BY f.doc_id, grp
UNION ALL SELECT f.doc_id, grp, sub, string_agg(piece, ' ' ORDER BY s3.m) FROM f JOIN s3 ON s3.doc_id = f.doc_id AND s3.i = f.i JOIN sf ON sf.doc_id = s3.doc_id AND sf.i = s3.i AND sf.m = s3.m WHERE lng GROUP BY f.doc_id, grp, sub)"""


@query(f"WITH RECURSIVE {CHUNKS_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, sub) - 1 AS chunk_pos, chunk, len({tok_sql('chunk')})::BIGINT AS n_tokens FROM ch")
def chunk_pack(spark, d):
    """Greedy packing of paragraphs into chunks, with production limits."""
    return chunking.chunk_documents(table(spark, d, "documents"), "doc_id", "text").withColumn("chunk_pos", F.col("chunk_pos").cast("long"))


@query(rf"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '') AS ps FROM documents),
z AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM l), n AS (SELECT doc_id, i, p, len(regexp_extract_all(p, '\S+')) AS k FROM z),
f AS (SELECT doc_id, i, k, k AS size, 0 AS chunk FROM n WHERE i = 0 UNION ALL
SELECT n.doc_id, n.i, n.k, CASE WHEN f.size + n.k > 400 THEN n.k ELSE f.size + n.k END, CASE WHEN f.size + n.k > 400 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1)
SELECT f.doc_id, chunk::BIGINT AS chunk, string_agg(p, chr(10) ORDER BY f.i) AS txt, sum(f.k)::BIGINT AS size FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i GROUP BY f.doc_id, chunk""")
def paragraph_pack(spark, d):
    """The packing fold alone, at a limit of 400 tokens."""
    paragraphs = F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")
    groups = chunking.pack(paragraphs, F.transform(paragraphs, n_tokens), 400)
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(groups).alias("chunk", "g"))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.array_join("g", "\n").alias("txt"), F.aggregate(F.transform("g", n_tokens), F.lit(0).cast("long"), lambda a, x: a + x).alias("size"))


ANSWER = "concat('<statement>', text, '<cite>[', turn, '-', turn + 1, '][', turn + 2, '-', turn + 4, '][9-7]</cite></statement> and then more<statement>x</statement>ok')"


@query("""SELECT conv_id, turn, 0::BIGINT AS pos, trim(text) AS statement, TRUE AS cited, CASE WHEN turn > 5 THEN '' WHEN turn + 1 > 5 THEN turn || '-' || 5 ELSE turn || '-' || least(turn + 4, 5) END AS ranges FROM conversations
UNION ALL SELECT conv_id, turn, 1, 'and then more', FALSE, NULL FROM conversations UNION ALL SELECT conv_id, turn, 2, 'x', TRUE, '' FROM conversations""")
def cited_statements(spark, d):
    """Statement blocks, the text between them, and their merged citation ranges over six sources."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(markup.statements(F.expr(ANSWER), F.lit(6))).alias("pos", "x"))
    shown = F.array_join(F.transform("x.ranges", lambda r: F.concat(r["lo"].cast("string"), F.lit("-"), r["hi"].cast("string"))), ",")
    return rows.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("x.text").alias("statement"), F.col("x.cited").alias("cited"), shown.alias("ranges"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 5) || '-' || (doc_id % 5 + 2) || ',9-9' ELSE (doc_id % 5 + 1) || '-' || (doc_id % 5 + 1) || ',' || (doc_id % 5) || '-' || (doc_id % 5 + 1) END AS runs FROM documents""")
def unsorted_runs(spark, d):
    """Runs in list order: a list that isn't sorted joins only what stands side by side."""
    k = (F.col("doc_id") % 5).cast("int")
    ids = F.when(F.col("doc_id") % 2 == 0, F.array(k, k + 1, k + 2, F.lit(9))).otherwise(F.array(k + 1, k, k + 1))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(index_runs(ids), lambda r: F.concat(r["lo"].cast("string"), F.lit("-"), r["hi"].cast("string"))), ",").alias("runs"))


#: Tags and entities by patterns, which well-formed pages need no parser for.
SKIPPED_SQL = "regexp_replace(html, '(?s)<!--.*?-->|<![^>]*>', '', 'g')"
for _tag in sorted(page_source.SKIPPED):
    SKIPPED_SQL = rf"regexp_replace({SKIPPED_SQL}, '(?is)<{_tag}(\s[^>]*)?>.*?</{_tag}>', '', 'g')"
BLOCKS_SQL = rf"regexp_replace(regexp_replace({SKIPPED_SQL}, '(?i)</?({'|'.join(sorted(page_source.BLOCKS))})(\s[^>]*)?/?>', chr(10), 'g'), '</?[A-Za-z][^>]*>', '', 'g')"
for _name, _sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("apos", "''"), ("nbsp", " "), ("amp", "&")):
    BLOCKS_SQL = f"replace({BLOCKS_SQL}, '&{_name};', '{_sign}')"


@query(rf"SELECT page_id, array_to_string(list_filter(list_transform(string_split({BLOCKS_SQL}, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS content FROM pages")
def page_text(spark, d):
    """Main text of each page, without markup, scripts and navigation."""
    return page_source.extract_text(table(spark, d, "pages"), "page_id", "html")


@query()
def main_content(spark, d):
    """The main text of each page, without its menus and what its site repeats; tests hold it against the articles of the pages."""
    found = main_content_source.extract(table(spark, d, "pages"), "page_id", "url", "html")
    return found.withColumn("reason", F.coalesce("reason", F.lit("")))


@query("""SELECT page_id, CASE WHEN lower(regexp_extract(url, '^(?:[^:/?#]+://[^/?#]*)?([^?#]*)', 1)) LIKE '%.pdf' THEN 'pdf' ELSE 'html' END AS kind, length(html)::INT AS size FROM pages""")
def page_table(spark, d):
    """What the page sink stores: one table with the kind of each page."""
    from ..sources.results import kind_of

    return table(spark, d, "pages").select("page_id", kind_of(F.col("url")).alias("kind"), F.length("html").alias("size"))


@query("""WITH r AS (SELECT text AS query, unnest(range((item_id % 40)::INT)) AS pos, item_id FROM benchmark) SELECT item_id, pos::INT AS pos FROM r WHERE pos < 30""")
def search_provider(spark, d):
    """The offline provider: each query's results up to the third page."""
    items = table(spark, d, "benchmark")
    results = items.select(F.col("text").alias("query"), F.explode(F.when(F.col("item_id") % 40 > 0, F.sequence(F.lit(0), (F.col("item_id") % 40 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))).alias("pos"))
    strings = items.select(F.col("text").alias("query"), "item_id")
    return scorers.table_search(strings, results).select("item_id", "pos")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def event_windows(spark, d):
    """Tumbling counts, as the stream computes them."""
    from ..streaming.resume import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type")


#: Pages as search results: each belongs to the item of its id modulo their number, in the order of ids.
RESULTS_SQL = """n AS (SELECT count(*) AS n FROM benchmark), rs AS (SELECT item_id, page_id // n AS pos, url AS link, (DATE '2020-01-01' + (page_id % 366)::INT)::VARCHAR AS date,
regexp_extract(lower(url), '^[a-z]+://([^/:]*)', 1) AS host FROM pages, n, benchmark WHERE item_id = page_id % n)"""
EXCLUDED, FROM, UNTIL, ENOUGH = "example.net", "2020-02-01", "2020-10-31", 4


@query(f"""WITH {RESULTS_SQL}, rk AS (SELECT item_id, pos, link, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS i FROM rs WHERE date BETWEEN '{FROM}' AND '{UNTIL}' AND host <> '{EXCLUDED}' AND NOT ends_with(host, '.{EXCLUDED}')),
fr AS (SELECT item_id, pos, link, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS i FROM rs), k AS (SELECT item_id, count(rk.pos) AS hits FROM benchmark LEFT JOIN rk USING (item_id) GROUP BY item_id)
SELECT item_id, pos, link, TRUE AS restricted FROM rk WHERE i <= 30 UNION ALL SELECT fr.item_id, pos, link, FALSE FROM fr JOIN k ON k.item_id = fr.item_id WHERE hits < {ENOUGH} AND i <= 30""")
def search_source(spark, d):
    """Three pages of results of every item within a date range and without one site; items with fewer than four hits
    also get what an unrestricted search finds. Both searches go through the data source."""
    from ..operators.dedup import search_with_fallback
    from ..sources import web

    items = table(spark, d, "benchmark").select("item_id", F.concat(F.col("item_id").cast("string"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("query"))
    n = items.count()
    buckets = max(4, -(-n // 10_000))
    at = F.pmod("page_id", F.lit(max(n, 1)))
    dated = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).cast("string")
    pages = table(spark, d, "pages").select(at.alias("item_id"), F.expr(f"page_id div {max(n, 1)}").cast("int").alias("pos"), F.col("url").alias("link"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), dated.alias("date"))
    folder = web.shared_folder(spark)
    queries = web.in_buckets(items.select("query"), f"{folder}/queries", buckets)
    results = web.in_buckets(pages.join(items, "item_id").drop("item_id"), f"{folder}/results", buckets)
    tight = web.search(spark, queries, buckets, results=results, after=FROM, before=UNTIL, exclude=EXCLUDED).withColumn("restricted", F.lit(True))
    loose = web.search(spark, queries, buckets, results=results).withColumn("restricted", F.lit(False))
    found = tight.unionByName(loose).join(items, "query").withColumn("try", F.lit(0))
    kept = search_with_fallback(found, "item_id", "restricted", "try", ENOUGH)
    return kept.select("item_id", F.col("pos").cast("long").alias("pos"), "link", "restricted")


@query("""SELECT page_id, url AS link, CASE WHEN lower(regexp_extract(url, '^(?:[^:/?#]+://[^/?#]*)?([^?#]*)', 1)) LIKE '%.pdf' THEN 'pdf' ELSE 'html' END AS kind, 'q' || (page_id % 7) AS query, length(html) AS size FROM pages""")
def page_sink(spark, d):
    """Pages through the sink and back: what the url list and the search records say of each stored page."""
    from ..sources import web
    from ..sources.results import kind_of

    pages = table(spark, d, "pages").select(F.concat(F.lit("q"), F.pmod("page_id", F.lit(7)).cast("string")).alias("query"), F.col("page_id").alias("pos"), F.col("url").alias("link"), kind_of(F.col("url")).alias("kind"), "html")
    path = f"{web.shared_folder(spark)}/pages"
    web.write_found(pages, path)
    back = lambda part, schema: web.read_found(spark, path, part, schema)
    items, urls = back("items", "pos long, link string, html string"), back("urls", "link string, kind string").distinct()
    records = back("searches", "query string, pos long, link string")
    rows = items.join(urls, "link").join(records.select("query", "pos"), "pos")
    return rows.select(F.col("pos").alias("page_id"), "link", "kind", "query", F.length("html").cast("long").alias("size"))


def third_time(item, attempt: int) -> str:
    """Stands for a judge's call: items answer at their first to fourth try."""
    if attempt < 1 + item % 4:
        raise OSError("busy")
    return f"{item}:{attempt}"


@query("""WITH u AS (SELECT user_id, count(*) AS n, 1 + user_id % 4 AS a FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT user_id, least(n, a, 3)::INT AS tries, CASE WHEN a <= least(n, 3) THEN 'done' WHEN n >= 3 THEN 'failed' ELSE 'open' END AS status, n AS deliveries, CASE WHEN a <= least(n, 3) THEN user_id || ':' || a END AS answer FROM u""")
def stream_attempts(spark, d):
    """Every event delivers its user as an item: the stream run to its end, a few files a batch, with three tries an item."""
    from ..sources.web import shared_folder
    from ..streaming.attempts import outcomes, work_through

    folder = shared_folder(spark)
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1000).parquet(f"{d}/events.parque[t]").filter("user_id IS NOT NULL")  # a pattern: the table may be one file
    work_through(spark, stream, "user_id", third_time, f"{folder}/out", f"{folder}/checkpoint")
    return outcomes(spark, f"{folder}/out", "user_id")
