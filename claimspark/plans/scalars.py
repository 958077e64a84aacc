"""Projections and predicates: URLs, dates, text, judge outputs, small arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, judge, sequences, text
from ..operators.citations import citation_label
from .bindings import table, tok_sql
from .registry import query

#: Stands for the blocked sites; the test tables have example hosts only.
BLOCKED = ("therwh.example.org", "m.tionsh.example.net", "blog.therst.example.net", "example.com", "therein.example.org", "factcheck.example.org")
BLOCKED_SQL = ", ".join(f"'{b}'" for b in BLOCKED)
DOMAIN_SQL = r"""replace(regexp_extract(CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN url ELSE 'http://' || url END, '^[^:/?#]+://([^/?#]*)', 1), 'www.', '')"""
LABELS = ("Supported", "Conflicting", "Refuted", "Not Enough Evidence")


@query(f"SELECT page_id, {DOMAIN_SQL} AS domain FROM pages")
def url_domain(spark, d):
    return table(spark, d, "pages").select("page_id", text.url_domain(F.col("url")).alias("domain"))


@query(f"SELECT page_id, {DOMAIN_SQL} AS domain FROM pages WHERE {DOMAIN_SQL} NOT IN ({BLOCKED_SQL})")
def blocked_domain_filter(spark, d):
    return table(spark, d, "pages").select("page_id", text.url_domain(F.col("url")).alias("domain")).filter(~F.col("domain").isin(*BLOCKED))


@query(r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, '?', '.pdf?') ELSE url END AS link,
lower(regexp_extract(CASE WHEN page_id % 3 = 0 THEN replace(url, '?', '.pdf?') ELSE url END, '^(?:[^:/?#]+://[^/?#]*)?([^?#]*)', 1)) LIKE '%.pdf' AS is_pdf FROM pages""")
def pdf_dispatch(spark, d):
    link = F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("?"), F.lit(".pdf?"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", link.alias("link"), text.is_pdf(link).alias("is_pdf"))


DAY_SQL = "strftime(o_orderdate, '%-d-%-m-') || CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%y') WHEN 2 THEN (o_orderkey % 10)::VARCHAR ELSE 'soon' END"
CLAIM_SQL = f"""SELECT o_orderkey, x, CASE WHEN regexp_matches(x, '^\\d{{1,2}}-\\d{{1,2}}-\\d{{1,4}}$') THEN
lpad(split_part(x, '-', 2), 2, '0') || '/' || lpad(split_part(x, '-', 1), 2, '0') || '/' ||
CASE length(split_part(x, '-', 3)) WHEN 1 THEN '200' || split_part(x, '-', 3)
 WHEN 2 THEN CASE WHEN split_part(x, '-', 3)::INT <= 26 THEN '20' ELSE '19' END || split_part(x, '-', 3)
 ELSE split_part(x, '-', 3) END ELSE '01/01/2022' END AS claim_date
FROM (SELECT o_orderkey, o_orderdate, {DAY_SQL} AS x FROM orders)"""


def _day():
    year = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yy")).when(F.col("o_orderkey") % 4 == 2, (F.col("o_orderkey") % 10).cast("string")).otherwise("soon")
    return F.concat(F.date_format("o_orderdate", "d-M-"), year)


@query(CLAIM_SQL)
def claim_date_normalise(spark, d):
    return table(spark, d, "orders").select("o_orderkey", _day().alias("x")).withColumn("claim_date", dates.claim_date(F.col("x")))


@query(f"""SELECT o_orderkey, c.claim_date, r.found FROM ({CLAIM_SQL}) c JOIN
(SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '3 days ago' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
 WHEN 3 THEN strftime(o_orderdate - INTERVAL 40 DAY, '%b %-d, %Y') ELSE strftime(o_orderdate + INTERVAL 400 DAY, '%m/%d/%Y') END AS found FROM orders) r ON k = o_orderkey
WHERE coalesce(coalesce(try_strptime(found, '%m/%d/%Y'), try_strptime(found, '%Y-%m-%d'), try_strptime(found, '%b %d, %Y'), try_strptime(found, '%d %b %Y')) < try_strptime(c.claim_date, '%m/%d/%Y'), TRUE)""")
def result_date_filter(spark, d):
    k, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    found = F.when(k == 0, None).when(k == 1, "3 days ago").when(k == 2, F.date_format(day, "yyyy-MM-dd")).when(k == 3, F.date_format(F.date_sub(day, 40), "MMM d, yyyy")).otherwise(F.date_format(F.date_add(day, 400), "MM/dd/yyyy"))
    rows = table(spark, d, "orders").select("o_orderkey", dates.claim_date(_day()).alias("claim_date"), found.alias("found"))
    return rows.filter(dates.before_claim(F.col("found"), F.col("claim_date")))


@query("""SELECT item_id, pos, kind, q FROM (SELECT item_id, unnest(['claim', 'speaker', 'generated', 'generated']) AS kind, unnest([text, CASE WHEN item_id % 2 = 0 THEN 'Speaker ' || item_id || ' ' || text END,
split_part(text, ' ', 1), split_part(text, ' ', 2)]) AS q, unnest([0, 1, 2, 3])::INT AS pos FROM benchmark) WHERE q IS NOT NULL""")
def search_strings(spark, d):
    speaker = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Speaker "), F.col("item_id").cast("string")))
    rows = table(spark, d, "benchmark").select("item_id", "text", speaker.alias("speaker"), F.slice(F.split("text", " "), 1, 2).alias("queries"))
    said = F.when(F.length(F.trim("speaker")) > 0, F.concat_ws(" ", "speaker", "text"))
    tag = lambda kind, q: F.struct(F.lit(kind).alias("kind"), q.alias("q"))
    all_ = F.concat(F.array(tag("claim", F.col("text")), tag("speaker", said)), F.transform("queries", lambda q: tag("generated", q)))
    return rows.select("item_id", F.posexplode(all_).alias("pos", "x")).select("item_id", "pos", "x.kind", "x.q").filter("q IS NOT NULL")


@query("SELECT item_id, text || ' -site:a.example.org -site:b.example.org filetype:pdf' AS q, 'cdr:1,cd_min:1/1/1900,cd_max:' || lpad((item_id % 12 + 1)::VARCHAR, 2, '0') || '/15/2020' AS tbs FROM benchmark")
def search_query_suffix(spark, d):
    claim = F.concat(F.lpad((F.col("item_id") % 12 + 1).cast("string"), 2, "0"), F.lit("/15/2020"))
    return table(spark, d, "benchmark").select("item_id", text.search_suffix(F.col("text"), ("a.example.org", "b.example.org"), "pdf").alias("q"), dates.date_range(claim).alias("tbs"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace('<statement>' || text || '<cite>[1-2]' || chr(10) || '</cite></statement><|stop|>', '(?s)<cite>.*?</cite>', '', 'g'), '</?statement>', '', 'g'), '<\|[^|<>]*\|>', ' ', 'g')) AS plain FROM conversations""")
def strip_markup(spark, d):
    marked = F.concat(F.lit("<statement>"), F.col("text"), F.lit("<cite>[1-2]\n</cite></statement><|stop|>"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.strip_markup(marked).alias("plain"))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;'), '$', '&#36;'), chr(10), '<br>') AS safe FROM pages""")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_escape(F.col("html")).alias("safe"))


@query(r"SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS flat FROM documents")
def whitespace_collapse(spark, d):
    return table(spark, d, "documents").select("doc_id", text.collapse_space(F.col("text")).alias("flat"))


JUDGE = "CASE doc_id % 5 WHEN 0 THEN 'Need Citation: [[No]] then Need Citation: [[Yes]]' WHEN 1 THEN 'I say [[Partially supported]], not [[Fully]]' WHEN 2 THEN 'Rating: [[Irrelevant]] Need Citation: [[no]]' WHEN 3 THEN 'so [[Fully supported]]' ELSE 'no verdict' END"


@query(rf"""SELECT doc_id, CASE WHEN len(n) = 0 THEN NULL WHEN contains(lower(n[-1]), 'yes') THEN 1::DOUBLE ELSE 0::DOUBLE END AS need,
CASE WHEN len(b) = 0 THEN NULL WHEN contains(lower(b[1]), 'fully') THEN 1::DOUBLE WHEN contains(lower(b[1]), 'partially') THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS support,
CASE WHEN len(b) = 0 THEN NULL WHEN contains(lower(b[1]), 'irrelevant') THEN 0::DOUBLE ELSE 1::DOUBLE END AS relevance
FROM (SELECT doc_id, regexp_extract_all(j, 'Need Citation:\s*\[\[([^\]]*)\]\]', 1) AS n, regexp_extract_all(j, '\[\[([^\]]*)\]\]', 1) AS b FROM (SELECT doc_id, {JUDGE} AS j FROM documents))""")
def judge_parse(spark, d):
    j = F.expr(JUDGE)
    return table(spark, d, "documents").select("doc_id", judge.need_citation(j).alias("need"), judge.support(j).alias("support"), judge.relevance(j).alias("relevance"))


RATING = "CASE doc_id % 4 WHEN 0 THEN 'Rating: [[1]] or [[' || (doc_id % 3 + 1) || ']]' WHEN 1 THEN '[[2.5]]' WHEN 2 THEN 'none' ELSE '[[score ' || (doc_id % 5 + 1) || ']]' END"


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(x, '^\d{{1,9}}$') THEN (x::DOUBLE - 1) / 2 ELSE 0.5::DOUBLE END AS three, CASE WHEN regexp_matches(x, '^\d{{1,9}}$') THEN (x::DOUBLE - 1) / 4 ELSE 0.5::DOUBLE END AS five,
CASE WHEN regexp_matches(x, '^\d{{1,9}}$') THEN x::DOUBLE / 10 ELSE 0.5::DOUBLE END AS ten
FROM (SELECT doc_id, regexp_extract(coalesce(regexp_extract_all(r, '\[\[([^\]]*)\]\]', 1)[-1], ''), '\d+(?:\.\d+)?') AS x FROM (SELECT doc_id, {RATING} AS r FROM documents))""")
def rating_parse(spark, d):
    r = F.expr(RATING)
    return table(spark, d, "documents").select("doc_id", judge.rating(r, 1, 2).alias("three"), judge.rating(r, 1, 4).alias("five"), judge.rating(r, 0, 10).alias("ten"))


OUTPUT = "'[' || (doc_id % 7) || '] and [' || (doc_id % 5) || '], [' || (doc_id % 3) || '] [2]' || CASE WHEN doc_id % 11 = 0 THEN '' ELSE '<eos>' END"


@query(rf"""SELECT doc_id, array_to_string(c, ',') AS ids FROM (SELECT doc_id, o, list_filter(u, lambda x, i: list_position(u, x) = i)[1:2] AS c, len(list_distinct(u)) AS n
FROM (SELECT doc_id, o, list_transform(regexp_extract_all(o, '\[(\d{{1,9}})\]', 1), lambda x: x::INT) AS u FROM (SELECT doc_id, {OUTPUT} AS o FROM documents)))
WHERE o LIKE '%<eos>' AND n >= 2 AND len(list_filter(c, lambda x: x <= 0 OR x > 6)) = 0""")
def sentence_index_extract(spark, d):
    ids = judge.sentence_indices(F.expr(OUTPUT), 2, F.lit(6))
    return table(spark, d, "documents").select("doc_id", ids.alias("c")).filter("c IS NOT NULL").select("doc_id", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("ids"))


LISTS = """CASE doc_id % 4 WHEN 0 THEN '```json["a","b c","d","e","f","g"]```<eos>' WHEN 1 THEN '["one ' || doc_id || '", "two"]' WHEN 2 THEN '["a",1]' ELSE 'not json' END"""


@query(f"""SELECT doc_id, pos::INT AS pos, q FROM (SELECT doc_id, unnest(xs) AS q, unnest(range(len(xs))) AS pos FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['a', 'b c', 'd', 'e', 'f'] WHEN 1 THEN ['one ' || doc_id, 'two'] END AS xs FROM documents))""")
def query_list_parse(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(judge.query_list(F.expr(LISTS))).alias("pos", "q"))


@query(r"SELECT item_id, 'Claim is: ' || regexp_extract('Context' || chr(10) || chr(10) || 'Claim: ' || text, '(?s)' || chr(10) || chr(10) || 'Claim: (.+)', 1) AS c FROM benchmark")
def claim_text_extract(spark, d):
    q = F.concat(F.lit("Context\n\nClaim: "), F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.concat(F.lit("Claim is: "), text.claim_of_query(q)).alias("c"))


@query("""SELECT doc_id, 'In ' || lang || ': ' || text || chr(10) || 'Verdict: ' || CASE doc_id % 4 WHEN 3 THEN 'Insufficient Evidence' WHEN 2 THEN 'Refuted' WHEN 1 THEN 'Conflicting' ELSE 'Supported' END AS prompt FROM documents""")
def prompt_render(spark, d):
    label = F.get(F.array(*map(F.lit, LABELS)), (F.col("doc_id") % 4).cast("int"))
    label = F.when(label == "Not Enough Evidence", "Insufficient Evidence").otherwise(label)
    return table(spark, d, "documents").select("doc_id", text.render("In {lang}: {text}\nVerdict: {label}", lang=F.col("lang"), text=F.col("text"), label=label).alias("prompt"))


@query("""SELECT d.doc_id, CASE WHEN source IN ('src0', 'src1') THEN lang || chr(10) || chr(10) || source ELSE text END AS context, CASE WHEN source = 'src0' THEN 'Is it true?' || chr(10) || chr(10) || 'Claim: ' || source ELSE 'Summarise.' END AS query FROM documents d""")
def datapoint_projection(spark, d):
    context = F.when(F.col("source").isin("src0", "src1"), F.array_join(F.array("lang", "source"), "\n\n")).otherwise(F.col("text"))
    ask = F.when(F.col("source") == "src0", F.concat(F.lit("Is it true?\n\nClaim: "), F.col("source"))).otherwise("Summarise.")
    return table(spark, d, "documents").select("doc_id", context.alias("context"), ask.alias("query"))


@query("""SELECT doc_id, array_to_string(list_transform(ls, lambda x, i: '[' || (i - 1) || '] ' || x), chr(10)) AS a, array_to_string(list_transform(ls, lambda x, i: i || '. ' || x), chr(10)) AS b FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""")
def numbered_list(spark, d):
    lines = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", text.numbered(lines).alias("a"), text.numbered(lines, "dot", 1).alias("b"))


@query("SELECT doc_id, array_to_string(CASE WHEN len(w) > 20 THEN list_concat(w[1:10], w[-10:]) ELSE w END, ' ') AS cut FROM (SELECT doc_id, " + tok_sql("text") + " AS w FROM documents)")
def middle_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.truncate_middle(text.tokens(F.col("text")), 20), " ").alias("cut"))


LOGITS = "map_from_arrays(array('SUP', 'CON', 'REF', 'NEE'), array(doc_id % 7 * 0.5D, doc_id % 3 * 0.25D, CASE WHEN doc_id % 5 = 0 THEN null ELSE doc_id % 4 * 0.125D END, doc_id % 2 * 1.0D))"
SOFT_SQL = """l AS (SELECT doc_id, (doc_id % 7) * 0.5::DOUBLE AS a, (doc_id % 3) * 0.25::DOUBLE AS b, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 4) * 0.125::DOUBLE END AS c, (doc_id % 2) * 1.0::DOUBLE AS e FROM documents),
w AS (SELECT doc_id, exp(a - m) AS a, exp(b - m) AS b, coalesce(exp(c - m), 0::DOUBLE) AS c, exp(e - m) AS e FROM (SELECT *, greatest(a, b, c, e) AS m FROM l)),
q AS (SELECT doc_id, a / (a + b + c + e) AS p0, b / (a + b + c + e) AS p1, c / (a + b + c + e) AS p2, e / (a + b + c + e) AS p3 FROM w)"""


def verdicts(spark, d):
    return table(spark, d, "documents").select("doc_id", judge.verdict_distribution(F.expr(LOGITS), ("SUP", "CON", "REF", "NEE")).alias("dist"))


@query(f"WITH {SOFT_SQL} SELECT doc_id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3 FROM q")
def verdict_softmax(spark, d):
    return verdicts(spark, d).select("doc_id", *[F.round(F.get("dist", F.lit(i)), 6).alias(f"p{i}") for i in range(4)])


@query(f"WITH {SOFT_SQL} SELECT doc_id, round(p0 / (p0 + p1 + p2), 6) AS r0, round(p1 / (p0 + p1 + p2), 6) AS r1, round(p2 / (p0 + p1 + p2), 6) AS r2, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END::INT AS best FROM q")
def verdict_renormalise(spark, d):
    three = judge.renormalised(F.col("dist"))
    return verdicts(spark, d).withColumn("r", three).select("doc_id", *[F.round(F.get("r", F.lit(i)), 6).alias(f"r{i}") for i in range(3)], judge.argmax(F.col("r")).alias("best"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE (doc_id % 4 = 0)::INT || ',' || (doc_id % 4 = 1)::INT || ',' || (doc_id % 4 = 2)::INT END AS truth FROM documents""")
def verdict_one_hot(spark, d):
    label = F.get(F.array(*map(F.lit, LABELS)), (F.col("doc_id") % 4).cast("int"))
    hot = judge.one_hot(label, LABELS[:3])
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(hot, lambda x: x.cast("int").cast("string")), ",").alias("truth"))


@query("SELECT doc_id, i::INT AS part, (n // k + CASE WHEN i < n % k THEN 1 ELSE 0 END)::INT AS size FROM (SELECT doc_id, n, k, unnest(range(k)) AS i FROM (SELECT doc_id, n_chars AS n, doc_id % 4 + 1 AS k FROM documents))")
def even_split(spark, d):
    sizes = sequences.split_evenly(F.col("n_chars"), F.col("doc_id") % 4 + 1)
    return table(spark, d, "documents").select("doc_id", F.posexplode(sizes).alias("part", "size"))


@query("""SELECT vec_id, string_agg(CASE WHEN rk <= 3 THEN '0' ELSE '1' END, '' ORDER BY i) AS mask FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i DESC) AS rk
FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)) GROUP BY vec_id""")
def topk_ablation_mask(spark, d):
    mask = sequences.topk_mask(F.transform("embedding", lambda x: x.cast("double")), 3)
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(mask, lambda m: m.cast("int").cast("string")), "").alias("mask"))


@query("""SELECT item_id, m::INT AS m, array_to_string(list_transform(range(n), lambda j: CASE WHEN j <> m - 1 THEN '1' ELSE '0' END), '') AS mask FROM (SELECT item_id, n, unnest(range(n + 1)) AS m FROM (SELECT item_id, (item_id % 5 + 1)::INT AS n FROM benchmark))""")
def leave_one_out_masks(spark, d):
    masks = sequences.leave_one_out((F.col("item_id") % 5 + 1).cast("int"))
    return table(spark, d, "benchmark").select("item_id", F.posexplode(masks).alias("m", "mask")).withColumn("mask", F.array_join(F.transform("mask", lambda x: x.cast("int").cast("string")), ""))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[' || doc_id || ']' ELSE '[' || doc_id || '-' || (doc_id + doc_id % 3) || ']' END AS label,
CASE WHEN doc_id % 10 >= 8 THEN 'green' WHEN doc_id % 10 >= 4 THEN 'yellow' ELSE 'red' END AS colour,
CASE WHEN contains(source, 'src1') THEN 'first' WHEN contains(source, 'src') THEN 'any' END AS method,
coalesce(CASE WHEN doc_id % 3 + doc_id % 2 = 0 THEN 0::DOUBLE ELSE 2 * (doc_id % 3) * (doc_id % 2)::DOUBLE / (doc_id % 3 + doc_id % 2) END) AS f1 FROM documents""")
def presentation_lookups(spark, d):
    lo, share = F.col("doc_id"), F.col("doc_id") % 10
    r, p = (lo % 3).cast("double"), (lo % 2).cast("double")
    colour = F.when(share >= 8, "green").when(share >= 4, "yellow").otherwise("red")
    method = F.when(F.col("source").contains("src1"), "first").when(F.col("source").contains("src"), "any")
    return table(spark, d, "documents").select("doc_id", citation_label(lo, lo + lo % 3).alias("label"), colour.alias("colour"), method.alias("method"), judge.f1(r, p).alias("f1"))
