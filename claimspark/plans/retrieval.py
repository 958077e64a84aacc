"""Search results, de-duplication, resumption, ranking and funnels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.sequences import cosine
from ..operators import dedup, ranking
from .bindings import table, tok_sql
from .registry import query
from .scalars import DOMAIN_SQL

#: The stated query set: every vector whose id is divisible by 100, against all others, its fellows included.
EVERY = 100
#: Result pages a query; three hits a page are enough to leave out the unrestricted search.
PAGES = 3

#: What a claim's searches found, in order: five claims, and links that several of their searches share.
FOUND_SQL = f"fd AS (SELECT page_id % 5 AS claim, {DOMAIN_SQL} || '/' || (page_id % 2) AS link, page_id AS pos FROM pages)"


@query(f"WITH {FOUND_SQL} SELECT claim, link, pos FROM (SELECT *, row_number() OVER (PARTITION BY claim, link ORDER BY pos) AS rn FROM fd) WHERE rn = 1")
def url_first_seen_dedup(spark, d):
    """Of the results of a claim with one URL the first stays."""
    link = F.concat(text.url_domain(F.col("url")), F.lit("/"), (F.col("page_id") % 2).cast("string"))
    rows = table(spark, d, "pages").select((F.col("page_id") % 5).alias("claim"), link.alias("link"), F.col("page_id").alias("pos"))
    return dedup.keep_first(rows, ["claim", "link"], ["pos"])


@query(f"""SELECT page_id, domain, kind FROM (SELECT *, row_number() OVER (PARTITION BY domain, kind ORDER BY page_id) AS rn FROM (SELECT page_id, {DOMAIN_SQL} AS domain, CASE WHEN page_id % 3 = 0 THEN 'pdf' ELSE 'html' END AS kind FROM pages)) WHERE kind = 'html' OR rn <= 5""")
def pdf_cap(spark, d):
    """All page results and the first five PDF results of each claim, here each domain."""
    kind = F.when(F.col("page_id") % 3 == 0, "pdf").otherwise("html")
    rows = table(spark, d, "pages").select("page_id", text.url_domain(F.col("url")).alias("domain"), kind.alias("kind"))
    return rows.filter("kind = 'html'").unionByName(dedup.first_n(rows.filter("kind = 'pdf'"), ["domain"], ["page_id"], 5))


@query(f"""WITH r AS (SELECT page_id, page_id % 20 AS claim, page_id % 2 = 0 AS restricted, (page_id // 40) % 3 AS try FROM pages),
n AS (SELECT claim, restricted, try, count(*) AS hits FROM r GROUP BY ALL),
b AS (SELECT c.claim, min(CASE WHEN n.hits IS NULL THEN t.try END) AS stop FROM (SELECT DISTINCT claim FROM r) c, (SELECT unnest([0, 1, 2]) AS try) t
 LEFT JOIN n ON n.claim = c.claim AND n.restricted AND n.try = t.try GROUP BY c.claim),
k AS (SELECT r.* FROM r JOIN b ON b.claim = r.claim WHERE restricted AND try < coalesce(stop, 3)),
m AS (SELECT c.claim, count(page_id) AS hits FROM (SELECT DISTINCT claim FROM r) c LEFT JOIN k ON k.claim = c.claim GROUP BY c.claim)
SELECT claim, page_id, restricted FROM k UNION ALL SELECT r.claim, page_id, restricted FROM r JOIN m ON m.claim = r.claim WHERE NOT restricted AND hits < 3 * {PAGES}""")
def search_fallback(spark, d):
    """Three restricted tries, ended by an empty one; claims with fewer than three hits a page get the unrestricted ones too."""
    columns = [(F.col("page_id") % 20).alias("claim"), "page_id", (F.col("page_id") % 2 == 0).alias("restricted"), F.floor(F.col("page_id") / 40 % 3).cast("int").alias("try")]
    rows = table(spark, d, "pages").select(*columns)
    return dedup.search_with_fallback(rows, "claim", "restricted", "try", 3 * PAGES).select("claim", "page_id", "restricted")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti_join(spark, d):
    """Orders that the checkpoint, the returned line items, lacks."""
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return dedup.unfinished(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("""SELECT doc_id, 'old' AS origin, n_chars AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'new', quality * 10 + toxic FROM labels""")
def result_upsert(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.lit("old").alias("origin"), F.col("n_chars").alias("v"))
    new = table(spark, d, "labels").select("doc_id", F.lit("new").alias("origin"), (F.col("quality") * 10 + F.col("toxic")).cast("long").alias("v"))
    return dedup.upsert(old, new, ["doc_id"])


@query("""SELECT (SELECT count(*) FROM documents) AS n_left, (SELECT count(*) FROM labels) AS n_right, (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS n_joined,
(SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AND (SELECT count(*) FROM documents) = (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS sound""")
def merge_checked(spark, d):
    return dedup.checked_merge(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])[1]


@query("""SELECT source, count(d.doc_id) AS expected, count(l.doc_id) AS finished, count(d.doc_id) = count(l.doc_id) AS finish FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source""")
def completeness_flag(spark, d):
    both = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return both.groupBy("source").agg(F.count("doc_id").alias("expected"), F.count("hit").alias("finished"), (F.count("doc_id") == F.count("hit")).alias("finish"))


@query(f"""SELECT doc_id, i::INT AS pos, a, b FROM (SELECT doc_id, unnest(w[1:least(len(w), len(l))]) AS a, unnest(l[1:least(len(w), len(l))]) AS b, unnest(range(least(len(w), len(l)))) AS i
FROM (SELECT doc_id, {tok_sql("text")} AS w, string_split(text, chr(10)) AS l FROM documents))""")
def positional_zip(spark, d):
    """Two parallel lists side by side, cut to the shorter: words and lines of each document."""
    rows = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"), F.split("text", "\n").alias("l"))
    n = F.least(F.size("w"), F.size("l"))
    pairs = F.arrays_zip(F.slice("w", 1, n).alias("a"), F.slice("l", 1, n).alias("b"))
    return rows.select("doc_id", F.posexplode(pairs).alias("pos", "x")).select("doc_id", "pos", "x.a", "x.b")


@query("""SELECT doc_id, rk FROM (SELECT doc_id, row_number() OVER (ORDER BY (doc_id * 2654435761 + 12345) % 4294967296, doc_id) AS rk FROM documents) WHERE rk <= 1000""")
def stable_sample(spark, d):
    """A seeded permutation cut to at most 1,000; a smaller sample is a prefix of a larger one."""
    key = (F.col("doc_id") * F.lit(2654435761) + 12345) % F.lit(4294967296)
    picked = table(spark, d, "documents").select("doc_id", key.alias("k")).orderBy("k", "doc_id").limit(1000)
    return picked.select("doc_id", F.row_number().over(Window.orderBy("k", "doc_id")).cast("long").alias("rk"))  # at most 1,000 rows


BM25_SQL = f"""q0 AS (SELECT item_id, {tok_sql("text")} AS ts FROM benchmark), d0 AS (SELECT doc_id, {tok_sql("text")} AS ts FROM documents),
c AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avgdl FROM d0),
tf AS (SELECT doc_id, term, dl, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d0) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, c), m AS (SELECT avg(idf) AS mean_idf FROM idf),
qt AS (SELECT item_id, term, count(*)::DOUBLE AS qtf FROM (SELECT item_id, unnest(ts) AS term FROM q0) GROUP BY ALL),
bm AS (SELECT item_id, doc_id, sum(qtf * CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
 FROM qt JOIN idf USING (term) JOIN tf USING (term), c, m GROUP BY item_id, doc_id)"""


def _bm25(spark, d, best=None):
    words = lambda t, i: table(spark, d, t).select(i, text.tokens(F.col("text")).alias("terms"))
    return ranking.bm25(words("benchmark", "item_id"), words("documents", "doc_id"), "item_id", "doc_id", best=best)


@query(f"WITH {BM25_SQL} SELECT item_id, doc_id, round(score, 6) AS score FROM bm")
def bm25_scores(spark, d):
    return _bm25(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH {BM25_SQL} SELECT item_id, doc_id, rk, score FROM (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id DESC) AS rk FROM bm) WHERE rk <= 10")
def bm25_top_n(spark, d):
    return ranking.top_n(_bm25(spark, d, 10).withColumn("score", F.round("score", 6)), ["item_id"], "score", "doc_id", 10)


@query(f"WITH {BM25_SQL} SELECT doc_id, round(max(score), 6) AS score FROM bm GROUP BY doc_id")
def bm25_max_pool(spark, d):
    return ranking.max_pool(_bm25(spark, d), ["doc_id"]).withColumn("score", F.round("score", 6))


DENSE_SQL = f"""dn AS (SELECT q.vec_id AS claim_id, c.vec_id AS chunk_id, c.label AS label, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
FROM embeddings q, embeddings c WHERE q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id)"""


def _dense(spark, d):
    """The stated query set against all vectors but the query's own."""
    rows = table(spark, d, "embeddings")
    asked = rows.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("claim_id"), F.col("embedding").alias("q"))
    chunks = rows.select(F.col("vec_id").alias("chunk_id"), "label", F.col("embedding").alias("v"))
    return ranking.dense_scores(asked, chunks, "claim_id", "chunk_id", "q", "v", ("label",)).filter("claim_id <> chunk_id")


@query(f"WITH {DENSE_SQL} SELECT label, chunk_id, round(max(score), 6) AS score FROM dn GROUP BY label, chunk_id")
def cosine_max_pool(spark, d):
    return ranking.max_pool(_dense(spark, d), ["label", "chunk_id"]).withColumn("score", F.round("score", 6))


#: A chunk is a vector and the document of the same id; a claim's words are its own document's.
FUSION_SQL = f"""{DENSE_SQL}, d0 AS (SELECT e.vec_id AS id, {tok_sql("text")} AS ts FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
c AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avgdl FROM d0), tf AS (SELECT id, term, dl, count(*)::DOUBLE AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM d0) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term), idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, c), m AS (SELECT avg(idf) AS mean_idf FROM idf),
bm AS (SELECT q.id AS claim_id, tf.id AS chunk_id, sum(q.tf * CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * tf.dl / avgdl))) AS score
 FROM tf q JOIN idf USING (term) JOIN tf ON tf.term = q.term, c, m WHERE q.id % {EVERY} = 0 GROUP BY q.id, tf.id),
bd AS (SELECT dn.claim_id, dn.chunk_id, round(dn.score, 6) AS score, round(coalesce(bm.score, 0), 6) AS sparse FROM dn LEFT JOIN bm ON bm.claim_id = dn.claim_id AND bm.chunk_id = dn.chunk_id),
f AS (SELECT *, 1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2) AS rrf FROM (SELECT claim_id, chunk_id,
row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, chunk_id DESC) AS r1, row_number() OVER (PARTITION BY claim_id ORDER BY sparse DESC, chunk_id DESC) AS r2 FROM bd))"""


def _fused(spark, d, best=None):
    """Dense and BM25 ranks of every chunk for every claim; chunks without a common word have a sparse score of 0."""
    from ..sources import web

    vectors = table(spark, d, "embeddings")
    # texts without a vector stay where they are; the others meet theirs once, and the weights and each pass over the chunks read what comes of it
    documents = table(spark, d, "documents").withColumnRenamed("doc_id", "vec_id").join(vectors.select("vec_id"), "vec_id", "left_semi").select("vec_id", text.tokens(F.col("text")).alias("terms"))
    path = f"{web.shared_folder(spark)}/chunks"
    vectors.select("vec_id", "embedding").join(documents, "vec_id", "left").write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    texts = rows.filter("terms IS NOT NULL").select("vec_id", "terms")
    asked = vectors.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("claim_id"), "embedding")
    weights = ranking.query_weights(texts.filter(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "claim_id"), texts, "claim_id")
    chunks = rows.withColumnRenamed("vec_id", "chunk_id")
    return ranking.fused_ranks(asked, chunks, weights, "claim_id", "chunk_id", "embedding", "terms", best)


@query(f"WITH {FUSION_SQL} SELECT claim_id, chunk_id, r1 AS rank_1, r2 AS rank_2, round(rrf, 9) AS rrf FROM f")
def rrf_fusion(spark, d):
    return _fused(spark, d).select("claim_id", "chunk_id", "rank_1", "rank_2", F.round("rrf", 9).alias("rrf"))


#: Chunks that a claim's funnel keeps, and those that go on after reranking.
FUNNEL, FINAL = 200, 10


def _funnel(spark, d):
    """(claim_id, chunk_id, rk): each claim's best chunks by both rankings."""
    return _fused(spark, d, FUNNEL).select("claim_id", "chunk_id", "rk")


TOP_SQL = f"t AS (SELECT claim_id, chunk_id, rk FROM (SELECT claim_id, chunk_id, row_number() OVER (PARTITION BY claim_id ORDER BY round(rrf, 9) DESC, chunk_id DESC) AS rk FROM f) WHERE rk <= {FUNNEL})"


@query(f"WITH {FUSION_SQL}, {TOP_SQL} SELECT claim_id, chunk_id, rk FROM t")
def hybrid_top_n(spark, d):
    return _funnel(spark, d)


#: A second scorer reranks the funnel: the share of the claim's distinct words that the chunk has.
RERANK_SQL = f"""{FUSION_SQL}, {TOP_SQL}, rr AS (SELECT t.claim_id, t.chunk_id, round(len(list_intersect(list_distinct(q.ts), k.ts))::DOUBLE / greatest(len(list_distinct(q.ts)), 1), 6) AS score
FROM t LEFT JOIN d0 q ON q.id = t.claim_id LEFT JOIN d0 k ON k.id = t.chunk_id)"""


@query(f"WITH {RERANK_SQL} SELECT claim_id, chunk_id, score, rk FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY coalesce(score, 0) DESC, chunk_id DESC) AS rk FROM (SELECT claim_id, chunk_id, coalesce(score, 0) AS score FROM rr)) WHERE rk <= {FINAL}")
def top_n_rerank(spark, d):
    """The funnel's chunks by another scorer, the ten best; chunks or claims without text score 0."""
    words = table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.tokens(F.col("text")).alias("ts"))
    pairs = _funnel(spark, d).drop("rk").join(words.select(F.col("id").alias("claim_id"), F.col("ts").alias("q")), "claim_id", "left").join(words.select(F.col("id").alias("chunk_id"), F.col("ts").alias("k")), "chunk_id", "left")
    scored = pairs.select("claim_id", "chunk_id", F.round(F.coalesce(text.overlap(F.col("q"), F.col("k")), F.lit(0.0)), 6).alias("score"))
    return ranking.top_n(scored, ["claim_id"], "score", "chunk_id", FINAL).select("claim_id", "chunk_id", "score", "rk")


#: Cosine from which two chunks of a funnel are near duplicates.
NEAR = 0.85
#: The test tables have no vectors that near; every third chunk of a funnel therefore comes a second time, under
#: an id of its own and with a vector that differs in its first dimension, as a page that was scraped twice would.
AGAIN = 1_000_000
FUNNEL_SQL = f"""{FUSION_SQL}, {TOP_SQL}, v0 AS (SELECT t.claim_id, t.chunk_id, e.embedding::DOUBLE[] AS v FROM t JOIN embeddings e ON e.vec_id = t.chunk_id),
tv AS (SELECT claim_id, chunk_id, v FROM v0 UNION ALL SELECT claim_id, chunk_id + {AGAIN}, list_concat([v[1] + 0.125 * (chunk_id % 8)], v[2:]) FROM v0 WHERE chunk_id % 3 = 0),
pr AS (SELECT a.claim_id, a.chunk_id AS a, b.chunk_id AS b FROM tv a JOIN tv b ON a.claim_id = b.claim_id AND a.chunk_id < b.chunk_id WHERE list_cosine_similarity(a.v, b.v) >= {NEAR})"""
COMP_SQL = f"""{FUNNEL_SQL}, ed AS (SELECT claim_id, a, b FROM pr UNION ALL SELECT claim_id, b, a FROM pr),
rc AS (SELECT claim_id, chunk_id AS n, chunk_id AS r FROM tv UNION SELECT rc.claim_id, ed.b, rc.r FROM rc JOIN ed ON ed.claim_id = rc.claim_id AND ed.a = rc.n),
cp AS (SELECT claim_id, n AS chunk_id, min(r) AS component FROM rc GROUP BY claim_id, n)"""


def _vectors(spark, d):
    """The funnel with its vectors, which only the kept chunks are joined to, and its repeated chunks."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = _funnel(spark, d).drop("rk").join(vectors, "chunk_id")
    moved = F.concat(F.array(F.get("v", F.lit(0)) + 0.125 * (F.col("chunk_id") % 8)), F.slice("v", 2, 1_000_000))
    one, other = F.struct("chunk_id", "v"), F.struct((F.col("chunk_id") + AGAIN).alias("chunk_id"), moved.alias("v"))
    return rows.select("claim_id", F.explode(F.when(F.col("chunk_id") % 3 == 0, F.array(one, other)).otherwise(F.array(one))).alias("x")).select("claim_id", "x.*")


def _components(spark, d):
    return dedup.similar_components(_vectors(spark, d), ["claim_id"], "chunk_id", "v", NEAR)


@query(f"WITH {FUNNEL_SQL} SELECT claim_id, a, b FROM pr")
def near_duplicate_pairs(spark, d):
    return dedup.similar_pairs(_vectors(spark, d), ["claim_id"], "chunk_id", "v", NEAR)


@query(f"WITH RECURSIVE {COMP_SQL} SELECT claim_id, chunk_id, component FROM cp")
def near_duplicate_components(spark, d):
    return _components(spark, d)


@query(f"WITH RECURSIVE {COMP_SQL} SELECT claim_id, component, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, component ORDER BY coalesce(n_chars, 0) DESC, chunk_id DESC) AS rn FROM cp LEFT JOIN documents ON doc_id = chunk_id % {AGAIN}) WHERE rn = 1")
def longest_representative(spark, d):
    """One chunk a cluster: the longest; of equal lengths the later."""
    sizes = table(spark, d, "documents").select(F.col("doc_id").alias("i"), "n_chars")
    rows = _components(spark, d).join(sizes, F.col("i") == F.col("chunk_id") % AGAIN, "left").withColumn("n", F.coalesce("n_chars", F.lit(0)))
    return dedup.longest_of_component(rows, ["claim_id"], "component", "n", "chunk_id").select("claim_id", "component", "chunk_id")


@query("SELECT DISTINCT text AS q FROM benchmark")
def distinct_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("text").alias("q")).distinct()


@query("SELECT v.label, round(avg(list_cosine_similarity(v.embedding::DOUBLE[], c.m)), 6) AS mean_cosine FROM embeddings v JOIN (SELECT label, array_agg(m ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label) c ON v.label = c.label GROUP BY v.label")
def label_cohesion(spark, d):
    """Mean cosine of a group's vectors with their mean vector."""
    rows = table(spark, d, "embeddings")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))  # one number a dimension
    return rows.join(mean, "label").groupBy("label").agg(F.round(F.avg(cosine(F.transform("embedding", lambda x: x.cast("double")), F.col("c"))), 6).alias("mean_cosine"))
