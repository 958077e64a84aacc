"""Filter interaction audit: what each of five filters removes in every order, alone and after the others.

Exact copies are found by a fingerprint-routed RDD, and what the filters do is counted in vectors by mask:

1. A task reads its rows in blocks of BLOCK_BYTES of text. Inside a block each XXH64 fingerprint has a chain of
   its full texts with the smallest id; rows that aren't the smallest are settled at once, so a text that a
   third of all rows hold leaves a task once a block. The masks of the filters that read one text are
   computed once a chain entry.
2. Entries are partitioned by fingerprint, texts compressed, so that about PART_BYTES of text meet in a task. There
   the chains are merged by comparing full texts (compressed alike), and all but the smallest ids fail the copy filter.
3. (doc_id, part, mask) rows, counted, meet the labels by id. combineByKey adds up, for each part, a vector of
   documents by mask, and the same for good and toxic ones: 96 numbers a part, merged on the map side.
4. All 120 orders follow from a part's vector: a mask is removed at the first step whose filter it fails.

Defined results. Null and empty texts have no words and no characters; they are copies of each other. Very long texts
are taken whole, compressed where they travel. A text is a copy where a row with a smaller id has the same text:
rows of one id aren't copies of each other, and a null id counts as larger than all others. A null part is the empty
string. Repeated label rows count as good (toxic) where one of them says so. An empty table gives an empty result;
other columns, also of clashing names, are not read.
"""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, parts_for, table

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
#: Bytes of text that a task holds before it hands its chains on, and that meet in one task afterwards.
BLOCK_BYTES, PART_BYTES = 16 << 20, 24 << 20

CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SYMBOL = re.compile(rb"[#$%&*|]")
REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_mask(raw: bytes, points: int) -> int:
    """The filters A to D that a text of so many code points fails: bit k for letter k."""
    words = raw.split()  # at the ASCII white space of the contract
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * points, SYMBOL.search(raw) is not None)
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def place(doc_id) -> tuple:
    """Null ids come last."""
    return doc_id is None, doc_id if doc_id is not None else 0


class Chains:
    """By fingerprint: full texts, each with its mask, its smallest id so far and that id's rows by part."""

    def __init__(self):
        self.by_print: dict[int, dict[bytes, list]] = {}

    def find(self, fp: int, text: bytes) -> list | None:
        return self.by_print.get(fp, {}).get(text)

    def meet(self, fp: int, text: bytes, mask: int, doc_id, parts: dict) -> tuple | None:
        """Add rows of one id and text. Returns (id, rows by part, mask) of what is thereby no longer the smallest."""
        entry = self.by_print.setdefault(fp, {}).setdefault(text, [mask, doc_id, {}])
        own, first, held = entry
        if place(doc_id) > place(first):
            return doc_id, parts, own | COPY
        if place(doc_id) == place(first):
            for part, n in parts.items():
                held[part] = held.get(part, 0) + n
            return None
        entry[1:] = doc_id, dict(parts)
        return first, held, own | COPY

    def entries(self):
        for fp, chain in self.by_print.items():
            for text, (mask, doc_id, parts) in chain.items():
                yield fp, text, mask, doc_id, parts


def routed(rows, block_bytes: int = BLOCK_BYTES):
    """(key, (packed text or None, mask, id, rows by part)) of a task's rows (doc_id, text, part).

    Without a text: a row that is settled as a copy; its key only spreads such rows.
    """
    pack = zstandard.ZstdCompressor(level=1).compress
    settled = lambda doc_id, parts, mask: (xxhash.xxh64_intdigest(repr(doc_id)), (None, mask, doc_id, parts))
    chains, held = Chains(), 0
    for doc_id, text, part in rows:
        raw = text.encode("utf-8", "surrogatepass")
        fp = xxhash.xxh64_intdigest(raw)
        known = chains.find(fp, raw)
        if known is None:
            held += len(raw)
        late = chains.meet(fp, raw, known[0] if known else own_mask(raw, len(text)), doc_id, {part: 1})
        if late:
            yield settled(*late)
        if held >= block_bytes:
            for f, t, *entry in chains.entries():
                yield f, (pack(t), *entry)
            chains, held = Chains(), 0
    for f, t, *entry in chains.entries():
        yield f, (pack(t), *entry)


def merged(pairs):
    """(id, part, mask, n) of all rows that met in one task: only the smallest id of a text has no copy bit."""
    chains = Chains()
    rows = lambda doc_id, parts, mask: ((doc_id, part, mask, n) for part, n in parts.items())
    for fp, (packed, mask, doc_id, parts) in pairs:
        late = (doc_id, parts, mask) if packed is None else chains.meet(fp, packed, mask, doc_id, parts)
        if late:
            yield from rows(*late)
    for _, _, mask, doc_id, parts in chains.entries():
        yield from rows(doc_id, parts, mask)


def masks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang", block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, part, mask int, n long): how many rows of an id and part fail exactly the filters of the mask."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fingerprint = int
    found = rows.rdd.mapPartitions(lambda it: routed(it, block_bytes)).partitionBy(parts_for(size, part_bytes), fingerprint).mapPartitions(merged)
    return materialise(spark.createDataFrame(found, f"doc_id {dict(rows.dtypes)['doc_id']}, part string, mask int, n long", verifySchema=False), "masks")


def vectors(marked: DataFrame, labels: DataFrame):
    """RDD of (part, 3 x MASKS counts): documents by mask, good ones, toxic ones."""
    said = labels.groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    counted = marked.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(said, "doc_id", "left")
    rows = counted.select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0))).rdd

    def add(counts, row):
        mask, n, good, toxic = row
        counts[:, mask] += (n, n * good, n * toxic)
        return counts

    create = lambda row: add(np.zeros((3, MASKS), np.int64), row)
    return rows.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(create, add, lambda a, b: a + b, int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def report(part: str, counts: np.ndarray):
    """The audit's rows of a part: every order, every step."""
    at = np.arange(MASKS)
    rows, total = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            fails, gone = (at & bit) != 0, (at & before) != 0
            here = fails & ~gone
            n, good, toxic = counts[:, here].sum(1).tolist()
            total[letter] += n
            rows.append((part, "".join(order), step, int(counts[0, ~fails & ~gone].sum()), n, int(counts[0, fails & gone].sum()), int(counts[0, bit]), good, toxic))
            before |= bit
    return [(*row, total[row[1][row[2] - 1]]) for row in rows]


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """One row a part, order and step (REPORT)."""
    spark = docs.sparkSession
    found = vectors(masks(docs, text, doc_id, part), labels)
    return spark.createDataFrame(found.flatMap(lambda kv: report(*kv)), REPORT, verifySchema=False)


def op13_filter_audit(spark, sf_dir) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_OP13 = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
o AS (SELECT [a, b, c, d, e] AS l FROM (SELECT x1.letter AS a, x2.letter AS b, x3.letter AS c, x4.letter AS d, x5.letter AS e FROM x AS x1, x AS x2, x AS x3, x AS x4, x AS x5)
      WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT array_to_string(l, '') AS filter_order, step, l[step] AS letter, l[1:step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
b AS (SELECT filter_order, step, letter, (SELECT bit FROM x WHERE x.letter = s.letter) AS bit,
             coalesce((SELECT sum(bit) FROM x WHERE list_contains(s.earlier, x.letter)), 0)::INT AS before FROM s),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (WHERE mask & (bit | before) = 0), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
      FROM c, b GROUP BY part, filter_order, step, letter)
SELECT * EXCLUDE (letter, step), step::INT AS step, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM r
"""
