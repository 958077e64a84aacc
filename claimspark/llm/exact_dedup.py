"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only.

1. The scan gives every row a SHA-256 of its normalised text; these keys, without the texts, go to a scratch
   table. Nothing is shuffled for it.
2. First pass: a counting Bloom filter of HASHES cells a row, with BITS cells for each row of the table. Cells
   are counted with partial aggregation, so that a text in a third of all rows is a few cells a task. Cells
   that two rows or more set make bitmaps of BLOCK bits; all cells of a row lie in one block.
3. Second pass: every key is tested against its block's bitmap. A row with a cell of its own repeats no other
   and passes straight through. Only rows whose cells are all shared shuffle, and equality of digests decides.
   With BITS = 16 about one row in seventy is taken along for nothing.

The bitmaps (2 bytes a row) are broadcast up to BROADCAST_BLOCKS of them, 64 MB or 33 million rows; beyond that
keys, still without texts, meet the bitmaps in a join by block. The results are the same.

Equal texts are identical after replacing each run of ASCII white space by one space; SHA-256 stands for
identity. Of equal texts the row with the smallest id stays. Groups with more than one in HOT of the possibly
repeated rows, fewer than HOT by that, are broadcast where rows meet their group, so that a group of any
size is spread over all tasks.

Defined results. A null text is empty, and equal to empty texts; very long texts are taken whole. Null ids come
after all others; the keep_id of a group of null ids is null. Ties: of rows with one id and equal texts one
stays and the others are dropped. An empty table gives an empty result. Other columns are kept by `unique_rows`,
whatever their names, and not read elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialise, parts_for, table

#: Bits of one bitmap: what bitmap_construct_agg makes.
BLOCK = 32_768
#: Cells of the filter for each row of the table, and cells that a row sets.
BITS, HASHES = 16, 2
#: Bitmaps of 4 KB that are broadcast at most.
BROADCAST_BLOCKS = 16_384
#: A group with more than one in HOT of the possibly repeated rows is broadcast.
HOT = 1000


def digest(text: Column) -> Column:
    """SHA-256 (binary) of the text with each run of ASCII white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), ASCII_SPACE + "+", " ").cast("binary"), 256))


def with_block(rows: DataFrame, blocks: int) -> DataFrame:
    """rows(digest) with the row's block of the filter and its cells there, from different bits of one hash."""
    h = F.xxhash64("digest")
    cells = F.array(*[F.shiftrightunsigned(h, 64 - 15 * (k + 1)).bitwiseAND(F.lit(BLOCK - 1)) for k in range(HASHES)])
    return rows.withColumns({"block": F.pmod(h, F.lit(blocks).cast("long")), "cells": cells})


def shared_cells(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the cells that two rows of keys(digest) or more set, as a bitmap a block."""
    cells = with_block(keys.select("digest"), blocks).select("block", F.explode(F.array_distinct("cells")).alias("cell"))
    often = cells.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # dealt by block first, so that each bitmap is built once and not once a task
    return often.select("block", "cell").repartition("block").groupBy("block").agg(F.bitmap_construct_agg("cell").alias("bits"))


def tested(rows: DataFrame, bitmaps: DataFrame, blocks: int, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """rows(digest, ...) with `maybe`: whether another row may have the same digest."""
    side = F.broadcast(bitmaps) if blocks <= broadcast_blocks else bitmaps
    byte = lambda c: F.conv(F.hex(F.substring(F.col("bits"), F.floor(c / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    shared = F.forall("cells", lambda c: F.getbit(byte(c), F.pmod(c, F.lit(8)).cast("int")) == 1)
    return with_block(rows, blocks).join(side, "block", "left").withColumn("maybe", F.col("bits").isNotNull() & shared).drop("block", "cells", "bits")


def blocks_for(rows: int) -> int:
    return parts_for(rows * BITS, BLOCK, 1)


def duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) of every row of docs."""
    keys = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), digest(F.col(f"`{text}`")).alias("digest"))
    keys = materialise(keys.withColumn("row", F.monotonically_increasing_id()), "keys")
    blocks = blocks_for(keys.count())
    marked = tested(keys, materialise(shared_cells(keys, blocks), "bitmaps"), blocks, broadcast_blocks)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    groups = materialise(marked.filter("maybe").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")), "groups")
    bound = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT
    met = marked.filter("maybe").join(F.broadcast(groups.filter(F.col("n") > bound)), "digest", "left")
    cold = met.filter("n IS NULL").drop("n", "first").join(groups.filter(F.col("n") <= bound), "digest")
    repeated = met.filter("n IS NOT NULL").unionByName(cold).select("doc_id", "digest", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"))
    alone = marked.filter("NOT maybe").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return alone.unionByName(repeated)


def unique_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """One row of each group of equal texts, with all columns of docs.

    Rows that repeat nothing never shuffle. The others are aggregated by digest, one row a group and task before the shuffle.
    """
    columns = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    keyed = named.withColumn("digest", digest(F.col(f"c{columns.index(text)}")))
    keys = materialise(keyed.select("digest"), "keys")
    blocks = blocks_for(keys.count())
    marked = tested(keyed, materialise(shared_cells(keys, blocks), "bitmaps"), blocks, broadcast_blocks)
    i = F.col(f"c{columns.index(doc_id)}")
    own = [f"c{k}" for k in range(len(columns))]
    first = marked.filter("maybe").groupBy("digest").agg(F.min_by(F.struct(*own), F.struct(i.isNull(), i)).alias("row"))
    return marked.filter("NOT maybe").select(*own).unionByName(first.select("row.*")).toDF(*columns)


def op12_exact_dedup(spark, sf_dir) -> DataFrame:
    found = duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_OP12 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
