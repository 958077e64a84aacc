"""Multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and
the others as named users; system turns stay system turns and are no participants. One row is one
turn in one perspective: the rendered segment, its place in the rendered dialogue (0-based character
offsets [start, end)), the mask, true where the assistant of this perspective speaks, and the
offsets [mask_start, mask_end) of what is learned: the words and the mark that ends them, without the head (elsewhere
empty, at start).

A text or name can't forge a turn: wherever one has `<|im_`, a blank goes after the `<`; line breaks in names are blanks.

Equal rows are counted first and dealt out again from their number, so that a turn in a third of all rows is one
row. They are told apart by MD5 digests, and texts travel once, to where their digest is; all sums go without them.
Offsets are prefix sums over a conversation of any length in three levels: inside (turn number, first SHARD digits of
the digest), over these inside BLOCK turn numbers (a bounded number of rows), and over blocks.

Turns are ordered by turn number; equal numbers, which have no order of their own, by the MD5 digest of role and text; a null turn comes
last, null roles and texts are empty strings; texts of any length stay whole. Repeated rows are kept. A null
conversation id is one conversation of its own. A conversation without
participants (system turns only) has no perspectives and gives no rows. Empty tables give empty
results. Other columns, also those with clashing names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

BLOCK = 256
SHARD = 3
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def unforged(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def head(role: Column, perspective: Column, system: str) -> Column:
    """How a turn begins as the perspective sees it; other speakers are users who carry their name."""
    name = F.translate(unforged(role), "\r\n", "  ")
    who = F.when(role == system, F.lit(system)).when(role == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name))
    return F.concat(F.lit(OPEN), who, F.lit("\n"))


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """(conv_id, perspective, seq, turn, role, segment, mask, start, end, mask_start, mask_end) of every turn and perspective."""
    number, last = F.col(turn).cast("long"), (1 << 63) - 1
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("")).alias("c"),
        F.col(conv_id).alias("conv_id"),
        number.alias("turn"),
        F.coalesce(number, F.lit(last)).alias("at"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    # the first sign keeps a null turn apart from the largest number
    digest = F.concat(F.when(F.col("turn").isNull(), "1").otherwise("0"), F.md5(F.concat("role", F.lit("\x00"), "text")))
    key = ["c", "at", "digest"]
    first = [F.first(x).alias(x) for x in ("conv_id", "turn", "role", "text")]
    distinct = rows.withColumn("digest", digest).groupBy(*key).agg(F.count("*").alias("n"), *first)
    said = F.length(unforged(F.col("text"))).cast("long") + len(CLOSE)
    sizes = rows.select(*key[:2], digest.alias("digest"), "role", said.alias("said")).groupBy(*key, "role", "said").agg(F.count("*").alias("n"))
    who = rows.filter(F.col("role") != system).select("c", F.col("role").alias("perspective")).distinct()
    size = F.col("said") + F.length(head(F.col("role"), F.col("perspective"), system))
    fine = sizes.join(who, "c").select(*key, "perspective", "n", (F.col("n") * size).alias("chars"), F.expr(f"at div {BLOCK}").alias("block"), F.substring("digest", 1, 1 + SHARD).alias("shard"))

    def level(part: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
        """What n and chars sum to before each row of its group."""
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return part.withColumns({f"{name}_{x}": F.coalesce(F.sum(x).over(w), F.lit(0)) for x in ("n", "chars")}).drop("n", "chars")

    whose = ["c", "perspective"]
    total = [F.sum(x).alias(x) for x in ("n", "chars")]
    shards = fine.groupBy(*whose, "block", "at", "shard").agg(*total)
    blocks = shards.groupBy(*whose, "block").agg(*total)
    placed = level(fine, [*whose, "at", "shard"], ["digest"], "fine")
    placed = placed.join(level(shards, [*whose, "block"], ["at", "shard"], "shard"), [*whose, "block", "at", "shard"]).join(level(blocks, whose, ["block"], "block"), [*whose, "block"])
    add = lambda x: (F.col(f"fine_{x}") + F.col(f"shard_{x}") + F.col(f"block_{x}")).cast("long")
    starts = placed.select(*key, "perspective", add("n").alias("first"), add("chars").alias("begin"))
    begins = head(F.col("role"), F.col("perspective"), system)
    seen = distinct.join(starts, key).withColumns({"segment": F.concat(begins, unforged(F.col("text")), F.lit(CLOSE)), "head": F.length(begins)})
    each = seen.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    length, mask = F.length("segment").cast("long"), F.col("role") == F.col("perspective")
    out = each.withColumns({"start": F.col("begin") + F.col("j") * length, "end": F.col("begin") + (F.col("j") + 1) * length})
    return out.select(
        "conv_id",
        "perspective",
        (F.col("first") + F.col("j")).alias("seq"),
        "turn",
        "role",
        "segment",
        mask.alias("mask"),
        "start",
        "end",
        F.when(mask, F.col("start") + F.col("head")).otherwise(F.col("start")).alias("mask_start"),
        F.when(mask, F.col("end") - 1).otherwise(F.col("start")).alias("mask_end"),  # the line break after the closing mark isn't learned
    )


def op8_chat_format(spark, sf_dir) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE_OP8 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
w AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (SELECT t.conv_id, perspective, turn, role, md5(role || chr(0) || text) AS digest,
             '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant'
             ELSE 'user name=' || replace(replace(replace(role, '<|im_', '< |im_'), chr(13), ' '), chr(10), ' ') END || chr(10) AS head,
             replace(text, '<|im_', '< |im_') || '<|im_end|>' || chr(10) AS said
      FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
p AS (SELECT *, head || said AS segment, row_number() OVER o - 1 AS seq, sum(length(head || said)) OVER o AS upto
      FROM s WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, digest ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, seq::BIGINT AS seq, turn, role, segment, (role = perspective) AS mask,
       (upto - length(segment))::BIGINT AS start, upto::BIGINT AS "end",
       (CASE WHEN role = perspective THEN upto - length(said) ELSE upto - length(segment) END)::BIGINT AS mask_start,
       (CASE WHEN role = perspective THEN upto - 1 ELSE upto - length(segment) END)::BIGINT AS mask_end FROM p
"""
