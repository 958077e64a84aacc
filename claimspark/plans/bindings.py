"""What the tables stand for: conversations are instances (assistant turns the answer, user turns the context), documents evidence, benchmark items claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..operators import attribution


#: How many rows a Python worker gets at once of tables of whole texts: sessions hand out 10,000, which holds more memory the larger a partition is.
#: What comes of conversations are statements, a few numbers each, and blocks of texts that give some 16 kB a row.
BATCH, BLOCKS = 500, 2000
TEXTS = {"documents": BATCH, "pages": BATCH, "conversations": BLOCKS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is; for those of texts the session's Arrow batches are lowered to so many rows, if they are larger or without bound."""
    held = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name in TEXTS and not 0 < int(spark.conf.get(held)) <= TEXTS[name]:
        spark.conf.set(held, str(TEXTS[name]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turn_sentences(spark, sf_dir, role: str, index: str) -> DataFrame:
    """(conv_id, index, s): the sentences of a role's turns, numbered over the conversation."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == role)
    # outer: a plain generator filters on the size of its array first, and so cuts twice
    each = turns.select("conv_id", "turn", F.posexplode_outer(sentences(F.col("text"))).alias("i", "s")).filter("i IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i")) - 1
    return each.select("conv_id", place.cast("long").alias(index), "s")


def statements(spark, sf_dir) -> DataFrame:
    return turn_sentences(spark, sf_dir, "assistant", "sent_idx")


def sources(spark, sf_dir) -> DataFrame:
    return turn_sentences(spark, sf_dir, "user", "source_idx")


def overlap_scores(spark, sf_dir) -> DataFrame:
    """(conv_id, sent_idx, source_idx, score): lexical entailment of each statement by each source of its instance."""
    return attribution.overlap_grid(statements(spark, sf_dir), sources(spark, sf_dir), "conv_id", "sent_idx", "source_idx", "s")


def held_sql(text: str, pattern: str) -> str:
    for _ in range(2):
        text = f"regexp_replace({text}, {pattern}, '\\1\\2' || chr(30) || '\\3', 'g')"
    return text


def pieces_sql(text: str, separator: str) -> str:
    return f"list_filter(list_transform(string_split({text}, {separator}), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


def cut_sql(text: str) -> str:
    """The text, with chr(31) wherever a sentence ends."""
    for pattern in ENDS_SQL:
        text = f"regexp_replace({text}, {pattern}, '\\1' || chr(31) || '\\2', 'g')"
    return f"replace({text}, chr(30), '.')"


#: The sentence rule as DuckDB has it.
HOLDS_SQL = (r"'(^|[^\p{L}\p{N}])(\p{L})\.(\s)'", r"'(^|[^\p{L}\p{N}.])(\p{N}+)\.(\s+\p{Ll})'", r"'(\.)(\.)\.(\s+\p{Ll})'")
ENDS_SQL = (r"""'([.!?][.!?"'')\]}»”’]*)(\s)'""", r"'([。！？；])()'")


def sent_sql(text: str) -> str:
    held = f"coalesce({text}, '')"
    for pattern in HOLDS_SQL:
        held = held_sql(held, pattern)
    rows = pieces_sql(cut_sql(held), "chr(31)")
    return f"(CASE WHEN len({rows}) = 1 THEN {pieces_sql(f"coalesce({text}, '')", "chr(10) || chr(10)")} ELSE {rows} END)"


def tok_sql(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '\\S+')"


#: DuckDB twins of the functions above, to be put after WITH.
SENTENCES_SQL = f"""a0 AS (SELECT conv_id, turn, role, {sent_sql("text")} AS xs FROM conversations),
e0 AS (SELECT conv_id, turn, role, unnest(xs) AS s, unnest(range(len(xs))) AS i FROM a0),
src AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS source_idx, s FROM e0 WHERE role = 'user'),
stm AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS sent_idx, s FROM e0 WHERE role = 'assistant')"""
SCORES_SQL = f"""{SENTENCES_SQL},
sc AS (SELECT m.conv_id, m.sent_idx, r.source_idx,
       CASE WHEN len(list_distinct({tok_sql("m.s")})) = 0 THEN 0::DOUBLE
            ELSE len(list_intersect(list_distinct({tok_sql("m.s")}), {tok_sql("r.s")}))::DOUBLE / len(list_distinct({tok_sql("m.s")})) END AS score
       FROM stm m JOIN src r ON m.conv_id = r.conv_id)"""
