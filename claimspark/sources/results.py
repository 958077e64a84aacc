"""Result documents, checkpoints and datasets.

Schemas are declared: inferring them would turn maps with data-dependent keys into structs. Scores are
kept as JSON text, since their shape depends on the method; `score_vectors` and `score_vectors_by_k`
read the two shapes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ATTRIBUTIONS = """metadata STRUCT<dataset: STRING, model: STRING>, results ARRAY<STRUCT<instance_idx: INT, query: STRING, model_answer: STRING,
answer_statements: ARRAY<STRING>, answer_statement_char_spans: ARRAY<ARRAY<INT>>, num_sources: INT, decomposed_model_answer: ARRAY<ARRAY<STRING>>,
methods: MAP<STRING, STRUCT<attr_scores: STRING, citations: ARRAY<ARRAY<INT>>, citation_spans_scores: ARRAY<ARRAY<DOUBLE>>>>>>"""
FORMATTED = """idx INT, dataset STRING, query STRING, prediction STRING, claim STRING, label STRING, pred_label STRING, justification STRING,
statements ARRAY<STRUCT<statement: STRING, support_score: DOUBLE, citation: ARRAY<STRUCT<cite: STRING, span: ARRAY<INT>, score: DOUBLE, pre_context: STRING, post_context: STRING, relevant_score: DOUBLE>>>>"""


def read_document(spark: SparkSession, path: str, schema: str = ATTRIBUTIONS) -> DataFrame:
    """One JSON document a file, read whole."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_formatted(spark: SparkSession, path: str, schema: str = FORMATTED) -> DataFrame:
    """A JSON array of items; a trailing summary element has no idx and is left out."""
    return spark.read.schema(schema).option("multiLine", True).json(path).filter("idx IS NOT NULL")


def write_document(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_checkpoint(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The finished items, or none where nothing was written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def instances(document: DataFrame) -> DataFrame:
    return document.select("metadata.dataset", "metadata.model", F.explode("results").alias("r")).select("dataset", "model", "r.*")


def score_vectors(document: DataFrame) -> DataFrame:
    """(instance_idx, method, sent_idx, source_idx, score); methods whose scores have another shape give no rows."""
    rows = instances(document).select("instance_idx", F.explode("methods").alias("method", "m"))
    vectors = rows.select("instance_idx", "method", F.posexplode(F.from_json("m.attr_scores", "array<array<double>>")).alias("sent_idx", "v"))
    return vectors.select("instance_idx", "method", "sent_idx", F.posexplode("v").alias("source_idx", "score"))


def score_vectors_by_k(document: DataFrame) -> DataFrame:
    """(instance_idx, method, sent_idx, k, source_idx, score) of methods that score each k on its own."""
    rows = instances(document).select("instance_idx", F.explode("methods").alias("method", "m"))
    maps = rows.select("instance_idx", "method", F.posexplode(F.from_json("m.attr_scores", "array<map<string,array<double>>>")).alias("sent_idx", "by"))
    each = maps.select("instance_idx", "method", "sent_idx", F.explode("by").alias("k", "v"))
    return each.select("instance_idx", "method", "sent_idx", "k", F.posexplode("v").alias("source_idx", "score"))


def nested_scores(documents: DataFrame, document: str) -> DataFrame:
    """(instance_idx, method, sent_idx, k, source_idx, score) of documents as JSON text, whatever shape a method's scores have.

    The text becomes a VARIANT once. A statement's scores are an array (k null), or an object of arrays by k; null or
    anything else, also a document that isn't JSON, gives no rows. A score that is null stays as one.
    """
    parsed = documents.select(F.try_parse_json(document).alias("v"))
    each = parsed.select(F.explode(F.try_variant_get("v", "$.results", "array<variant>")).alias("i"))
    by = each.select(F.try_variant_get("i", "$.instance_idx", "bigint").alias("instance_idx"), F.explode(F.try_variant_get("i", "$.methods", "map<string,variant>")).alias("method", "m"))
    statements = by.select("instance_idx", "method", F.posexplode(F.try_variant_get("m", "$.attr_scores", "array<variant>")).alias("sent_idx", "s"))
    plain = F.try_variant_get("s", "$", "array<double>")
    keyed = F.transform(F.map_entries(F.try_variant_get("s", "$", "map<string,array<double>>")), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("xs")))
    shapes = F.when(plain.isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("k"), plain.alias("xs")))).otherwise(keyed)
    vectors = statements.select("instance_idx", "method", F.col("sent_idx").cast("long").alias("sent_idx"), F.explode(shapes).alias("x"))
    scored = vectors.select("instance_idx", "method", "sent_idx", "x.k", F.posexplode("x.xs").alias("source_idx", "score"))
    return scored.withColumn("source_idx", F.col("source_idx").cast("long"))


def paragraphs(spark: SparkSession, folder: str, separator: str = "\n\n") -> DataFrame:
    """(path, pos, paragraph) of a folder of text files."""
    files = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", separator)).alias("pos", "paragraph"))


def seeded_sample(rows: DataFrame, row_id: str, most: int = 1000, seed: int = 0) -> DataFrame:
    """A seeded permutation cut to `most` rows; smaller samples are prefixes of larger ones."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(row_id)), row_id).limit(most)


@dataclass(frozen=True)
class Dataset:
    """Where instances come from: a table, which of its columns are context, question, claim and label, and what is left out."""

    table: str
    context: str
    question: str = "CAST(NULL AS STRING)"
    claim: str = "CAST(NULL AS STRING)"
    label: str = "CAST(NULL AS STRING)"
    keep: str = "true"


#: Datasets by name, as SQL expressions over their tables; callers add their own.
DATASETS: dict[str, Dataset] = {
    "summaries": Dataset("documents", "text"),
    "claims": Dataset("benchmark", "text", claim="text"),
    "web_evidence": Dataset("pages", "html", claim="url"),
    "chats": Dataset("conversations", "text", question="role"),
    "stances": Dataset("documents", "text", label="lang", keep="size(filter(split(text, '[.!?]'), s -> trim(s) <> '')) >= 5"),
}


def load_dataset(spark: SparkSession, folder: str, name: str, n_samples: int = -1, start: int = 0, seed: int = 0, most: int = 1000) -> DataFrame:
    """(instance_idx, dataset, context, query, claim, label): a named dataset's instances in a seeded order.

    The filter of the dataset comes first, then a seeded permutation cut to `most`, then the slice from
    `start` of n_samples (-1: all); slices of one seed fit together.
    """
    if name not in DATASETS:
        raise KeyError(f"no dataset {name!r}; there are {sorted(DATASETS)}")
    d = DATASETS[name]
    rows = spark.read.parquet(f"{folder}/{d.table}.parquet").filter(d.keep)
    taken = rows.select(*[F.expr(x).alias(n) for n, x in (("context", d.context), ("query", d.question), ("claim", d.claim), ("label", d.label))])
    keyed = taken.withColumn("key", F.xxhash64(F.lit(seed), *taken.columns))
    order = Window.orderBy("key", *taken.columns)
    numbered = keyed.orderBy("key", *taken.columns).limit(most).withColumn("instance_idx", F.row_number().over(order) - 1)  # at most `most` rows
    stop = most if n_samples < 0 else start + n_samples
    return numbered.filter((F.col("instance_idx") >= start) & (F.col("instance_idx") < stop)).select("instance_idx", F.lit(name).alias("dataset"), *taken.columns)


def write_ordered(df: DataFrame, path: str, by: str) -> None:
    """Rows in the order of a column: range-partitioned, so that files follow each other and each is sorted."""
    df.orderBy(by).write.mode("overwrite").json(path)


def kind_of(url: Column) -> Column:
    from ..functions.text import is_pdf

    return F.when(is_pdf(url), "pdf").otherwise("html")
