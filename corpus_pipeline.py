"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next.

quality rules -> SimHash near-dedup -> benchmark decontamination -> secret scans -> byte-level BPE.
Every stage works on all that its predecessor kept. All but the last return the columns of documents. A stage's
table goes when the next one is written.

Defined results. Null and empty texts have no words: the first stage rejects them. Very long texts are worked on whole in
every stage. Ties and repeated rows: of a near-duplicate group the row with the smallest id stays, one row also where rows
are equal; null ids come last. An empty table gives an empty result. Other columns, also those whose names clash with
columns that stages use, are kept as they are; the last stage returns the id and what it found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimspark.llm import byte_bpe, decontaminate, quality_rules, secret_scan, simhash
from claimspark.llm.common import discard, materialise, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("secret_scan", secret_scan.stage),
    ("byte_bpe", byte_bpe.stage),
]

#: Fingerprints, components, the automaton and the forest are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
            if before is not None:  # written again by the stage that follows it
                discard(before)
            before = docs
    return docs
