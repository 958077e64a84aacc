"""Work on items that arrive more than once: each is worked on until it succeeds or has failed too often, and never after that.

What is known of an item is keyed state, so that a stream that was stopped between or inside batches goes on where
its checkpoint ends, and no finished item is worked on again. Results are upserts: a row of a later batch replaces the item's earlier one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedup import keep_first

STATE = "tries int, status string, deliveries bigint, answer string"
OPEN, DONE, FAILED = "open", "done", "failed"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: work(item, attempt) gives an answer or raises.
Work = Callable[[object, int], str]


class Attempts(StatefulProcessor):
    """One try for each delivery of an item that isn't finished; deliveries come in batches, and none is kept."""

    def __init__(self, key: str, work: Work, most: int):
        self.key, self.work, self.most = key, work, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tries, status, deliveries, answer = self.known.get() if self.known.exists() else (0, OPEN, 0, None)
        for batch in rows:
            deliveries += len(batch)
            for _ in range(len(batch)):
                if status != OPEN:
                    break
                tries += 1
                try:
                    answer, status = self.work(key[0], tries), DONE
                except Exception:  # noqa: BLE001 - whatever a call raises, the item stays open or has failed
                    status = FAILED if tries >= self.most else OPEN
        self.known.update((tries, status, deliveries, answer))
        yield pd.DataFrame({self.key: [key[0]], "tries": [tries], "status": [status], "deliveries": [deliveries], "answer": [answer]})

    def close(self) -> None:
        pass


def work_through(spark: SparkSession, deliveries: DataFrame, key: str, work: Work, out: str, checkpoint: str, most: int = 3) -> None:
    """Run a stream of deliveries (a row each, with the item's key) to its present end; a batch that is run again replaces its own rows."""
    kind = deliveries.schema[key].dataType.simpleString()
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        worked = deliveries.select(key).groupBy(key).transformWithStateInPandas(
            statefulProcessor=Attempts(key, work, most), outputStructType=f"{key} {kind}, {STATE}", outputMode="Update", timeMode="None"
        )

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        worked.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def outcomes(spark: SparkSession, out: str, key: str) -> DataFrame:
    """(key, tries, status, deliveries, answer): the latest row of every item."""
    return keep_first(spark.read.parquet(out), [key], [F.desc("batch")]).drop("batch")
