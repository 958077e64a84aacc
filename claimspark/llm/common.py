"""Shared pieces of the training-data operators: scratch tables, partition counts and column hygiene."""

from __future__ import annotations

import atexit
import ctypes
import math
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words in the contracts `[^\x20\x09-\x0D]+`.
ASCII_SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_own_scratch: list[str] = []
#: Scratch folders not deleted yet.
_written: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python workers at most `rows` at a time, unless the session already asks for fewer.

    The default of 10,000 rows is meant for numbers; of whole texts that is tens of megabytes, held
    several times over.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master may do without."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named
    if not conf.get("spark.master", "").startswith("local") or conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_scratch:
        _own_scratch.append("file://" + tempfile.mkdtemp(prefix="claimspark-"))
    return _own_scratch[0]


@contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Writes in here drop their shuffle files when they end: nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _scratch(spark: SparkSession) -> str:
    path = f"{scratch_root(spark)}/claimspark-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep, spark)
    _written.add(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again.

    This cuts lineage and survives lost executors: later stages read the committed files instead of
    recomputing what came before.
    """
    spark = df.sparkSession
    root = _scratch(spark)
    with shuffles_cleaned(spark):
        df.write.parquet(f"{root}/{name}")
    out = spark.read.schema(df.schema).parquet(f"{root}/{name}")
    out._claimspark_scratch = root
    return out


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write df to the shared folder, bucketed by key, so that joins by key don't shuffle it.

    Only a catalogue entry tells Spark of the buckets; it goes at once, and the plan keeps what it read.
    """
    spark = df.sparkSession
    root, name = _scratch(spark), f"claimspark_{uuid.uuid4().hex}"
    with shuffles_cleaned(spark):
        df.write.bucketBy(buckets, key).option("path", f"{root}/{name}").format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.schema  # analysed now, while the entry stands
    spark.sql(f"DROP TABLE {name}")
    out._claimspark_scratch = root
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no plan reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._claimspark_scratch)


def _delete(spark: SparkSession, root: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    _written.discard(root)


def _sweep(spark: SparkSession) -> None:
    """At exit: what results that were still to be read kept."""
    for root in sorted(_written):
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001 - the session may be gone, and then so is its way to the folder
            return


def give_back() -> None:
    """Return freed memory to the system where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def parts_for(rows: float, per_part: float, least: int = 8) -> int:
    """Partitions so that each holds about per_part rows, whatever the input's size."""
    return max(least, math.ceil(rows / per_part))
