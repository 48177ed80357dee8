"""What the training-data operators share: the shared folder, Python paths, Arrow kernels."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: ASCII upper case and its lower case; nothing else is folded.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of an Arrow batch where the session has Spark's default of 10,000.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def release() -> None:
    """Give memory that a worker has freed back to the system: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, give the session a checkpoint folder where it has none, and keep Arrow batches small.

    A batch of texts lies in memory on both sides of a worker's pipe, several times; a session that has set its own
    number of rows keeps it.
    """
    if spark.conf.get(BATCH_CONF, "10000") == "10000":
        spark.conf.set(BATCH_CONF, BATCH_ROWS)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or, where it is unset (tests), one made here."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    now = spark.sparkContext.getCheckpointDir()
    if not now:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terrachron-"))
        now = spark.sparkContext.getCheckpointDir()
    return now.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends, lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Remove a table made by ``stored`` once nothing will read it again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of finished jobs: its cleaner does once the driver's JVM has collected what named them, which else may take half an hour.

    Twice, since listeners hold the last job's plan for a moment after its end.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores as long as ``df`` has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column, modulus: int) -> Column:
    """Whether crc32 of the id as text leaves 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == 1


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_key(text: Column) -> Column:
    """A 64-bit hash that tells rows of one id apart by their text."""
    return F.xxhash64(text)


def arrow_rows(kernel: Callable[[dict], Iterable[dict] | None], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow kernel from a function on a batch's columns (lists) that returns the output columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(kernel(batch.to_pydict()), schema=schema)

    return run


def by_bytes(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none holds more than ``most`` bytes, but for single rows."""
    for batch in batches:
        n = max(1, batch.num_rows)
        step = max(1, int(n * most / max(most, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
    release()
