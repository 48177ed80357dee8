"""Least squares on a stream: the sums of a fit add up, so epochs can arrive batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrachron.functions.basis import TimeModel
from terrachron.operators import lsq


def add(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of sums, each with a row a key at most, as one; centred ones are merged by their means."""
    both = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    one, two = (F.coalesce(F.col(f"{s}.n"), F.lit(0)) for s in "ab")
    apart = lambda name: F.col(f"b.{name}") / two - F.col(f"a.{name}") / one
    total = lambda name: F.when(one == 0, F.col(f"b.{name}")).when(two == 0, F.col(f"a.{name}")).otherwise(F.col(f"a.{name}") + F.col(f"b.{name}"))
    out = []
    for name in (c for c in a.columns if c not in keys):
        value = one + two if name == "n" else total(name)
        if name == "cyy" or name[0] == "c" and name[1:].isdigit():
            mine = "b0" if name == "cyy" else f"g{name[1:]}_0"
            value = F.when((one > 0) & (two > 0), value + one * two / (one + two) * apart("b0") * apart(mine)).otherwise(value)
        out.append(value.alias(name))
    return a.alias("a").join(b.alias("b"), both, "full_outer").select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), *out)


def sink(path: str, keys: list[str], model: TimeModel) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds a batch's sums to the table at ``path``.

    Every batch writes a version of its own, named by its number, from the newest earlier one; a repeated batch
    writes the same version again, so a restart counts nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sums = lsq.gram(batch, keys, list(model.columns().values()))
        before = newest(spark, path, number)
        (sums if before is None else add(spark.read.parquet(before), sums, keys)).write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def newest(spark: SparkSession, path: str, below: int | None = None) -> str | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbers = {int(p.getName().split("=")[1]): p.toString() for p in found}
    numbers = {k: v for k, v in numbers.items() if below is None or k < below}
    return numbers[max(numbers)] if numbers else None


def start(stream: DataFrame, path: str, checkpoint: str, keys: list[str], model: TimeModel, **trigger: object) -> StreamingQuery:
    """Keep the sums of a stream of (keys, day, value) at ``path``."""
    return stream.writeStream.foreachBatch(sink(path, keys, model)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fits(spark: SparkSession, path: str, keys: list[str], model: TimeModel, min_obs: int = 0) -> DataFrame:
    """The fits of all that has arrived."""
    at = newest(spark, path)
    if at is None:
        raise FileNotFoundError(path)
    return lsq.solve(spark.read.parquet(at), keys, model.size, min_obs)
