"""Session helpers: tables in, intermediate tables out, degree of parallelism."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, per_core: int = 2) -> int:
    """Partitions for Python stages: AQE would merge them by bytes although they are bound by CPU.

    ``spark.cellwright.partitionsPerCore`` overrides ``per_core``, for sessions whose tables are all small.
    """
    per_core = int(spark.conf.get("spark.cellwright.partitionsPerCore", str(per_core)))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, n: int, *cols) -> DataFrame:
    """At least ``n`` partitions for a stage bound by CPU: rows move only where a scan has fewer, never when it is large."""
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, *cols)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session in one process may do without naming it: it gets a folder of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(sc, "_cellwright_dir", None):
        sc._cellwright_dir = tempfile.mkdtemp(prefix="cellwright-")
        atexit.register(shutil.rmtree, sc._cellwright_dir, True)
    return sc._cellwright_dir


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the session stops."""
    path = f"{shared_dir(spark).rstrip('/')}/cellwright-{uuid.uuid4().hex}"
    _swept(spark).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: ends its lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cellwright_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote and nothing reads any more."""
    if path := getattr(df, "_cellwright_path", None):
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _swept(spark: SparkSession) -> list:
    """Paths that this session wrote; what is left of them is deleted when the session stops."""
    sc = spark.sparkContext
    if not hasattr(sc, "_cellwright_paths"):
        sc._cellwright_paths, stop = [], sc.stop

        def clean() -> None:
            if sc._jsc is not None:
                for path in sc._cellwright_paths:
                    try:
                        delete(spark, path)
                    except Exception:  # the gateway may be gone already
                        break
                sc._cellwright_paths.clear()
            stop()

        sc.stop = clean
        atexit.register(clean)
    return sc._cellwright_paths


def usable(*coords):
    """Coordinates that are present, finite and not negative (placeholders are negative)."""
    cond = F.lit(True)
    for c in coords:
        cond = cond & c.isNotNull() & (c >= 0) & (c < F.lit(float("inf")))
    return F.coalesce(cond, F.lit(False))


def runs(batches, key: str):
    """Arrow batches sorted by ``key`` as tables that never cut a run of equal keys; memory follows the longest run."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        at = int(k.searchsorted(k[-1], "left"))  # where the last, perhaps unfinished, run begins
        if at == 0 and (not held or held[-1].column(key)[-1].as_py() == k[0]):
            held.append(batch)
            continue
        held.append(batch.slice(0, at))
        yield pa.Table.from_batches(held)
        held = [batch.slice(at)]
    if held:
        yield pa.Table.from_batches(held)
