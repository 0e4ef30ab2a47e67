"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import pickle
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bounds of one Arrow batch sent to a Python worker.
ARROW_ROWS, ARROW_BYTES = 1000, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"_{name}_{uuid.uuid4().hex}"


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a column's texts; one number comes to the driver."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]


def arrow_limits(spark: SparkSession) -> None:
    """Bound the batches that Python workers get, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's spark.checkpoint.dir.

    Only on one machine (a local master) a temporary folder is made and set where none is named; on a cluster that is an error.
    """
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = tempfile.mkdtemp(prefix="docledger-shared-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


def materialize(df: DataFrame, name: str, bucket_by: str | None = None, n_buckets: int = 0) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage and is not computed again.

    The files survive lost executors; they belong to the run and may be deleted after it. bucket_by: a column by which
    the files are bucketed, so that a join on it does not shuffle them; they are then a table of the session's catalog.
    """
    spark, token = df.sparkSession, uuid.uuid4().hex
    path = f"{shared_dir(spark)}/{name}-{token}"
    writer = df.write.option("compression", "zstd")
    if not bucket_by:
        writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    named = f"{name.replace('-', '_')}_{token}"
    writer.bucketBy(n_buckets, bucket_by).option("path", path).saveAsTable(named, format="parquet")
    return spark.table(named)


def free(*dfs: DataFrame) -> None:
    """Delete the files that materialize() wrote for these DataFrames, once nothing reads them any more."""
    for df in dfs:
        jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsparkSession.sparkContext().hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if re.search(r"-[0-9a-f]{32}$", folder):  # a name that only materialize() gives
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(hadoop).delete(path, True)


def trim() -> None:
    """Gives memory that this worker has freed back to the machine: workers are used again, and hold what they once took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(batches_of):
    """A function of batches that trims when it is done."""

    def run(batches):
        yield from batches_of(batches)
        trim()

    return run


def trimmed_group(group_of):
    """A function of one or two groups that trims when it is done."""

    def run(*groups):
        out = group_of(*groups)
        trim()
        return out

    return run


_held: dict = {}


class Shared:
    """A broadcast value of bounded size, and what each worker builds of it, once for each process.

    What is built is kept under the value's digest, so that a worker that is used again for the same value builds it no more;
    the eight last ones are kept.
    """

    def __init__(self, spark: SparkSession, value):
        raw = pickle.dumps(value)
        self.token, self.broadcast = hashlib.md5(raw).hexdigest(), spark.sparkContext.broadcast(raw)

    def get(self, build=None, kind: str = ""):
        """The value, or what `build` makes of it; kind tells different things built of one value apart."""
        at = self.token, kind
        if at not in _held:
            while len(_held) >= 8:
                del _held[next(iter(_held))]
            value = pickle.loads(self.broadcast.value)
            _held[at] = build(value) if build else value
        return _held[at]
