"""Helpers that the training-data operators share: reading, cutting lineage, byte access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words in most operators here; bytes.split() uses the same.
SPACE_CLASS = r"\x20\x09-\x0D"


#: Rows of an Arrow batch; texts make rows large, and a batch stands in memory several times.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (single-machine tests) is a temporary folder set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="quarrylake-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder, which survive the loss of executors.

    ``keep`` writes a DataFrame as Parquet and rereads it, so its lineage ends there;
    ``drop`` removes a table once nothing reads it any more. Shuffle files of each write
    are released as it ends.
    """

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        conf = self.spark.conf
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, "false")
        conf.set(key, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(key, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in dfs:
            p = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            p.getFileSystem(conf).delete(p, True)


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Python values of the named columns, batch by batch."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


class Writer:
    """Collects output columns and hands out record batches of a bounded number of rows."""

    def __init__(self, schema: pa.Schema, rows: int = 5000, nbytes: int = 8_000_000):
        self.schema, self.rows, self.nbytes = schema, rows, nbytes
        self.columns: list[list] = [[] for _ in schema]
        self.size = 0

    def add(self, *values, nbytes: int = 0) -> bool:
        """Append a row; True once a batch is due."""
        for column, value in zip(self.columns, values):
            column.append(value)
        self.size += nbytes
        return len(self.columns[0]) >= self.rows or self.size >= self.nbytes

    def flush(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.columns, self.schema)]
        self.columns, self.size = [[] for _ in self.schema], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)

    def __len__(self) -> int:
        return len(self.columns[0])
