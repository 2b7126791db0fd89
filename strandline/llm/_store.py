"""Intermediate tables in the folder that the whole cluster shares.

Results that are read more than once, or that cut a long lineage, are written as Parquet below
``spark.checkpoint.dir``. A lost executor takes none of them along, and nothing is kept on one machine.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its estimated size is below this; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Run) -> Run:
    """``run`` for mapInArrow. When a task is through, its worker gives what it has freed back to the machine: Spark
    keeps idle workers, and without this each would stay as large as its largest task."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
            if trim:
                trim(0)

    return go


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A local folder is made only where none is set and the master is local, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Store:
    """Written tables of one operator run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        # texts are long: smaller Arrow batches keep the memory of a task down (a session's own choice stays)
        if spark.conf.get(ARROW_ROWS, "10000") == "10000":
            spark.conf.set(ARROW_ROWS, "2000")
        self.root = f"{shared_dir(spark)}/strandline-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read back, with the schema given, so that no file is opened to infer it."""
        at = self.path(name)
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing will read again."""
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if f.startswith(("file:", "hdfs:", "s3", "gs:", "abfs", "viewfs:", "/")) and "/strandline-" in f:
                p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if ``rows`` rows of about ``row_bytes`` stay below ``limit``; else as it is."""
    return F.broadcast(df) if rows * row_bytes <= limit else df
