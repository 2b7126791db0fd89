"""File discovery and fingerprints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fingerprint, sample_offsets

# What counts as a video file.
VIDEO = (".mkv", ".mp4", ".avi", ".mov", ".m4v", ".webm", ".wmv", ".flv", ".mpg", ".mpeg", ".ts", ".m2ts", ".vob", ".ogv", ".3gp", ".mts")


def discover(spark: SparkSession, folder: str, extensions=VIDEO) -> DataFrame:
    """Files with one of the extensions, largest first; contents are pruned from the scan."""
    pattern = "(?i)(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$"
    f = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    return f.filter(F.col("path").rlike(pattern)).orderBy(F.desc("length"), "path")


def single_input(found: DataFrame) -> str:
    """The only file found; anything else is an error that says so."""
    rows = found.select("path").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("no input found" if not rows else "more than one input found: name one")
    return rows[0]["path"]


def source_ids(spark: SparkSession, folder: str, extensions=VIDEO, block: int = 8 << 20) -> DataFrame:
    """Fingerprint of each file from its size and up to three sampled blocks, read where the task runs."""

    def read(batches):
        from pyarrow import fs

        for pdf in batches:
            ids = []
            for path, size in zip(pdf["path"], pdf["length"], strict=True):
                store, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
                with store.open_input_file(at) as f:
                    ids.append(fingerprint(size, (f.read_at(n, o) for o, n in sample_offsets(size, block))))
            yield pd.DataFrame({"path": pdf["path"], "length": pdf["length"], "source_id": ids})

    return discover(spark, folder, extensions).select("path", "length").mapInPandas(read, "path string, length long, source_id string")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)
