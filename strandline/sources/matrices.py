"""Dense matrices as rows: numpy files read into, and written from, a column of vectors."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, row, embedding) of every ``.npy`` file under ``path``; the source is the file's name without extension."""

    def rows(batches):
        for pdf in batches:
            for name, content in zip(pdf["source_id"], pdf["content"], strict=True):
                m = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                for a in range(0, len(m), 4096):
                    part = m[a : a + 4096]
                    yield pd.DataFrame({"source_id": name, "row": np.arange(a, a + len(part), dtype=np.int32), "embedding": list(part)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    named = files.select(F.regexp_extract("path", r"([^/]*)\.npy$", 1).alias("source_id"), "content")
    return named.mapInPandas(rows, "source_id string, row int, embedding array<float>")


def write_npy(vectors: DataFrame, uri: str) -> DataFrame:
    """One float32 matrix per source below ``uri``, rows in order of ``row``; returns (source_id, rows). Written under a
    name of the attempt and then moved, so a repeated task leaves one whole file."""

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
        store.create_dir(root, recursive=True)
        name = str(pdf["source_id"].iloc[0])
        m = np.stack(pdf.sort_values("row")["embedding"].to_list()).astype(np.float32)
        part = f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            buf = io.BytesIO()
            np.save(buf, m)
            f.write(buf.getvalue())
        store.move(part, f"{root}/{name}.npy")
        return pd.DataFrame({"source_id": [name], "rows": [len(m)]})

    return vectors.select(F.col("source_id").cast("string").alias("source_id"), "row", "embedding").groupBy("source_id").applyInPandas(save, "source_id string, rows int")
