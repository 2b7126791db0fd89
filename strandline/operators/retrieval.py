"""Vector retrieval: similarity inside a source, rescaling, top-k against all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.math import dot, min_max_rescale

BY = ("source_id",)


def line_shot_similarity(lines: DataFrame, shots: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Similarity of every line to every shot of its own source; a shot without a vector gets 0.

    The join is on the source, never across sources. Vectors are unit length, so the dot product is the cosine.
    """
    a = lines.select(*by, F.col("i").alias("line_i"), F.col("embedding").alias("_q"))
    b = shots.select(*by, F.col("i").alias("shot_i"), F.col("embedding").alias("_v"))
    x = a.join(b, list(by))
    return x.withColumn("similarity", F.coalesce(dot(F.col("_q"), F.col("_v")), F.lit(0.0))).drop("_q", "_v")


def rescale_per_line(sim: DataFrame, by: Sequence[str] = ("source_id", "line_i")) -> DataFrame:
    return sim.withColumn("similarity", min_max_rescale(F.col("similarity"), W.partitionBy(*by)))


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """Exact top ``k`` neighbours (by cosine, the smaller id on a tie) of every query among all other vectors.

    Queries are cut into blocks of ``block`` rows and each block meets each partition of the vectors once, as a
    matrix product; only ``k`` rows per query and partition are shuffled to the final merge. ``queries`` and
    ``vectors`` have (vec_id, embedding).
    """
    q = queries.select("vec_id", "embedding").filter("embedding is not null")
    q = q.withColumn("_b", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-q.count() // block)))))
    blocks = q.groupBy("_b").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("q")).select("q")
    n = max(1, -(-vectors.count() // (4 * block)))  # tiles of a bounded size, however many vectors there are
    tiles = vectors.select("vec_id", "embedding").filter("embedding is not null")
    tiles = tiles.withColumn("_t", F.pmod(F.xxhash64("vec_id"), F.lit(n))).groupBy("_t").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("v")).select("v")

    def unit(rows) -> tuple[np.ndarray, np.ndarray]:
        m = np.array([r["embedding"] for r in rows], dtype=np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.array([r["vec_id"] for r in rows], dtype=np.int64), m / np.where(norm == 0, 1, norm)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q_rows, v_rows in zip(pdf["q"], pdf["v"], strict=True):
                qi, qm = unit(q_rows)
                vi, vm = unit(v_rows)
                s = qm @ vm.T
                s[qi[:, None] == vi[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(vi, s.shape), -s), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(qi)), order.shape[1])
                cols = order.ravel()
                got = pd.DataFrame({"vec_id": qi[rows], "neighbour": vi[cols], "cosine": s[rows, cols]})
                yield got[np.isfinite(got["cosine"])]

    pairs = blocks.crossJoin(tiles)  # a stated query set in blocks against all rows in tiles
    found = pairs.mapInPandas(score, "vec_id long, neighbour long, cosine double")
    w = W.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
