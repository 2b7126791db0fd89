"""Text outputs: subtitles and concat lists, one document per source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

BY = ("source_id",)


def _joined(rows: DataFrame, order: str, block: str, by: Sequence[str], sep: str, name: str) -> DataFrame:
    a = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(block).alias("b"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(a, lambda x: x["b"]), sep).alias(name))


def srt_blocks(lines: DataFrame, by: Sequence[str] = BY, order: str = "i") -> DataFrame:
    """Numbered blocks; the number is the place on the timeline, so empty lines leave gaps."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(order))
    length = F.coalesce(F.nullif(F.col("spoken_s"), F.lit(0.0)), F.col("seconds"))
    x = lines.withColumn("n", n).filter(F.coalesce(F.trim("narration"), F.lit("")) != "")
    times = F.concat(T.timestamp_srt(F.col("start_s")), F.lit(" --> "), T.timestamp_srt(F.col("start_s") + length))
    return x.select(*by, "n", F.concat(F.col("n").cast("string"), F.lit("\n"), times, F.lit("\n"), F.trim("narration"), F.lit("\n")).alias("block"))


def srt_documents(lines: DataFrame, by: Sequence[str] = BY, order: str = "i") -> DataFrame:
    return _joined(srt_blocks(lines, by, order), "n", "block", by, "\n", "content")


def concat_lists(edl: DataFrame, path: str, by: Sequence[str] = BY) -> DataFrame:
    """``file``, ``inpoint``, ``outpoint`` per clip in timeline order; clips without length go."""
    c = edl.select(*by, "i", F.posexplode("clips").alias("k", "c")).filter("c.src_end > c.src_start")
    num = lambda x: F.format_string("%.3f", x)
    block = F.concat(
        F.lit("file "), T.concat_path(F.lit(path)), F.lit("\ninpoint "), num(F.col("c.src_start")), F.lit("\noutpoint "), num(F.col("c.src_end"))
    )
    x = c.select(*by, (F.col("i").cast("bigint") * 100000 + F.col("k")).alias("o"), block.alias("b"))
    out = _joined(x, "o", "b", by, "\n", "content")
    return out.withColumn("content", F.concat(F.lit("ffconcat version 1.0\n"), F.col("content"), F.lit("\n")))


def narration_list(lines: DataFrame, gap: str, by: Sequence[str] = BY) -> DataFrame:
    """Audio files in order with the silence ``gap`` between all but after the last."""
    w = W.partitionBy(*by).orderBy("i")
    parts = F.when(F.lead("i").over(w).isNull(), F.array("wav")).otherwise(F.array(F.col("wav"), F.lit(gap)))
    x = lines.withColumn("_p", parts).select(*by, F.col("i"), F.posexplode("_p").alias("k", "file"))
    x = x.select(*by, (F.col("i").cast("bigint") * 2 + F.col("k")).alias("o"), F.concat(F.lit("file "), T.concat_path(F.col("file"))).alias("b"))
    return _joined(x, "o", "b", by, "\n", "content")


def narration_format(lines: DataFrame, by: Sequence[str] = BY, default=(22050, 1)) -> DataFrame:
    """Sample rate and channels of the first readable audio file of each source."""
    a = lines.groupBy(*by).agg(F.min_by(F.struct("rate", "channels"), F.when(F.col("rate").isNotNull(), F.col("i"))).alias("f"))
    return a.select(*by, F.coalesce("f.rate", F.lit(default[0])).alias("rate"), F.coalesce("f.channels", F.lit(default[1])).alias("channels"))


def write_documents(docs: DataFrame, path: str, by: Sequence[str] = BY) -> None:
    """Documents as text, one folder per source, by Spark's own commit protocol."""
    docs.select(*by, F.col("content").alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
