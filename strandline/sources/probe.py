"""Stream tables out of a container probe's JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.math import fraction, num

BY = ("source_id",)
TAGS = "struct<language:string,LANGUAGE:string,title:string,TITLE:string,NUMBER_OF_FRAMES:string>"
STREAM = (
    "struct<index:int,codec_name:string,codec_type:string,channels:int,width:int,height:int,avg_frame_rate:string,"
    "r_frame_rate:string,duration:string,tags:map<string,string>,disposition:map<string,int>>"
)
PROBE = f"struct<format:struct<duration:string,start_time:string>,streams:array<{STREAM}>>"


def parse_probe(raw: DataFrame, content: str = "content") -> DataFrame:
    return raw.withColumn("probe", F.from_json(content, PROBE))


def streams(probed: DataFrame, codec_type: str | None = None, by: Sequence[str] = BY) -> DataFrame:
    """One row per stream; language in lower case, frame rate from the average or else the nominal rate."""
    s = probed.select(*by, F.explode("probe.streams").alias("s"))
    tag = lambda *ks: F.coalesce(*[F.nullif(F.try_element_at("s.tags", F.lit(k)), F.lit("")) for k in ks])
    flag = lambda k: F.coalesce(F.try_element_at("s.disposition", F.lit(k)) != 0, F.lit(False))
    rate = lambda c: F.nullif(fraction(F.col(c)), F.lit(0.0))
    out = s.select(
        *by,
        F.coalesce("s.index", F.lit(-1)).alias("index"),
        F.coalesce("s.codec_name", F.lit("unknown")).alias("codec"),
        F.coalesce("s.codec_type", F.lit("unknown")).alias("codec_type"),
        F.lower(tag("language", "LANGUAGE")).alias("language"),
        tag("title", "TITLE").alias("title"),
        flag("default").alias("is_default"),
        flag("forced").alias("forced"),
        F.col("s.channels").alias("channels"),
        F.col("s.width").alias("width"),
        F.col("s.height").alias("height"),
        F.coalesce(rate("s.avg_frame_rate"), rate("s.r_frame_rate")).alias("fps"),
        num(F.col("s.duration")).alias("duration_s"),
        F.try_element_at("s.tags", F.lit("NUMBER_OF_FRAMES")).alias("n_frames"),
        F.to_json("s").alias("raw"),
    )
    return out.filter(F.col("codec_type") == codec_type) if codec_type else out


def runtime(probed: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Container length if positive, else the longest stream, else 0; and the start offset."""
    d = num(F.col("probe.format.duration"))
    longest = F.array_max(F.transform("probe.streams", lambda s: num(s["duration"], 0.0)))
    return probed.select(
        *by,
        F.coalesce(F.when(d > 0, d), F.greatest(longest, F.lit(0.0)), F.lit(0.0)).alias("runtime_s"),
        num(F.col("probe.format.start_time"), 0.0).alias("start_offset_s"),
    )


def stream_label(df: DataFrame) -> DataFrame:
    """A readable one-line label per stream."""
    parts = F.concat_ws(
        " ", F.concat(F.lit("#"), F.col("index").cast("string")), "codec", "language", "title",
        F.when(F.col("is_default"), "(default)"), F.when(F.col("forced"), "(forced)"),
    )
    return df.withColumn("label", parts)
