"""SRT and WebVTT text to cues, entirely as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.intervals import merge_cues

BY = ("source_id",)


def parse_subtitles(raw: DataFrame, content: str = "content", by: Sequence[str] = BY, merge: bool = True) -> DataFrame:
    """Cues of each file: blocks between blank lines, found by their time range and not by their number.

    Markup goes; empty and music-only cues go; a cue without length gets one second; repeated cues merge.
    """
    body = F.regexp_replace(F.ltrim(F.col(content), F.lit("﻿")), r"\r\n?", "\n")
    blocks = raw.select(*by, F.posexplode(F.split(body, r"\n{2,}")).alias("_pos", "_block"))
    start, end = T.time_range(F.col("_block"))
    after = F.regexp_extract("_block", r"(?s)" + T.TIME_RANGE + r"[^\n]*\n(.*)$", 9)
    cues = blocks.select(*by, "_pos", start.alias("start"), end.alias("end"), T.clean_text(F.translate(after, "\n", " ")).alias("text"))
    cues = cues.filter("start is not null").filter((F.col("text") != "") & ~T.is_music_only(F.col("text")))
    cues = cues.withColumn("end", F.when(F.col("end") <= F.col("start"), F.col("start") + 1.0).otherwise(F.col("end")))
    return merge_cues(cues, 1.0, by, tie=("_pos",)) if merge else cues


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle files under ``path``; the source is the file name without its extension."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    return parse_subtitles(raw.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("source_id"), F.col("value").alias("content")))


def transcribed_cues(segments: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Cues from a speech recogniser: cleaned and merged, without the music filter or the length repair."""
    x = segments.withColumn("text", T.clean_text(F.col("text"))).filter("text <> ''")
    return merge_cues(x, 1.0, by)
