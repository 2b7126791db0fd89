"""Track ranking and top-k selections. Every order ends in a unique key, so ties never depend on the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import title_penalty
from .filters import PREFERRED_LANGS, codec_class

BY = ("source_id",)


def language_score(language: Column) -> Column:
    return F.when(language.isin(*PREFERRED_LANGS), 100).when(language.isNull(), 20).otherwise(0)


def rank_subtitles(streams: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Subtitle tracks best first: usable ones, then by score, then in file order."""
    frames = F.coalesce(F.least(F.floor(F.col("n_frames").try_cast("bigint") / 200), F.lit(25)), F.lit(0))
    score = (
        language_score(F.col("language"))
        + F.when(F.col("is_default"), 15).otherwise(0)
        - F.when(F.col("forced"), 90).otherwise(0)
        + title_penalty(F.col("title"))
        + frames
    )
    x = streams.withColumns({"kind": codec_class(F.col("codec")), "score": score.cast("int")})
    x = x.withColumn("usable", F.col("kind") == "text")
    w = W.partitionBy(*by).orderBy(F.desc("usable"), F.desc("score"), F.asc("index"))
    return x.withColumn("rank", F.row_number().over(w))


def pick_audio(streams: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The audio track most likely to hold the dialogue; the first on a tie."""
    score = (
        language_score(F.col("language"))
        + F.when(F.col("is_default"), 15).otherwise(0)
        + F.least(F.coalesce(F.col("channels"), F.lit(0)), F.lit(8)) * 3
        + title_penalty(F.col("title"))
    )
    x = streams.withColumn("score", score.cast("int"))
    a = x.groupBy(*by).agg(F.max_by(F.struct("index", "score"), F.struct("score", -F.col("index"))).alias("b"))
    return a.select(*by, F.col("b.index").alias("index"), F.col("b.score").alias("score"))


def audio_ordinal(streams: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Position of each audio stream among the audio streams of its file."""
    a = streams.filter("codec_type = 'audio'")
    return a.withColumn("ordinal", F.row_number().over(W.partitionBy(*by).orderBy("index")) - 1)


def sidecars(files: DataFrame, stem: str, extensions: Sequence[str] = (".srt", ".ass", ".ssa", ".vtt")) -> DataFrame:
    """Subtitle files beside a source: english tags first, then shorter names, then by name."""
    name = F.element_at(F.split("path", "/"), -1)
    x = files.withColumn("name", name).filter(F.col("name").startswith(stem))
    cond = F.lit(False)
    for e in extensions:
        cond = cond | F.lower("name").endswith(e)
    english = F.lower("name").rlike(r"[._-](en|eng|english)[._-]")
    return x.filter(cond).withColumn("english", english).orderBy(F.desc("english"), F.length("name"), "name")


def topk(rows: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = BY) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def topk_longest(shots: DataFrame, k: int = 3000, by: Sequence[str] = BY) -> DataFrame:
    """The ``k`` longest shots (the lower index on a tie), numbered again by start."""
    x = topk(shots, k, [F.desc(F.col("end") - F.col("start")), F.asc("i")], by)
    return x.withColumn("i_new", F.row_number().over(W.partitionBy(*by).orderBy("start")) - 1)


def argmax(rows: DataFrame, score: str, index: str, by: Sequence[str] = BY) -> DataFrame:
    """The best-scored row of each group, the lowest index on a tie, as a grouped maximum (no sort)."""
    return rows.groupBy(*by).agg(F.max_by(index, F.struct(F.col(score), -F.col(index))).alias(index), F.max(score).alias(score))
