"""Scene-change logs to (t, score).

A header line arms an instant, the next score line takes it and disarms; a header without a score is
overwritten; old logs give a bare time with an unknown (infinite) score. The carried state is the last
header since the last score, so one window over the line numbers of a file finds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BY = ("source_id",)
# The log's keys.
PTS = r"\bpts_time:([0-9.]+)"
SCORE = r"lavfi\.scd\.score=([0-9.]+)"
LEGACY = r"lavfi\.scd\.time=([0-9.]+)"


def parse_scene_log(raw: DataFrame, content: str = "content", by: Sequence[str] = BY) -> DataFrame:
    lines = raw.select(*by, F.posexplode(F.split(content, r"\r\n|\r|\n")).alias("_pos", "_line"))
    is_pts, is_score = F.col("_line").rlike(PTS), F.col("_line").rlike(SCORE)
    kind = F.when(is_pts, "pts").when(is_score, "score").when(F.col("_line").rlike(LEGACY), "legacy")
    x = lines.withColumn("_kind", kind).filter("_kind is not null")
    pattern = F.when(F.col("_kind") == "pts", F.regexp_extract("_line", PTS, 1)).when(F.col("_kind") == "score", F.regexp_extract("_line", SCORE, 1))
    x = x.withColumn("_v", F.coalesce(pattern, F.regexp_extract("_line", LEGACY, 1)).try_cast("double"))
    # an orphan score line leaves things as they are, so only the line just before can arm it:
    # whatever comes between a header and its score (a score or an old time) has disarmed it
    w = W.partitionBy(*by).orderBy("_pos")
    x = x.withColumns({"_pk": F.lag("_kind").over(w), "_pv": F.lag("_v").over(w)})
    scored = (F.col("_kind") == "score") & (F.col("_pk") == "pts") & F.col("_pv").isNotNull()
    t = F.when(scored, F.col("_pv")).when(F.col("_kind") == "legacy", F.col("_v"))
    score = F.when(scored, F.col("_v")).when(F.col("_kind") == "legacy", F.lit(float("inf")))
    return x.select(*by, t.alias("t"), score.alias("score")).filter("t is not null and score is not null")


def read_scene_logs(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    return parse_scene_log(raw.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("source_id"), F.col("value").alias("content")))
