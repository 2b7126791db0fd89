"""Per-source statistics of every stage's table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import word_count

BY = ("source_id",)


def cue_stats(cues: DataFrame, runtime: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Counts, spoken time and coverage; the last cue is the last row by (start, end), not the largest end."""
    a = cues.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cue_count"),
        F.sum(word_count(F.col("text"))).alias("word_count"),
        F.sum(F.greatest(F.lit(0.0), F.col("end") - F.col("start"))).alias("spoken_seconds"),
        F.min("start").alias("first_cue_s"),
        F.max_by("end", F.struct("start", "end")).alias("last_cue_s"),
    )
    x = runtime.select(*by, "runtime_s").join(a, list(by), "left").fillna(0, ["cue_count", "word_count", "spoken_seconds", "first_cue_s", "last_cue_s"])
    return x.withColumn("coverage_ratio", F.when(F.col("runtime_s") > 0, F.col("spoken_seconds") / F.col("runtime_s")).otherwise(0.0))


def shot_stats(shots: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Counts and length statistics; the median is exact and 0 for no shots."""
    d = F.col("end") - F.col("start")
    return shots.groupBy(*by).agg(
        F.count(F.lit(1)).alias("shots"),
        F.coalesce(F.median(d), F.lit(0.0)).alias("median_s"),
        F.avg(d).alias("mean_s"),
        F.min(d).alias("min_s"),
        F.max(d).alias("max_s"),
        F.count_if("split").alias("split_count"),
        F.count_if("tail").alias("tail_count"),
    )


def cut_rate(cuts: DataFrame, sources: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    c = cuts.groupBy(*by).agg(F.count(F.lit(1)).alias("raw_cuts"))
    x = sources.join(c, list(by), "left").fillna(0, ["raw_cuts"])
    return x.withColumn("cuts_per_min", F.coalesce(F.try_divide(F.col("raw_cuts"), F.col("duration") / 60.0), F.lit(0.0)))


def mean_in_order(c: str, order: Sequence[str]) -> Column:
    """Mean of what is not NULL, added up in the order given: a plain sum of doubles hangs on how the rows are dealt to tasks."""
    rows = F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).cast("double").alias("_x")))))
    return F.try_divide(F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["_x"]), F.count(c))


def story_stats(beats: DataFrame, twists: DataFrame, pairs: DataFrame, by: Sequence[str] = BY, order: Sequence[str] = ("i",)) -> DataFrame:
    """Counts, and the mean importance, which is the same for every layout of the rows."""
    b = beats.groupBy(*by).agg(F.count(F.lit(1)).alias("beats"), mean_in_order("importance", order).alias("mean_importance"))
    t = twists.groupBy(*by).agg(F.count(F.lit(1)).alias("twists"))
    p = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.count("payoff_s").alias("paid_off"))
    return b.join(t, list(by), "left").join(p, list(by), "left").fillna(0, ["twists", "pairs", "paid_off"])


def script_stats(segments: DataFrame, by: Sequence[str] = BY, words_per_minute: float = 150.0) -> DataFrame:
    return segments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum("word_count").alias("total_words"),
        (F.sum("word_count") / F.lit(max(1.0, words_per_minute))).alias("estimated_minutes"),
        F.avg("word_count").alias("mean_words"),
        F.count_if("unresolved").alias("unresolved_beat_ids"),
        F.count_if(~F.col("anchored")).alias("dialogue_unanchored"),
    )


def index_stats(regions: DataFrame, sources: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    r = regions.groupBy(*by).agg(F.count(F.lit(1)).alias("regions"), F.sum(F.col("end") - F.col("start")).alias("covered_s"))
    x = sources.join(r, list(by), "left").fillna(0, ["regions", "covered_s"])
    return x.withColumn("covered_fraction", F.coalesce(F.try_divide("covered_s", "duration"), F.lit(0.0)))


def narration_stats(lines: DataFrame, by: Sequence[str] = BY, gap_s: float = 0.35) -> DataFrame:
    """Spoken and total time (no gap after the last line), speech rate, dropped lines."""
    spoken = F.col("seconds") > 0
    a = lines.groupBy(*by).agg(
        F.count_if(spoken).alias("lines"),
        F.count_if(~spoken).alias("dropped"),
        F.coalesce(F.sum(F.when(spoken, F.col("seconds"))), F.lit(0.0)).alias("spoken_s"),
        F.coalesce(F.sum(F.when(spoken, F.col("word_count"))), F.lit(0)).alias("words"),
    )
    a = a.withColumn("total_s", F.col("spoken_s") + F.greatest(F.lit(0), F.col("lines") - 1) * gap_s)
    return a.withColumn("wpm", F.col("words") / F.greatest(F.lit(1e-6), F.col("spoken_s") / 60.0))


def edl_stats(edl: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Clips per line and their mean length from an edit list with an array of clips."""
    c = edl.select(*by, "i", F.size("clips").alias("_n"), F.aggregate("clips", F.lit(0.0), lambda a, x: a + x["duration"]).alias("_d"))
    a = c.groupBy(*by).agg(F.count(F.lit(1)).alias("lines"), F.sum("_n").alias("clips"), F.sum("_d").alias("footage_s"))
    return a.withColumns({"clips_per_line": F.try_divide("clips", "lines"), "mean_clip_s": F.coalesce(F.try_divide("footage_s", "clips"), F.lit(0.0))})


def drift(edl: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Expected against cut footage."""
    need = F.col("seconds")
    got = F.aggregate("clips", F.lit(0.0), lambda a, x: a + x["duration"])
    return edl.groupBy(*by).agg(F.sum(need).alias("expected_s"), F.sum(got - need).alias("drift_s"))


def first_notes(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """One note per distinct trimmed name: the earliest by ``ord``; nameless rows go."""
    x = rows.withColumn("name", F.trim("name")).filter("name <> ''")
    return x.groupBy(*by, "name").agg(F.min_by("note", "ord").alias("note"), F.min("ord").alias("ord"))


def inventory(files: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Bytes and the set of stages per source."""
    return files.groupBy(*by).agg(F.sum("length").alias("bytes"), F.array_sort(F.collect_set("stage")).alias("stages"))


def run_report(stages: DataFrame) -> DataFrame:
    """Rows per stage and a total row for each run."""
    total = stages.groupBy("run").agg(F.sum("seconds").alias("seconds")).select("run", F.lit("total").alias("name"), "seconds")
    return stages.select("run", "name", "seconds").unionByName(total)


def keep_last_runs(runs: DataFrame, keep: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """The newest ``keep`` runs, overall (a top-k) or per key."""
    if not by:
        return runs.orderBy(F.desc("when")).limit(keep)
    w = W.partitionBy(*by).orderBy(F.desc("when"))
    return runs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")


def summary_line(facts: Column, *doubts: tuple[Column, str]) -> Column:
    """One line of text: an array of facts, then each number that is not zero with its word."""
    more = [F.when(n > 0, F.concat_ws(" ", n.cast("string"), F.lit(word))) for n, word in doubts]
    return F.array_join(F.concat(facts, F.array_compact(F.array(*more)) if more else F.array().cast("array<string>")), ", ")
