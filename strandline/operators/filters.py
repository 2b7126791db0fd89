"""Filters and clamps over untrusted or candidate rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.math import num

BY = ("source_id",)
# Codec classes and preferred languages.
TEXT_CODECS = ("subrip", "srt", "ass", "ssa", "mov_text", "webvtt", "text", "subviewer", "microdvd")
BITMAP_CODECS = ("hdmv_pgs_subtitle", "dvd_subtitle", "dvb_subtitle", "xsub", "dvb_teletext")
PREFERRED_LANGS = ("eng", "en", "english")


def codec_class(codec: Column) -> Column:
    c = F.lower(codec)
    return F.when(c.isin(*TEXT_CODECS), "text").when(c.isin(*BITMAP_CODECS), "bitmap").otherwise("unknown")


def content_shots(shots: DataFrame, span: DataFrame, by: Sequence[str] = BY, slack_s: float = 0.001) -> DataFrame:
    """Shots that lie inside the content span."""
    x = shots.join(span.select(*by, "low", "high"), list(by))
    return x.filter((F.col("start") >= F.col("low") - slack_s) & (F.col("end") <= F.col("high") + slack_s)).drop("low", "high")


def first_usable(candidates: DataFrame, by: Sequence[str] = BY, least_coverage: float = 0.10) -> DataFrame:
    """The first candidate in priority order that is ok and covers enough of the runtime."""
    ok = candidates.filter(F.col("ok") & (F.col("coverage_ratio") >= least_coverage))
    return ok.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("priority"))).filter("_r = 1").drop("_r")


def clamp_beats(beats: DataFrame, runtime: DataFrame, by: Sequence[str] = BY, order: Sequence[str] = ("ord",)) -> DataFrame:
    """Beats with a usable place: outside starts go, bad ends become start + 5, importance is 1 to 5."""
    x = beats.join(runtime.select(*by, "runtime_s"), list(by))
    s, e = num(F.col("start_s"), -1.0), num(F.col("end_s"), 0.0)
    x = x.withColumns({"start_s": s, "end_s": e}).filter("start_s >= 0 and start_s <= runtime_s")
    end = F.when(F.col("end_s") <= F.col("start_s"), F.least(F.col("runtime_s"), F.col("start_s") + 5.0)).otherwise(F.least("runtime_s", "end_s"))
    x = x.withColumns(
        {
            "end_s": end,
            "kind": F.coalesce(F.nullif(F.trim("kind"), F.lit("")), F.lit("escalation")),
            "importance": F.greatest(F.lit(1.0), F.least(F.lit(5.0), num(F.col("importance"), 3.0))).cast("int"),
        }
    )
    return x.withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).drop("runtime_s")


def normalise_pairs(pairs: DataFrame, runtime: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Setup and payoff in time order; a bad setup drops the pair, a bad payoff becomes NULL."""
    x = pairs.join(runtime.select(*by, "runtime_s"), list(by))
    x = x.withColumns({"_s": num(F.col("setup_s"), -1.0), "_p": F.when(F.col("payoff_s").isNotNull(), num(F.col("payoff_s"), -1.0))})
    x = x.filter("_s >= 0 and _s <= runtime_s").withColumn("_p", F.when(F.col("_p").between(F.lit(0.0), F.col("runtime_s")), F.col("_p")))
    x = x.withColumns({"setup_s": F.least("_s", "_p"), "payoff_s": F.when(F.col("_p").isNotNull(), F.greatest("_s", "_p"))})
    return x.withColumn("what", F.trim(F.coalesce("what", F.lit("")))).drop("_s", "_p", "runtime_s")


def normalise_twists(twists: DataFrame, runtime: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Twists on the timeline, severity 1 to 5 (3 if unknown)."""
    x = twists.join(runtime.select(*by, "runtime_s"), list(by)).withColumn("at_s", num(F.col("at_s"), -1.0))
    x = x.filter("at_s >= 0 and at_s <= runtime_s")
    sev = F.greatest(F.lit(1.0), F.least(F.lit(5.0), num(F.col("severity"), 3.0))).cast("int")
    return x.withColumns({"severity": sev, "what": F.trim(F.coalesce("what", F.lit("")))}).drop("runtime_s")


def acts_or_thirds(acts: DataFrame, runtime: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Valid acts (0 <= start < end <= runtime + 1, end clipped); a source without any gets three even thirds."""
    x = acts.join(runtime.select(*by, "runtime_s"), list(by))
    ok = x.filter("start_s >= 0 and start_s < end_s and end_s <= runtime_s + 1")
    ok = ok.select(*by, "act", "start_s", F.least("end_s", "runtime_s").alias("end_s"))
    none = runtime.select(*by, "runtime_s").join(ok.select(*by).distinct(), list(by), "left_anti")
    n = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    thirds = none.withColumn("act", n).select(
        *by, "act", (F.col("runtime_s") * (F.col("act") - 1) / 3).alias("start_s"), (F.col("runtime_s") * F.col("act") / 3).alias("end_s")
    )
    return ok.unionByName(thirds)


def eligible(
    scored: DataFrame, by: Sequence[str], max_uses: int = 3, radii: Sequence[float] = (90.0, 180.0, 360.0, 720.0), last_radius: float = 1440.0
) -> DataFrame:
    """Hard exclusions with a radius that widens until something is left.

    ``scored`` has one row per (line, shot) with start, mid, story_time, ceiling, uses. ``by`` names the line.
    Adds ``radius`` and ``eligible``.
    """
    d = F.abs(F.col("mid") - F.col("story_time"))
    base = (F.col("start") <= F.col("ceiling")) & (F.col("uses") < max_uses)
    x = scored.withColumns({"_d": d, "_base": base})
    nearest = F.min(F.when(F.col("_base"), F.col("_d"))).over(W.partitionBy(*by))
    pick = F.lit(float(last_radius))
    for r in reversed(list(radii)):
        pick = F.when(nearest <= r, float(r)).otherwise(pick)
    x = x.withColumn("radius", pick)
    return x.withColumn("eligible", F.col("_base") & (F.col("_d") <= F.col("radius"))).drop("_d", "_base")


def similarity_floor(scored: DataFrame, by: Sequence[str], floor: float = 0.15) -> DataFrame:
    """Where even the best eligible similarity is below ``floor``, score by closeness, length and light alone."""
    best = F.max(F.when(F.col("eligible"), F.col("similarity"))).over(W.partitionBy(*by))
    weak = F.coalesce(best < floor, F.lit(False))
    x = scored.withColumn("weak", weak)
    return x.withColumn("score", F.when(F.col("weak"), F.col("proximity") + F.col("band") - F.col("dark")).otherwise(F.col("score")))


def speakable(segments: DataFrame) -> DataFrame:
    """Segments with both narration and a visual query."""
    return segments.filter((F.coalesce(F.trim("narration"), F.lit("")) != "") & (F.coalesce(F.trim("visual_query"), F.lit("")) != ""))


def with_keyframe(shots: DataFrame) -> DataFrame:
    """Shots of which there is a picture."""
    return shots.filter(F.coalesce("has_keyframe", F.lit(False)))
