"""Joins along the timeline.

Range joins always carry the source as an equi key. ``overlap_join`` adds a time bucket, so that a
long source is dealt over many tasks and no pair is compared twice. The as-of joins merge both
sides into one ordered stream per source and carry the last value: no join on ranges at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BY = ("source_id",)


def overlap_join(left: DataFrame, right: DataFrame, by: Sequence[str] = BY, bucket_s: float = 300.0) -> DataFrame:
    """Pairs of ``left`` [start, end) and ``right`` [r_start, r_end) that overlap strictly, each once.

    Both sides are dealt to the buckets they touch; the pair belongs to the bucket of the later start.
    """
    b = lambda c: F.floor(c / bucket_s).cast("bigint")
    lx = left.withColumn("_b", F.explode(F.sequence(b(F.col("start")), F.greatest(b(F.col("start")), b(F.col("end"))))))
    rx = right.withColumn("_b", F.explode(F.sequence(b(F.col("r_start")), F.greatest(b(F.col("r_start")), b(F.col("r_end"))))))
    x = lx.join(rx, [*by, "_b"]).filter("start < r_end and end > r_start")
    return x.filter(F.col("_b") == b(F.greatest("start", "r_start"))).drop("_b")


def overlap_semi(left: DataFrame, regions: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Rows of ``left`` that overlap any region strictly.

    No join: of all regions that start before a row ends, the latest end says whether one reaches into the row. So both
    sides pass once in order of time, and the work does not grow with the number of pairs.
    """
    row = F.struct(*left.columns).alias("_row")
    a = left.select(*by, F.col("end").alias("_t"), F.lit(0).alias("_side"), row)
    b = regions.select(*by, F.col("start").alias("_t"), F.lit(1).alias("_side"), F.col("end").alias("_end"))
    x = a.unionByName(b, allowMissingColumns=True)
    # at equal times the row comes first: a region that starts where the row ends does not overlap it
    w = W.partitionBy(*by).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumn("_reach", F.max("_end").over(w)).filter("_side = 0")
    return x.filter(F.col("_reach") > F.col("_row.start")).select("_row.*")


def within(points: DataFrame, ranges: DataFrame, t: str, low: str, high: str, by: Sequence[str] = BY, closed: bool = False) -> DataFrame:
    """Pairs of points and the ranges that hold them: low <= t < high, or <= high if ``closed``.

    Time is cut into buckets as long as a source's ranges are on average, so a range lies in about two of them and a point
    meets only ranges near it.
    """
    span = F.greatest(F.avg(F.col(high) - F.col(low)), F.lit(1e-3))
    size = ranges.groupBy(*by).agg(span.alias("_size"))
    bucket = lambda c: F.floor(F.col(c) / F.col("_size")).cast("bigint")
    r = ranges.filter(F.col(low) <= F.col(high)).join(size, list(by))
    r = r.withColumn("_b", F.explode(F.sequence(bucket(low), bucket(high)))).drop("_size")
    p = points.join(size, list(by)).withColumn("_b", bucket(t)).drop("_size")
    inside = (F.col(t) >= F.col(low)) & ((F.col(t) <= F.col(high)) if closed else (F.col(t) < F.col(high)))
    return p.join(r, [*by, "_b"]).filter(inside).drop("_b")


def shot_vectors(shots: DataFrame, vectors: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Shots with the vector in their row of the source's matrix; NULL where they have none."""
    return shots.join(vectors.select(*by, F.col("row").alias("clip_row"), "embedding"), [*by, "clip_row"], "left")


def _merged(left: DataFrame, right: DataFrame, t: str, rt: str, payload: Sequence[str], by: Sequence[str]):
    row = F.struct(*[c for c in left.columns if c not in by])
    a = left.select(*by, F.col(t).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"))
    pay = F.struct(F.col(rt).alias("_rt"), *payload)
    b = right.select(*by, F.col(rt).alias("_t"), F.lit(0).alias("_side"), pay.alias("_pay"))
    return a.unionByName(b, allowMissingColumns=True)


def asof_next(left: DataFrame, right: DataFrame, t: str, rt: str, payload: Sequence[str] = (), by: Sequence[str] = BY) -> DataFrame:
    """The first right row strictly after ``t`` as ``next`` (struct with ``_rt`` and the payload, NULL if none)."""
    x = _merged(left, right, t, rt, payload, by)
    # at equal times the event sorts before the probe, so what follows the probe is strictly later
    w = W.partitionBy(*by).orderBy("_t", "_side").rowsBetween(W.currentRow, W.unboundedFollowing)
    x = x.withColumn("next", F.first("_pay", ignorenulls=True).over(w)).filter("_side = 1")
    return x.select(*by, "_row.*", "next")


def asof_last(left: DataFrame, right: DataFrame, t: str, rt: str, payload: Sequence[str] = (), by: Sequence[str] = BY) -> DataFrame:
    """The last right row at or before ``t`` as ``prev``; before the first one, the first (clamped)."""
    x = _merged(left, right, t, rt, payload, by)
    w = W.partitionBy(*by).orderBy("_t", "_side")
    back = F.last("_pay", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    ahead = F.first("_pay", ignorenulls=True).over(w.rowsBetween(W.currentRow, W.unboundedFollowing))
    x = x.withColumn("prev", F.coalesce(back, ahead)).filter("_side = 1")
    return x.select(*by, "_row.*", "prev")


def asof_nearest(left: DataFrame, right: DataFrame, t: str, rt: str, payload: Sequence[str] = (), by: Sequence[str] = BY) -> DataFrame:
    """The right row nearest to ``t`` as ``near``; the earlier one on a tie."""
    x = _merged(left, right, t, rt, payload, by)
    w = W.partitionBy(*by).orderBy("_t", "_side")
    x = x.withColumns(
        {
            "_b": F.last("_pay", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)),
            "_a": F.first("_pay", ignorenulls=True).over(w.rowsBetween(W.currentRow, W.unboundedFollowing)),
        }
    ).filter("_side = 1")
    later = F.col("_b").isNull() | (F.col("_a").isNotNull() & (F.col("_a._rt") - F.col("_t") < F.col("_t") - F.col("_b._rt")))
    return x.withColumn("near", F.when(later, F.col("_a")).otherwise(F.col("_b"))).select(*by, "_row.*", "near")


def resolve_beat(segments: DataFrame, beats: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Segments joined to the beat they name, else to the beat at their own position in the act (clamped to the last).

    ``segments``: beat_id, act, ord (position in the act); ``beats``: i, act, and what is to be carried.
    ``unresolved`` marks the fallback.
    """
    known = beats.select(*by, F.col("i").alias("beat_id"), F.col("act").alias("_act")).withColumn("_hit", F.lit(True))
    x = segments.join(known.drop("_act"), [*by, "beat_id"], "left")
    seat = beats.withColumn("_seat", F.row_number().over(W.partitionBy(*by, "act").orderBy("i")) - 1)
    last = seat.groupBy(*by, "act").agg(F.max("_seat").alias("_last"))
    x = x.join(last, [*by, "act"], "left").withColumn("_seat", F.least("ord", "_last"))
    x = x.join(seat.select(*by, "act", "_seat", F.col("i").alias("_fallback")), [*by, "act", "_seat"], "left")
    x = x.withColumns({"unresolved": F.col("_hit").isNull(), "beat_id": F.when(F.col("_hit"), F.col("beat_id")).otherwise(F.col("_fallback"))})
    return x.drop("_hit", "_last", "_seat", "_fallback")


def cite_cue(segments: DataFrame, cues: DataFrame, by: Sequence[str] = BY, slack_s: float = 1.0) -> DataFrame:
    """Anchor of a segment: the start of the cue it cites if that lies within its beat (with slack), else the beat's start.

    A negative or unknown ordinal is misplaced.
    """
    c = cues.select(*by, F.col("i").alias("line_id"), F.col("start").alias("_cue"))
    x = segments.join(c, [*by, "line_id"], "left")
    ok = F.coalesce((F.col("_cue") >= F.col("beat_start") - slack_s) & (F.col("_cue") <= F.col("beat_end") + slack_s), F.lit(False))
    return x.withColumns({"anchored": ok, "anchor": F.when(ok, F.col("_cue")).otherwise(F.col("beat_start"))}).drop("_cue")


def backfill(rows: DataFrame, lookup: DataFrame, on: Sequence[str], fill: dict[str, str]) -> DataFrame:
    """Left join that fills NULLs of ``rows`` columns from ``lookup`` columns (``{column: lookup column}``)."""
    lk = lookup.select(*on, *[F.col(v).alias(f"_{k}") for k, v in fill.items()])
    x = rows.join(lk, list(on), "left")
    return x.withColumns({k: F.coalesce(k, f"_{k}") for k in fill}).drop(*[f"_{k}" for k in fill])


def memo_split(requests: DataFrame, cache: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(hits joined with what the cache holds, misses)."""
    return requests.join(cache, list(on), "inner"), requests.join(cache.select(*on), list(on), "left_anti")


def dedupe_before(rows: DataFrame, key: Sequence[str], work) -> DataFrame:
    """Run ``work`` (DataFrame -> DataFrame keyed by ``key``) over distinct keys only and join the result back."""
    return rows.join(work(rows.select(*key).distinct()), list(key), "left")


def touched(clips: DataFrame, shots: DataFrame, by: Sequence[str] = BY, bucket_s: float = 60.0) -> DataFrame:
    """Uses of each shot: how many clips overlap it strictly."""
    c = clips.select(*by, F.col("src_start").alias("start"), F.col("src_end").alias("end"))
    s = shots.select(*by, "i", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return overlap_join(c, s, by, bucket_s).groupBy(*by, "i").agg(F.count(F.lit(1)).alias("uses"))


def line_query(lines: DataFrame, n_queries: Column) -> DataFrame:
    """Row of the query matrix that a line uses, clamped to the last."""
    return lines.withColumn("query_row", F.least(F.col("script_i"), n_queries - 1))
