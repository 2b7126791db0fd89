"""Instants and intervals per source: cleaning, merging, splitting, thinning, anchoring.

Each function takes DataFrames keyed by ``by`` (default ``source_id``) and builds a plan of window
functions over one shuffle on that key; no operator collects and only ``greedy_spacing``, whose
next step depends on the last kept row, folds an array (still inside the JVM).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BY = ("source_id",)


def _w(by: Sequence[str], *order):
    return W.partitionBy(*by).orderBy(*order)


def _before(w):
    return w.rowsBetween(W.unboundedPreceding, -1)


def _upto(w):
    return w.rowsBetween(W.unboundedPreceding, W.currentRow)


def cut_dedupe(cuts: DataFrame, by: Sequence[str] = BY, grid_s: float = 0.001) -> DataFrame:
    """One row per grid instant with the best score (at least 0); negative instants go."""
    key = F.floor(F.col("t") / grid_s + 0.5).cast("bigint")
    out = cuts.filter("t >= 0").groupBy(*by, key.alias("t_key")).agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
    return out.withColumn("t", F.col("t_key") * grid_s)


def threshold_cuts(cuts: DataFrame, least: float) -> DataFrame:
    """The late filter over a permissive candidate set; infinite (unknown) scores stay."""
    return cuts.filter(F.col("score") >= least)


def build_shots(
    cuts: DataFrame,
    sources: DataFrame,
    min_shot_s: float = 0.6,
    max_shot_s: float = 20.0,
    tail_fraction: float = 0.06,
    by: Sequence[str] = BY,
) -> DataFrame:
    """Shots that tile [0, duration]: short spans join their predecessor, long ones are split evenly.

    ``sources`` has one row per source with ``duration``. A short first span folds forward.
    """
    ends = sources.select(*by, "duration").filter("duration > 0")
    inner = cuts.select(*by, "t").join(ends, list(by)).filter("t > 0 and t < duration").select(*by, "t", "duration")
    points = inner.unionByName(ends.select(*by, F.explode(F.array(F.lit(0.0), F.col("duration"))).alias("t"), "duration")).distinct()
    order = _w(by, "t")
    spans = points.withColumn("end", F.lead("t").over(order)).filter("end is not null")
    opens = (F.col("end") - F.col("t") >= min_shot_s) | (F.row_number().over(order) == 1)
    spans = spans.withColumn("island", F.sum(opens.cast("int")).over(_upto(order)))
    isl = spans.groupBy(*by, "island").agg(F.min("t").alias("start"), F.max("end").alias("end"), F.max("duration").alias("duration"))
    whole = W.partitionBy(*by)
    first_short = F.max((F.col("island") == 1) & (F.col("end") - F.col("start") < min_shot_s)).over(whole) & (F.max("island").over(whole) > 1)
    isl = isl.withColumn("island", F.when(first_short & (F.col("island") == 1), 2).otherwise(F.col("island")))
    merged = isl.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("duration").alias("duration"))
    merged = merged.withColumn("pieces", F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / max_shot_s)).cast("int"))
    cut = merged.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    step = (F.col("end") - F.col("start")) / F.col("pieces")
    cut = cut.select(
        *by,
        (F.col("start") + F.col("p") * step).alias("start"),
        F.when(F.col("p") < F.col("pieces") - 1, F.col("start") + (F.col("p") + 1) * step).otherwise(F.col("end")).alias("end"),
        (F.col("pieces") > 1).alias("split"),
        (F.col("start") + F.col("p") * step >= F.col("duration") * (1.0 - tail_fraction)).alias("tail"),
    )
    return cut.withColumn("i", F.row_number().over(_w(by, "start")) - 1).withColumn("duration", F.col("end") - F.col("start"))


def uniform_grid(sources: DataFrame, step: float, by: Sequence[str] = BY) -> DataFrame:
    """Pieces of ``step`` over [0, duration], the last one clipped."""
    n = F.ceil(F.col("duration") / step).cast("int")
    g = sources.filter("duration > 0").select(*by, "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return g.select(*by, "i", (F.col("i") * float(step)).alias("start"), F.least((F.col("i") + 1) * float(step), F.col("duration")).alias("end"))


def merge_cues(cues: DataFrame, gap_s: float = 1.0, by: Sequence[str] = BY, tie: Sequence[str] = ()) -> DataFrame:
    """Consecutive cues of equal text with a gap under ``gap_s`` to the running end become one."""
    order = _w(by, "start", "end", *tie)
    runs = cues.withColumn("_new", F.coalesce((F.col("text") != F.lag("text").over(order)), F.lit(True)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(_upto(order)))
    inside = W.partitionBy(*by, "_run").orderBy("start", "end", *tie)
    reach = F.max("end").over(_before(inside))
    isl = runs.withColumn("_open", F.coalesce(F.col("start") - reach >= gap_s, F.lit(True)).cast("int"))
    isl = isl.withColumn("_isl", F.sum("_open").over(_upto(inside)))
    out = isl.groupBy(*by, "_run", "_isl").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("text").alias("text"))
    return out.withColumn("i", F.row_number().over(_w(by, "_run", "_isl")) - 1).drop("_run", "_isl")


def union_intervals(iv: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Disjoint sorted union; touching intervals merge."""
    order = _w(by, "start", "end")
    x = iv.withColumn("_open", F.coalesce(F.col("start") > F.max("end").over(_before(order)), F.lit(True)).cast("int"))
    x = x.withColumn("_isl", F.sum("_open").over(_upto(order)))
    return x.groupBy(*by, "_isl").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_isl")


def anchor_regions(anchors: DataFrame, sources: DataFrame, window_s: float, by: Sequence[str] = BY) -> DataFrame:
    """Union of [t-w, t+w] clipped to the source; anchors outside the source are dropped."""
    x = anchors.select(*by, "t").join(sources.select(*by, "duration"), list(by)).filter("t between 0 and duration")
    x = x.select(*by, F.greatest(F.lit(0.0), F.col("t") - window_s).alias("start"), F.least(F.col("duration"), F.col("t") + window_s).alias("end"))
    return union_intervals(x.filter("end > start"), by)


def window_ladder(start_s: float, least_s: float) -> list[float]:
    """Halvings of ``start_s``, ending with ``least_s``."""
    out = [float(start_s)]
    while out[-1] > least_s:
        out.append(max(float(least_s), out[-1] / 2))
    return out


def adaptive_regions(
    anchors: DataFrame, sources: DataFrame, start_s: float = 90.0, least_s: float = 5.0, share: float = 0.30, by: Sequence[str] = BY
) -> DataFrame:
    """Regions at the widest window of the ladder that covers at most ``share`` of the source, else the narrowest."""
    ladder = window_ladder(start_s, least_s)
    keys = [*by, "window"]
    x = anchors.select(*by, "t").join(sources.select(*by, "duration"), list(by)).filter("t between 0 and duration")
    x = x.withColumn("window", F.explode(F.array(*map(F.lit, ladder))))
    x = x.select(
        *keys, "duration", F.greatest(F.lit(0.0), F.col("t") - F.col("window")).alias("start"), F.least(F.col("duration"), F.col("t") + F.col("window")).alias("end")
    ).filter("end > start")
    limits = x.groupBy(*by).agg(F.first("duration").alias("duration"))
    regions = union_intervals(x, keys).join(limits, list(by))
    covered = F.sum(F.col("end") - F.col("start")).over(W.partitionBy(*keys))
    regions = regions.withColumn("_ok", (covered <= share * F.col("duration")) | (F.col("window") == ladder[-1]))
    best = F.max(F.when(F.col("_ok"), F.col("window"))).over(W.partitionBy(*by))
    return regions.withColumn("_best", best).filter("window = _best").select(*by, "window", "start", "end")


def clamp_regions(regions: DataFrame, span: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Intersection with one [low, high] per source; empty results go."""
    x = regions.join(span.select(*by, "low", "high"), list(by))
    x = x.withColumns({"start": F.greatest("start", "low"), "end": F.least("end", "high")})
    return x.filter("end > start").drop("low", "high")


def chunk_windows(cues: DataFrame, sources: DataFrame, step_s: float = 600.0, overlap_s: float = 45.0, by: Sequence[str] = BY) -> DataFrame:
    """(window, cue) rows for tiles of ``step_s`` with a trailing overlap; ``index`` is dense over tiles that hold cues.

    Tile numbers follow from the time by arithmetic, so there is no join on ranges.
    """
    step = float(max(60.0, step_s))
    back = int(max(0.0, overlap_s) // step) + 1
    x = cues.join(sources.select(*by, "duration"), list(by)).filter("start >= 0")
    own = F.floor(F.col("start") / step).cast("bigint")
    x = x.withColumn("tile", F.explode(F.sequence(F.greatest(F.lit(0), own - back), own)))
    x = x.withColumn("start_s", F.col("tile") * step).filter("start_s < duration")
    x = x.withColumn("end_s", F.least(F.col("duration"), F.col("start_s") + step)).filter(F.col("start") < F.col("end_s") + max(0.0, overlap_s))
    x = x.withColumn("index", F.dense_rank().over(_w(by, "tile")) - 1)
    return x.drop("tile", "duration")


def thin_even(rows: DataFrame, order: Sequence[str], limit: int = 40, by: Sequence[str] = BY) -> DataFrame:
    """At most ``limit`` rows per group, evenly spread: positions ``floor(k*n/limit)``."""
    n, pos = F.count(F.lit(1)).over(W.partitionBy(*by)), F.row_number().over(_w(by, *order)) - 1
    x = rows.withColumns({"_n": n, "_p": pos})
    k = F.ceil(F.col("_p") * limit / F.col("_n"))  # the first k that could land on this position
    hit = F.floor(k * F.col("_n") / limit) == F.col("_p")
    return x.filter((F.col("_n") <= limit) | (hit & (k < limit))).drop("_n", "_p")


def greedy_spacing(rows: DataFrame, gap_s: float = 3.0, by: Sequence[str] = BY, rank: str = "importance", tie: str = "i") -> DataFrame:
    """Keep a row if it starts at least ``gap_s`` after the last kept one, in (start, rank descending) order.

    A fold over the sorted array of the group: what counts is the last *kept* row, so no window function gives it.
    """
    item = F.struct(F.col("start"), (-F.col(rank)).alias("_r"), F.col(tie).alias("_t"), F.struct(*[c for c in rows.columns if c not in by]).alias("row"))
    grouped = rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("a"))
    kept = F.aggregate(
        "a",
        F.filter(F.slice("a", 1, 1), lambda _: F.lit(True)),
        lambda acc, x: F.when(x["start"] - F.element_at(acc, -1)["start"] >= gap_s, F.concat(acc, F.array(x))).otherwise(acc),
    )
    return grouped.select(*by, F.explode(kept).alias("x")).select(*by, "x.row.*")


def running_anchor(rows: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = BY, low=None, high=None) -> DataFrame:
    """``story_time``: the value clamped to [low, high], then never less than before."""
    c = F.col(value)
    c = F.greatest(low, c) if low is not None else c
    c = F.least(high, c) if high is not None else c
    return rows.withColumn("story_time", F.max(c).over(_upto(_w(by, *order))))


def place_cumulative(lines: DataFrame, order: Sequence[str], gap_s: float = 0.35, by: Sequence[str] = BY) -> DataFrame:
    """Lines laid end to end with a gap between them; unspoken lines go and ``i`` is dense over the rest."""
    x = lines.filter("seconds > 0")
    w = _w(by, *order)
    start = F.coalesce(F.sum(F.col("seconds") + gap_s).over(_before(w)), F.lit(0.0))
    x = x.withColumns({"i": F.row_number().over(w) - 1, "start": start})
    return x.withColumn("end", F.col("start") + F.col("seconds"))


def group_runs(rows: DataFrame, key, order: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """``run``: number of the stretch of consecutive rows with equal ``key`` (NULL equals NULL)."""
    w = _w(by, *order)
    x = rows.withColumn("_k", key)
    first = F.row_number().over(w) == 1
    x = x.withColumn("_new", (first | ~F.col("_k").eqNullSafe(F.lag("_k").over(w))).cast("int"))
    return x.withColumn("run", F.sum("_new").over(_upto(w)) - 1).drop("_k", "_new")


def split_proportional(lines: DataFrame, order: Sequence[str], by: Sequence[str] = BY, floor_s: float = 0.1) -> DataFrame:
    """Shares of [low, high] in proportion to spoken length (at least ``floor_s``), one after the other."""
    w = _w(by, *order)
    x = lines.withColumn("_len", F.greatest(F.lit(floor_s), F.col("seconds")))
    total, before = F.sum("_len").over(W.partitionBy(*by)), F.coalesce(F.sum("_len").over(_before(w)), F.lit(0.0))
    at = lambda c: F.col("low") + (F.col("high") - F.col("low")) * c / total
    return x.withColumns({"win_start": at(before), "win_end": at(before + F.col("_len"))}).drop("_len")


def split_anchored(lines: DataFrame, order: Sequence[str], by: Sequence[str] = BY, scale: float = 1.6, least_s: float = 8.0) -> DataFrame:
    """Ordered, disjoint windows near each line's anchor inside [low, high]; shares by length if the widths do not fit.

    ``start_i = W_i + least(C, greatest(low, running max of (anchor_j - w_j/4 - W_j)))`` with W the widths before
    and C the room left: the closed form of pushing each window behind the one before it.
    """
    w = _w(by, *order)
    span = F.col("high") - F.col("low")
    x = split_proportional(lines, order, by)
    x = x.withColumn("_w", F.least(F.greatest(scale * F.col("seconds"), F.lit(least_s)), span))
    x = x.withColumns({"_before": F.coalesce(F.sum("_w").over(_before(w)), F.lit(0.0)), "_all": F.sum("_w").over(W.partitionBy(*by))})
    push = F.max(F.col("anchor") - F.col("_w") / 4 - F.col("_before")).over(_upto(w))
    x = x.withColumn("_s", F.col("_before") + F.least(F.col("high") - F.col("_all"), F.greatest(F.col("low"), push)))
    fits = F.col("_all") <= span
    x = x.withColumns({"win_start": F.when(fits, F.col("_s")).otherwise(F.col("win_start")), "win_end": F.when(fits, F.col("_s") + F.col("_w")).otherwise(F.col("win_end"))})
    return x.drop("_w", "_before", "_all", "_s")


def line_windows(
    lines: DataFrame,
    beats: DataFrame,
    span: DataFrame,
    by: Sequence[str] = BY,
    anchored: bool = True,
    default_span_s: float = 90.0,
    max_span_s: float = 240.0,
) -> DataFrame:
    """Where on the source each narration line may draw from.

    Runs of consecutive lines on one beat share the beat's range (90 s when the beat has no end, 240 s at most),
    clamped to the content span and at least one second long; the ceiling is never below the end of the window.
    """
    key = F.coalesce(F.concat(F.lit("b"), F.col("beat_id").cast("string")), F.concat(F.lit("t"), F.floor(F.col("story_time") * 100 + 0.5).cast("bigint").cast("string")))
    x = group_runs(lines, key, ["i"], by)
    b = beats.select(*by, F.col("i").alias("beat_id"), F.col("start_s").alias("_bs"), F.col("end_s").alias("_be"))
    x = x.join(b, [*by, "beat_id"], "left").join(span.select(*by, F.col("low").alias("_cl"), F.col("high").alias("_ch")), list(by))
    run = W.partitionBy(*by, "run")
    low = F.coalesce(F.col("_bs"), F.min("story_time").over(run))
    end = F.when(F.col("_be") > low, F.col("_be")).otherwise(low + default_span_s)
    x = x.withColumns({"_lo": low, "_hi": F.least(end, low + max_span_s)})
    x = x.withColumns({"low": F.greatest(F.col("_cl"), F.least(F.col("_lo"), F.col("_ch")))})
    x = x.withColumn("high", F.greatest(F.least(F.col("_hi"), F.col("_ch")), F.col("low") + 1.0))
    x = x.withColumn("anchor", F.col("story_time"))
    x = (split_anchored if anchored else split_proportional)(x, ["i"], [*by, "run"])
    ceiling = F.greatest(F.col("spoiler_ceiling"), F.col("high"))
    return x.withColumn("ceiling", ceiling).drop("_bs", "_be", "_cl", "_ch", "_lo", "_hi", "anchor")
