"""Queries over instants and intervals: the events table, one source per user, and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import math as M
from ..operators import aggregates as A
from ..operators import filters as E
from ..operators import intervals as G
from ..operators import joins as J
from ..operators import ranking as R
from .base import EV, RUNTIME, big, events, ms, query, sources, sql_ms, table

D = "2592000e0"
DAY = 86400.0


def _cuts(spark, sf):
    return E_threshold(events(spark, sf))


def E_threshold(ev):
    return G.threshold_cuts(ev.withColumn("score", F.col("value")), 20.0)


def _shots(spark, sf):
    ev = events(spark, sf)
    return G.build_shots(E_threshold(ev), sources(ev), 21600.0, 172800.0, 0.06)


SHOTS = f"""{EV},
pts AS (SELECT source_id, t FROM ev WHERE value >= 20 AND t > 0 AND t < {D}
        UNION SELECT source_id, 0e0 FROM ev UNION SELECT source_id, {D} FROM ev),
spans AS (SELECT * FROM (SELECT source_id, t AS s, lead(t) OVER (PARTITION BY source_id ORDER BY t) AS e,
          row_number() OVER (PARTITION BY source_id ORDER BY t) AS rn FROM pts) WHERE e IS NOT NULL),
isl AS (SELECT *, sum(CASE WHEN e - s >= 21600e0 OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY s) AS k FROM spans),
m1 AS (SELECT source_id, k, min(s) AS s, max(e) AS e FROM isl GROUP BY 1, 2),
m2 AS (SELECT *, max(k) OVER (PARTITION BY source_id) AS last, max(CASE WHEN k = 1 AND e - s < 21600e0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id) AS short1 FROM m1),
m3 AS (SELECT source_id, CASE WHEN k = 1 AND short1 = 1 AND last > 1 THEN 2 ELSE k END AS k, s, e FROM m2),
m4 AS (SELECT source_id, k, min(s) AS s, max(e) AS e FROM m3 GROUP BY 1, 2),
m5 AS (SELECT *, greatest(1, CAST(ceil((e - s) / 172800e0) AS INT)) AS n FROM m4),
m6 AS (SELECT *, unnest(range(n)) AS p FROM m5),
m7 AS (SELECT source_id, s + p * ((e - s) / n) AS st, CASE WHEN p < n - 1 THEN s + (p + 1) * ((e - s) / n) ELSE e END AS en, n > 1 AS split FROM m6),
shots AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY st) - 1 AS i, st AS "start", en AS "end", split, st >= {D} * 0.94e0 AS tail FROM m7)"""


@query("shots_from_cuts", f"""WITH {SHOTS} SELECT source_id, CAST(i AS BIGINT) AS i, {sql_ms('"start"')} AS start_ms, {sql_ms('"end"')} AS end_ms, split, tail FROM shots""")
def shots_from_cuts(spark, sf):
    return _shots(spark, sf).select("source_id", big("i").alias("i"), ms("start").alias("start_ms"), ms("end").alias("end_ms"), "split", "tail")


@query("cut_dedupe_max", f"""WITH {EV} SELECT source_id, CAST(floor(t / 3600e0 + 0.5) AS BIGINT) AS t_key, greatest(max(value), 0e0) AS score FROM ev WHERE t >= 0 GROUP BY 1, 2""")
def cut_dedupe_max(spark, sf):
    return G.cut_dedupe(events(spark, sf).withColumn("score", F.col("value")), grid_s=3600.0).select("source_id", "t_key", "score")


@query("cut_threshold", f"WITH {EV} SELECT source_id, event_id, {sql_ms('t')} AS t_ms, value AS score FROM ev WHERE value >= 20")
def cut_threshold(spark, sf):
    return _cuts(spark, sf).select("source_id", "event_id", ms("t").alias("t_ms"), "score")


@query("shot_stats", f"""WITH {SHOTS} SELECT source_id, count(*) AS shots, {sql_ms('median("end" - "start")')} AS median_ms, {sql_ms('min("end" - "start")')} AS min_ms,
 {sql_ms('max("end" - "start")')} AS max_ms, count(*) FILTER (split) AS split_count, count(*) FILTER (tail) AS tail_count FROM shots GROUP BY 1""")
def shot_stats(spark, sf):
    s = A.shot_stats(_shots(spark, sf))
    return s.select("source_id", "shots", ms("median_s").alias("median_ms"), ms("min_s").alias("min_ms"), ms("max_s").alias("max_ms"), big("split_count").alias("split_count"), big("tail_count").alias("tail_count"))


@query("cut_rate", f"""WITH {EV} SELECT source_id, count(*) FILTER (value >= 20) AS raw_cuts, CAST(floor(count(*) FILTER (value >= 20) / ({D} / 60e0) * 1e9 + 0.5) AS BIGINT) AS cuts_per_min_e9 FROM ev GROUP BY 1""")
def cut_rate(spark, sf):
    ev = events(spark, sf)
    x = A.cut_rate(E_threshold(ev), sources(ev))
    return x.select("source_id", big("raw_cuts").alias("raw_cuts"), F.floor(F.col("cuts_per_min") * 1e9 + 0.5).cast("bigint").alias("cuts_per_min_e9"))


@query("uniform_grid", """WITH o AS (SELECT o_custkey AS source_id, CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS DOUBLE) AS d FROM orders GROUP BY 1),
g AS (SELECT source_id, d, unnest(range(CAST(ceil(d / 100e0) AS INT))) AS i FROM o WHERE d > 0)
SELECT source_id, CAST(i AS BIGINT) AS i, i * 100e0 AS "start", least((i + 1) * 100e0, d) AS "end" FROM g""")
def uniform_grid(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("source_id"))
    o = o.agg(F.datediff(F.max(F.to_date("o_orderdate")), F.min(F.to_date("o_orderdate"))).cast("double").alias("duration"))
    return G.uniform_grid(o, 100.0).select("source_id", big("i").alias("i"), "start", "end")


CUES = f"""{EV}, cue AS (SELECT source_id, event_id, t AS s, t + value / 20e0 * 3600e0 AS e, text FROM ev),
r1 AS (SELECT *, CASE WHEN text = lag(text) OVER (PARTITION BY source_id ORDER BY s, e, event_id) THEN 0 ELSE 1 END AS nw FROM cue),
r2 AS (SELECT *, sum(nw) OVER (PARTITION BY source_id ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r1),
r3 AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY source_id, run ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 1e0 THEN 0 ELSE 1 END AS op FROM r2),
r4 AS (SELECT *, sum(op) OVER (PARTITION BY source_id, run ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM r3),
cues AS (SELECT source_id, run, isl, min(s) AS s, max(e) AS e, min(text) AS text FROM r4 GROUP BY 1, 2, 3)"""


def _cues(spark, sf):
    ev = events(spark, sf).select("source_id", "event_id", F.col("t").alias("start"), (F.col("t") + F.col("value") / 20.0 * 3600.0).alias("end"), "text")
    return G.merge_cues(ev, 1.0, tie=("event_id",))


@query("cue_merge", f"WITH {CUES} SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY run, isl) - 1 AS BIGINT) AS i, {sql_ms('s')} AS start_ms, {sql_ms('e')} AS end_ms, text FROM cues")
def cue_merge(spark, sf):
    return _cues(spark, sf).select("source_id", big("i").alias("i"), ms("start").alias("start_ms"), ms("end").alias("end_ms"), "text")


@query("cue_stats", f"""WITH {CUES} SELECT source_id, count(*) AS cue_count, count(*) AS word_count, {sql_ms('min(s)')} AS first_ms,
 {sql_ms('arg_max(e, ROW(s, e))')} AS last_ms, CAST(floor(sum({sql_ms('e - s')}) / 1e6 + 0.5) AS BIGINT) AS spoken_ks FROM cues GROUP BY 1""")
def cue_stats(spark, sf):
    c = _cues(spark, sf).withColumns({"end_ms": ms(F.col("end") - F.col("start"))})
    s = A.cue_stats(c, sources(events(spark, sf), "runtime_s"))
    spoken = c.groupBy("source_id").agg(F.floor(F.sum("end_ms") / 1e6 + 0.5).cast("bigint").alias("spoken_ks"))
    return s.join(spoken, "source_id").select("source_id", "cue_count", "word_count", ms("first_cue_s").alias("first_ms"), ms("last_cue_s").alias("last_ms"), "spoken_ks")


def _anchors(spark, sf):
    return events(spark, sf).filter("text = 'purchase'")


def regions_sql(w: str, keys: str = "source_id", extra: str = "") -> str:
    return f"""a AS (SELECT {keys}{extra}, greatest(0e0, t - {w}) AS s, least({D}, t + {w}) AS e FROM anchors WHERE t BETWEEN 0 AND {D}),
u1 AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS op FROM a WHERE e > s),
u2 AS (SELECT *, sum(op) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM u1),
regions AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM u2 GROUP BY {keys}, isl)"""


REGIONS = f"{EV}, anchors AS (SELECT source_id, t FROM ev WHERE text = 'purchase'), " + regions_sql("43200e0")


def _regions(spark, sf):
    return G.anchor_regions(_anchors(spark, sf), sources(events(spark, sf)), 43200.0)


@query("region_union", f"WITH {REGIONS} SELECT source_id, {sql_ms('s')} AS start_ms, {sql_ms('e')} AS end_ms FROM regions")
def region_union(spark, sf):
    return _regions(spark, sf).select("source_id", ms("start").alias("start_ms"), ms("end").alias("end_ms"))


ADAPT = (
    f"{EV}, anchors AS (SELECT source_id, t, w FROM (SELECT source_id, t FROM ev WHERE text = 'purchase'), (SELECT unnest([172800e0, 86400e0, 43200e0, 21600e0, 10800e0]) AS w)), "
    + regions_sql("w", "source_id, w")
    + f""", c AS (SELECT *, (sum(e - s) OVER (PARTITION BY source_id, w) <= 0.3e0 * {D}) OR w = 10800e0 AS ok FROM regions),
b AS (SELECT *, max(CASE WHEN ok THEN w END) OVER (PARTITION BY source_id) AS best FROM c)"""
)


@query("region_adaptive", f"WITH {ADAPT} SELECT source_id, w AS window_s, {sql_ms('s')} AS start_ms, {sql_ms('e')} AS end_ms FROM b WHERE w = best")
def region_adaptive(spark, sf):
    r = G.adaptive_regions(_anchors(spark, sf), sources(events(spark, sf)), 172800.0, 10800.0, 0.3)
    return r.select("source_id", F.col("window").alias("window_s"), ms("start").alias("start_ms"), ms("end").alias("end_ms"))


SPAN = f"""cs AS (SELECT source_id, min(t) AS f, max(t) AS l FROM ev GROUP BY 1),
span AS (SELECT source_id, CASE WHEN least({D}, l - 86400e0) > greatest(0e0, f + 86400e0) THEN greatest(0e0, f + 86400e0) ELSE 0e0 END AS low,
 CASE WHEN least({D}, l - 86400e0) > greatest(0e0, f + 86400e0) THEN least({D}, l - 86400e0) ELSE {D} END AS high FROM cs)"""


def _span(spark, sf):
    s = events(spark, sf).groupBy("source_id").agg(F.min("t").alias("f"), F.max("t").alias("l"))
    low, high = M.content_span(F.col("f"), F.col("l"), F.lit(RUNTIME), -86400.0, -86400.0)
    return s.select("source_id", low.alias("low"), high.alias("high"))


@query("content_span", f"WITH {EV}, {SPAN} SELECT source_id, {sql_ms('low')} AS low_ms, {sql_ms('high')} AS high_ms FROM span")
def content_span(spark, sf):
    return _span(spark, sf).select("source_id", ms("low").alias("low_ms"), ms("high").alias("high_ms"))


@query("region_clamp", f"WITH {REGIONS}, {SPAN} SELECT r.source_id, {sql_ms('greatest(s, low)')} AS start_ms, {sql_ms('least(e, high)')} AS end_ms FROM regions r JOIN span p ON r.source_id = p.source_id WHERE least(e, high) > greatest(s, low)")
def region_clamp(spark, sf):
    return G.clamp_regions(_regions(spark, sf), _span(spark, sf)).select("source_id", ms("start").alias("start_ms"), ms("end").alias("end_ms"))


@query("index_stats", f"WITH {REGIONS} SELECT e.source_id, count(s) AS regions, coalesce(CAST(sum({sql_ms('e.e - s')}) / 1000000 AS BIGINT), 0) AS covered_ks FROM (SELECT x.source_id, r.s, r.e FROM (SELECT DISTINCT source_id FROM ev) x LEFT JOIN regions r ON r.source_id = x.source_id) e GROUP BY 1")
def index_stats(spark, sf):
    r = _regions(spark, sf)
    s = A.index_stats(r, sources(events(spark, sf)))
    cov = r.groupBy("source_id").agg(F.sum(ms(F.col("end") - F.col("start"))).alias("c"))
    return s.join(cov, "source_id", "left").select("source_id", big("regions").alias("regions"), F.coalesce(F.round(F.col("c") / 1e6).cast("bigint"), F.lit(0)).alias("covered_ks"))


@query("shots_in_regions", f"""WITH {SHOTS}, anchors AS (SELECT source_id, t FROM ev WHERE text = 'purchase'), {regions_sql("43200e0")}
SELECT source_id, CAST(i AS BIGINT) AS i FROM shots h WHERE NOT tail AND EXISTS (SELECT 1 FROM regions r WHERE r.source_id = h.source_id AND h."start" < r.e AND h."end" > r.s)""")
def shots_in_regions(spark, sf):
    return J.overlap_semi(_shots(spark, sf).filter("not tail"), _regions(spark, sf)).select("source_id", big("i").alias("i"))


@query("shot_region_overlap", f"""WITH {SHOTS}, anchors AS (SELECT source_id, t FROM ev WHERE text = 'purchase'), {regions_sql("43200e0")}
SELECT h.source_id, CAST(i AS BIGINT) AS i, {sql_ms('r.s')} AS region_ms, {sql_ms('least(h."end", r.e) - greatest(h."start", r.s)')} AS shared_ms FROM shots h JOIN regions r ON r.source_id = h.source_id AND h."start" < r.e AND h."end" > r.s""")
def shot_region_overlap(spark, sf):
    r = _regions(spark, sf).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    x = J.overlap_join(_shots(spark, sf), r, bucket_s=7 * DAY)
    return x.select("source_id", big("i").alias("i"), ms("r_start").alias("region_ms"), ms(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("shared_ms"))


@query("shot_content", f"""WITH {SHOTS}, {SPAN} SELECT h.source_id, CAST(i AS BIGINT) AS i FROM shots h JOIN span p ON p.source_id = h.source_id WHERE "start" >= low - 0.001e0 AND "end" <= high + 0.001e0""")
def shot_content(spark, sf):
    return E.content_shots(_shots(spark, sf), _span(spark, sf)).select("source_id", big("i").alias("i"))


@query("topk_longest", f"""WITH {SHOTS}, k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY "end" - "start" DESC, i) AS r FROM shots)
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY "start") - 1 AS BIGINT) AS i, CAST(i AS BIGINT) AS shot_i FROM k WHERE r <= 10""")
def topk_longest(spark, sf):
    return R.topk_longest(_shots(spark, sf), 10).select("source_id", big("i_new").alias("i"), big("i").alias("shot_i"))


@query("chunk_overlap", f"""WITH {EV}, x AS (SELECT *, CAST(floor(t / 86400e0) AS BIGINT) AS own FROM ev WHERE t >= 0),
y AS (SELECT *, unnest(range(greatest(0, own - 1), own + 1)) AS tile FROM x),
z AS (SELECT *, tile * 86400e0 AS s, least({D}, tile * 86400e0 + 86400e0) AS e FROM y WHERE tile * 86400e0 < {D})
SELECT source_id, event_id, CAST(dense_rank() OVER (PARTITION BY source_id ORDER BY tile) - 1 AS BIGINT) AS chunk, {sql_ms('s')} AS start_ms, {sql_ms('e')} AS end_ms FROM z WHERE t < e + 7200e0""")
def chunk_overlap(spark, sf):
    ev = events(spark, sf).withColumn("start", F.col("t"))
    x = G.chunk_windows(ev, sources(ev), DAY, 7200.0)
    return x.select("source_id", "event_id", big("index").alias("chunk"), ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"))


@query("thin_even", f"""WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS n, row_number() OVER (PARTITION BY source_id ORDER BY t, event_id) - 1 AS p FROM ev)
SELECT source_id, event_id FROM n WHERE n <= 40 OR p IN (SELECT k * n // 40 FROM range(40) g(k))""")
def thin_even(spark, sf):
    return G.thin_even(events(spark, sf), ["t", "event_id"], 40).select("source_id", "event_id")


@query("greedy_spacing", f"""WITH RECURSIVE {EV}, k(source_id, t) AS (SELECT source_id, min(t) FROM ev GROUP BY 1 UNION ALL
SELECT k.source_id, (SELECT min(e.t) FROM ev e WHERE e.source_id = k.source_id AND e.t - k.t >= 172800e0) FROM k WHERE k.t IS NOT NULL)
SELECT source_id, {sql_ms('t')} AS t_ms FROM k WHERE t IS NOT NULL""")
def greedy_spacing(spark, sf):
    ev = events(spark, sf).select("source_id", F.col("t").alias("start"), F.col("value").alias("importance"), F.col("event_id").alias("i"))
    return G.greedy_spacing(ev, 172800.0).select("source_id", ms("start").alias("t_ms"))


@query("monotone_anchor", """SELECT o_custkey AS source_id, o_orderkey, max(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS story_cents FROM orders""")
def monotone_anchor(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("source_id"), "o_orderkey", F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint").alias("c"))
    return G.running_anchor(o, "c", ["o_orderkey"]).select("source_id", "o_orderkey", F.col("story_time").alias("story_cents"))


@query("cumulative_placement", """WITH x AS (SELECT o_custkey AS source_id, o_orderkey, CAST(o_orderkey % 50 AS BIGINT) AS q FROM orders WHERE o_orderkey % 50 > 0),
y AS (SELECT *, coalesce(sum(q + 2) OVER (PARTITION BY source_id ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM x)
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY o_orderkey) - 1 AS BIGINT) AS i, CAST(s AS BIGINT) AS start_s, CAST(s + q AS BIGINT) AS end_s FROM y""")
def cumulative_placement(spark, sf):
    x = table(spark, sf, "orders").select(F.col("o_custkey").alias("source_id"), "o_orderkey", (F.col("o_orderkey") % 50).cast("double").alias("seconds"))
    return G.place_cumulative(x, ["o_orderkey"], 2.0).select("source_id", big("i").alias("i"), big("start").alias("start_s"), big("end").alias("end_s"))


RUNS = f"""{EV}, c AS (SELECT *, CASE WHEN text IS NOT DISTINCT FROM lag(text) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS nw FROM ev WINDOW w AS (PARTITION BY source_id ORDER BY t, event_id)),
runs AS (SELECT *, sum(nw) OVER (PARTITION BY source_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM c)"""


@query("group_runs", f"WITH {RUNS} SELECT source_id, CAST(run AS BIGINT) AS run, min(text) AS text, count(*) AS n, {sql_ms('min(t)')} AS start_ms FROM runs GROUP BY 1, 2")
def group_runs(spark, sf):
    x = G.group_runs(events(spark, sf), F.col("text"), ["t", "event_id"])
    return x.groupBy("source_id", big("run").alias("run")).agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n"), ms(F.min("t")).alias("start_ms"))


@query("split_proportional", """WITH x AS (SELECT o_custkey AS source_id, o_orderkey, greatest(0.1e0, CAST(o_orderkey % 50 AS DOUBLE)) AS q FROM orders),
y AS (SELECT *, sum(q) OVER (PARTITION BY source_id) AS n, coalesce(sum(q) OVER (PARTITION BY source_id ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS b FROM x)
SELECT source_id, o_orderkey, CAST(floor((0e0 + 1000e0 * b / n) * 1000 + 0.5) AS BIGINT) AS start_ms, CAST(floor((0e0 + 1000e0 * (b + q) / n) * 1000 + 0.5) AS BIGINT) AS end_ms FROM y""")
def split_proportional(spark, sf):
    x = table(spark, sf, "orders").select(F.col("o_custkey").alias("source_id"), "o_orderkey", (F.col("o_orderkey") % 50).cast("double").alias("seconds"), F.lit(0.0).alias("low"), F.lit(1000.0).alias("high"))
    return G.split_proportional(x, ["o_orderkey"]).select("source_id", "o_orderkey", ms("win_start").alias("start_ms"), ms("win_end").alias("end_ms"))


@query("split_anchored", """WITH x AS (SELECT o_custkey AS source_id, o_orderkey, greatest(0.1e0, CAST(o_orderkey % 50 AS DOUBLE)) AS q, least(greatest(1.5e0 * (o_orderkey % 50), 8e0), 256e0) AS w, CAST(o_orderkey % 256 AS DOUBLE) AS anchor FROM orders),
y AS (SELECT *, sum(q) OVER (PARTITION BY source_id) AS n, coalesce(sum(q) OVER o, 0e0) AS b, coalesce(sum(w) OVER o, 0e0) AS bw, sum(w) OVER (PARTITION BY source_id) AS aw FROM x
 WINDOW o AS (PARTITION BY source_id ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, bw + least(256e0 - aw, greatest(0e0, max(anchor - w / 4 - bw) OVER (PARTITION BY source_id ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))) AS s FROM y)
SELECT source_id, o_orderkey, CAST(floor((CASE WHEN aw <= 256e0 THEN s ELSE 256e0 * b / n END) * 1000 + 0.5) AS BIGINT) AS start_ms,
 CAST(floor((CASE WHEN aw <= 256e0 THEN s + w ELSE 256e0 * (b + q) / n END) * 1000 + 0.5) AS BIGINT) AS end_ms FROM z""")
def split_anchored(spark, sf):
    x = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("source_id"), "o_orderkey", (F.col("o_orderkey") % 50).cast("double").alias("seconds"), (F.col("o_orderkey") % 256).cast("double").alias("anchor"), F.lit(0.0).alias("low"), F.lit(256.0).alias("high")
    )
    return G.split_anchored(x, ["o_orderkey"], scale=1.5).select("source_id", "o_orderkey", ms("win_start").alias("start_ms"), ms("win_end").alias("end_ms"))


def _line_inputs(spark, sf):
    """Narration lines (the events of a user), beats (the runs of equal event types) and content spans."""
    runs = G.group_runs(events(spark, sf), F.col("text"), ["t", "event_id"])
    beats = runs.groupBy("source_id", F.col("run").alias("i")).agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"))
    lines = G.place_cumulative(runs.withColumn("seconds", F.col("value") * 600.0), ["t", "event_id"])
    lines = lines.select("source_id", "i", F.col("event_id").alias("script_i"), F.col("start").alias("start_s"), "seconds", F.col("t").alias("story_time"), F.col("run").alias("beat_id"), F.lit(RUNTIME / 2).alias("spoiler_ceiling"))
    return lines, beats, _span(spark, sf)


def line_windows_df(spark, sf):
    lines, beats, span = _line_inputs(spark, sf)
    return G.line_windows(lines, beats, span, anchored=False, default_span_s=DAY, max_span_s=3 * DAY), span


LINE_WINDOWS = f"""{RUNS}, {SPAN}, beats AS (SELECT source_id, run, min(t) AS bs, max(t) AS be FROM runs GROUP BY 1, 2),
li AS (SELECT source_id, event_id, t, run, greatest(0.1e0, value * 600e0) AS q, value FROM runs WHERE value > 0),
g AS (SELECT l.*, CASE WHEN be > bs THEN be ELSE bs + 86400e0 END AS en, bs, low AS cl, high AS ch FROM li l JOIN beats b USING (source_id, run) JOIN span p USING (source_id)),
h AS (SELECT *, greatest(cl, least(bs, ch)) AS lo, least(en, bs + 259200e0) AS hi0 FROM g),
k AS (SELECT *, greatest(least(hi0, ch), lo + 1e0) AS hi, sum(q) OVER (PARTITION BY source_id, run) AS n, coalesce(sum(q) OVER (PARTITION BY source_id, run ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS b FROM h)"""


@query("line_windows", f"WITH {LINE_WINDOWS} SELECT source_id, event_id, CAST(floor(lo + (hi - lo) * b / n + 0.5) AS BIGINT) AS start_s, CAST(floor(lo + (hi - lo) * (b + q) / n + 0.5) AS BIGINT) AS end_s, CAST(floor(greatest(1296000e0, hi) + 0.5) AS BIGINT) AS ceiling_s FROM k")
def line_windows(spark, sf):
    x, _ = line_windows_df(spark, sf)
    r = lambda c: F.floor(F.col(c) + 0.5).cast("bigint")
    return x.select("source_id", F.col("script_i").alias("event_id"), r("win_start").alias("start_s"), r("win_end").alias("end_s"), r("ceiling").alias("ceiling_s"))


@query("spoiler_ceiling", f"""WITH {EV}, x AS (SELECT e.source_id, e.event_id, e.t, (SELECT min(w.t) FROM ev w WHERE w.source_id = e.source_id AND w.text = 'error' AND w.t > e.t) AS nx FROM ev e WHERE text <> 'error')
SELECT source_id, event_id, {sql_ms(f'greatest(t, CASE WHEN nx IS NULL THEN least({D}, t + 86400e0) ELSE least(least({D}, t + 86400e0), greatest(t, nx - 2e0)) END)')} AS ceiling_ms FROM x""")
def spoiler_ceiling(spark, sf):
    ev = events(spark, sf)
    x = J.asof_next(ev.filter("text <> 'error'"), ev.filter("text = 'error'"), "t", "t")
    c = M.spoiler_ceiling(F.col("t"), F.col("next._rt"), F.lit(RUNTIME), 86400.0)
    return x.select("source_id", "event_id", ms(c).alias("ceiling_ms"))


GRID = f"grid AS (SELECT source_id, g AS i, g * 200000e0 AS s FROM (SELECT DISTINCT source_id FROM ev), range(13) t(g))"


def _grid(spark, sf):
    return G.uniform_grid(sources(events(spark, sf)), 200000.0).select("source_id", "i", F.col("start").alias("s"))


@query("asof_backward", f"WITH {EV}, {GRID} SELECT e.source_id, e.event_id, CAST(max(g.i) AS BIGINT) AS i FROM ev e JOIN grid g ON g.source_id = e.source_id AND g.s <= e.t GROUP BY 1, 2")
def asof_backward(spark, sf):
    x = J.asof_last(events(spark, sf), _grid(spark, sf), "t", "s", ["i"])
    return x.select("source_id", "event_id", big("prev.i").alias("i"))


@query("asof_nearest", f"""WITH {EV}, {GRID}, d AS (SELECT e.source_id, e.event_id, g.i, row_number() OVER (PARTITION BY e.source_id, e.event_id ORDER BY abs(g.s - e.t), g.i) AS r FROM ev e JOIN grid g ON g.source_id = e.source_id)
SELECT source_id, event_id, CAST(i AS BIGINT) AS i FROM d WHERE r = 1""")
def asof_nearest(spark, sf):
    x = J.asof_nearest(events(spark, sf), _grid(spark, sf), "t", "s", ["i"])
    return x.select("source_id", "event_id", big("near.i").alias("i"))


THIRDS = f"acts AS (SELECT source_id, a AS act, {D} * (a - 1) / 3 AS s, {D} * a / 3 AS e FROM (SELECT DISTINCT source_id FROM ev), range(1, 4) t(a))"


def _thirds(spark, sf):
    src = sources(events(spark, sf), "runtime_s")
    none = src.select("source_id", F.lit(1).alias("act"), F.lit(5.0).alias("start_s"), F.lit(1.0).alias("end_s")).filter("false")
    return E.acts_or_thirds(none, src)


@query("beats_in_acts", f"WITH {EV}, {THIRDS} SELECT e.source_id, e.event_id, CAST(a.act AS BIGINT) AS act FROM ev e JOIN acts a ON a.source_id = e.source_id AND e.t >= a.s AND e.t < a.e")
def beats_in_acts(spark, sf):
    return J.within(events(spark, sf), _thirds(spark, sf), "t", "start_s", "end_s").select("source_id", "event_id", big("act").alias("act"))


@query("cues_in_beats", f"""WITH {RUNS}, beats AS (SELECT source_id, run, min(t) AS s, max(t) AS e FROM runs GROUP BY 1, 2 HAVING count(*) > 1)
SELECT e.source_id, CAST(b.run AS BIGINT) AS run, e.event_id FROM ev e JOIN beats b ON b.source_id = e.source_id AND e.t BETWEEN b.s AND b.e""")
def cues_in_beats(spark, sf):
    ev = events(spark, sf)
    runs = G.group_runs(ev, F.col("text"), ["t", "event_id"])
    beats = runs.groupBy("source_id", "run").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return J.within(ev, beats, "t", "s", "e", closed=True).select("source_id", big("run").alias("run"), "event_id")


@query("act_fallback_thirds", """WITH r AS (SELECT o_custkey AS source_id, CAST(count(*) * 100 AS DOUBLE) AS rt FROM orders GROUP BY 1),
a AS (SELECT o_custkey AS source_id, o_orderkey AS act, CAST(o_orderkey % 900 AS DOUBLE) AS s, CAST(o_orderkey % 1700 AS DOUBLE) AS e FROM orders),
ok AS (SELECT a.source_id, act, s, least(e, rt) AS e FROM a JOIN r ON r.source_id = a.source_id WHERE s >= 0 AND s < e AND e <= rt + 1)
SELECT source_id, act, CAST(floor(s * 1000 + 0.5) AS BIGINT) AS start_ms, CAST(floor(e * 1000 + 0.5) AS BIGINT) AS end_ms FROM ok
UNION ALL SELECT source_id, a, CAST(floor(rt * (a - 1) / 3 * 1000 + 0.5) AS BIGINT), CAST(floor(rt * a / 3 * 1000 + 0.5) AS BIGINT) FROM r, range(1, 4) t(a) WHERE source_id NOT IN (SELECT source_id FROM ok)""")
def act_fallback_thirds(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("source_id"), "o_orderkey")
    runtime = o.groupBy("source_id").agg((F.count(F.lit(1)) * 100).cast("double").alias("runtime_s"))
    acts = o.select("source_id", big("o_orderkey").alias("act"), (F.col("o_orderkey") % 900).cast("double").alias("start_s"), (F.col("o_orderkey") % 1700).cast("double").alias("end_s"))
    return E.acts_or_thirds(acts, runtime).select("source_id", big("act").alias("act"), ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"))


def _raw_beats(spark, sf):
    s = lambda c: c.cast("string")
    return events(spark, sf).select(
        "source_id", F.col("event_id").alias("ord"),
        F.when(F.col("event_id") % 11 == 0, "soon").otherwise(s((F.col("event_id") % 3000) * 1000)).alias("start_s"),
        s((F.col("event_id") % 7000) * 500).alias("end_s"),
        F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.col("text")).alias("kind"),
        F.when(F.col("event_id") % 6 == 0, None).otherwise(s(F.col("event_id") % 9)).alias("importance"),
    )


@query("clamp_beats", f"""WITH {EV}, b AS (SELECT source_id, event_id AS ord, CASE WHEN event_id % 11 = 0 THEN -1e0 ELSE (event_id % 3000) * 1000e0 END AS s, (event_id % 7000) * 500e0 AS e,
 CASE WHEN event_id % 4 = 0 THEN 'escalation' ELSE text END AS kind, CASE WHEN event_id % 6 = 0 THEN 3 ELSE greatest(1, least(5, event_id % 9)) END AS importance FROM ev)
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY ord) - 1 AS BIGINT) AS i, {sql_ms('s')} AS start_ms, {sql_ms(f'CASE WHEN e <= s THEN least({D}, s + 5e0) ELSE least({D}, e) END')} AS end_ms, kind, CAST(importance AS BIGINT) AS importance FROM b WHERE s >= 0 AND s <= {D}""")
def clamp_beats(spark, sf):
    b = E.clamp_beats(_raw_beats(spark, sf), sources(events(spark, sf), "runtime_s"))
    return b.select("source_id", big("i").alias("i"), ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "kind", big("importance").alias("importance"))


@query("normalise_pairs", f"""WITH {EV}, b AS (SELECT source_id, event_id, CASE WHEN event_id % 11 = 0 THEN -1e0 ELSE (event_id % 3000) * 1000e0 END AS s, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 7000) * 500e0 END AS p FROM ev),
c AS (SELECT source_id, event_id, s, CASE WHEN p BETWEEN 0 AND {D} THEN p END AS p FROM b WHERE s >= 0 AND s <= {D})
SELECT source_id, event_id, {sql_ms('CASE WHEN p < s THEN p ELSE s END')} AS setup_ms, {sql_ms('CASE WHEN p IS NULL THEN NULL WHEN p < s THEN s ELSE p END')} AS payoff_ms FROM c""")
def normalise_pairs(spark, sf):
    b = _raw_beats(spark, sf).select("source_id", F.col("ord").alias("event_id"), F.col("start_s").alias("setup_s"), F.when(F.col("ord") % 5 != 0, F.col("end_s")).alias("payoff_s"), F.lit("x").alias("what"))
    return E.normalise_pairs(b, sources(events(spark, sf), "runtime_s")).select("source_id", "event_id", ms("setup_s").alias("setup_ms"), ms("payoff_s").alias("payoff_ms"))


@query("normalise_twists", f"""WITH {EV}, b AS (SELECT source_id, event_id, CASE WHEN event_id % 11 = 0 THEN -1e0 ELSE (event_id % 3000) * 1000e0 END AS s, CASE WHEN event_id % 6 = 0 THEN 3 ELSE greatest(1, least(5, event_id % 9)) END AS v FROM ev)
SELECT source_id, event_id, {sql_ms('s')} AS at_ms, CAST(v AS BIGINT) AS severity FROM b WHERE s >= 0 AND s <= {D}""")
def normalise_twists(spark, sf):
    b = _raw_beats(spark, sf).select("source_id", F.col("ord").alias("event_id"), F.col("start_s").alias("at_s"), F.col("importance").alias("severity"), F.lit("x").alias("what"))
    return E.normalise_twists(b, sources(events(spark, sf), "runtime_s")).select("source_id", "event_id", ms("at_s").alias("at_ms"), big("severity").alias("severity"))


@query("resolve_beat", f"""WITH {RUNS}, b AS (SELECT source_id, run AS i, run // 20 AS act, row_number() OVER (PARTITION BY source_id, run // 20 ORDER BY run) - 1 AS seat FROM (SELECT DISTINCT source_id, CAST(run AS BIGINT) AS run FROM runs)),
la AS (SELECT source_id, act, max(seat) AS last FROM b GROUP BY 1, 2),
s AS (SELECT source_id, event_id, CAST(run AS BIGINT) // 20 AS act, event_id % 30 AS ord, CASE WHEN event_id % 3 = 0 THEN event_id ELSE CAST(run AS BIGINT) END AS want FROM runs)
SELECT s.source_id, s.event_id, coalesce(k.i, f.i) AS beat_id, k.i IS NULL AS unresolved FROM s LEFT JOIN b k ON k.source_id = s.source_id AND k.i = s.want
JOIN la ON la.source_id = s.source_id AND la.act = s.act JOIN b f ON f.source_id = s.source_id AND f.act = s.act AND f.seat = least(s.ord, la.last)""")
def resolve_beat(spark, sf):
    runs = G.group_runs(events(spark, sf), F.col("text"), ["t", "event_id"]).withColumn("run", big("run"))
    act = F.floor(F.col("run") / 20).cast("bigint")
    beats = runs.select("source_id", F.col("run").alias("i"), act.alias("act")).distinct()
    seg = runs.select("source_id", "event_id", act.alias("act"), (F.col("event_id") % 30).alias("ord"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).otherwise(F.col("run")).alias("beat_id"))
    return J.resolve_beat(seg, beats).select("source_id", "event_id", "beat_id", "unresolved")


@query("cite_cue", f"""WITH {EV}, c AS (SELECT source_id, t, row_number() OVER (PARTITION BY source_id ORDER BY t, event_id) - 1 AS i FROM ev),
s AS (SELECT source_id, event_id, event_id % 90 AS line_id, greatest(0e0, t - 500000e0) AS bs, t + 500000e0 AS be FROM ev),
x AS (SELECT s.*, c.t AS cue, coalesce(c.t >= bs - 1e0 AND c.t <= be + 1e0, false) AS ok FROM s LEFT JOIN c ON c.source_id = s.source_id AND c.i = s.line_id)
SELECT source_id, event_id, ok AS anchored, {sql_ms('CASE WHEN ok THEN cue ELSE bs END')} AS anchor_ms FROM x""")
def cite_cue(spark, sf):
    ev = events(spark, sf)
    cues = G.place_cumulative(ev.withColumn("seconds", F.lit(1.0)), ["t", "event_id"]).select("source_id", "i", F.col("t").alias("start"))
    seg = ev.select("source_id", "event_id", (F.col("event_id") % 90).alias("line_id"), F.greatest(F.lit(0.0), F.col("t") - 500000.0).alias("beat_start"), (F.col("t") + 500000.0).alias("beat_end"))
    return J.cite_cue(seg, cues).select("source_id", "event_id", "anchored", ms("anchor").alias("anchor_ms"))


@query("narration_stats", """SELECT l_orderkey AS source_id, count(*) FILTER (l_quantity > 25) AS lines, count(*) FILTER (l_quantity <= 25) AS dropped, CAST(coalesce(sum(l_quantity - 25) FILTER (l_quantity > 25), 0) AS BIGINT) AS spoken_s,
CAST(coalesce(sum(l_linenumber) FILTER (l_quantity > 25), 0) AS BIGINT) AS words, CAST(coalesce(sum(l_quantity - 25) FILTER (l_quantity > 25), 0) + greatest(0, count(*) FILTER (l_quantity > 25) - 1) * 2 AS BIGINT) AS total_s FROM lineitem GROUP BY 1""")
def narration_stats(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.greatest(F.lit(0.0), F.col("l_quantity").cast("double") - 25).alias("seconds"), F.col("l_linenumber").alias("word_count"))
    s = A.narration_stats(x, gap_s=2.0)
    return s.select("source_id", big("lines").alias("lines"), big("dropped").alias("dropped"), big("spoken_s").alias("spoken_s"), big("words").alias("words"), big("total_s").alias("total_s"))


@query("touched_shots", f"""WITH {SHOTS}, c AS (SELECT source_id, t AS s, t + value * 600e0 AS e FROM ev)
SELECT h.source_id, CAST(i AS BIGINT) AS i, count(*) AS uses FROM shots h JOIN c ON c.source_id = h.source_id AND h."start" < c.e AND h."end" > c.s GROUP BY 1, 2""")
def touched_shots(spark, sf):
    clips = events(spark, sf).select("source_id", F.col("t").alias("src_start"), (F.col("t") + F.col("value") * 600.0).alias("src_end"))
    return J.touched(clips, _shots(spark, sf), bucket_s=3 * DAY).select("source_id", big("i").alias("i"), "uses")


@query("run_report", f"""WITH {EV} SELECT source_id AS run, text AS name, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM ev GROUP BY 1, 2
UNION ALL SELECT source_id, 'total', CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) FROM ev GROUP BY 1""")
def run_report(spark, sf):
    s = events(spark, sf).groupBy(F.col("source_id").alias("run"), F.col("text").alias("name")).agg(F.sum(F.floor(F.col("value") * 100 + 0.5).cast("bigint")).alias("seconds"))
    return A.run_report(s).withColumnRenamed("seconds", "cents")


@query("keep_last_runs", f"WITH {EV} SELECT source_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY t DESC) AS r FROM ev) WHERE r <= 50")
def keep_last_runs(spark, sf):
    return A.keep_last_runs(events(spark, sf).withColumn("when", F.col("t")), 50, ["source_id"]).select("source_id", "event_id")
