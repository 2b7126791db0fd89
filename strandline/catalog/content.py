"""Queries over text, tracks, vectors, scoring and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import hashing as H
from ..functions import math as M
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import filters as E
from ..operators import intervals as G
from ..operators import joins as J
from ..operators import ranking as R
from ..operators import retrieval as V
from ..operators import selection as S
from ..plans import story as P
from ..sinks import edl as K
from ..sources import probe as PR
from ..sources import scenelog as SL
from ..sources import subtitles as SUB
from .base import EV, RUNTIME, big, events, ms, query, sources, sql_ms, table
from .timeline import LINE_WINDOWS, RUNS, _shots, line_windows_df

LANG = "CASE WHEN p_size % 4 = 0 THEN 'eng' WHEN p_size % 4 = 1 THEN NULL ELSE 'fre' END"
CODEC = "CASE WHEN p_size % 3 = 0 THEN 'subrip' WHEN p_size % 3 = 1 THEN 'hdmv_pgs_subtitle' ELSE 'xyz' END"
PENALTY = "CASE WHEN " + " OR ".join(f"contains(lower(p_name), '{h}')" for h in T.TITLE_HINTS) + " THEN -80 ELSE 0 END"


def _tracks(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_brand").alias("source_id"), big("p_partkey").alias("index"),
        F.when(size % 3 == 0, "subrip").when(size % 3 == 1, "hdmv_pgs_subtitle").otherwise("xyz").alias("codec"),
        F.when(size % 4 == 0, "eng").when(size % 4 != 1, "fre").alias("language"),
        F.col("p_name").alias("title"), (size % 5 == 0).alias("is_default"), (size % 7 == 0).alias("forced"),
        (F.col("p_partkey") * 13).cast("string").alias("n_frames"), (size % 9).cast("int").alias("channels"),
    )


@query("rank_tracks", f"""WITH x AS (SELECT p_brand AS source_id, CAST(p_partkey AS BIGINT) AS idx, ({CODEC}) = 'subrip' AS usable,
 CASE WHEN ({LANG}) = 'eng' THEN 100 WHEN ({LANG}) IS NULL THEN 20 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 15 ELSE 0 END - CASE WHEN p_size % 7 = 0 THEN 90 ELSE 0 END + {PENALTY} + least(p_partkey * 13 // 200, 25) AS score FROM part)
SELECT source_id, idx AS "index", usable, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY source_id ORDER BY usable DESC, score DESC, idx) AS BIGINT) AS "rank" FROM x""")
def rank_tracks(spark, sf):
    return R.rank_subtitles(_tracks(spark, sf)).select("source_id", "index", "usable", big("score").alias("score"), big("rank").alias("rank"))


@query("pick_track", f"""WITH x AS (SELECT p_brand AS source_id, CAST(p_partkey AS BIGINT) AS idx,
 CASE WHEN ({LANG}) = 'eng' THEN 100 WHEN ({LANG}) IS NULL THEN 20 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 15 ELSE 0 END + least(p_size % 9, 8) * 3 + {PENALTY} AS score FROM part)
SELECT source_id, idx AS "index", CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, idx) AS r FROM x) WHERE r = 1""")
def pick_track(spark, sf):
    return R.pick_audio(_tracks(spark, sf)).select("source_id", "index", big("score").alias("score"))


@query("first_usable", """WITH x AS (SELECT p_brand AS source_id, p_partkey AS priority, p_size % 3 = 0 AS ok, p_size / 100e0 AS c FROM part)
SELECT source_id, CAST(min(priority) AS BIGINT) AS priority FROM x WHERE ok AND c >= 0.1e0 GROUP BY 1""")
def first_usable(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("source_id"), big("p_partkey").alias("priority"), (F.col("p_size") % 3 == 0).alias("ok"), (F.col("p_size") / 100.0).alias("coverage_ratio"))
    return E.first_usable(p).select("source_id", "priority")


CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\{[^}]*\}', '', 'g'), '\\[Nnh]', ' ', 'g'), '</?[a-zA-Z][^>]*>', '', 'g'), '[ \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"


@query("clean_markup", f"SELECT page_id, {CLEAN} AS text FROM pages")
def clean_markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_text(F.col("html")).alias("text"))


@query("clean_speakable", r"""SELECT doc_id, trim(regexp_replace(translate(regexp_replace(coalesce(text, ''), '\s*[—–]\s*', ', ', 'g'), '[]{}<>*_#`|', ''), '\s+', ' ', 'g')) AS narration FROM documents""")
def clean_speakable(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_narration(F.col("text")).alias("narration"))


@query("safe_name", r"""SELECT page_id, coalesce(nullif(left(regexp_replace(trim(trim(regexp_replace(url, '[^A-Za-z0-9 ._-]', '', 'g')), '.'), '\s+', ' ', 'g'), 90), ''), 'untitled') AS name FROM pages""")
def safe_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("word_stats", r"""SELECT doc_id, CAST(coalesce(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')), 0) AS BIGINT) AS words FROM documents""")
def word_stats(spark, sf):
    return table(spark, sf, "documents").select("doc_id", big(T.word_count(F.col("text"))).alias("words"))


@query("format_hms", f"""WITH {EV}, s AS (SELECT event_id, CAST(floor(t) AS BIGINT) % 20000 AS s FROM ev) SELECT event_id,
CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS hms FROM s""")
def format_hms(spark, sf):
    return events(spark, sf).select("event_id", T.format_hms((F.floor("t").cast("bigint") % 20000).cast("double")).alias("hms"))


def _srt_lines(spark, sf):
    x = events(spark, sf)
    i = F.row_number().over(W.partitionBy("source_id").orderBy("t", "event_id"))
    text = F.when(F.col("event_id") % 10 == 0, "").otherwise(F.concat("text", F.lit(" "), F.col("event_id").cast("string")))
    return x.select("source_id", i.alias("i"), F.col("t").alias("start_s"), F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(1.5).alias("spoken_s"), F.lit(2.25).alias("seconds"), text.alias("narration"))


STAMP = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
SRT = f"""{EV}, l AS (SELECT source_id, event_id, t, row_number() OVER (PARTITION BY source_id ORDER BY t, event_id) AS n, {sql_ms('t')} AS a,
 {sql_ms('t + CASE WHEN event_id % 3 = 0 THEN 2.25e0 ELSE 1.5e0 END')} AS b, text || ' ' || CAST(event_id AS VARCHAR) AS narration FROM ev)"""


@query("srt_render", f"WITH {SRT} SELECT source_id, CAST(n AS BIGINT) AS n, CAST(n AS VARCHAR) || chr(10) || {STAMP.format('a')} || ' --> ' || {STAMP.format('b')} || chr(10) || narration || chr(10) AS block FROM l WHERE event_id % 10 <> 0")
def srt_render(spark, sf):
    return K.srt_blocks(_srt_lines(spark, sf)).select("source_id", big("n").alias("n"), "block")


@query("srt_parse", f"""WITH {SRT}, k AS (SELECT source_id, a, b, narration FROM l WHERE event_id % 10 <> 0)
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY a, b) - 1 AS BIGINT) AS i, a AS start_ms, b AS end_ms, narration AS text FROM k""")
def srt_parse(spark, sf):
    docs = K.srt_documents(_srt_lines(spark, sf))
    return SUB.parse_subtitles(docs).select("source_id", big("i").alias("i"), ms("start").alias("start_ms"), ms("end").alias("end_ms"), "text")


def _scene_log(spark, sf):
    """A log per user: headers and scores, a header without its score now and then, some old-style lines."""
    ev = events(spark, sf)
    head = F.concat(F.lit("frame:0    pts:1    pts_time:"), F.col("ms").cast("string"))
    score = F.concat(F.lit("lavfi.scd.score="), F.floor("value").cast("bigint").cast("string"))
    old = F.concat(F.lit("lavfi.scd.time="), F.col("ms").cast("string"))
    line = F.when(F.col("event_id") % 13 == 0, old).when(F.col("event_id") % 7 == 0, head).otherwise(F.concat(head, F.lit("\n"), score))
    x = ev.withColumn("ms", ms("t")).withColumn("line", line)
    a = F.array_sort(F.collect_list(F.struct("t", "event_id", "line")))
    return x.groupBy("source_id").agg(F.array_join(F.transform(a, lambda s: s["line"]), "\n").alias("content"))


@query("scene_log_parse", f"""WITH {EV} SELECT source_id, {sql_ms('t')} AS t_ms, CASE WHEN event_id % 13 = 0 THEN -1 ELSE CAST(floor(value) AS BIGINT) END AS score FROM ev WHERE event_id % 13 = 0 OR event_id % 7 <> 0""")
def scene_log_parse(spark, sf):
    x = SL.parse_scene_log(_scene_log(spark, sf))
    return x.select("source_id", big("t").alias("t_ms"), F.when(F.col("score") == float("inf"), -1).otherwise(F.col("score")).cast("bigint").alias("score"))


@query("json_salvage", """WITH e AS (SELECT event_id, props, event_id % 4 AS k FROM events) SELECT event_id, CASE WHEN k < 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM e""")
def json_salvage(spark, sf):
    e, p = table(spark, sf, "events"), F.col("props")
    k = F.col("event_id") % 4
    reply = F.when(k == 0, p).when(k == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here: "), p, F.lit(" as asked."))).otherwise(F.lit("[1, 2]"))
    return e.select("event_id", F.try_variant_get(T.extract_json(reply), "$.k", "bigint").alias("k"))


@query("text_key")
def text_key(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", H.text_key(F.col("text"), "voice", 1.0).alias("key"))


@query("token_total", """SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN event_id ELSE 2 * user_id + 1 END AS DOUBLE) AS tokens FROM events""")
def token_total(spark, sf):
    d = lambda c: c.cast("double")
    e = table(spark, sf, "events")
    whole = F.create_map(F.lit("total_tokens"), d(F.col("event_id")), F.lit("input_tokens"), F.lit(1.0))
    parts = F.create_map(F.lit("input_tokens"), d(F.col("user_id") * 2), F.lit("output_tokens"), F.lit(1.0), F.lit("cost"), F.lit(9.0))
    return e.select("event_id", T.token_total(F.when(F.col("event_id") % 2 == 0, whole).otherwise(parts)).alias("tokens"))


def _probe_json(spark, sf):
    o = table(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    js = F.concat(
        F.lit('{"format":{"duration":"'), F.when(F.col("p_size") % 2 == 0, k).otherwise("0"), F.lit('","start_time":"0.5"},"streams":[{"index":0,"codec_name":"hevc","codec_type":"video","avg_frame_rate":"24000/1001","r_frame_rate":"0/0","duration":"'),
        k, F.lit('.25"},{"index":1,"codec_name":"aac","codec_type":"audio","channels":6,"avg_frame_rate":"0/0","r_frame_rate":"x","tags":{"LANGUAGE":"ENG","title":"Main"},"disposition":{"default":1,"forced":0}},{"index":2,"codec_type":"subtitle","tags":{"language":"fre"},"disposition":{"forced":1}}]}'),
    )
    return PR.parse_probe(o.select(big("p_partkey").alias("source_id"), js.alias("content")))


@query("probe_streams", """SELECT CAST(p_partkey AS BIGINT) AS source_id, CAST(i AS BIGINT) AS "index", ['hevc', 'aac', 'unknown'][i + 1] AS codec, ['video', 'audio', 'subtitle'][i + 1] AS codec_type,
 [NULL, 'eng', 'fre'][i + 1] AS language, i = 1 AS is_default, i = 2 AS forced, CASE WHEN i = 0 THEN CAST(floor(24000e0 / 1001e0 * 1000 + 0.5) AS BIGINT) END AS fps_e3 FROM part, range(3) t(i)""")
def probe_streams(spark, sf):
    s = PR.streams(_probe_json(spark, sf))
    return s.select("source_id", big("index").alias("index"), "codec", "codec_type", "language", "is_default", "forced", ms("fps").alias("fps_e3"))


@query("probe_runtime", """SELECT CAST(p_partkey AS BIGINT) AS source_id, CASE WHEN p_size % 2 = 0 AND p_partkey > 0 THEN CAST(p_partkey AS DOUBLE) ELSE p_partkey + 0.25e0 END AS runtime_s, 0.5e0 AS start_offset_s FROM part""")
def probe_runtime(spark, sf):
    return PR.runtime(_probe_json(spark, sf))


@query("first_notes", f"WITH {EV} SELECT source_id, text AS name, min(event_id) AS ord, CAST(arg_min(event_id, event_id) AS VARCHAR) AS note FROM ev GROUP BY 1, 2")
def first_notes(spark, sf):
    x = events(spark, sf).select("source_id", F.concat(F.lit(" "), "text").alias("name"), F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("note"))
    return A.first_notes(x).select("source_id", "name", "ord", "note")


@query("source_inventory", """SELECT c_mktsegment AS source_id, CAST(sum(CAST(floor(c_acctbal) AS BIGINT)) AS BIGINT) AS bytes, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS stages FROM customer GROUP BY 1""")
def source_inventory(spark, sf):
    x = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("source_id"), F.floor("c_acctbal").cast("bigint").alias("length"), F.col("c_nationkey").cast("string").alias("stage"))
    return A.inventory(x).select("source_id", "bytes", big(F.size("stages")).alias("stages"))


@query("act_budget", """WITH a AS (SELECT o_custkey AS source_id, o_orderkey AS act, CAST(o_orderkey % 900 + 1 AS DOUBLE) AS d FROM orders),
b AS (SELECT *, greatest(150, CAST(floor(2200e0 * (d / sum(d) OVER (PARTITION BY source_id))) AS BIGINT)) AS words FROM a),
c AS (SELECT *, greatest(3, CAST(round_even(words / 26e0, 0) AS BIGINT)) AS segments FROM b)
SELECT source_id, act, words, segments, greatest(4, CAST(floor(segments * 1.2e0) AS BIGINT)) AS segment_cap FROM c""")
def act_budget(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("source_id"), big("o_orderkey").alias("act"), F.lit(0.0).alias("start_s"), (F.col("o_orderkey") % 900 + 1).cast("double").alias("end_s"))
    return P.act_budget(a).select("source_id", "act", big("words").alias("words"), big("segments").alias("segments"), big("segment_cap").alias("segment_cap"))


@query("recent_lines", f"""WITH {EV} SELECT source_id, event_id, coalesce(string_agg(text, ' ') OVER (PARTITION BY source_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS context FROM ev""")
def recent_lines(spark, sf):
    x = events(spark, sf).withColumn("i", F.struct("t", "event_id")).withColumn("narration", F.col("text"))
    return P.recent_lines(x).select("source_id", "event_id", F.array_join("context", " ").alias("context"))


@query("sequence_requests", f"""WITH {EV}, x AS (SELECT *, CAST(floor(t / 86400e0) AS BIGINT) AS own FROM ev WHERE t >= 0), y AS (SELECT *, unnest(range(greatest(0, own - 1), own + 1)) AS tile FROM x),
z AS (SELECT * FROM y WHERE tile * 86400e0 < 2592000e0 AND t < least(2592000e0, tile * 86400e0 + 86400e0) + 7200e0),
g AS (SELECT source_id, tile, string_agg('[' || CAST(CAST(floor(t) AS BIGINT) AS VARCHAR) || '] ' || text, chr(10) ORDER BY t, event_id) AS transcript FROM z GROUP BY 1, 2)
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY tile) - 1 AS BIGINT) AS chunk,
 'Dialogue from second ' || CAST(tile * 86400 AS VARCHAR) || ' to ' || CAST(least(2592000, tile * 86400 + 86400) AS VARCHAR) || ':' || chr(10) || transcript || chr(10) || chr(10) || 'List the events, characters and open questions as one JSON object.' AS prompt FROM g""")
def sequence_requests(spark, sf):
    ev = events(spark, sf)
    cues = ev.select("source_id", F.col("event_id").alias("i"), F.col("t").alias("start"), "text")
    r = P.sequence_requests(cues, sources(ev, "runtime_s"), 86400.0, 7200.0)
    return r.select("source_id", big("index").alias("chunk"), "prompt")


@query("l2_normalise", """WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings)
SELECT vec_id, CAST(floor(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE) / n))) * 1e6 + 0.5) AS BIGINT) AS l1_e6 FROM n""")
def l2_normalise(spark, sf):
    v = M.l2_normalise(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.floor(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x)) * 1e6 + 0.5).cast("bigint").alias("l1_e6"))


DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * z[2]))"


@query("cosine_topk", f"""WITH e AS (SELECT vec_id, embedding, sqrt({DOT.format('embedding', 'embedding')}) AS n FROM embeddings),
p AS (SELECT q.vec_id, v.vec_id AS neighbour, {DOT.format('q.embedding', 'v.embedding')} / (q.n * v.n) AS c FROM e q JOIN e v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, neighbour) AS rk FROM p)
SELECT vec_id, CAST(rk AS BIGINT) AS "rank", neighbour, CAST(floor(c * 1e6 + 0.5) AS BIGINT) AS cosine_e6 FROM r WHERE rk <= 5""")
def cosine_topk(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    x = V.cosine_topk(e.filter("vec_id % 100 = 0"), e, 5)
    return x.select("vec_id", big("rank").alias("rank"), "neighbour", F.floor(F.col("cosine") * 1e6 + 0.5).cast("bigint").alias("cosine_e6"))


def _line_shot(spark, sf):
    """Lines and shots of ten sources: the embeddings, by label; ids divisible by 100 are lines."""
    e = table(spark, sf, "embeddings").select(F.col("label").alias("source_id"), F.col("vec_id").alias("i"), "embedding")
    return e.filter("i % 100 = 0"), e


@query("minmax_rescale", f"""WITH s AS (SELECT a.label AS source_id, a.vec_id AS line_i, b.vec_id AS shot_i, {DOT.format('a.embedding', 'b.embedding')} AS c FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0),
w AS (SELECT *, min(c) OVER (PARTITION BY source_id, line_i) AS lo, max(c) OVER (PARTITION BY source_id, line_i) AS hi FROM s)
SELECT CAST(source_id AS BIGINT) AS source_id, line_i, shot_i, CAST(floor(CASE WHEN hi - lo > 1e-6 THEN (c - lo) / (hi - lo) ELSE c END * 1e6 + 0.5) AS BIGINT) AS similarity_e6 FROM w""")
def minmax_rescale(spark, sf):
    x = V.rescale_per_line(V.line_shot_similarity(*_line_shot(spark, sf)))
    return x.select(big("source_id").alias("source_id"), "line_i", "shot_i", F.floor(F.col("similarity") * 1e6 + 0.5).cast("bigint").alias("similarity_e6"))


@query("best_shot", f"""WITH s AS (SELECT a.label AS source_id, a.vec_id AS line_i, b.vec_id AS shot_i, {DOT.format('a.embedding', 'b.embedding')} AS c FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT CAST(source_id AS BIGINT) AS source_id, line_i, shot_i FROM (SELECT *, row_number() OVER (PARTITION BY source_id, line_i ORDER BY c DESC, shot_i) AS r FROM s) WHERE r = 1""")
def best_shot(spark, sf):
    x = V.line_shot_similarity(*_line_shot(spark, sf)).filter("line_i <> shot_i")
    return R.argmax(x, "similarity", "shot_i", ["source_id", "line_i"]).select(big("source_id").alias("source_id"), "line_i", "shot_i")


@query("band_score", """WITH d AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) / 8 - 0.5e0 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(floor(CASE WHEN d <= 0 THEN 0e0 WHEN d < 1.5e0 THEN d / 1.5e0 WHEN d > 4e0 THEN 4e0 / d ELSE 1e0 END * 1e6 + 0.5) AS BIGINT) AS score_e6 FROM d""")
def band_score(spark, sf):
    d = F.col("l_quantity").cast("double") / 8 - 0.5
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.floor(M.band_score(d, 1.5, 4.0) * 1e6 + 0.5).cast("bigint").alias("score_e6"))


@query("proximity_score", f"WITH {EV} SELECT event_id, CAST(floor(exp(-((t - value * 3600e0) * (t - value * 3600e0)) / (2e0 * 86400e0 * 86400e0)) * 1e6 + 0.5) AS BIGINT) AS score_e6 FROM ev")
def proximity_score(spark, sf):
    x = M.proximity_score(F.col("t"), F.col("value") * 3600.0, 86400.0)
    return events(spark, sf).select("event_id", F.floor(x * 1e6 + 0.5).cast("bigint").alias("score_e6"))


@query("quantise", """SELECT event_id, CAST(greatest(1e0, round_even(value * 24e0, 0)) AS BIGINT) AS frames, CAST(floor((greatest(1e0, round_even(value * 24e0, 0)) + 0.5e0) / 24e0 * 1e6 + 0.5) AS BIGINT) AS request_e6 FROM events""")
def quantise(spark, sf):
    exact, ask = M.quantise(F.col("value"), F.lit(24.0))
    return events(spark, sf).select("event_id", big(F.bround(exact * 24.0)).alias("frames"), F.floor(ask * 1e6 + 0.5).cast("bigint").alias("request_e6"))


ELIGIBLE = f"""{EV}, li AS (SELECT source_id, event_id AS line_i, t AS story FROM ev WHERE event_id % 100 = 0),
x AS (SELECT l.source_id, line_i, e.event_id AS shot_i, abs(e.t - story) AS d, e.t <= 1296000e0 AND e.event_id % 5 < 3 AS base, e.value / 500e0 AS sim, e.value > 100 AS dark,
 exp(-((e.t - story) * (e.t - story)) / (2e0 * 86400e0 * 86400e0)) AS prox FROM li l JOIN ev e ON e.source_id = l.source_id),
n AS (SELECT *, min(CASE WHEN base THEN d END) OVER (PARTITION BY source_id, line_i) AS near FROM x),
r AS (SELECT *, CASE WHEN near <= 21600e0 THEN 21600e0 WHEN near <= 43200e0 THEN 43200e0 WHEN near <= 86400e0 THEN 86400e0 WHEN near <= 172800e0 THEN 172800e0 ELSE 345600e0 END AS radius FROM n),
g AS (SELECT *, base AND d <= radius AS ok FROM r),
w AS (SELECT *, coalesce(max(CASE WHEN ok THEN sim END) OVER (PARTITION BY source_id, line_i) < 0.05e0, false) AS weak FROM g)"""


@query("score_eligible", f"WITH {ELIGIBLE} SELECT source_id, line_i, shot_i, radius, ok AS eligible, weak, CAST(floor(CASE WHEN weak THEN prox + 0e0 - CASE WHEN dark THEN 1e0 ELSE 0e0 END ELSE sim END * 1e6 + 0.5) AS BIGINT) AS score_e6 FROM w")
def score_eligible(spark, sf):
    ev = events(spark, sf)
    li = ev.filter("event_id % 100 = 0").select("source_id", F.col("event_id").alias("line_i"), F.col("t").alias("story_time"))
    sh = ev.select("source_id", F.col("event_id").alias("shot_i"), F.col("t").alias("start"), F.col("t").alias("mid"), (F.col("event_id") % 5).alias("uses"), (F.col("value") / 500.0).alias("similarity"), F.when(F.col("value") > 100, 1.0).otherwise(0.0).alias("dark"))
    x = li.join(sh, "source_id").withColumns({"ceiling": F.lit(RUNTIME / 2), "band": F.lit(0.0), "score": F.col("similarity"), "proximity": M.proximity_score(F.col("mid"), F.col("story_time"), 86400.0)})
    by = ["source_id", "line_i"]
    x = E.similarity_floor(E.eligible(x, by, 3, (21600.0, 43200.0, 86400.0, 172800.0), 345600.0), by, 0.05)
    return x.select("source_id", "line_i", "shot_i", "radius", "eligible", "weak", F.floor(F.col("score") * 1e6 + 0.5).cast("bigint").alias("score_e6"))


def edl(spark, sf, mode: str):
    w, span = line_windows_df(spark, sf)
    lines = w.join(span.select("source_id", F.col("low").alias("content_low"), F.col("high").alias("content_high")), "source_id").withColumn("runtime_s", F.lit(RUNTIME))
    shots = _shots(spark, sf).withColumn("luma", (F.col("i") * 37 % 200).cast("double"))
    rules = S.Rules(mode=mode, band_low_s=21600.0, band_high_s=172800.0, target_clip_s=43200.0, max_run_s=172800.0, radius_s=172800.0, proximity_sigma_s=86400.0, gap_s=3600.0, fps=None)
    return S.select_clips(lines, shots, rules)


def _flat(df):
    c = df.select("source_id", "i", "script_i", "weak", F.posexplode("clips").alias("k", "c"))
    return c.select("source_id", "i", "script_i", "weak", "k", "c.shot_i", ms("c.src_start").alias("src_start_ms"), ms("c.src_end").alias("src_end_ms"), ms("c.duration").alias("duration_ms"), "c.continuous")


@query("edl_traverse")
def edl_traverse(spark, sf):
    return _flat(edl(spark, sf, "traverse"))


@query("edl_continuous")
def edl_continuous(spark, sf):
    return _flat(edl(spark, sf, "continuous"))


@query("edl_montage")
def edl_montage(spark, sf):
    return _flat(edl(spark, sf, "montage"))


@query("edl_stats")
def edl_stats(spark, sf):
    return A.edl_stats(edl(spark, sf, "traverse"))


@query("concat_lists")
def concat_lists(spark, sf):
    return K.concat_lists(edl(spark, sf, "traverse"), "film's cut.mkv")


@query("script_stats", f"""WITH {RUNS} SELECT source_id, count(*) AS segments, CAST(sum(event_id % 40) AS BIGINT) AS total_words, count(*) FILTER (event_id % 3 = 0) AS unresolved, count(*) FILTER (event_id % 4 <> 0) AS unanchored FROM runs GROUP BY 1""")
def script_stats(spark, sf):
    x = events(spark, sf).select("source_id", (F.col("event_id") % 40).alias("word_count"), (F.col("event_id") % 3 == 0).alias("unresolved"), (F.col("event_id") % 4 == 0).alias("anchored"))
    s = A.script_stats(x)
    return s.select("source_id", big("segments").alias("segments"), big("total_words").alias("total_words"), big("unresolved_beat_ids").alias("unresolved"), big("dialogue_unanchored").alias("unanchored"))


@query("memo_lookup", "SELECT d.doc_id, l.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def memo_lookup(spark, sf):
    hits, misses = J.memo_split(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), ["doc_id"])
    return hits.select("doc_id", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", F.lit(False).alias("hit")))


@query("dedupe_before_udf", "SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n FROM conversations")
def dedupe_before_udf(spark, sf):
    work = lambda d: d.withColumn("n", F.length("text").cast("bigint"))
    return J.dedupe_before(table(spark, sf, "conversations"), ["text"], work).select("conv_id", "turn", "n")


@query("backfill_beats", f"WITH {EV} SELECT source_id, event_id, CASE WHEN event_id % 2 = 0 THEN event_id ELSE (SELECT min(f.event_id) FROM ev f WHERE f.source_id = e.source_id) END AS beat_id FROM ev e")
def backfill_beats(spark, sf):
    ev = events(spark, sf)
    first = ev.groupBy("source_id").agg(F.min("event_id").alias("first_beat"))
    rows = ev.select("source_id", "event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("beat_id"))
    return J.backfill(rows, first, ["source_id"], {"beat_id": "first_beat"}).select("source_id", "event_id", "beat_id")


__all__ = ["LINE_WINDOWS"]
