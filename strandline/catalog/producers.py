"""Queries over labels, requests, injected producers and the writers' text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import math as M
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import filters as E
from ..operators import intervals as G
from ..operators import joins as J
from ..operators import ranking as R
from ..plans import story as P
from ..sinks import edl as K
from ..sources import probe as PR
from ..sources import producers as PD
from ..sources import subtitles as SUB
from ..streaming import sessions as ST
from .base import EV, big, events, ms, query, sql_ms, table
from .content import CODEC, LANG, _tracks, edl
from .timeline import RUNS


def floor6(c):
    return F.floor(c * 1e6 + 0.5).cast("bigint")


@query("cue_lines", f"WITH {EV} SELECT event_id, '[' || CAST(CAST(floor(t) AS BIGINT) AS VARCHAR) || '] ' || text AS line FROM ev")
def cue_lines(spark, sf):
    return events(spark, sf).select("event_id", T.cue_line(F.col("t"), F.col("text")).alias("line"))


@query("prompt_lines", r"SELECT conv_id, turn, nullif(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 70), '') AS line FROM conversations")
def prompt_lines(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.prompt_line(F.col("text")).alias("line"))


@query("music_only", r"SELECT doc_id, regexp_matches(text, '^[\s♪♫♬♩~#*_\-]*$') AS music FROM documents")
def music_only(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.is_music_only(F.col("text")).alias("music"))


@query("voice_names", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_nationkey < 5 THEN c_mktsegment ELSE '' END, ''), 'am') AS voice FROM customer")
def voice_names(spark, sf):
    named = F.when(F.col("c_nationkey") < 5, F.concat(F.lit(f" {T.LEGACY_VOICE}"), "c_mktsegment", F.lit(" "))).otherwise("  ")
    return table(spark, sf, "customer").select("c_custkey", T.voice_name(named, "am").alias("voice"))


@query("cast_list", """WITH x AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer)
SELECT n_nationkey, coalesce(string_agg('- ' || c_name || ' (' || c_mktsegment || '): ' || CAST(c_custkey AS VARCHAR), chr(10) ORDER BY c_custkey) FILTER (c_acctbal >= 0), '(no cast given)') AS people FROM nation LEFT JOIN x ON c_nationkey = n_nationkey AND r <= 12 GROUP BY 1""")
def cast_list(spark, sf):
    name = F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name")
    person = F.struct(name, F.col("c_mktsegment").alias("role"), F.col("c_custkey").cast("string").alias("description"))
    first = R.topk(table(spark, sf, "customer").withColumn("person", person), 12, [F.col("c_custkey")], ["c_nationkey"])
    ordered = F.array_sort(F.collect_list(F.struct("c_custkey", "person")))
    c = first.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.transform(ordered, lambda s: s["person"]).alias("people"))
    return table(spark, sf, "nation").join(c, "n_nationkey", "left").select("n_nationkey", T.format_cast(F.col("people")).alias("people"))


@query("keyframe_names", f"WITH {EV} SELECT event_id, printf('kf_%09d.jpg', CAST(round_even(t * 1000, 0) AS BIGINT)) AS name FROM ev")
def keyframe_names(spark, sf):
    return events(spark, sf).select("event_id", T.keyframe_name(F.col("t")).alias("name"))


@query("rational_parse", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN CAST(floor(24000e0 / (l_linenumber - 1) * 1e6 + 0.5) AS BIGINT) END AS rate_e6 FROM lineitem")
def rational_parse(spark, sf):
    rate = M.fraction(F.concat(F.lit("24000/"), (F.col("l_linenumber") - 1).cast("string")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", floor6(rate).alias("rate_e6"))


@query("speech_rates", """SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 150e0 * 60e0 * 1e6 + 0.5) AS BIGINT) AS est_e6, CAST(floor(l_quantity / greatest(1e-6, l_linenumber / 60e0) * 1e6 + 0.5) AS BIGINT) AS wpm_e6,
 CAST(l_quantity AS BIGINT) - CAST(l_quantity AS BIGINT) % 2 AS even, CAST(floor(least(100e0, l_linenumber / 5e0 * 100) * 1e6 + 0.5) AS BIGINT) AS pct_e6, CAST(floor(l_quantity / nullif(l_linenumber - 1, 0) * 1e6 + 0.5) AS BIGINT) AS factor_e6 FROM lineitem""")
def speech_rates(spark, sf):
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", floor6(M.est_seconds(q, 150.0)).alias("est_e6"), floor6(M.wpm(q, n)).alias("wpm_e6"), M.even(big("l_quantity")).alias("even"),
        floor6(M.progress_pct(n, F.lit(5.0))).alias("pct_e6"), floor6(M.realtime_factor(q, n - 1)).alias("factor_e6"),
    )


@query("codec_class", f"SELECT p_partkey, CASE ({CODEC}) WHEN 'subrip' THEN 'text' WHEN 'hdmv_pgs_subtitle' THEN 'bitmap' ELSE 'unknown' END AS kind FROM part")
def codec_class(spark, sf):
    return _tracks(spark, sf).select(F.col("index").alias("p_partkey"), E.codec_class(F.col("codec")).alias("kind"))


@query("stream_labels", f"""SELECT CAST(p_partkey AS BIGINT) AS p_partkey, '#' || CAST(p_partkey AS VARCHAR) || ' ' || ({CODEC}) || coalesce(' ' || ({LANG}), '') || ' ' || p_name
 || CASE WHEN p_size % 5 = 0 THEN ' (default)' ELSE '' END || CASE WHEN p_size % 7 = 0 THEN ' (forced)' ELSE '' END AS label FROM part""")
def stream_labels(spark, sf):
    return PR.stream_label(_tracks(spark, sf)).select(F.col("index").alias("p_partkey"), "label")


@query("audio_ordinal", "SELECT p_brand AS source_id, CAST(p_partkey AS BIGINT) AS idx, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS BIGINT) AS ordinal FROM part WHERE p_size > 20")
def audio_ordinal(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("source_id"), big("p_partkey").alias("index"), F.when(F.col("p_size") > 20, "audio").otherwise("video").alias("codec_type"))
    return R.audio_ordinal(p).select("source_id", F.col("index").alias("idx"), big("ordinal").alias("ordinal"))


@query("sidecars", "SELECT s_suppkey, s_nationkey < 12 AS english FROM supplier WHERE s_name LIKE 'Supplier%' AND s_acctbal >= 0")
def sidecars(spark, sf):
    tag, ext = F.when(F.col("s_nationkey") < 12, ".EN").otherwise(".fr"), F.when(F.col("s_acctbal") >= 0, ".Srt").otherwise(".txt")
    files = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.concat(F.lit("/films/"), "s_name", tag, ext).alias("path"))
    return R.sidecars(files, "Supplier").select("s_suppkey", "english")


@query("future_twists", f"WITH {EV} SELECT source_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY t, event_id) AS r FROM ev WHERE text = 'error' AND t > 1296000) WHERE r <= 10")
def future_twists(spark, sf):
    ahead = events(spark, sf).filter("text = 'error' and t > 1296000")
    return R.topk(ahead, 10, [F.col("t"), F.col("event_id")]).select("source_id", "event_id")


@query("interval_union", f"""WITH {EV}, x AS (SELECT source_id, t AS s, t + value * 600e0 AS e FROM ev),
y AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY source_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM x),
z AS (SELECT *, sum(o) OVER (PARTITION BY source_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM y) SELECT source_id, {sql_ms('min(s)')} AS start_ms, {sql_ms('max(e)')} AS end_ms FROM z GROUP BY source_id, k""")
def interval_union(spark, sf):
    iv = events(spark, sf).select("source_id", F.col("t").alias("start"), (F.col("t") + F.col("value") * 600.0).alias("end"))
    return G.union_intervals(iv).select("source_id", ms("start").alias("start_ms"), ms("end").alias("end_ms"))


@query("line_query", "SELECT o_orderkey, least(CAST(floor(o_totalprice / 1000) AS BIGINT), 99) AS query_row FROM orders")
def line_query(spark, sf):
    lines = table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("script_i"))
    return J.line_query(lines, F.lit(100)).select("o_orderkey", big("query_row").alias("query_row"))


@query("speakable", "SELECT conv_id, turn FROM conversations WHERE coalesce(trim(text), '') <> '' AND coalesce(trim(role), '') <> ''")
def speakable(spark, sf):
    c = table(spark, sf, "conversations").withColumns({"narration": F.col("text"), "visual_query": F.col("role")})
    return E.speakable(c).select("conv_id", "turn")


@query("beat_blocks", f"""WITH {RUNS}, b AS (SELECT source_id, CAST(run AS BIGINT) AS beat, min(t) AS s, max(t) AS e, min(text) AS summary FROM runs GROUP BY 1, 2),
x AS (SELECT b.*, ev.event_id, ev.t, ev.text, count(*) OVER w AS n, row_number() OVER (w ORDER BY ev.t, ev.event_id) - 1 AS p FROM b JOIN ev ON ev.source_id = b.source_id AND ev.t >= b.s AND ev.t <= b.e WINDOW w AS (PARTITION BY b.source_id, b.beat)),
k AS (SELECT * FROM x WHERE n <= 2 OR p IN (SELECT g * n // 2 FROM range(2) q(g)))
SELECT source_id, beat, '[' || CAST(beat AS VARCHAR) || '] ' || min(summary) || chr(10) || string_agg('    [' || CAST(CAST(floor(t) AS BIGINT) AS VARCHAR) || '] ' || text, chr(10) ORDER BY t, event_id) AS block FROM k GROUP BY 1, 2""")
def beat_blocks(spark, sf):
    ev = events(spark, sf)
    runs = G.group_runs(ev, F.col("text"), ["t", "event_id"])
    beats = runs.groupBy("source_id", big("run").alias("i")).agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.min("text").alias("summary"))
    return P.beat_lines(beats, ev.select("source_id", F.col("event_id").alias("i"), F.col("t").alias("start"), "text"), 2)


@query("story_stats", f"""WITH {EV}, b AS (SELECT source_id, count(*) FILTER (text <> 'error') AS beats, count(*) FILTER (text = 'error') AS twists, count(*) FILTER (text = 'purchase') AS pairs, count(*) FILTER (text = 'purchase' AND value > 20) AS paid_off,
 CAST(floor(avg(least(value, 5)) FILTER (text <> 'error') * 1e6 + 0.5) AS BIGINT) AS importance_e6 FROM ev GROUP BY 1) SELECT * FROM b WHERE beats > 0""")
def story_stats(spark, sf):
    ev = events(spark, sf)
    beats = ev.filter("text <> 'error'").withColumn("importance", F.least("value", F.lit(5.0)))
    pairs = ev.filter("text = 'purchase'").withColumn("payoff_s", F.when(F.col("value") > 20, F.col("t")))
    s = A.story_stats(beats, ev.filter("text = 'error'"), pairs, order=["event_id"])
    return s.select("source_id", *[big(c).alias(c) for c in ("beats", "twists", "pairs", "paid_off")], floor6(F.col("mean_importance")).alias("importance_e6"))


@query("edl_drift")
def edl_drift(spark, sf):
    return A.drift(edl(spark, sf, "traverse"))


@query("mechanical_story")
def mechanical_story(spark, sf):
    ev = events(spark, sf)
    beats = ev.select(
        "source_id", F.col("event_id").alias("ord"), F.col("t").alias("start"), F.col("t").cast("string").alias("start_s"), (F.col("t") + F.col("value")).cast("string").alias("end_s"),
        F.col("text").alias("kind"), F.floor(F.col("value") / 20).cast("string").alias("importance"),
    )
    return P.mechanical_story(beats, ev.select("source_id", F.lit(2592000.0).alias("runtime_s")).distinct()).select("source_id", "i", "ord", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "importance")


@query("synthesis_requests", """SELECT conv_id AS source_id, string_agg(text, chr(10) ORDER BY turn, text) AS notes FROM conversations WHERE text IS NOT NULL GROUP BY 1""")
def synthesis_requests(spark, sf):
    notes = table(spark, sf, "conversations").filter("text is not null").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("index"), F.col("text").alias("note"))
    head, tail = P.SYNTHESIS.split("%s")
    body = F.expr(f"substring(prompt, {len(head) + 1}, length(prompt) - {len(head) + len(tail)})")
    return P.synthesis_requests(notes).select("source_id", body.alias("notes"))


@query("narration_list", f"""WITH {EV}, x AS (SELECT source_id, event_id, row_number() OVER w AS i, lead(event_id) OVER w IS NULL AS final FROM ev WINDOW w AS (PARTITION BY source_id ORDER BY t, event_id))
SELECT source_id, string_agg('file ''w' || CAST(event_id AS VARCHAR) || '.wav''' || CASE WHEN final THEN '' ELSE chr(10) || 'file ''gap.wav''' END, chr(10) ORDER BY i) AS content FROM x GROUP BY 1""")
def narration_list(spark, sf):
    lines = G.group_runs(events(spark, sf), F.col("event_id"), ["t", "event_id"]).withColumns({"i": F.col("run"), "wav": F.concat(F.lit("w"), F.col("event_id").cast("string"), F.lit(".wav"))})
    return K.narration_list(lines, "gap.wav")


@query("narration_format", f"""WITH {EV} SELECT source_id, coalesce(arg_min(CAST(16000 + event_id % 3 AS BIGINT), event_id) FILTER (value > 50), 22050) AS rate, coalesce(arg_min(CAST(1 + event_id % 2 AS BIGINT), event_id) FILTER (value > 50), 1) AS channels FROM ev GROUP BY 1""")
def narration_format(spark, sf):
    read = F.col("value") > 50
    x = events(spark, sf).select("source_id", F.col("event_id").alias("i"), F.when(read, 16000 + F.col("event_id") % 3).alias("rate"), F.when(read, 1 + F.col("event_id") % 2).alias("channels"))
    return K.narration_format(x)


@query("transcribed_cues", f"""WITH {EV}, c AS (SELECT *, CASE WHEN text = lag(text) OVER w AND t - lag(t + 3600) OVER w < 1 THEN 0 ELSE 1 END AS o FROM ev WINDOW w AS (PARTITION BY source_id ORDER BY t, event_id)),
k AS (SELECT *, sum(o) OVER (PARTITION BY source_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM c) SELECT source_id, {sql_ms('min(t)')} AS start_ms, {sql_ms('max(t) + 3600')} AS end_ms, min(text) AS text FROM k GROUP BY source_id, g""")
def transcribed_cues(spark, sf):
    x = events(spark, sf).select("source_id", F.col("t").alias("start"), (F.col("t") + 3600.0).alias("end"), F.concat(F.lit("{x}<i>"), "text", F.lit("</i> ")).alias("text"))
    return SUB.transcribed_cues(x).select("source_id", ms("start").alias("start_ms"), ms("end").alias("end_ms"), "text")


@query("spoken_lines", r"SELECT conv_id, turn, CAST(floor(coalesce(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')), 0) / 150e0 * 60 * 1e6 + 0.5) AS BIGINT) AS seconds_e6 FROM conversations WHERE text IS NOT NULL")
def spoken_lines(spark, sf):
    c = table(spark, sf, "conversations").filter("text is not null").withColumns({"key": F.sha2("text", 256), "narration": F.col("text")})
    return PD.speak(c, PD.stub_seconds()).select("conv_id", "turn", floor6(F.col("seconds")).alias("seconds_e6"))


@query("asked_replies", "SELECT conv_id || ':' || turn AS tag, CASE WHEN role = 'user' THEN 'kept' WHEN length(text) > 0 THEN upper(left(role, 1)) END AS reply, role <> 'user' AND length(text) = 0 AS failed FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL")
def asked_replies(spark, sf):
    def fn(system: str, prompt: str) -> str:
        if prompt.startswith("\n"):
            raise ValueError("nothing to answer")
        return system[:1].upper()

    c = table(spark, sf, "conversations").filter("text is not null and role is not null")
    tag = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    asked = c.select(tag.alias("tag"), tag.alias("key"), F.col("role").alias("system"), F.when(F.length("text") == 0, "\n").otherwise("x").alias("prompt"))
    cache = asked.filter("system = 'user'").select("key", F.lit("kept").alias("reply"))
    return PD.ask(asked, fn, cache=cache).select("tag", "reply", F.col("error").isNotNull().alias("failed"))


@query("embedded_lines")
def embedded_lines(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return PD.embed(c, "text", PD.stub_vectors(16))


@query("tumbling_counts", """SELECT user_id AS source_id, date_trunc('day', ts) AS "start", count(*) AS n, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2""")
def tumbling_counts(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") * 100 + 0.5).cast("bigint").alias("value"))
    return ST.window_counts(e, "1 day").select("source_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.col("value").alias("cents"))


@query("keyframed", "SELECT user_id AS source_id, event_id FROM events WHERE event_id % 7 <> 0 AND value > 20")
def keyframed(spark, sf):
    flag = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("boolean")).otherwise(F.col("value") > 20)
    return E.with_keyframe(events(spark, sf).withColumn("has_keyframe", flag)).select("source_id", "event_id")


@query("shot_vectors", "SELECT e.user_id AS source_id, e.event_id, v.vec_id, v.embedding IS NULL AS missing FROM events e LEFT JOIN embeddings v ON v.vec_id = e.event_id % 1000 AND v.label % 150 = e.user_id % 10")
def shot_vectors(spark, sf):
    ev = events(spark, sf).select((F.col("source_id") % 10).cast("int").alias("label"), "source_id", "event_id", (F.col("event_id") % 1000).alias("clip_row"))
    v = table(spark, sf, "embeddings").select((F.col("label") % 150).alias("label"), F.col("vec_id").alias("row"), F.struct("vec_id", "embedding").alias("embedding"))
    x = J.shot_vectors(ev, v, ["label"])
    return x.select("source_id", "event_id", F.col("embedding.vec_id").alias("vec_id"), F.col("embedding.embedding").isNull().alias("missing"))


@query("retry_delays", "SELECT event_id, coalesce(least(120.0::DOUBLE, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN NULL END), least(60.0::DOUBLE, 4.0::DOUBLE * pow(2, event_id % 7))) AS delay FROM events")
def retry_delays(spark, sf):
    advice = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).when(F.col("event_id") % 3 == 2, "soon")
    return events(spark, sf).select("event_id", M.retry_delay(F.col("event_id") % 7, advice).alias("delay"))


@query("fit_filters", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'scale=224:224:force_original_aspect_ratio=increase,crop=224:224' ELSE 'scale=224:224:force_original_aspect_ratio=decrease,pad=224:224:(ow-iw)/2:(oh-ih)/2:black' END AS filter FROM part")
def fit_filters(spark, sf):
    mode = F.when(F.col("p_size") % 2 == 0, "crop").when(F.col("p_size") % 3 == 0, "pad")
    return table(spark, sf, "part").select("p_partkey", T.fit_filter(mode).alias("filter"))


@query("summary_lines", "SELECT user_id AS source_id, count(*) || ' events, ' || count(DISTINCT event_type) || ' kinds' || CASE WHEN count_if(value > 300) > 0 THEN ', ' || count_if(value > 300) || ' large' ELSE '' END AS line FROM events GROUP BY 1")
def summary_lines(spark, sf):
    g = events(spark, sf).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("k"), F.count_if(F.col("value") > 300).alias("large"))
    facts = F.array(F.concat_ws(" ", F.col("n").cast("string"), F.lit("events")), F.concat_ws(" ", F.col("k").cast("string"), F.lit("kinds")))
    return g.select("source_id", A.summary_line(facts, (F.col("large"), "large")).alias("line"))
