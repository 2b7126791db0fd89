"""The whole chain from subtitles and scene logs to edit lists, for many sources at once, as memoised stages.

Models stay outside, as producers with a version: ``answer`` replies to a prompt, ``write`` gives an act's lines, ``say``
the seconds that a line takes, ``embed`` (optional) the vectors of texts that shots are to look like; ``frames``
(optional) is a table of the shots' own vectors and brightness: source_id, i, embedding, luma.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import math as M
from ..functions import text as T
from ..operators import filters as E
from ..operators import intervals as G
from ..operators import joins as J
from ..operators.selection import Rules, select_clips
from ..sources.producers import ask, speak
from ..sources.producers import embed as vectors
from ..sources.scenelog import parse_scene_log
from ..sources.subtitles import parse_subtitles
from .memo import Memo, Producer, Stage, Step, digest, run_graph
from .story import mechanical_story, sequence_requests, write_acts

BEATS = "array<struct<start_s string, end_s string, summary string, kind string, importance string>>"
TWISTS = "array<struct<at_s string, what string, severity string>>"


def content(cues: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, low, high: the source between its titles and its credits."""
    ends = cues.groupBy("source_id").agg(F.min("start").alias("_first"), F.max_by("end", F.struct("start", "end")).alias("_last"))
    low, high = M.content_span(F.col("_first"), F.col("_last"), F.col("duration"))
    return sources.join(ends, "source_id", "left").select("source_id", "duration", low.alias("low"), high.alias("high"))


def scenemap(raw: DataFrame, sources: DataFrame, least: float = 10.0) -> DataFrame:
    return G.build_shots(G.threshold_cuts(G.cut_dedupe(parse_scene_log(raw)), least), sources)


def replies(cues: DataFrame, sources: DataFrame, answer: Callable[[str, str], str]) -> DataFrame:
    """source_id, index, reply: one request per window of dialogue."""
    asked = sequence_requests(cues, sources.select("source_id", F.col("duration").alias("runtime_s")))
    return asked.select("source_id", "index", "tag").join(ask(asked.select("tag", "key", "system", "prompt"), answer).select("tag", "reply"), "tag").drop("tag")


def told(replies: DataFrame, field: str, kind: str) -> DataFrame:
    """The rows of one list in all replies, in order (``ord``); a reply without an object adds none."""
    found = F.try_variant_get(T.extract_json(F.col("reply")), f"$.{field}", kind)
    rows = replies.select("source_id", "index", F.posexplode(found).alias("_k", "b")).select("source_id", "index", "_k", "b.*")
    return rows.withColumn("ord", F.row_number().over(W.partitionBy("source_id").orderBy("index", "_k")) - 1).drop("index", "_k")


def story(replies: DataFrame, sources: DataFrame) -> DataFrame:
    """Beats, spaced out by importance."""
    runtime = sources.select("source_id", F.col("duration").alias("runtime_s"))
    beats = told(replies, "beats", BEATS)
    return mechanical_story(beats.withColumns({"start": M.num(F.col("start_s"), -1.0), "importance": M.num(F.col("importance"), 3.0).cast("string")}), runtime).drop("ord", "start")


def twists(replies: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, at_s, what, severity: what must not be shown before it is told."""
    return E.normalise_twists(told(replies, "twists", TWISTS), sources.select("source_id", F.col("duration").alias("runtime_s"))).select("source_id", "at_s", "what", "severity")


def script(beats: DataFrame, cues: DataFrame, twists: DataFrame, sources: DataFrame, write: Callable[[dict, list[str]], list], lookahead_s: float = 180.0) -> DataFrame:
    """Lines of three acts. A line is on the beat it names, else on the one at its own place in the act, and at the cue that
    it cites if that lies within the beat, else at the beat's start; anchors never go back, nor out of the act. The ceiling
    is how far footage may look ahead without giving the next twist away."""
    runtime = sources.select("source_id", F.col("duration").alias("runtime_s"))
    acts = E.acts_or_thirds(runtime.select("source_id", F.lit(0).alias("act"), F.lit(0.0).alias("start_s"), F.lit(-1.0).alias("end_s")), runtime)
    lines = write_acts(acts, write).withColumn("narration", T.clean_narration(F.col("narration"))).filter("narration <> ''")
    lines = lines.withColumn("ord", F.row_number().over(W.partitionBy("source_id", "act").orderBy("i")) - 1)
    bounds = acts.select("source_id", "act", F.col("start_s").alias("_low"), F.col("end_s").alias("_high"))
    seated = J.within(beats.select("source_id", "i", "start_s", "end_s"), bounds, "start_s", "_low", "_high")
    x = J.resolve_beat(lines, seated.select("source_id", "i", "act"))
    x = x.join(seated.select("source_id", F.col("i").alias("beat_id"), F.col("start_s").alias("beat_start"), F.col("end_s").alias("beat_end")), ["source_id", "beat_id"], "left")
    x = J.cite_cue(x, cues.select("source_id", "i", "start")).join(bounds, ["source_id", "act"])
    held = F.greatest("_low", F.least(F.coalesce("anchor", "_low"), "_high"))
    x = x.withColumn("story_time", F.max(held).over(W.partitionBy("source_id").orderBy("i")))
    x = J.asof_next(x, twists.select("source_id", "at_s"), "story_time", "at_s").join(runtime, "source_id")
    x = x.withColumn("spoiler_ceiling", M.spoiler_ceiling(F.col("story_time"), F.col("next._rt"), F.col("runtime_s"), lookahead_s))
    return x.select("source_id", "act", "i", "narration", "visual_query", "beat_id", "story_time", "spoiler_ceiling", "unresolved", "anchored")


def narrate(lines: DataFrame, say: Callable[[str], float]) -> DataFrame:
    """Lines that were spoken, one after the other; ``script_i`` is the line's place in the script."""
    spoken = speak(lines.withColumn("key", F.sha2("narration", 256)), say).drop("key").withColumnRenamed("i", "script_i")
    return G.place_cumulative(spoken, ["script_i"])


def index(shots: DataFrame, beats: DataFrame, cues: DataFrame, sources: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Shots around the beats, inside the content, without the tail, and with what is known of their frames."""
    span = content(cues, sources)
    regions = G.clamp_regions(G.adaptive_regions(beats.select("source_id", F.col("start_s").alias("t")), sources), span)
    x = J.overlap_semi(shots.filter("not tail"), regions)
    return x if frames is None else x.join(frames.select("source_id", "i", "embedding", "luma"), ["source_id", "i"], "left")


def select(lines: DataFrame, beats: DataFrame, shots: DataFrame, cues: DataFrame, sources: DataFrame, rules: Rules, embed: Callable | None = None) -> DataFrame:
    span = content(cues, sources)
    x = G.line_windows(lines, beats, span)
    limits = span.select("source_id", F.col("duration").alias("runtime_s"), F.col("low").alias("content_low"), F.col("high").alias("content_high"))
    x = x.join(limits, "source_id")
    return select_clips(vectors(x, "visual_query", embed) if embed else x, shots, rules)


def run(
    memo: Memo,
    subtitles: DataFrame,
    logs: DataFrame,
    sources: DataFrame,
    answer: Producer,
    write: Producer,
    say: Producer,
    embed: Producer | None = None,
    frames: DataFrame | None = None,
    rules: Rules = Rules(),
    anew=(),
) -> dict[str, Step]:
    """All stages. ``subtitles`` and ``logs``: source_id, content; ``sources``: source_id, duration. Results are used again
    only for the same rows of all tables and the same versions of all producers. A broken stage blocks those that need it."""
    seen = {"sources": digest(sources)}
    by = lambda **k: seen | {n: p.version if isinstance(p, Producer) else p for n, p in k.items()}
    stages = [
        Stage("ingest", 1, [], lambda: parse_subtitles(subtitles), {"subtitles": digest(subtitles)}),
        Stage("scenemap", 1, [], lambda: scenemap(logs, sources), by(logs=digest(logs))),
        Stage("replies", 1, ["ingest"], lambda cues: replies(cues, sources, answer), by(answer=answer)),
        Stage("story", 2, ["replies"], lambda r: story(r, sources), seen),
        Stage("twists", 1, ["replies"], lambda r: twists(r, sources), seen),
        Stage("script", 2, ["story", "ingest", "twists"], lambda b, c, t: script(b, c, t, sources, write), by(write=write)),
        Stage("narrate", 1, ["script"], lambda lines: narrate(lines, say), by(say=say)),
        Stage("index", 2, ["scenemap", "story", "ingest"], lambda s, b, c: index(s, b, c, sources, frames), by(frames=digest(frames) if frames is not None else None)),
        Stage("select", 2, ["narrate", "story", "index", "ingest"], lambda a, b, c, d: select(a, b, c, d, sources, rules, embed), by(rules=str(rules), embed=embed)),
    ]
    return run_graph(memo, stages, anew)
