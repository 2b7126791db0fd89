"""Dialogue to story: windows, map requests, one reduce request, normalisation, and a mechanical fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators.filters import clamp_beats
from ..operators.intervals import chunk_windows, greedy_spacing

BY = ("source_id",)
SYSTEM = "You describe what happens in a film from its dialogue. Times are seconds from the start."
SEQUENCE = "Dialogue from second %d to %d:\n%s\n\nList the events, characters and open questions as one JSON object."
SYNTHESIS = "Notes on each part of the film, in order:\n%s\n\nGive acts, beats, twists and set-ups with their payoffs as one JSON object."


def sequence_requests(cues: DataFrame, runtime: DataFrame, step_s: float = 600.0, overlap_s: float = 45.0, by: Sequence[str] = BY) -> DataFrame:
    """One request per window of dialogue: (source, tag, key, system, prompt)."""
    w = chunk_windows(cues, runtime.select(*by, F.col("runtime_s").alias("duration")), step_s, overlap_s, by)
    lines = F.array_sort(F.collect_list(F.struct("start", "i", T.cue_line(F.col("start"), F.col("text")).alias("line"))))
    g = w.groupBy(*by, "index", "start_s", "end_s").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))
    prompt = F.format_string(SEQUENCE, F.floor("start_s").cast("bigint"), F.floor("end_s").cast("bigint"), F.col("transcript"))
    tag = F.concat_ws(":", *by, F.col("index").cast("string"))
    return g.select(*by, "index", tag.alias("tag"), F.sha2(F.concat_ws("\x1f", F.lit(SYSTEM), prompt), 256).alias("key"), F.lit(SYSTEM).alias("system"), prompt.alias("prompt"))


def synthesis_requests(notes: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """All notes of a source in one request."""
    a = F.array_sort(F.collect_list(F.struct("index", "note")))
    g = notes.groupBy(*by).agg(F.array_join(F.transform(a, lambda x: x["note"]), "\n").alias("notes"))
    prompt = F.format_string(SYNTHESIS, F.col("notes"))
    return g.select(*by, F.concat_ws(":", *by, F.lit("all")).alias("tag"), F.sha2(F.concat_ws("\x1f", F.lit(SYSTEM), prompt), 256).alias("key"), F.lit(SYSTEM).alias("system"), prompt.alias("prompt"))


def mechanical_story(beats: DataFrame, runtime: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Beats without the reduce step: spaced out by importance, then clamped."""
    spaced = greedy_spacing(beats, 3.0, by, rank="importance", tie="ord")
    return clamp_beats(spaced, runtime, by, order=("start_s", "ord"))


def beat_lines(beats: DataFrame, cues: DataFrame, limit: int = 40, by: Sequence[str] = BY) -> DataFrame:
    """A beat's header and, below it, its evenly thinned dialogue."""
    from ..operators.intervals import thin_even
    from ..operators.joins import within

    b = beats.select(*by, F.col("i").alias("beat"), "start_s", "end_s", "summary")
    inside = within(cues, b, "start", "start_s", "end_s", by, closed=True)
    inside = thin_even(inside, ["start", "i"], limit, [*by, "beat"])
    line = T.prompt_line(F.col("text"))
    x = inside.withColumn("line", line).filter("line is not null")
    a = F.array_sort(F.collect_list(F.struct("start", "i", F.concat(F.lit("    "), T.cue_line(F.col("start"), F.col("line"))).alias("l"))))
    d = x.groupBy(*by, "beat").agg(F.transform(a, lambda s: s["l"]).alias("lines"))
    head = F.concat(F.lit("["), F.col("beat").cast("string"), F.lit("] "), F.coalesce("summary", F.lit("")))
    return b.join(d, [*by, "beat"], "left").select(*by, "beat", F.array_join(F.concat(F.array(head), F.coalesce("lines", F.array().cast("array<string>"))), "\n").alias("block"))


def recent_lines(segments: DataFrame, n: int = 2, by: Sequence[str] = BY) -> DataFrame:
    """The last ``n`` lines before each line, across acts, as context."""
    w = W.partitionBy(*by).orderBy("i").rowsBetween(-n, -1)
    return segments.withColumn("context", F.collect_list("narration").over(w))


def act_budget(acts: DataFrame, target_words: int = 2200, words_per_segment: int = 26, by: Sequence[str] = BY) -> DataFrame:
    """Words, segments and the cap on segments for each act by its share of the time."""
    share = (F.col("end_s") - F.col("start_s")) / F.sum(F.col("end_s") - F.col("start_s")).over(W.partitionBy(*by))
    words = F.greatest(F.lit(150), F.floor(target_words * share)).cast("int")
    x = acts.withColumn("words", words)
    x = x.withColumn("segments", F.greatest(F.lit(3), F.bround(F.col("words") / words_per_segment).cast("int")))
    return x.withColumn("segment_cap", F.greatest(F.lit(4), F.floor(F.col("segments") * 1.2).cast("int")))


def write_acts(acts: DataFrame, fn, by: str = "source_id") -> DataFrame:
    """Acts written one after the other, each told the last two lines so far: sequential inside a source.

    ``fn(act, recent)`` gives the act's lines, each a text or a mapping with ``narration`` and perhaps ``beat_id``,
    ``line_id`` (the cue that it cites) and ``visual_query`` (the narration if absent). ``acts`` has (source_id, act, ...).
    """
    import pandas as pd

    kind = dict(acts.dtypes)[by]
    cols = [by, "act", "i", "narration", "visual_query", "beat_id", "line_id"]

    def whole(x) -> int | None:
        try:
            return int(x)
        except (TypeError, ValueError):
            return None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for row in pdf.sort_values("act").to_dict("records"):
            for x in fn(row, [o[3] for o in out[-2:]]):
                x = {"narration": x} if isinstance(x, str) else dict(x)
                out.append((row[by], int(row["act"]), len(out), x.get("narration"), x.get("visual_query") or x.get("narration"), whole(x.get("beat_id")), whole(x.get("line_id"))))
        frame = pd.DataFrame(out, columns=cols)
        return frame.astype({"beat_id": "Int32", "line_id": "Int32"})

    return acts.groupBy(by).applyInPandas(run, f"{by} {kind}, act int, i int, narration string, visual_query string, beat_id int, line_id int")
