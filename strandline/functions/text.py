"""String, regex and JSON column functions.

Everything here is a JVM-side expression. ``\\s`` is always written ``(?U)\\s``,
because Java's plain ``\\s`` does not match U+00A0 or U+2003.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define what counts as markup, music or a time range.
OVERRIDE = r"\{[^}]*\}"
BREAK = r"\\[Nnh]"
TAG = r"</?[a-zA-Z][^>]*>"
MUSIC_ONLY = "^(?U)[\\s♪♫♬♩~#*_\\-]*$"
TIME_RANGE = r"(\d{1,3}):(\d{2}):(\d{2})[,.](\d{1,3})\s*-->\s*(\d{1,3}):(\d{2}):(\d{2})[,.](\d{1,3})"
TITLE_HINTS = ("commentary", "director", "cast", "lyrics", "song", "karaoke", "signs", "forced", "descriptive", "description")
LEGACY_VOICE = "kokoro:"


def squeeze(c: Column) -> Column:
    """Collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """Strip subtitle markup. Override blocks go first: drawing commands may hold angle brackets."""
    c = F.regexp_replace(c, OVERRIDE, "")
    c = F.regexp_replace(c, BREAK, " ")
    c = F.regexp_replace(c, TAG, "")
    return squeeze(F.translate(c, "​﻿", ""))


def is_music_only(c: Column) -> Column:
    return c.rlike(MUSIC_ONLY)


def clean_narration(c: Column) -> Column:
    """Speakable text: dashes become commas, brackets and markup characters go. NULL gives ''."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s*[—–]\\s*", ", ")
    return squeeze(F.translate(c, "[]{}<>*_#`|", ""))


def safe_name(c: Column, fallback: str = "untitled") -> Column:
    """A file-system safe name of at most 90 characters."""
    kept = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9 ._-]", ""))
    kept = F.btrim(kept, F.lit("."))
    kept = F.substring(F.regexp_replace(kept, r"\s+", " "), 1, 90)
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(fallback))


def word_count(c: Column) -> Column:
    """Words between white space; NULL and '' have none."""
    return F.coalesce(F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")), F.lit(0))


def title_penalty(c: Column) -> Column:
    return F.when(F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(TITLE_HINTS)), -80).otherwise(0)


def voice_name(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(c), f"^{LEGACY_VOICE}", ""), F.lit("")), F.lit(default))


def cue_line(start: Column, text: Column) -> Column:
    """``[12] text`` with whole seconds."""
    return F.concat(F.lit("["), F.floor(start).cast("bigint").cast("string"), F.lit("] "), text)


def prompt_line(c: Column, width: int = 70) -> Column:
    """Squeezed and cut to ``width``; NULL when nothing is left."""
    return F.nullif(F.substring(squeeze(c), 1, width), F.lit(""))


def format_cast(cast: Column, limit: int = 12) -> Column:
    """``- name (role): description`` for the first ``limit`` named entries of an array of structs."""
    named = F.filter(F.slice(cast, 1, limit), lambda p: F.coalesce(p["name"], F.lit("")) != "")
    lines = F.transform(
        named,
        lambda p: F.concat(
            F.lit("- "), p["name"], F.lit(" ("), F.coalesce(p["role"], F.lit("")), F.lit("): "), F.coalesce(p["description"], F.lit(""))
        ),
    )
    return F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit("(no cast given)"))


def time_to_seconds(h: Column, m: Column, s: Column, frac: Column) -> Column:
    """The fraction is padded on the right: "5" is 500 ms."""
    whole = h.cast("bigint") * 3600 + m.cast("bigint") * 60 + s.cast("bigint")
    return whole + F.rpad(frac, 3, "0").cast("bigint") / F.lit(1000.0)


def time_range(c: Column) -> tuple[Column, Column]:
    """(start, end) seconds of the first ``-->`` range in ``c``; NULL when there is none."""
    g = [F.regexp_extract(c, TIME_RANGE, i) for i in range(1, 9)]
    found = c.rlike(TIME_RANGE)
    return F.when(found, time_to_seconds(*g[:4])), F.when(found, time_to_seconds(*g[4:]))


def timestamp_srt(seconds: Column) -> Column:
    """``HH:MM:SS,mmm`` from total milliseconds, so that rounding carries into the seconds."""
    ms = F.floor(F.greatest(seconds, F.lit(0.0)) * 1000 + 0.5).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    )


def format_hms(seconds: Column) -> Column:
    """``H:MM:SS`` or ``M:SS``; negative counts as 0."""
    s = F.floor(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0))).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def keyframe_name(mid: Column) -> Column:
    return F.format_string("kf_%09d.jpg", F.bround(mid * 1000).cast("bigint"))


def extract_json(c: Column) -> Column:
    """The JSON object in a model's reply as VARIANT: the whole text, the text inside a fence,
    or what lies between the outermost braces. NULL when none of them is an object."""
    fenced = F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)

    def obj(x: Column) -> Column:
        v = F.try_parse_json(x)
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)

    return F.coalesce(obj(c), obj(fenced), obj(braces))


def token_total(usage: Column) -> Column:
    """``total_tokens`` of a MAP<STRING,DOUBLE>, else the sum of its token counters."""
    counters = F.map_values(F.map_filter(usage, lambda k, _: k.contains("token")))
    return F.coalesce(F.try_element_at(usage, F.lit("total_tokens")), F.aggregate(counters, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))))


def concat_path(path: Column) -> Column:
    """A path quoted for a concat list."""
    return F.concat(F.lit("'"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def fit_filter(mode: Column, size: int = 224) -> Column:
    """The frame filter that crops to a square or, in any other mode, pads to one. The filter's words."""
    box = f"{size}:{size}"
    crop, pad = (f"scale={box}:force_original_aspect_ratio={how},{last}" for how, last in (("increase", f"crop={box}"), ("decrease", f"pad={box}:(ow-iw)/2:(oh-ih)/2:black")))
    return F.when(mode == "crop", crop).otherwise(pad)
