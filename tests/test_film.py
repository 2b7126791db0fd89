import json
import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from strandline.plans import film
from strandline.plans.memo import Memo, Producer

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test module


@pytest.fixture(scope="module")
def given(spark):
    stamp = lambda t: f"00:{t // 60:02d}:{t % 60:02d},000"
    srt = "\n\n".join(f"{k}\n{stamp(t)} --> {stamp(t + 2)}\nline {k}" for k, t in enumerate(range(30, 570, 6)))
    log = "\n".join(f"pts_time:{t}\nlavfi.scd.score={12 if t % 10 else 3}" for t in range(5, 600, 5))
    two = lambda x: spark.createDataFrame([("a", x), ("b", x)], "source_id string, content string")
    return two(srt), two(log), spark.createDataFrame([("a", 600.0), ("b", 600.0)], "source_id string, duration double"), two


def answer(system, prompt):
    times = [int(t) for t in re.findall(r"^\[(\d+)\]", prompt, re.M)]
    beats = [{"start_s": t, "end_s": t + 20, "summary": "x", "kind": "", "importance": 4} for t in times[::4]]
    return "so: " + json.dumps({"beats": beats, "twists": [{"at_s": 250, "what": "y", "severity": 9}, {"at_s": 9000, "what": "z"}]})


def plain(act, recent):
    return [f"act {act['act']}: {n}" for n in range(4)]


def test_chain(spark, tmp_path, given):
    srt, log, sources, two = given
    memo = Memo(spark, str(tmp_path))
    go = lambda srt=srt, write=Producer("1", plain), **k: film.run(memo, srt, log, sources, Producer("1", answer), write, Producer("1", lambda t: 5.0), **k)
    got = go()
    assert {n: (o.state, o.why) for n, o in got.items()} == {n: ("made", None) for n in got}
    edl = got["select"].table.orderBy("source_id", "i").collect()
    assert {r["source_id"] for r in edl} == {"a", "b"} and all(r["clips"] for r in edl)
    a, b = ([r for r in edl if r["source_id"] == s] for s in "ab")
    assert len(a) == 12 and [r["clips"] for r in a] == [r["clips"] for r in b]
    assert all(x["story_time"] <= y["story_time"] for x, y in zip(a, a[1:], strict=False))
    assert all(0 <= c["src_start"] < c["src_end"] <= 600 for r in edl for c in r["clips"])
    again = go(anew=["select"])
    assert [o.state for o in again.values()] == ["reused"] * 8 + ["made"]
    # other rows or another version of a producer make anew what hangs on them, and only that
    other = go(srt=two(srt.first()["content"].replace("line", "word")))
    assert {n for n, o in other.items() if o.state == "reused"} == {"scenemap"}
    assert other["ingest"].table.first()["text"].startswith("word")
    rewritten = go(write=Producer("2", lambda act, recent: ["only"]))
    assert {n for n, o in rewritten.items() if o.state == "made"} == {"script", "narrate", "select"}


def test_chain_by_meaning(spark, tmp_path, given):
    """Beats and cues that lines name, ceilings before the twist, and shots that look like the query."""
    srt, log, sources, _ = given

    def write(act, recent):
        first = (act["act"] - 1) * 8
        return [{"narration": f"n{k}", "beat_id": first + k, "line_id": (first + k) * 4 + 1, "visual_query": f"q{k % 2}"} for k in range(3)] + [{"narration": "lost", "beat_id": 999, "line_id": 0}]

    embed = Producer("1", lambda texts: np.array([[1.0, 0.0] if t == "q0" else [0.0, 1.0] for t in texts]))
    frames = spark.createDataFrame([(s, i, [1.0, 0.0] if i % 2 else [0.0, 1.0], 100.0) for s in "ab" for i in range(200)], "source_id string, i int, embedding array<float>, luma double")
    got = film.run(Memo(spark, str(tmp_path)), srt, log, sources, Producer("1", answer), Producer("1", write), Producer("1", lambda t: 5.0), embed, frames)
    assert all(o.state == "made" for o in got.values()), [o.why for o in got.values()]
    assert {(r["at_s"], r["severity"]) for r in got["twists"].table.collect()} == {(250.0, 5)}
    lines = got["script"].table.filter("source_id = 'a'").orderBy("i").collect()
    beats = {r["i"]: r for r in got["story"].table.filter("source_id = 'a'").collect()}
    assert [r["unresolved"] for r in lines] == [False, False, False, True] * 3
    for r in lines[:3]:
        b = beats[r["beat_id"]]
        assert r["anchored"] and b["start_s"] < r["story_time"] <= b["end_s"] + 1 and r["beat_id"] == r["i"]
    for r in lines:
        t = r["story_time"]
        want = min(600.0, t + 180.0)
        assert r["spoiler_ceiling"] == pytest.approx(max(t, min(want, max(t, 248.0))) if t < 250 else want)
    edl = got["select"].table.collect()
    assert any(c["similarity"] == 1.0 for r in edl for c in r["clips"]) and not any(r["weak"] for r in edl)
