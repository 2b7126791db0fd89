"""Golden cases and properties of the timeline operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import math as M
from strandline.functions import text as T
from strandline.functions.hashing import fingerprint, sample_offsets
from strandline.operators import intervals as G
from strandline.operators import joins as J
from strandline.operators.selection import Rules, select_clips
from strandline.plans.memo import Memo, Stage, address_of, digest, run_graph
from strandline.sources.scenelog import parse_scene_log
from strandline.sources.subtitles import parse_subtitles


def one(spark, col, value="x"):
    return spark.createDataFrame([(value,)], "x string").select(col.alias("y")).first()["y"]


def test_subtitles(spark):
    text = (
        "1\n00:00:01,000 --> 00:00:02,500\n<i>Hello</i>\\Nworld\n\n00:00:03,2 --> 00:00:04,000\nHello world\n\n"
        "3\n00:00:05,000 --> 00:00:06,000\n♪ ♪\n\n4\r\n00:00:10,000 --> 00:00:10,000\r\nStop\r\n"
    )
    got = parse_subtitles(spark.createDataFrame([(1, text)], "source_id int, content string")).orderBy("start").collect()
    assert [(r["start"], r["end"], r["text"]) for r in got] == [(1.0, 4.0, "Hello world"), (10.0, 11.0, "Stop")]


def test_shots_golden(spark):
    cuts = spark.createDataFrame([(1, t) for t in (0.3, 5.0, 5.4, 47.5)], "source_id int, t double")
    src = spark.createDataFrame([(1, 50.0)], "source_id int, duration double")
    got = G.build_shots(cuts, src).orderBy("i").collect()
    assert [round(r["start"], 3) for r in got] == [0, 5.4, 19.433, 33.467, 47.5]
    assert [r["split"] for r in got] == [False, True, True, True, False]
    assert [r["tail"] for r in got] == [False] * 4 + [True]


@pytest.mark.parametrize("seed", range(3))
def test_shots_tile_and_match_fold(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for s in range(30):
        d = rng.uniform(5, 80)
        cuts = sorted({round(rng.uniform(0, d), 2) for _ in range(rng.randint(0, 40))} - {0.0})
        rows += [(s, d, t) for t in cuts] or [(s, d, -1.0)]
        spans, merged = list(zip([0.0, *cuts], [*cuts, d], strict=True)), []
        for a, b in spans:
            if b - a < 1.0 and merged:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        if len(merged) > 1 and merged[0][1] - merged[0][0] < 1.0:
            head = merged.pop(0)
            merged[0][0] = head[0]
        want[s] = [tuple(x) for x in merged]
    df = spark.createDataFrame(rows, "source_id int, duration double, t double")
    got = G.build_shots(df.select("source_id", "t"), df.select("source_id", "duration").distinct(), 1.0, 1e9).orderBy("source_id", "i").collect()
    out = {}
    for r in got:
        out.setdefault(r["source_id"], []).append((r["start"], r["end"]))
    assert out == want


def test_regions_chunks_thinning(spark):
    src = spark.createDataFrame([(1, 42.0)], "source_id int, duration double")
    a = spark.createDataFrame([(1, t) for t in (10.0, 12.0, 40.0)], "source_id int, t double")
    assert [(r["start"], r["end"]) for r in G.anchor_regions(a, src, 5.0).orderBy("start").collect()] == [(5, 17), (35, 42)]
    cues = spark.createDataFrame([(1, float(t)) for t in (10, 610, 640, 650, 1250)], "source_id int, start double")
    w = G.chunk_windows(cues, spark.createDataFrame([(1, 1300.0)], "source_id int, duration double")).collect()
    by = {}
    for r in w:
        by.setdefault(r["index"], []).append(r["start"])
    assert {k: sorted(v) for k, v in by.items()} == {0: [10, 610, 640], 1: [610, 640, 650], 2: [1250]}
    five = spark.createDataFrame([(1, i) for i in range(5)], "source_id int, i int")
    assert sorted(r["i"] for r in G.thin_even(five, ["i"], 3).collect()) == [0, 1, 3]
    beats = spark.createDataFrame([(1, i, s, 3) for i, s in enumerate((0.0, 2.0, 3.5, 5.0, 6.4))], "source_id int, i int, start double, importance int")
    assert sorted(r["start"] for r in G.greedy_spacing(beats).collect()) == [0.0, 3.5]


def test_placement_and_ceiling(spark):
    x = spark.createDataFrame([(1, i, s) for i, s in enumerate((2.0, 3.0, 0.0, 1.5))], "source_id int, k int, seconds double")
    assert [round(r["start"], 2) for r in G.place_cumulative(x, ["k"]).orderBy("i").collect()] == [0, 2.35, 5.7]
    seg = spark.createDataFrame([(1, t) for t in (50.0, 99.5, 100.0, 350.0)], "source_id int, t double")
    tw = spark.createDataFrame([(1, 100.0), (1, 300.0)], "source_id int, at double")
    c = M.spoiler_ceiling(F.col("t"), F.col("next._rt"), F.lit(400.0), 180.0)
    assert [r["c"] for r in J.asof_next(seg, tw, "t", "at").withColumn("c", c).orderBy("t").collect()] == [98.0, 99.5, 280.0, 400.0]


def test_scene_log(spark):
    log = "pts_time:1\npts_time:2\nlavfi.scd.score=9\nlavfi.scd.score=8\npts_time:3\nlavfi.scd.time=4.5\nlavfi.scd.score=7\npts_time:6"
    got = parse_scene_log(spark.createDataFrame([(1, log)], "source_id int, content string")).orderBy("t").collect()
    assert [(r["t"], r["score"]) for r in got] == [(2.0, 9.0), (4.5, float("inf"))]


def test_scalars(spark):
    x = F.col("x")
    assert one(spark, T.clean_narration(x), "a — b[x]*") == "a, bx"
    assert one(spark, T.timestamp_srt(F.lit(3661.9996))) == "01:01:02,000"
    assert one(spark, T.word_count(x), "") == 0
    assert one(spark, F.to_json(T.extract_json(x)), 'text {"a":1} more') == '{"a":1}'
    assert one(spark, T.extract_json(x).isNull(), "[1]")
    assert one(spark, M.fraction(x), "24000/1001") == pytest.approx(23.976, abs=1e-3)
    assert one(spark, M.fraction(x), "1/0") is None
    assert [one(spark, M.band_score(F.lit(v), 1.5, 4.0)) for v in (0.0, 0.75, 2.0, 8.0)] == [0, 0.5, 1, 0.5]
    exact, ask = M.quantise(F.lit(3.2), F.lit(24.0))
    assert one(spark, exact) == pytest.approx(77 / 24) and one(spark, ask) == pytest.approx(77.5 / 24)


def test_keys():
    assert address_of("a", {"y": 1, "x": 2}) == address_of("a", {"x": 2, "y": 1}) != address_of("a", {"x": 1, "y": 2})
    assert len(sample_offsets(10)) == 1 and len(sample_offsets(100 << 20)) == 3
    assert fingerprint(3, [b"abc"]) != fingerprint(4, [b"abc"])


@pytest.mark.parametrize("mode", ["traverse", "continuous", "montage"])
def test_selection_properties(spark, mode):
    shots = spark.createDataFrame([(1, i, i * 5.0, i * 5.0 + 5.0, 100.0) for i in range(40)], "source_id int, i int, start double, end double, luma double")
    rows = [(1, i, i, 6.0, i * 20.0 + 5, 150.0, i * 20.0, i * 20.0 + 20, 200.0, 0.0, 200.0) for i in range(6)]
    lines = spark.createDataFrame(rows, "source_id int, i int, script_i int, seconds double, story_time double, ceiling double, win_start double, win_end double, runtime_s double, content_low double, content_high double")
    got = select_clips(lines, shots, Rules(mode=mode)).orderBy("i").collect()
    assert len(got) == 6
    for k, r in enumerate(got):
        need = 6.0 + (0.35 if k < 5 else 0)
        assert sum(c["duration"] for c in r["clips"]) == pytest.approx(need, abs=0.05)
        assert all(0 <= c["src_start"] < c["src_end"] <= 200.0 for c in r["clips"])
        if mode == "traverse":
            assert all(a["src_end"] <= b["src_start"] + 0.1 for a, b in zip(r["clips"], r["clips"][1:], strict=False))


def test_memo(spark, tmp_path):
    memo = Memo(spark, str(tmp_path))
    stages = [Stage("a", 1, [], lambda: spark.range(3)), Stage("b", 1, ["a"], lambda a: a.filter("id > 0")), Stage("c", 1, ["b"], lambda b: 1 / 0), Stage("d", 1, ["c"], lambda c: c)]
    first = run_graph(memo, stages)
    assert [first[n].state for n in "abcd"] == ["made", "made", "broken", "blocked"]
    again = run_graph(memo, stages[:2], anew=["b"])
    assert [again[n].state for n in "ab"] == ["reused", "made"] and again["b"].table.count() == 2
    changed = run_graph(memo, [stages[0]._replace(settings={"x": 1}), stages[1]])
    assert [changed[n].state for n in "ab"] == ["made", "made"] and changed["b"].address != first["b"].address
    assert [r["state"] for r in memo.journal().collect()][:4] == ["made", "made", "broken", "blocked"]
    with pytest.raises(ValueError):
        run_graph(memo, stages, anew=["nope"])
    x = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    assert digest(x) == digest(x.orderBy("a", ascending=False).repartition(3)) != digest(x.na.fill("c"))


def test_streaming_matches_batch(spark, tmp_path):
    from strandline.streaming.sessions import window_counts

    src = str(tmp_path / "in")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    ev.write.parquet(src)
    q = window_counts(spark.readStream.schema(ev.schema).parquet(src), "1 day").writeStream.outputMode("complete").format("memory").queryName("wc").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from wc").first()[0] == ev.count()


def test_choices():
    from strandline.plans.choose import by_will, first_working

    assert first_working([0, 0, 2], lambda x: 1 / x) == (2, [(0, "ZeroDivisionError: division by zero")] * 2)
    with pytest.raises(RuntimeError):
        first_working([0], lambda x: 1 / x)
    known = {"a": lambda: False, "b": lambda: True}
    assert (by_will(known, " A "), by_will(known, None, "\ufeffa\n"), by_will(known, None, "gone")) == ("a", "a", "b")
    with pytest.raises(ValueError):
        by_will(known, "c")


def test_npy_round_trip(spark, tmp_path):
    from strandline.sources.matrices import read_npy, write_npy

    rows = [(s, k, [float(k), len(s) / 2]) for s in ("a", "bb") for k in range(5)]
    df = spark.createDataFrame(rows, "source_id string, row int, embedding array<float>")
    assert sorted(r["rows"] for r in write_npy(df, f"file://{tmp_path}/m").collect()) == [5, 5]
    assert sorted(tuple(r) for r in read_npy(spark, f"file://{tmp_path}/m").collect()) == sorted(rows)
    assert np.load(tmp_path / "m" / "bb.npy").dtype == np.float32


def test_range_joins_against_loops(spark):
    from strandline.operators.joins import overlap_semi, within

    rng = np.random.default_rng(3)
    spans = [(s, k, float(a), float(a + d)) for s in "ab" for k, (a, d) in enumerate(zip(rng.integers(0, 200, 40), rng.integers(0, 30, 40), strict=True))]
    a = spark.createDataFrame(spans, "source_id string, i int, start double, end double")
    b = spark.createDataFrame([(s, x, x + 3.0) for s, _, x, _ in spans[::7]] + [("c", 0.0, 900.0)], "source_id string, start double, end double")
    regions = b.collect()
    want = {(s, k) for s, k, x, y in spans if any(r["source_id"] == s and x < r["end"] and y > r["start"] for r in regions)}
    assert {(r["source_id"], r["i"]) for r in overlap_semi(a, b).collect()} == want
    points = [(s, float(t)) for s in "ab" for t in range(0, 220, 3)]
    p = spark.createDataFrame(points, "source_id string, t double")
    for closed in (False, True):
        want = sorted((s, t, k) for s, t in points for s2, k, x, y in spans if s == s2 and x <= t and (t < y or (closed and t == y)))
        assert sorted((r["source_id"], r["t"], r["i"]) for r in within(p, a, "t", "start", "end", closed=closed).collect()) == want


def test_story_stats_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    import duckdb

    from strandline.catalog import ORACLES, QUERIES

    # 64 values with a mean of 3.7109375: in the table's order their sum of doubles is just below the tie, reversed it is not
    cents = np.random.default_rng(0).permutation([491, 206, 479, 351, 269, 238, 456, 391, 493, 359, 423, 457, 382, 470, 365, 200, 263, 426, 430, 379, 356, 476, 404, 373, 492, 452, 257, 393, 395, 304, 485, 201, 342, 461, 301, 436, 464, 409, 356, 287, 430, 471, 301, 384, 469, 201, 399, 496, 418, 407, 372, 499, 234, 452, 326, 348, 210, 408, 279, 403, 338, 291, 237, 205])
    rows = [(0, int(k), int(c) / 100) for k, c in enumerate(cents)] + [(1, k, 1.0) for k in range(64, 68)] + [(1, 68, None)]
    con, got = duckdb.connect(), []
    con.execute("SET threads = 1")
    for k, order in enumerate((rows, rows[::-1], sorted(rows, key=lambda r: (r[2] is None, r[2])))):
        sf = tmp_path / str(k)
        sf.mkdir()
        con.execute("CREATE OR REPLACE TABLE events (user_id BIGINT, event_id BIGINT, ts TIMESTAMP, event_type VARCHAR, value DOUBLE)")
        con.executemany("INSERT INTO events VALUES (?, ?, TIMESTAMP '2024-01-02', 'view', ?)", order)
        con.execute(f"COPY events TO '{sf}/events.parquet' (FORMAT parquet)")
        if k == 0:
            want = sorted(con.execute(ORACLES["story_stats"]).fetchall())
        got.append(sorted(tuple(r) for r in QUERIES["story_stats"](spark, str(sf)).collect()))
    assert got == [want] * 3
