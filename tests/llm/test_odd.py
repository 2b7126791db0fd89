"""Odd inputs, independence of layout, and models recomputed the plain way."""

import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from strandline.llm import chat, embeddings, langid, lmscore, mixing, neardup, quality, substrings

SF = "/root/testdata/sf0.001"
COLS = "doc_id long, text string, lang string, source string, n_chars long, rep long, row string, id long, h long, key string, copies int, _id long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, docs):
    """NULLs in every column, empty and very long texts, repeated rows and ids, and columns whose names clash."""
    good = [r["text"] for r in docs.filter("lang = 'en' and length(text) between 300 and 1500").orderBy("doc_id").limit(6).collect()]
    long = " ".join(f"{t} {k}" for k in range(40) for t in good[:3])
    base = [
        (1, good[0], "en"), (1, good[0], "en"), (1, good[1], "en"), (None, good[0], "en"), (None, None, None), (2, None, "en"), (3, "", "en"), (4, " \t\n", None),
        (5, long, "en"), (6, long + " tail", None), (7, "12 34 !!", "de"), (8, good[2], "en"), (9, good[2].upper(), "en"), (10, good[3] + " " + good[4], "en"), (None, good[5], None),
    ]
    rows = [(i, t, g, None if k == 11 else f"src{k % 3}", None if k == 10 else len(t or ""), k, "x", k, k, "k", 9, k) for k, (i, t, g) in enumerate(base)]
    return spark.createDataFrame(rows, COLS)


def test_stages_on_odd_rows(spark, odd):
    """Every stage keeps the columns, reads every row for itself, and is the same on any layout."""
    for name, stage in corpus_pipeline.STAGES:
        found = []
        for n in (1, 4):
            out = stage(spark, odd.repartition(n), SF)
            want = odd.columns if name != "mixture" else [c for c in odd.columns if c != "copies"] + ["copies"]
            assert out.columns == want, name
            found.append(sorted(str(r["text"])[:300] + str(r["doc_id"]) + str(r["copies"]) for r in out.collect()))
        assert found[0] == found[1], name
        assert stage(spark, odd.limit(0), SF).count() == 0, name
    kept = Counter(r["doc_id"] for r in corpus_pipeline.language(spark, odd, SF).collect())
    assert kept == Counter([1, 1, 1, None, 5, 6, 8, 9, 10, None])
    kept = Counter((r["doc_id"], r["text"] is None) for r in corpus_pipeline.near_duplicates(spark, odd, SF).collect())
    assert kept[1, False] == 2 and kept[None, False] == 2 and kept[None, True] == 1 and (6, False) not in kept and (9, False) not in kept and len(kept) == 10
    cut = {(r["doc_id"], len(r["text"] or "")): r for r in corpus_pipeline.repeated_passages(spark, odd, SF).collect()}
    assert sum(1 for i, _ in cut if i is None) == 3 and not any(i == 6 and n > 100 for i, n in cut)
    mix = corpus_pipeline.mixture(spark, odd, SF).collect()
    assert all(r["copies"] >= 1 for r in mix) and max(Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in mix).values()) == 1


def test_stages_write(spark, odd, tmp_path):
    """What a stage returns can be written and is the next one's input."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() > 0


def test_clashing_columns(spark):
    """Operators ignore extra columns, whatever their names."""
    vec = spark.createDataFrame([(1, [1.0, 0.0], 5, 6, "h", "v", 7), (2, [1.0, 0.01], 5, 6, "h", "v", 7), (None, None, 1, 1, "", "", 1), (3, [0.0, 0.0], 1, 1, "", "", 1)], "vec_id long, embedding array<double>, id long, m long, h string, v string, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(vec).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), None: (0, None, None), 3: (0, 3, True)}
    text = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3, "x", 4), (2, "a b c d e f", 1, 2, 3, "x", 4)], "doc_id long, text string, rid long, held_out int, tid long, text_hash string, n_shingles int")
    assert [r["component_id"] for r in neardup.near_duplicates(text).collect()] == [1, 1]
    assert substrings.remove_repeats(text).count() == lmscore.score(text, lmscore.Params(steps=2)).count() == quality.classify(text).count() == 2
    turns = spark.createDataFrame([(1, 0, "user", "a", "z", 5)], "conv_id long, turn long, role string, text string, m string, chunk int")
    assert chat.repair(turns).first()["n_out"] == 2


def test_quality_layout(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 500"), spark.read.parquet(f"{sf}/labels.parquet")
    p = quality.Params(sample=200)
    a, b = ({r["doc_id"]: (r["quality"], r["toxic"]) for r in quality.classify(d.repartition(n, "text"), lab.repartition(n), p).collect()} for n in (1, 5))
    assert set(a) == set(b) and all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)


def test_em_plain():
    """Expectation-maximisation over single votes, in plain loops, gives the same posteriors."""
    rng = np.random.default_rng(0)
    truth = rng.random(300) < 0.7
    right = np.array([0.9, 0.8, 0.7, 0.95])
    votes = np.where(rng.random((300, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((300, 4)) < 0.2] = 2
    pats, counts = np.unique(votes, axis=0, return_counts=True)
    post, table = quality.em(pats, counts.astype(float), 15, 0.8)
    soft = {tuple(v): 1 - (0.95 if (v == 0).sum() >= 2 else 0.5 if (v == 0).sum() == 1 else 0.05) for v in pats}
    for _ in range(15):
        weight = defaultdict(float)
        share = sum(soft[tuple(v)] for v in votes) / len(votes)
        for c in (0, 1):
            for j in range(4):
                for x in range(3):
                    weight[c, j, x] = (2.0 if x == c else 1.0) + sum((soft[tuple(v)] if c else 1 - soft[tuple(v)]) for v in votes if v[j] == x)
                total = sum(weight[c, j, x] for x in range(3))
                for x in range(3):
                    weight[c, j, x] /= total
        for v in pats:
            one, zero = share, 1 - share
            for j, x in enumerate(v):
                one, zero = one * weight[1, j, x], zero * weight[0, j, x]
            soft[tuple(v)] = one / (one + zero)
    assert post == pytest.approx([soft[tuple(v)] for v in pats], abs=1e-9)
    guess = {tuple(v): q >= 0.5 for v, q in zip(pats, post, strict=True)}
    assert np.mean([guess[tuple(v)] == t for v, t in zip(votes, truth, strict=True)]) > 0.9


def test_langid_plain(spark, docs):
    """Sets instead of filters: per language the n-grams it has often enough, and the share of a text's n-grams in each."""
    p = langid.Params(positions=1 << 22)
    rows = docs.select("doc_id", "text", "lang").collect()

    def grams(t):
        x = b"\0" + bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in (t or "").lower().encode()) + b"\0"
        return [x[k : k + 4] for k in range(len(x) - 3) if x[k + 1] and x[k + 2]]

    count = defaultdict(Counter)
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % p.folds != p.held:
            count[r["lang"]].update(grams(r["text"]))
    total = {g: max(1, sum(c.values())) for g, c in count.items()}
    rate = {g: {n: k / total[g] for n, k in c.items() if k >= p.count} for g, c in count.items()}
    top = defaultdict(float)
    for c in rate.values():
        for n, x in c.items():
            top[n] = max(top[n], x)
    sets = {g: {n for n, x in c.items() if x >= p.share * top[n]} for g, c in rate.items()}
    got = {r["doc_id"]: r for r in langid.identify(docs, p).collect()}
    for r in rows:
        g = grams(r["text"])
        letters = any(unicodedata.category(c)[0] == "L" for c in r["text"] or "")
        share = {k: sum(n in s for n in g) / max(1, len(g)) for k, s in sets.items()}
        best = max(share.values())
        out = got[r["doc_id"]]
        if not letters:
            assert out["lang_pred"] == "und" and out["score"] == 0
        elif best > 0.05:
            assert share[out["lang_pred"]] >= best - 0.02 and out["score"] == pytest.approx(best, abs=0.02)


def test_mixing_layout(spark, docs):
    few = docs.unionByName(docs.limit(20)).unionByName(docs.limit(5).withColumn("doc_id", docs["doc_id"] * 0))
    a, b = (Counter((r["doc_id"], r["row_hash"], r["copies"]) for r in mixing.choose(few.repartition(n)).collect()) for n in (1, 5))
    assert a == b
    out = mixing.mix(few).collect()
    assert sum(r["copies"] for r in out) == sum(k[2] * n for k, n in a.items())
