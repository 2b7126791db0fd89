"""Brute force, round trips, held-out accuracy and odd inputs for the training-data operators."""

import functools
import itertools
import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from strandline.llm import chat, decontaminate, embeddings, langid, lmscore, mixing, neardup, quality, substrings, warc
from strandline.llm.queries import ORACLES, QUERIES

sys.path.insert(0, "tests")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep long, fp long, part int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    long = " ".join(f"w{i % 700}x{i}" for i in range(30_000))
    base = [(1, "The cat sat on the mat and saw the dog.", "en"), (2, None, "en"), (3, "", None), (4, " \t\n ", "fr"), (5, long, "en"), (6, long + " tail", "en"), (7, "one two", "en"), (8, "ONE two", "en"), (9, "12 34 !!", "de"), (10, "the dog ate the cat", "en"), (10, "the dog ate the cat", "en")]
    rows = [(i, t, g, None if i == 9 else f"src{i % 3}", len(t or ""), i, i, 0) for i, t, g in base]
    return spark.createDataFrame([*rows, (None, "the cat and the dog", "en", "src1", 3, 0, 0, 0)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def near_brute(rows, n=4):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def cut_brute(rows):
    first, out = {}, {}
    words = {i: WORD.findall(t or "") for i, t in sorted(rows)}
    for i, w in words.items():
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def mutated(rng, w, share):
    return [f"z{rng.integers(1000)}" if rng.random() < share else x for x in w]


@pytest.fixture(scope="module")
def copies(spark):
    """Groups of near copies at all distances, chains, exact copies and shared passages."""
    rng = np.random.default_rng(1)
    rows = []
    vocab = [f"v{i}" for i in range(400)]
    passage = list(rng.choice(vocab, 70))
    for g in range(12):
        base = list(rng.choice(vocab, 160))
        for k in range(12):
            w = mutated(rng, base, 0.004 * k)
            if k % 4 == 1:
                at = int(rng.integers(0, len(w)))
                w = w[:at] + passage[int(rng.integers(0, 15)) :] + w[at:]
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, t) for k, (_, t) in enumerate(rows[:20])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_neardup(spark, copies):
    rows, df = copies
    want = near_brute(rows)
    for p in (neardup.Params(words=4), neardup.Params(words=4, block=8, spread=5), neardup.Params(words=4, block_shingles=900)):
        got = neardup.near_duplicates(df, p).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_substrings(spark, copies):
    rows, df = copies
    want = cut_brute(rows)
    for p in (substrings.Params(), substrings.Params(shard_words=300, task_words=2000)):
        got = substrings.remove_repeats(df, p).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want
        assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_automaton_finds_all_substrings():
    rng = np.random.default_rng(0)
    for _ in range(30):
        seqs = [rng.integers(0, 3, rng.integers(5, 40)).tolist() for _ in range(4)]
        auto = substrings.Automaton()
        for k, s in enumerate(seqs):
            auto.add(s, k)
        auto.finish()
        probe = rng.integers(0, 3, 50).tolist()
        got = auto.windows(probe, 4)
        for e in range(50):
            has = [k for k, s in enumerate(seqs) if e >= 3 and any(s[i : i + 4] == probe[e - 3 : e + 1] for i in range(len(s) - 3))]
            assert got[e] == (min(has) if has else 1 << 62)


def test_odd_documents(spark, odd):
    near = {(r["doc_id"], r["n_shingles"]): r for r in neardup.near_duplicates(odd).collect()}
    assert near[2, 0]["kept"] and near[6, 29997]["component_id"] == 5 and near[8, 1]["component_id"] == 7
    cut = {r["doc_id"]: r for r in substrings.remove_repeats(odd).collect()}
    assert (cut[2]["n_words"], cut[5]["n_removed"], cut[6]["kept_text"], cut[10]["n_removed"]) == (0, 0, "tail", 0)
    lang = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert lang[2]["lang_pred"] == lang[9]["lang_pred"] == "und" and lang[1]["lang_pred"] != "und"
    mix = mixing.choose(odd).collect()
    assert len(mix) == odd.count() and sum(r["tokens"] * r["copies"] for r in mix) <= sum(r["tokens"] for r in mix)
    lm = {r["doc_id"]: r for r in lmscore.score(odd, lmscore.Params(steps=5)).collect()}
    assert lm[2]["n_tokens"] == lm[4]["n_tokens"] == 1 and lm[5]["n_tokens"] == 30_001 and lm[1]["score"] < 0
    q = {r["doc_id"]: r for r in quality.classify(odd).collect()}
    assert q[2]["quality"] is None and q[2]["kept"] is False and q[1]["quality"] is not None
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "The cat sat on the mat, and saw the dog!")], "item_id long, text string")
    dec = {r["doc_id"]: r for r in decontaminate.find(odd, bench).collect()}
    assert not dec[1]["kept"] and dec[1]["item_ids"] == [4] and dec[5]["kept"] and dec[2]["kept"]


def test_empty(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert neardup.near_duplicates(none).count() == substrings.remove_repeats(none).count() == langid.identify(none).count() == 0
    assert mixing.choose(none).count() == lmscore.score(none, lmscore.Params(steps=2)).count() == quality.classify(none).count() == 0
    assert decontaminate.find(none, bench).count() == 0
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 16))
    for c in range(4):  # clusters of several sizes, one above a list's length
        n = (3, 8, 40, 90)[c]
        x[c * 100 : c * 100 + n] = x[c * 100] + rng.standard_normal((n, 16)) * 0.12
    x[590:595] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, []), (1004, [1.0, 2.0])]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), embeddings.Params(tile=16)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    assert [got[i]["n_links"] for i in range(600)] == link.sum(axis=1).tolist()
    root = np.arange(600)
    for _ in range(600):
        new = np.minimum(root, np.where(link, root, 600).min(axis=1))
        if (new == root).all():
            break
        root = new
    assert [got[i]["component_id"] for i in range(600)] == root.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(1000, 1005)) and got[594]["component_id"] == 0


def test_embeddings_saturated_groups(spark):
    """Links between two groups whose lists are all filled by their own group."""
    rng = np.random.default_rng(5)
    u, w = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    x = np.concatenate([c + rng.standard_normal((20, 64)) * 0.006 for c in (u, 0.93 * u + np.sqrt(1 - 0.93**2) * w)] + [rng.standard_normal((200, 64))])
    n = np.linalg.norm(x, axis=1)
    link = (x @ x.T) / n[:, None] / n >= 0.9
    np.fill_diagonal(link, False)
    assert link[:20, 20:40].all()
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for tile in (256, 8):
        got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, embeddings.Params(tile=tile)).collect()}
        assert [got[i]["n_links"] for i in range(240)] == link.sum(axis=1).tolist()
        assert all(got[i]["component_id"] == 0 and got[i]["kept"] == (i == 0) for i in range(40))


def test_embeddings_isolated_pairs(spark):
    """Rare pairs near the threshold that a starved candidate search misses are found by the exact comparison."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((6, 32))
    y -= (y * x[:6]).sum(axis=1, keepdims=True) * x[:6]
    x[200:206] = 0.91 * x[:6] + np.sqrt(1 - 0.91**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    p = embeddings.Params(orders=1, block=2, rounds=1, more=0, audit=800, tile=32)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df, p).collect()}
    assert {i for i, n in got.items() if n} == {*range(6), *range(200, 206)}
    assert embeddings.orders_of(1 << 20, p) > embeddings.orders_of(1000, p)


def test_decontaminate_edits(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    item = " ".join(rng.choice(words, 40))
    text = lambda: " ".join(rng.choice(words, 120))
    hurt = list(item)
    for k in range(10, len(hurt), 25):
        hurt[k] = "#"
    rows = [(1, text() + " " + item.upper() + " " + text()), (2, text() + " " + "".join(hurt) + " " + text()), (3, text()), (4, text() + " " + item[: len(item) * 3 // 4]), (5, item[::-1])]
    got = {r["doc_id"]: r["kept"] for r in decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: True}


def edit_brute(item, text):
    """Least edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def contaminated(text, items, p):
    plain = lambda t: re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", (t or "").lower()).strip()
    x, out = plain(text), set()
    for k, t in items:
        t = plain(t)
        if not t:
            continue
        if len(t) < p.q:
            hit = x == t
        elif len(t) < p.least:
            hit = f" {t} " in f" {x} "
        else:
            m = min(len(t), p.width)
            starts = [*range(0, len(t) - m, p.stride), len(t) - m]
            hit = any(edit_brute(t[s : s + m], x) <= min(int(m * p.edits), m // p.q - 1) for s in starts)
        if hit:
            out.add(k)
    return sorted(out)


def test_decontaminate_brute(spark):
    """Whole items, parts, short items and edits at every level against a search without filters, with one and many shards."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(words, n))
    items = [(k, say(n)) for k, n in enumerate((9, 14, 30, 40, 4, 3, 2))] + [(7, "Xy z"), (8, None), (9, "...")]
    rows = []
    for _, t in items[:8]:
        for edits in range(0, 12, 2):
            hurt = list(t)
            for at in rng.choice(len(hurt), min(edits, len(hurt)), replace=False):
                hurt[at] = str(rng.choice(["", "Q", hurt[at] + "qq"]))
            hurt = "".join(hurt)
            lo = int(rng.integers(0, max(1, len(hurt) - 130)))
            rows += [(len(rows), say(12) + ", " + hurt + "! " + say(9)), (len(rows) + 1, say(5) + " " + hurt[lo : lo + 130] + " " + say(5))]
    rows += [(0, "xy  Z"), (0, "a xy z"), (None, items[2][1]), (None, ""), (None, None), (3, say(40)), (3, "é" * 50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for p in (decontaminate.Params(), decontaminate.Params(shard_chars=60)):
        got = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), bench, p, carry=True).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["item_ids"] == contaminated(r["row"]["text"], items, p), r
            assert r["kept"] == (not r["item_ids"]) and r["doc_id"] == r["row"]["doc_id"] and (r["best_edits"] is None) == r["kept"]


def test_langid_held_out(spark, docs):
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


def test_lm_base_and_order(spark, docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    train = {i: t for i, t in rows.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    count = defaultdict(int)
    for t in train.values():
        for w in WORD.findall(lower(t)):
            count[w] += 1
    total, distinct = sum(count.values()) + len(train), len(count) + 1
    for top in (400_000, 50):  # with and without words that are looked up by a join
        got = {r["doc_id"]: r for r in lmscore.score(docs, lmscore.Params(steps=60, top_words=top)).collect()}
        for i, t in rows.items():
            w = WORD.findall(lower(t))
            want = sum(np.log10((count.get(x, 0) + 1) / (total + distinct + 1)) for x in w) + np.log10((len(train) + 1) / (total + distinct + 1))
            assert got[i]["base_score"] == pytest.approx(want, rel=1e-9) and got[i]["train_tokens"] == total
            assert got[i]["n_known"] == sum(x in count for x in w) + 1 and got[i]["n_tokens"] == len(w) + 1


def test_lm_is_a_distribution():
    rng = np.random.default_rng(0)
    p = lmscore.Params(rows=64, classes=4, leaves=4, steps=30, batch=8)
    per = np.full(50, 12)
    ids = rng.integers(0, 99, 600).astype(np.int32)
    ids[11::12] = 100
    m = lmscore.fit(ids, per, np.bincount(ids, minlength=101), 100, p)
    head = ids[:20]
    total = sum(10 ** lmscore.score_ids(np.append(head, y).astype(np.int32), np.array([21]), m)[-1] for y in range(101))
    assert total == pytest.approx(1, abs=1e-4)


def test_lm_full_model():
    """Every id sees at least 16 ids before it, and the 7168 most frequent ids have a row of their own."""
    p = lmscore.Params(steps=2)
    end = 9000
    counts = np.arange(end + 1, 0, -1)
    ids = np.random.default_rng(0).integers(0, end, 4000).astype(np.int32)
    m = lmscore.fit(ids, np.full(40, 100), counts, end, p)
    assert len(np.unique(m.row[:7168])) == 7168 and len(np.unique(m.row)) == 8192
    text = ids[:80]
    base = lmscore.score_ids(text, np.array([80]), m)
    for at in range(16, 80):
        other = text.copy()
        other[at - 16] = (other[at - 16] + 4000) % 7000
        assert lmscore.score_ids(other, np.array([80]), m)[at] != base[at]


def test_lm_against_plain_attention():
    """Every id scored apart from the others, over the whole context that the model gives it, in double precision."""
    rng = np.random.default_rng(1)
    p = lmscore.Params(rows=128, classes=8, leaves=8, steps=40, batch=16)
    end = 200
    per = np.array([1, 5, 16, 17, 40, 33, 100])
    ids = rng.integers(0, end, per.sum()).astype(np.int32)
    ids[np.cumsum(per) - 1] = end
    m = lmscore.fit(ids, per, np.bincount(ids, minlength=end + 1), end, p)
    got = lmscore.score_ids(ids, per, m)
    n, e, at = p.block, m.e.astype(float), 0
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for size in per:
        text = [end, *ids[at : at + size]]  # an end stands before the text
        for k in range(size):
            low = max(0, k // n * n - n)
            x = np.array([e[m.row[i]] for i in text[low : k + 1]])
            far = np.arange(len(x) - 1, -1, -1)
            att = soft((x[-1] @ m.q) @ (x @ m.k).T / np.sqrt(p.dim) + m.near[far])
            h = att @ (x @ m.v) + x[-1]
            y = ids[at + k]
            want = np.log(soft(h @ m.o + m.b)[m.group[y]]) + np.log(soft(h @ m.o2[m.group[y]] + m.b2[m.group[y]])[m.leaf[y]]) + m.cond[y]
            assert got[at + k] == pytest.approx(want / np.log(10), rel=1e-4), (size, k)
        at += size


def test_lm_layout_and_growth(spark, docs):
    """Scores do not hang on the layout of the rows; what is learned from grows with the corpus."""
    few = docs.filter("length(text) < 3000")
    p = lmscore.Params(steps=40, sample_words=2000, refine_percent=60.0, shard_words=150)
    a, b = ({r["doc_id"]: r["score"] for r in lmscore.score(few.repartition(n, "text"), p).collect()} for n in (1, 5))
    assert a == pytest.approx(b, rel=1e-5)
    c = {r["doc_id"]: r["score"] for r in lmscore.score(few, lmscore.Params(steps=40, sample_words=2000, refine_percent=0.001)).collect()}
    assert any(abs(c[i] - a[i]) > 1e-3 * abs(a[i]) for i in a)
    sample = lambda share: lmscore.sampled(few, share, 1).count()
    assert sample(0.2) < sample(0.6) < sample(1.0) == few.select("doc_id").distinct().count()


def test_lm_table():
    rng = np.random.default_rng(0)
    t, h = lmscore.Table(8), np.unique(rng.integers(1, 1 << 63, 150, dtype=np.uint64)) | np.uint64(1)
    h = np.unique(np.concatenate((h, h[:40] & np.uint64(0xFF00000000000001) | np.uint64(3))))
    t.add(h[:100], np.arange(100, dtype=np.int32))
    t.add(h[100:], np.arange(100, len(h), dtype=np.int32))
    assert t.find(h).tolist() == list(range(len(h))) and (t.find(h + np.uint64(1)) == -1).all()


def chat_brute(roles, p):
    """Least cost over all legal outputs, from the rules alone: every source turn goes into some output turn, in order."""
    legal = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    ends = {"": 0, "a": 0, "u": p.insert, "s": 2 * p.insert}

    def open_turn(state, role):
        """Costs of opening a turn of this role: directly, or behind one empty turn."""
        if role in legal[state]:
            yield 0
        for x in legal[state]:
            if x != "s" and role in legal[x]:
                yield p.insert

    @functools.cache
    def least(k, state):
        if k == len(roles):
            return ends[state]
        found = []
        if state:
            found.append(p.merge + (p.relabel if roles[k] != state else 0) + least(k + 1, state))
        for role in "sua":
            for c in open_turn(state, role):
                found.append(c + (p.relabel if roles[k] != role else 0) + least(k + 1, role))
        return min(found)

    return least(0, "")


def test_chat(spark):
    p = chat.Params()
    rng = np.random.default_rng(4)
    names = [None, "system", "user", "assistant", "tool"]
    convs = {c: rng.integers(0, 5, int(rng.integers(1, 30))).tolist() for c in range(40)}
    rows = [(c, k * 1000, names[r], f"t{k}") for c, rs in convs.items() for k, r in enumerate(rs)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {}
    for part, tasks in ((512, 1), (3, 4)):
        got = {r["conv_id"]: r for r in chat.repair(df.repartition(tasks), chat.Params(part=part)).collect()}
        assert set(got) == set(convs)
        for c, rs in convs.items():
            r = got[c]
            assert r["cost"] == chat_brute(tuple("?sua?"[x] for x in rs), p) and r["n_in"] == len(rs)
            turns = re.findall(r"<\|(system|user|assistant)\|>\n(.*?)<\|end\|>\n", r["rendered"], re.S)
            assert re.fullmatch(r"(s)?(ua)+", "".join(x[0][0] for x in turns)) and len(turns) == r["n_out"]
            assert [x for _, t in turns for x in t.split("\n") if x] == [f"t{k}" for k in range(len(rs))]
            assert p.merge * r["merged"] + p.relabel * r["relabelled"] + p.insert * r["inserted"] == r["cost"]
            assert whole.setdefault(c, r["rendered"]) == r["rendered"]


def test_chat_odd(spark):
    """Large ids beside NULL ones, a long conversation, NULL turns, repeated rows, clashing columns."""
    big = 2**60 + 1
    rows = [(big, k, ("user", "assistant")[k % 2], f"x{k}") for k in range(1200)]
    rows += [(None, 0, " User ", "a"), (None, 0, " User ", "a"), (None, None, "assistant", None), (7, 5, None, ""), (8, None, None, None)]
    df = spark.createDataFrame([(*r, 1, 1, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, r long, task int, key string, n long")
    got = {r["conv_id"]: r for r in chat.repair(df).collect()}
    assert set(got) == {big, None, 7, 8} and got[big]["n_in"] == 1200 and got[big]["cost"] == 0 and got[None]["n_in"] == 3
    assert got[big]["rendered"] == "".join(f"<|{('user', 'assistant')[k % 2]}|>\nx{k}<|end|>\n" for k in range(1200))
    assert got[8]["cost"] == chat_brute(("?",), chat.Params())
    text = chat.repair(spark.createDataFrame([("b", 1, "user", "hi"), (None, 1, "user", "yo")], "conv_id string, turn long, role string, text string")).collect()
    assert {(r["conv_id"], r["n_out"]) for r in text} == {("b", 2), (None, 2)}


def test_warc(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    extra = spark.createDataFrame([(10**6, "u\r\nX: y", None), (10**6 + 1, None, ""), (10**6 + 2, "u", "a" * 5000), (10**6 + 3, "u", "a" * 5000), (10**6 + 4, "u", "b" * 999), (10**6 + 5, "u", "b" * 999), (None, "u", "a" * 5000)], "page_id long, url string, html string")
    both = pages.select("page_id", "url", "html").union(extra)
    got = {r["page_id"]: r for r in warc.round_trip(both, warc.Params(archive_bytes=20_000)).collect()}
    html = {r["page_id"]: (r["html"] or "").encode() for r in both.collect()}
    assert set(got) == set(html)
    for i, r in got.items():
        same = [j for j, h in html.items() if h == html[i] and len(h) >= 1000]
        top = max((j for j in same if j is not None), default=i)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if top == i else ("revisit", top))
        assert r["payload"] == (html[i] if top == i else None) and r["payload_bytes"] == len(html[i])


def test_warc_odd(spark):
    """NULL ids with equal payloads, repeated rows, clashing columns."""
    rows = [(None, "u", "c" * 2000), (None, "v", "c" * 2000), (1, "u", "d" * 2000), (1, "u", "d" * 2000), (None, "u", "d" * 2000), (None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1, b"") for r in rows], "page_id long, url string, html string, d string, n long, payload binary")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(df).collect()), key=str)
    assert got == sorted([(None, "response", None, 2000)] * 2 + [(1, "response", None, 2000)] * 2 + [(None, "revisit", 1, 2000), (None, "response", None, 0)], key=str)


def test_repeated_ids(spark):
    """Several texts or vectors under one id, NULL ids, repeated rows."""
    rng = np.random.default_rng(9)
    say = lambda n: " ".join(f"q{x}" for x in rng.integers(0, 10**6, n))
    a, b, c = say(120), say(3), say(300)
    rows = [(1, a), (2, b), (2, "x " + a[: len(a) // 2] + " " + c), (2, c), (2, c), (3, c + " tail"), (None, a), (None, a), (3, a + " " + say(70))]
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), carry=True).collect())
    half = len(a[: len(a) // 2].split())
    want = [(-1, 120, 0), (-1, 120, 0), (1, 120, 0), (2, 3, 0), (2, 300, 0), (2, 300, 0), (2, 1 + half + 300, half - 1 if a[len(a) // 2] != " " and a[len(a) // 2 - 1] != " " else half), (3, 301, 300), (3, 190, 120)]
    assert got == sorted(want)
    x = rng.standard_normal((40, 24))
    x[7] = x[3] + 0.01
    vec = [(i, x[i].tolist()) for i in range(10)] + [(1, x[20].tolist()), (5, (x[20] + 0.01).tolist()), (1, x[1].tolist()), (8, (x[2] + 0.01).tolist()), (None, x[2].tolist())]
    df = spark.createDataFrame([(*r, 1, 1, "h") for r in vec], "vec_id long, embedding array<double>, id long, m long, h string")
    out = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()]
    assert len(out) == len(vec)
    want = [(i, 0, i, True) for i in (0, 4, 6, 9)] + [(5, 0, 5, True), (5, 1, 1, False), (1, 0, 1, True), (1, 0, 1, True), (1, 1, 1, True), (3, 1, 3, True), (7, 1, 3, False), (2, 1, 2, True), (8, 1, 2, False), (8, 0, 8, True), (None, 0, None, None)]
    assert sorted(out, key=str) == sorted(want, key=str)


def test_warc_rejects_damage():
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(warc.encode_record(1, "u", b"x" * 100, "response", None))
    good = warc.dictionary_frame(b"") + frame
    assert [r["page_id"] for r in warc.read_archive(good)] == [1]
    wrong = zstandard.ZstdCompressor().compress(warc.encode_record(1, "u", b"x", "response", None).replace(b"Content-Length: 1", b"Content-Length: 2"))
    for bad in (good[:-3], good[8:], b"", good + b"junk", warc.dictionary_frame(b"") + wrong):
        with pytest.raises(warc.FormatError):
            list(warc.read_archive(bad))


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(d, lab).select("doc_id", "kept").join(lab, "doc_id").collect()
    clean = [r["kept"] for r in got if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["kept"] for r in got if r["quality"] == 0 or r["toxic"] == 1]
    assert np.mean(clean) >= 0.95 and np.mean(bad) <= 0.15


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    from oracle import compare, duck

    assert compare(duck(SF), QUERIES[name](spark, SF), ORACLES[name]) == ""


def test_pipeline(spark):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    near = near_brute([(i, r["text"]) for i, r in rows.items()], 5)
    kept = {i: rows[i]["text"] for i, (_, c) in near.items() if c == i}
    cut = cut_brute(list(kept.items()))
    texts = {i: (t if cut[i][1] == 0 else cut[i][2]) for i, t in kept.items()}
    bench = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in got:
        assert r["copies"] >= 1 and r["text"] == texts[r["doc_id"]]
        assert not any(b in " ".join(re.findall(r"\w+", r["text"].lower())) for b in bench)
    assert len(got) > 0.2 * len(kept)


def test_lm_learns_from_all_training_texts(spark, docs, monkeypatch):
    """Classes come from the neighbours in all training texts, and the weights from every window of them, once each."""
    from pyspark.sql import functions as F

    from strandline.llm._store import Store
    from strandline.llm._text import Words

    p = lmscore.Params()
    few = docs.filter("length(text) < 3000").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert lmscore.dealt(few, p.refine_percent / 100, 1).count() == few.count()
    ranks = lmscore.load_ranks(p.tokenizer)
    tokens, end = lmscore.Tokens(ranks), max(ranks.values()) + 1
    want, counts, per = np.zeros((p.rows, lmscore.NEAR), np.int64), np.zeros(end + 1, np.int64), []
    ids = []
    for r in few.collect():
        b = np.frombuffer(r["text"].encode(), np.uint8)
        ids.append(lmscore.sequences_of(Words(b, np.array([0, len(b)]), 0, 1), tokens)[0])
        counts += np.bincount(ids[-1], minlength=end + 1)
    row = lmscore.rows_of(counts, p)
    for x in ids:
        for a, b in zip([end, *x[:-1].tolist()], x.tolist(), strict=True):
            want[row[b], a % 256] += 1
            want[row[a], 256 + b % 256] += 1
    for n in (1, 3):
        counted = lmscore.counts_of(few.repartition(n, "doc_id"), spark.sparkContext.broadcast(ranks), Store(spark))
        assert (lmscore.near_of(counted, row, p) == want.ravel()).all()
    seen = []
    monkeypatch.setattr(lmscore, "gradients", lambda w, m, ids, start, *rest: seen.extend(start.tolist()) or len(start))
    per = np.array([len(x) for x in ids])
    m = lmscore.layout_of(row, want.ravel(), counts, end, p)
    n = int((-(-per // p.block)).sum())
    lmscore.train(lmscore.first_weights(m, p), m, np.concatenate(ids), per, p, -(-n // p.refine_batch), p.refine_rate, p.refine_batch)
    assert sorted(seen) == sorted(lmscore.windows(per, p.block)[0].tolist())


def test_lm_gradients():
    """Against differences of the loss that the scorer gives."""
    rng = np.random.default_rng(1)
    p, end = lmscore.Params(rows=128, classes=8, leaves=8), 200
    per = np.array([1, 5, 16, 17, 40, 33, 100])
    ids = rng.integers(0, end, per.sum()).astype(np.int32)
    ids[np.cumsum(per) - 1] = end
    counts = np.bincount(ids, minlength=end + 1)
    row, (who, column) = lmscore.rows_of(counts, p), lmscore.neighbours(ids, end)
    m = lmscore.layout_of(row, np.bincount(row[who] * lmscore.NEAR + column, minlength=p.rows * lmscore.NEAR), counts, end, p)
    w = lmscore.train(lmscore.first_weights(m, p), m, ids, per, p, 30, 0.01, 16)
    w = {k: x.astype(float) for k, x in w.items()}
    g = {k: np.zeros_like(x) for k, x in w.items()}
    assert lmscore.gradients(w, m, (m.row[ids], m.group[ids], m.leaf[ids]), *lmscore.windows(per, p.block), g) == len(ids)
    for k in w:
        by = rng.standard_normal(w[k].shape) * (np.abs(w[k]) < 1e8)
        lose = lambda s, k=k, by=by: (lmscore.score_ids(ids, per, lmscore.model_of(w | {k: w[k] + s * by}, m, p)) * np.log(10)).sum()
        assert (lose(-1e-3) - lose(1e-3)) / 2e-3 == pytest.approx((g[k] * by).sum(), rel=1e-2, abs=1e-2), k


def test_lm_words_are_cut_together():
    """All new words of a run in one call of the vocabulary, with the ids that each word has alone."""
    import tiktoken

    from strandline.llm._text import Words

    ranks = lmscore.load_ranks(lmscore.Params().tokenizer)
    alone = tiktoken.Encoding("alone", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = ["Ein Wort, zwei  Wörter\nund\tnoch\r\x0beins", "", "日本語 x\u0085y   a\x00b é 😀", "q" * 3000, " ", "ein Wort"]
    raw = [t.encode() for t in texts] + [b"cut \xe4\xb8 off \xff", b"\xe4\xb8"]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    tokens, calls = lmscore.Tokens(ranks), []
    encode = tokens.encode
    tokens.encode = lambda text: calls.append(text) or encode(text)
    ids, per, _ = lmscore.sequences_of(Words(data, offsets, 0, len(raw)), tokens)
    want = [[i for w in b.lower().split() for i in alone(" " + w.decode("utf-8", "replace"))] + [tokens.end] for b in raw]
    assert ids.tolist() == [i for t in want for i in t] and per.tolist() == [len(t) for t in want]
    assert len(calls) == 1
