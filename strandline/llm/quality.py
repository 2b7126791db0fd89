"""Quality and toxicity by a weak-label model.

Heuristic labellers vote on each document (good, bad, or no opinion) from a few counts over its text. They overlap
and err, so expectation-maximisation on the patterns of votes estimates how often each labeller speaks and is right,
without any true label, and gives the posterior of each pattern. The posteriors are the labels of a hashed linear
scorer (logistic, on presence of hashed words and on shape features), which then judges every document by its
whole text, also those on which the labellers are silent.

There are two tasks, each with its own labellers and its own scorer: quality and toxicity. Words that mark toxic texts
are a seed list and words that occur, in a bounded set of labelled documents, in toxic ones and in hardly any other. Each
such word is in two of several lists; a list votes toxic on a text with a word of its own and clean on one of some length
without any. What is returned is the scorer's word alone.

Vote patterns are counted by a distributed sum; there are at most 3^labellers of them. The scorer's weights are
learned on a bounded sample (``sample`` documents), chosen and ordered by a hash of doc_id and text, so results do not
hang on how rows are laid out; votes and patterns cover all documents.

Defined results: a NULL or word-less text gets no opinion and NULL scores and is not kept; repeated documents are
judged alike; a NULL doc_id is judged like any other; extra columns are ignored; without labels toxicity has only
the seed words; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Store, lean
from ._text import U, Words, buffers, mix, runs, sequences, to_list

# Seed words of the lexicon: common English insults.
INSULTS = ("idiot", "moron", "scum", "loser", "stupid", "pathetic", "worthless", "disgusting", "trash", "clown")


@dataclass(frozen=True)
class Params:
    """``labelled``: documents with labels at most that toxic words are induced from; ``sample`` documents at most that
    the scorer learns from; ``buckets`` of hashed words and word beginnings (``stem`` bytes); ``lists``: labellers that share
    the toxic words; ``enough`` words for a vote that a text is clean."""

    labelled: int = 20_000
    sample: int = 20_000
    buckets: int = 1 << 18
    lists: int = 4
    stem: int = 6
    enough: int = 8
    least_docs: int = 4
    purity: float = 0.92
    em_rounds: int = 60
    epochs: int = 10
    seed: int = 11
    keep_quality: float = 0.5
    drop_toxic: float = 0.5


FEATURES = ("symbols", "upper", "word_length", "pipes", "repeats", "marked", "adjacent")


def features(w: Words, h: np.ndarray) -> np.ndarray:
    """Shape of each text: share of symbols, of capitals, mean word length, share of bars, share of repeated
    trigrams, share of words with a symbol at the end, and share of words that repeat the one before."""
    n = w.n
    out = np.zeros((n, len(FEATURES)))
    if not len(w.start):
        return out
    c = w.data
    sym = ((c >= 0x21) & (c <= 0x2F) & (c != 0x2C) & (c != 0x2E)) | ((c >= 0x3A) & (c <= 0x40)) | ((c >= 0x5B) & (c <= 0x60)) | ((c >= 0x7B) & (c <= 0x7E))
    up = (c >= 0x41) & (c <= 0x5A)
    alpha = up | ((c >= 0x61) & (c <= 0x7A)) | (c >= 0x80)
    total = lambda m: np.concatenate(([0], np.cumsum(m)))
    first, last = w.first[:-1], w.first[1:]
    words = last - first
    some = np.flatnonzero(words)
    lo, hi = w.start[first[some]], w.end[last[some] - 1]
    span = lambda m: (lambda t: t[hi] - t[lo])(total(m))
    letters = np.maximum(1, span(alpha))
    out[some, 0] = span(sym) / np.maximum(1, hi - lo)
    out[some, 1] = span(up) / letters
    out[some, 2] = np.add.reduceat(w.end - w.start, first[some]) / words[some]
    out[some, 3] = span(c == 0x7C) / words[some]
    ends = sym[w.end - 1]
    out[some, 5] = np.add.reduceat(ends.astype(np.int64), first[some]) / words[some]
    again = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    out[:, 6] = np.bincount(w.row[1:], again, n)[:n] / np.maximum(1, words)
    tri = sequences(h, 3)
    if len(tri):
        ok = w.row[: len(tri)] == w.row[2:]
        r = w.row[: len(tri)][ok]
        order = np.lexsort((tri[ok], r))
        t, rr = tri[ok][order], r[order]
        same = np.concatenate(([False], (t[1:] == t[:-1]) & (rr[1:] == rr[:-1])))
        out[:, 4] = np.bincount(rr, same, n)[:n] / np.maximum(1, words - 2)
    return out


def bucket_of(h: np.ndarray, p: Params) -> np.ndarray:
    return (mix(h) & U(p.buckets - 1)).astype(np.int64)


def presence(w: Words, h: list[np.ndarray], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of one or more hashes per word, in order of rows."""
    row = w.row.astype(np.int64) << 32
    pair = np.unique(np.concatenate([row | bucket_of(x, p) for x in h]))
    return pair >> 32, pair & ((1 << 32) - 1)


_TRIM = np.ones(256, bool)
_TRIM[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = False


def bare(w: Words) -> Words:
    """The words without ASCII punctuation at their edges; what is inside becomes a blank."""
    data = np.where(_TRIM[w.data], w.data, 0x20)
    # punctuation becomes a blank inside the same word: the hash is over the letters that stay, in order
    x = Words.__new__(Words)
    x.data, x.start, x.end, x.row, x.first, x.n = data, w.start, w.end, w.row, w.first, w.n
    # leading and trailing punctuation moves the edges; punctuation inside stays a blank and keeps words apart
    keep = np.concatenate(([0], np.cumsum(_TRIM[w.data])))
    lead = np.searchsorted(keep, keep[w.start] + 1, side="left") - 1
    tail = np.searchsorted(keep, keep[w.end], side="left")
    x.start = np.minimum(np.maximum(w.start, lead), w.end)
    x.end = np.maximum(x.start, np.minimum(w.end, tail))
    return x


def word_hashes(w: Words, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each bare word in lower case and of its beginning."""
    if not len(w.start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    x = bare(w)
    whole = x.hashes(lower=True)
    x.end = np.minimum(x.end, x.start + p.stem)
    return whole, mix(x.hashes(lower=True) + U(1))


def toxic_words(docs: DataFrame, labels: DataFrame | None, p: Params) -> np.ndarray:
    """Hashes of words that mark toxic documents among a bounded set of labelled ones."""
    fixed = Words(np.frombuffer(" ".join(INSULTS).encode(), np.uint8), np.array([0, len(" ".join(INSULTS).encode())]), 0, 1).hashes(lower=True)
    if labels is None:
        return fixed
    lab = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lab = lab.orderBy(F.xxhash64("doc_id", F.lit(p.seed))).limit(p.labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column("text"))
            tox = b.column("toxic").to_numpy()
            for i, j in runs(off):
                w = Words(data, off, i, j)
                pair = np.unique(np.stack([w.row.astype(np.uint64), word_hashes(w, p)[0]]), axis=1) if len(w.start) else np.zeros((2, 0), np.uint64)
                t = tox[i + pair[0].astype(np.int64)] if pair.shape[1] else np.zeros(0, np.int32)
                u, inv = np.unique(pair[1], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(inv, t == 1, len(u)).astype(np.int64)), pa.array(np.bincount(inv, minlength=len(u)))], names=["h", "bad", "n"])

    c = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").mapInArrow(lean(run), "h long, bad long, n long")
    c = c.groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).filter((F.col("bad") >= p.least_docs) & (F.col("bad") >= p.purity * F.col("n")))
    got = c.select("h").toArrow().column("h").to_numpy().view(np.uint64)  # at most the words of the bounded labelled set
    return np.unique(np.concatenate((fixed, got)))


def quality_votes(f: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Votes of the quality labellers: 1 good, 0 bad, 2 no opinion."""
    rules = (("symbols", 0.02, 0.06), ("upper", 0.12, 0.45), ("word_length", 7.0, 9.5), ("pipes", 0.01, 0.15), ("repeats", 0.08, 0.25), ("marked", 0.04, 0.25), ("adjacent", 0.004, 0.04))
    v = np.full((len(f), len(rules)), 2, np.int64)
    for k, (name, good, bad) in enumerate(rules):
        x = f[:, FEATURES.index(name)]
        v[x <= good, k] = 1
        v[x >= bad, k] = 0
    v[~has] = 2
    return v


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of the positive class per pattern, accuracy table): two classes, votes independent given the class.

    Rare votes start as the weightier ones (``prior`` says which class is common), so the classes keep their meaning.
    """
    n, m = patterns.shape
    common = 1 if prior >= 0.5 else 0
    against = (patterns == 1 - common).sum(axis=1)
    rare = np.where(against >= 2, 0.95, np.where(against == 1, 0.5, 0.05))
    post = 1 - rare if common else rare
    table = np.zeros((2, m, 3))
    for _ in range(rounds):
        pi = np.clip((counts * post).sum() / max(counts.sum(), 1), 1e-3, 1 - 1e-3)
        for c, q in ((1, post), (0, 1 - post)):
            for v in range(3):
                table[c, :, v] = ((counts * q)[:, None] * (patterns == v)).sum(axis=0) + (2.0 if v == c else 1.0)
            table[c] /= table[c].sum(axis=1, keepdims=True)
        log = np.log(table)
        at = np.arange(m)
        one, zero = log[1, at, patterns].sum(axis=1) + np.log(pi), log[0, at, patterns].sum(axis=1) + np.log(1 - pi)
        post = 1 / (1 + np.exp(np.clip(zero - one, -50, 50)))
    return post, table


def learn(rows: list[np.ndarray], shape: np.ndarray, y: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, np.ndarray]:
    """Logistic weights for hashed words and scaled shape features, by gradient steps on soft labels."""
    mean, std = shape.mean(axis=0), shape.std(axis=0) + 1e-6
    z = (shape - mean) / std
    w, u, b = np.zeros(p.buckets), np.zeros(shape.shape[1]), 0.0
    gw = np.full(p.buckets, 1e-2)
    rng = np.random.default_rng(p.seed)
    size = np.array([len(r) for r in rows])
    for _ in range(p.epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            idx = np.concatenate([rows[k] for k in part]) if len(part) else np.zeros(0, np.int64)
            own = np.repeat(np.arange(len(part)), size[part])
            s = np.bincount(own, w[idx], len(part)) + z[part] @ u + b
            g = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[part]
            at, inv = np.unique(idx, return_inverse=True)
            d = np.bincount(inv, g[own], len(at)) + 1e-4 * w[at]
            gw[at] += d * d
            w[at] -= 0.1 * d / np.sqrt(gw[at])
            u -= 0.02 * (g @ z[part]) / max(1, len(part)) * 8
            b -= 0.02 * g.mean() * 8
    return w.astype(np.float32), u, b, mean, std


def classify(docs: DataFrame, labels: DataFrame | None = None, p: Params = Params()) -> DataFrame:
    """One row per document: doc_id, quality, toxic (scores 0 to 1), kept, and the labellers' posteriors."""
    spark = Store(docs.sparkSession).spark
    bad_words = spark.sparkContext.broadcast(toxic_words(docs, labels, p))
    lists = p.lists + 1

    def votes_of(w: Words, h: np.ndarray, hb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = features(w, h)
        size = np.diff(w.first)
        has = size > 0
        q = quality_votes(f, has)
        bad = bad_words.value
        at = np.minimum(np.searchsorted(bad, hb), len(bad) - 1)
        hit = np.flatnonzero(bad[at] == hb)
        t = np.where(size >= p.enough, 0, 2)[:, None].repeat(lists, axis=1)
        row, k = w.row[hit], mix(hb[hit])
        for which in (k % U(p.lists), (k // U(p.lists) + k // U(64)) % U(p.lists)):  # a word is in two lists, or twice in one
            t[row, which.astype(np.int64)] = 1
        # the last one goes by density and has an opinion on every text
        dense = np.bincount(row, minlength=w.n)[: w.n] / np.maximum(1, size)
        t[:, -1] = np.where(dense >= 0.01, 1, np.where(dense == 0, 0, 2))
        t[~has] = 2
        return f, q, t

    def pattern(v: np.ndarray) -> np.ndarray:
        return (v * 3 ** np.arange(v.shape[1])).sum(axis=1)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column("text"))
            for i, j in runs(off):
                w = Words(data, off, i, j)
                _, q, t = votes_of(w, w.hashes(lower=True), word_hashes(w, p)[0])
                for kind, v in ((0, q), (1, t)):
                    u, n = np.unique(pattern(v), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u), pa.array(n)], names=["task", "pattern", "n"])

    found = docs.select("text").mapInArrow(lean(vote), "task int, pattern long, n long").groupBy("task", "pattern").agg(F.sum("n").alias("n")).collect()  # at most 3^7 + 3^5 rows
    posts = []
    for kind, m, prior in ((0, len(FEATURES), 0.8), (1, lists, 0.1)):
        rows = [(r["pattern"], r["n"]) for r in found if r["task"] == kind]
        codes = np.array([c for c, _ in rows], np.int64)
        votes = (codes[:, None] // 3 ** np.arange(m)) % 3
        post, _ = em(votes, np.array([n for _, n in rows], float), p.em_rounds, prior) if rows else (np.zeros(0), None)
        table = np.full(3**m, prior)
        table[codes] = post
        posts.append(table)
    total = sum(r["n"] for r in found if r["task"] == 0)
    share = min(1.0, p.sample / max(1, total))
    chosen = docs.select(F.xxhash64("doc_id", "text", F.lit(p.seed)).alias("id"), "text")
    chosen = chosen.filter(F.pmod("id", F.lit(1 << 40)) < int(share * (1 << 40)) + 1).dropDuplicates(["id"])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column("text"))
            for i, j in runs(off):
                w = Words(data, off, i, j)
                hb = word_hashes(w, p)
                f, q, t = votes_of(w, w.hashes(lower=True), hb[0])
                r, k = presence(w, hb, p)
                size = np.bincount(r, minlength=w.n)[: w.n]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), to_list(k.astype(np.int32), size, pa.int32()), to_list(f.ravel(), np.full(w.n, f.shape[1]), pa.float64()), pa.array(posts[0][pattern(q)]), pa.array(posts[1][pattern(t)])], names=["id", "k", "f", "q", "t"])

    got = chosen.mapInArrow(lean(sample), "id long, k array<int>, f array<double>, q double, t double").toArrow().sort_by("id")
    if got.num_rows:
        ks = got.column("k").combine_chunks()
        off, flat = ks.offsets.to_numpy(), ks.values.to_numpy().astype(np.int64)
        rows = [flat[off[i] : off[i + 1]] for i in range(len(ks))]
        shape = got.column("f").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        models = [learn(rows, shape, got.column(c).to_numpy(), p) for c in ("q", "t")]
    else:
        models = [(np.zeros(p.buckets, np.float32), np.zeros(len(FEATURES)), 0.0, np.zeros(len(FEATURES)), np.ones(len(FEATURES)))] * 2
    shared = spark.sparkContext.broadcast((models, posts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, posts = shared.value
        for b in batches:
            data, off = buffers(b.column("text"))
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, j in runs(off):
                w = Words(data, off, i, j)
                hb = word_hashes(w, p)
                f, q, t = votes_of(w, w.hashes(lower=True), hb[0])
                r, k = presence(w, hb, p)
                for c, (wt, u, bias, mean, std) in enumerate(models):
                    s = np.bincount(r, wt[k], w.n)[: w.n] + ((f - mean) / std) @ u + bias
                    cols[c].append(1 / (1 + np.exp(-np.clip(s, -30, 30))))
                cols[2].append(posts[0][pattern(q)])
                cols[3].append(posts[1][pattern(t)])
                cols[4].append(np.diff(w.first) > 0)
            cat = [np.concatenate(x) if x else np.zeros(0) for x in cols]
            none = ~cat[4].astype(bool)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, mask=none) for x in cat[:4])], names=["doc_id", "quality", "toxic", "quality_posterior", "toxic_posterior"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = x.mapInArrow(lean(run), "doc_id long, quality double, toxic double, quality_posterior double, toxic_posterior double")
    kept = F.coalesce((F.col("quality") >= p.keep_quality) & (F.col("toxic") < p.drop_toxic), F.lit(False))
    return out.select("doc_id", "quality", "toxic", kept.alias("kept"), "quality_posterior", "toxic_posterior")
