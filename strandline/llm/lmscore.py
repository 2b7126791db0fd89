"""Scoring texts with a small causal self-attention model over subword ids.

Words (ASCII letters in lower case) are cut into ids by a public byte-pair vocabulary, each word with a blank
before it; a text is the ids of its words and one end. From at most 32 ids before, one attention head with a learned
bias per distance (in numpy) predicts a class, then a leaf within the class; the id within its leaf goes by how
often it occurs. Each part is a proper distribution, so the score is a log probability over the whole vocabulary. Texts are cut
into overlapping windows of 32 ids; each window scores its last 16 ids, so every id is scored once with 16 to 32
ids of context, and windows go through masked attention in batches.

What is learned comes from all training texts: counts of words, of ids and of their neighbours, which make the classes
(distributed sums), and the weights. For these each shard of about ``shard_words`` words goes in a task of its own through
every window of its texts, and the mean of all shards is the model. Only where the shards start from is trained on the
driver, on a bounded sample of whole training texts. Shards, samples and their order go by a hash of doc_id and text, so
scores do not hang on how the rows are laid out.

The base score needs the count of every word. The most frequent words, at most ``top_words``, go to every task; what
a text holds beyond them is summed up by a join with the full counts.

Defined results: a NULL text is empty and scores its end only; a NULL doc_id is scored and not learned from;
repeated rows are scored one by one, count each in all counts, and train the weights once; without training texts all ids are equally likely; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Store, lean
from ._text import U, Words, buffers, mix, runs, signed, to_list

_DOWN = np.arange(256, dtype=np.uint8)
_DOWN[0x41:0x5B] = np.arange(0x61, 0x7B)


@dataclass(frozen=True)
class Params:
    """``tokenizer``: file of base64 pieces and ranks; ``folds``/``held``: crc32(doc_id) mod folds = held is not learned
    from; ``top_words`` that are broadcast; ``sample_words`` of the sample that the start is trained on, about, with its ``steps``
    of ``batch`` windows; ``refine_percent`` of all training texts train the weights, in shards of ``shard_words`` and steps of
    ``refine_batch`` windows; model sizes."""

    tokenizer: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    folds: int = 7
    held: int = 2
    top_words: int = 1_000_000
    sample_words: int = 600_000
    refine_percent: float = 100.0
    shard_words: int = 2_400_000
    rows: int = 8192
    dim: int = 16
    classes: int = 64
    leaves: int = 64
    block: int = 16
    steps: int = 3000
    batch: int = 128
    rate: float = 0.01
    refine_batch: int = 1024
    refine_rate: float = 0.002
    seed: int = 5


# ---------------------------------------------------------------- subword ids


def load_ranks(path: str) -> dict[bytes, int]:
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no vocabulary at {path}: set Params.tokenizer to a file of base64 pieces and ranks")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Table:
    """Numbers of 64-bit hashes by open addressing, a whole array at a time."""

    def __init__(self, bits: int):
        self.key, self.val = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it has none."""
        at = (h >> self.shift).astype(np.int64)
        got = self.key[at]
        out = np.where(got == h, self.val[at], np.int32(-1))
        todo = np.flatnonzero((got != h) & (got != 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            got = self.key[at]
            same = got == h[todo]
            out[todo[same]] = self.val[at[same]]
            on = ~same & (got != 0)
            todo, at = todo[on], at[on]
        return out

    def add(self, h: np.ndarray, val: np.ndarray) -> None:
        """Distinct hashes that have no number yet."""
        at, todo = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = np.flatnonzero(self.key[at] == 0)
            self.key[at[free]] = h[todo[free]]  # of several for one place the last one has it
            placed = np.zeros(len(todo), bool)
            placed[free] = self.key[at[free]] == h[todo[free]]
            self.val[at[placed]] = val[todo[placed]]
            todo, at = todo[~placed], (at[~placed] + 1) & self.mask


def grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate((x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)))


class Tokens:
    """Ids of words, remembered by the word's hash; the memory is emptied when it is full. With ``price``, which gives two
    arrays for new hashes (known, log probability), these are remembered too."""

    def __init__(self, ranks: dict[bytes, int], price=None, most: int = 600_000):
        import tiktoken

        self.encode = tiktoken.Encoding("words", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.line = ranks[b"\n"]
        self.end = max(ranks.values()) + 1
        self.most, self.price = most, price
        self.clear()

    def clear(self) -> None:
        self.table, self.n, self.used = Table(21), 0, 0
        self.flat, self.start, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.hash, self.has, self.log = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, bool), np.zeros(1 << 16)

    def lookup(self, hashes: np.ndarray, first: np.ndarray, w: Words) -> np.ndarray:
        """Index of each distinct word (``first``: a place where it occurs)."""
        if self.n + len(hashes) > self.most:  # a run of texts has fewer words than the table has places
            self.clear()
        if len(hashes) > 1 << 20:
            self.table = Table(int(2 * len(hashes)).bit_length())
        out = self.table.find(hashes)
        new = np.flatnonzero(out < 0)
        if len(new):
            flat, size = self.cut(w, first[new])
            a, z = self.n, self.n + len(new)
            self.start, self.size, self.hash, self.has, self.log = (grown(x, z) for x in (self.start, self.size, self.hash, self.has, self.log))
            self.flat = grown(self.flat, self.used + len(flat))
            self.flat[self.used : self.used + len(flat)] = flat
            self.start[a:z] = self.used + np.cumsum(size) - size
            self.size[a:z] = size
            self.hash[a:z] = hashes[new]
            if self.price:
                self.has[a:z], self.log[a:z] = self.price(hashes[new])
            out[new] = np.arange(a, z)
            self.table.add(hashes[new], out[new])
            self.used += len(flat)
            self.n = z
        return out

    def cut(self, w: Words, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these words one after the other, number of ids of each). They are cut in one call, a line each: no word
        holds the end of a line, so its id stands between words only."""
        start, n = w.start[place], w.end[place] - w.start[place]
        each = np.arange(int(n.sum()))
        lines = np.full(len(each) + 2 * len(n), 0x0A, np.uint8)
        lines[np.cumsum(n + 2) - n - 2] = 0x20
        lines[each + np.repeat(2 * np.arange(len(n)) + 1, n)] = _DOWN[w.data[each + np.repeat(start - np.cumsum(n) + n, n)]]
        ids = self.encode(lines.tobytes().decode("utf-8", "replace"))
        ids = np.fromiter(ids, np.int32, len(ids))
        ends = np.flatnonzero(ids == self.line)
        return np.delete(ids, ends), np.diff(ends, prepend=-1).astype(np.int32) - 1

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these words one after the other, number of ids of each)."""
        size = self.size[at].astype(np.int64)
        total = np.cumsum(size)
        return self.flat[np.repeat(self.start[at] - total + size, size) + np.arange(int(total[-1]) if len(at) else 0)], size


def distinct(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, a place of each, word -> distinct); 0, which a table cannot hold, becomes 1."""
    inv, u = pd.factorize(np.maximum(w.hashes(lower=True), U(1)))  # by hashing; a sort would cost several times as much
    first = np.empty(len(u), np.int64)
    first[inv[::-1]] = np.arange(len(inv) - 1, -1, -1)
    return u, first, inv


def sequences_of(w: Words, tokens: Tokens, words: tuple | None = None) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(ids with an end after each text, number of ids of each text, (distinct hashes, word -> distinct, word -> index))."""
    u, first, inv = words or distinct(w)
    at = tokens.lookup(u, first, w)[inv] if len(u) else np.zeros(0, np.int64)
    flat, size = tokens.ids_of(at)
    total = np.concatenate(([0], np.cumsum(size)))
    per = total[w.first[1:]] - total[w.first[:-1]] + 1
    out = np.full(len(flat) + w.n, tokens.end, np.int32)
    out[np.arange(len(flat)) + np.repeat(w.row, size)] = flat  # one end was put in after each text before
    return out, per, (u, inv, at)


NEAR = 512  # columns of neighbours: 256 for what stands before an id, 256 for what stands after it


def neighbours(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, column) of each id's neighbours in texts that lie one after the other, each with its end; an end stands before
    each text as well, and so before the first."""
    before = np.concatenate((np.full(1, end, ids.dtype), ids[:-1]))
    return np.concatenate((ids, before)), np.concatenate((before & 255, 256 + (ids & 255)))


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    """Weights; ``row`` of each id's embedding, its ``group`` (class) and ``leaf``, ``cond``: log of its share in the leaf."""

    row: np.ndarray
    group: np.ndarray
    leaf: np.ndarray
    cond: np.ndarray
    e: np.ndarray
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    o: np.ndarray
    b: np.ndarray
    o2: np.ndarray
    b2: np.ndarray
    near: np.ndarray
    end: int
    block: int


def windows(per: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first scored id, how many are scored, how many come before it in its text) of each window."""
    n = -(-per // block)
    text = np.repeat(np.arange(len(per)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = np.concatenate(([0], np.cumsum(per)))[:-1][text] + k * block
    return start, np.minimum(block, per[text] - k * block), k * block


def log_pick(h: np.ndarray, o: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log of the softmax of ``h @ o`` at ``y``, row by row."""
    for shifted in (False, True):  # logits are seldom so large that exp needs the usual shift by their maximum
        z = h @ o
        if shifted:
            z -= z.max(axis=1, keepdims=True)
        picked = z.ravel().take(np.arange(0, z.size, z.shape[1]) + y).astype(np.float64)
        with np.errstate(over="ignore"):
            total = np.exp(z, out=z) @ np.ones(z.shape[1], np.float32)  # a product sums rows faster than sum does
        if total.size == 0 or (total.min() > 1e-30 and total.max() < 1e37):
            break
    return picked - np.log(total)


def score_ids(ids: np.ndarray, per: np.ndarray, m: Model) -> np.ndarray:
    """log10 probability of each id, in batches of windows."""
    out = np.zeros(len(ids))
    start, count, before = windows(per, m.block)
    n, d = m.block, m.e.shape[1]
    # a last column of ones in the values sums up the weights of attention, and becomes the constant that biases go with
    one = np.ones((len(m.e), 1), np.float32)
    tq, tk, tv, te = (m.e @ m.q) * np.float32(d**-0.5), m.e @ m.k, np.concatenate((m.e @ m.v, one), axis=1), np.concatenate((m.e, 0 * one), axis=1)
    dist = np.arange(n)[:, None] + n - np.arange(2 * n)[None, :]  # how far back each input lies
    bias = np.where(dist >= 0, m.near[np.clip(dist, 0, 2 * n - 1)], np.float32(-1e9)).astype(np.float32)
    o1 = np.concatenate((m.o, m.b[None, :]))
    o2 = np.concatenate((m.o2, m.b2[:, None, :]), axis=1)
    rows, groups = m.row.take(ids), m.group.take(ids).astype(np.int8 if len(m.b) < 128 else np.int32)
    first_row, leaves = m.row[m.end], m.leaf.take(ids)
    inputs, targets = np.arange(-n - 1, n - 1), np.arange(n)
    near, wide, tall = 1024, 8192, 4096  # windows at a time in attention and in all, rows at a time in a softmax
    for a in range(0, len(start), wide):
        s = slice(a, a + wide)
        place = (start[s][:, None] + targets).ravel()
        h = np.empty((len(place), d + 1), np.float32)
        for x in range(a, min(a + wide, len(start)), near):
            t = slice(x, x + near)
            r = rows.take(start[t][:, None] + inputs, mode="clip")
            head = np.flatnonzero(before[t] == 0)  # a text's first window: nothing stands before its beginning
            r[head, : n + 1] = first_row
            r[before[t] == n, 0] = first_row
            rq = r[:, n:]
            queries, keys, values = tq.take(rq, axis=0), tk.take(r, axis=0).transpose(0, 2, 1), tv.take(r, axis=0)
            for shifted in (False, True):
                att = np.matmul(queries, keys)
                att += bias
                att[head, :, :n] = -1e9
                if shifted:
                    att -= att.max(axis=2, keepdims=True)
                with np.errstate(over="ignore"):
                    got = np.matmul(np.exp(att, out=att), values)
                total = got[:, :, d:]
                if total.min() > 1e-30 and total.max() < 1e37:
                    break
            got /= total.copy()
            got += te.take(rq, axis=0)
            h[(x - a) * n : (x - a) * n + got.shape[0] * n] = got.reshape(-1, d + 1)
        if int(count[s].min()) < n:
            live = np.flatnonzero((targets < count[s][:, None]).ravel())
            place, h = place[live], h[live]
        order = np.argsort(groups[place], kind="stable")
        place, h = place[order], h[order]
        group, leaf = groups[place], leaves[place]
        got = np.empty(len(place))
        for x in range(0, len(place), tall):
            got[x : x + tall] = log_pick(h[x : x + tall], o1, group[x : x + tall])
        edge = np.searchsorted(group, np.arange(len(m.b) + 1))
        for c in np.flatnonzero(np.diff(edge)).tolist():  # leaves of one class at a time
            for x in range(edge[c], edge[c + 1], tall):
                z = min(x + tall, edge[c + 1])
                got[x:z] += log_pick(h[x:z], o2[c], leaf[x:z])
        out[place] = got
    out += m.cond.take(ids)
    return out / np.log(10)


@dataclass
class Layout:
    """What ids stand for: ``row`` of the embedding, class, leaf and log share in it; which leaves and classes are empty."""

    row: np.ndarray
    group: np.ndarray
    leaf: np.ndarray
    cond: np.ndarray
    used: np.ndarray
    end: int


def rows_of(id_counts: np.ndarray, p: Params) -> np.ndarray:
    """The embedding's row of each id: frequent ids have one of their own, the others share an eighth."""
    order = np.argsort(-id_counts, kind="stable")
    rare = max(1, p.rows // 8)
    row = np.empty(len(id_counts), np.int32)
    row[order] = np.minimum(np.arange(len(row)), p.rows)
    lows = row >= p.rows - rare
    row[lows] = p.rows - rare + np.arange(len(row))[lows] % rare
    return row


def layout_of(row: np.ndarray, near: np.ndarray, id_counts: np.ndarray, end: int, p: Params) -> Layout:
    """Classes from ``near``, the counts of neighbours by row and column; shares within classes from the counts of ids."""
    rng = np.random.default_rng(p.seed)
    near = near.reshape(p.rows, NEAR).astype(np.float32)
    mass = near.sum(axis=1)
    prof = np.sqrt(near / np.maximum(mass, 1)[:, None])
    basis, _ = np.linalg.qr((prof * np.sqrt(mass)[:, None]).T @ ((prof * np.sqrt(mass)[:, None]) @ rng.standard_normal((512, 32)).astype(np.float32)))
    low = prof @ basis.astype(np.float32)
    seeds = np.argsort(-mass)[: p.classes * 4]
    centre = low[rng.choice(seeds, p.classes, replace=False)] if len(seeds) >= p.classes else rng.standard_normal((p.classes, 32)).astype(np.float32)
    label = np.zeros(p.rows, np.int64)
    for _ in range(12):
        label = ((low**2).sum(axis=1)[:, None] - 2 * low @ centre.T + (centre**2).sum(axis=1)).argmin(axis=1)
        weight = np.bincount(label, mass + 1e-3, p.classes)
        for j in range(low.shape[1]):
            centre[:, j] = np.bincount(label, low[:, j] * (mass + 1e-3), p.classes) / np.maximum(weight, 1e-9)
    # within a class the frequent rows have a leaf each, the others share
    by = np.lexsort((-mass, label))
    rank = np.empty(p.rows, np.int64)
    rank[by] = np.arange(p.rows) - np.searchsorted(label[by], label[by])
    own = p.leaves * 3 // 4
    rank = np.where(rank < own, rank, own + (rank - own) % (p.leaves - own))
    group, leaf = label[row].astype(np.int32), rank[row].astype(np.int32)
    both = group.astype(np.int64) * p.leaves + leaf
    inside = np.bincount(both, id_counts + 1.0, p.classes * p.leaves)
    cond = np.log((id_counts + 1.0) / inside[both])
    used = np.bincount(both, minlength=p.classes * p.leaves).reshape(p.classes, p.leaves) > 0
    return Layout(row, group, leaf, cond, used, end)


def first_weights(m: Layout, p: Params) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    d, n = p.dim, p.block
    w = {
        "e": rng.standard_normal((p.rows, d)) * 0.1, "q": rng.standard_normal((d, d)) * d**-0.5, "k": rng.standard_normal((d, d)) * d**-0.5,
        "v": rng.standard_normal((d, d)) * d**-0.5, "o": rng.standard_normal((d, p.classes)) * 0.1, "b": np.zeros(p.classes), "near": -0.05 * np.arange(2 * n),
        "o2": rng.standard_normal((p.classes, d, p.leaves)) * 0.1, "b2": np.zeros((p.classes, p.leaves)),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    return shut(w, m)


def shut(w: dict[str, np.ndarray], m: Layout) -> dict[str, np.ndarray]:
    """Classes and leaves without ids must not take any probability."""
    w["b"][~m.used.any(axis=1)] = -1e9
    w["b2"][~m.used] = -1e9
    return w


SOME, TALL = 1024, 2048  # windows, and rows of a softmax, at a time in training


def exps(logits, sums) -> tuple[np.ndarray, np.ndarray]:
    """(exp of what ``logits`` gives, what ``sums`` makes of it, with the sum of each row last); large values are seldom, and
    only then shifted by the row's maximum."""
    for shifted in (False, True):
        z = logits()
        if shifted:
            z -= z.max(axis=-1, keepdims=True)
        np.exp(z, out=z)
        got = sums(z)
        total = got[..., -1]
        if total.size == 0 or (total.min() > 1e-30 and total.max() < 1e37):
            break
    return z, got


def gradients(w: dict[str, np.ndarray], m: Layout, seen: tuple, start: np.ndarray, count: np.ndarray, before: np.ndarray, g: dict[str, np.ndarray]) -> int:
    """Add to ``g`` the gradients of the summed loss over these windows; how many ids they predict.

    ``seen``: row, class and leaf of each id of the texts. A softmax is not divided by its sums: what it is multiplied with
    is, which has fewer columns.
    """
    n, d, kind = len(w["near"]) // 2, w["e"].shape[1], w["e"].dtype
    rows, groups, leaves = seen
    inputs, targets = np.arange(-n - 1, n - 1), np.arange(n)
    dist = targets[:, None] + n - np.arange(2 * n)[None, :]
    far = np.clip(dist, 0, 2 * n - 1)
    bias = np.where(dist >= 0, w["near"][far], np.float32(-1e9)).astype(kind)
    first_row, b = m.row[m.end], len(start)
    wq, wkv = w["q"] * kind.type(d**-0.5), np.concatenate((w["k"], w["v"]), axis=1)
    wide = np.zeros((d + 1, 2 * d + 1), kind)  # from an embedding and a one to key, value and a one
    wide[:d, : 2 * d], wide[d, 2 * d] = wkv, 1
    r = rows.take(start[:, None] + inputs, mode="clip")
    head = np.flatnonzero(before == 0)  # a text's first window: nothing stands before its beginning
    r[head, : n + 1] = first_row
    r[before == n, 0] = first_row
    # attention; a column of ones after the values sums up its weights
    fx = np.concatenate((w["e"], np.ones((len(w["e"]), 1), kind)), axis=1).take(r.ravel(), axis=0)
    eq = fx.reshape(b, 2 * n, d + 1)[:, n:].reshape(-1, d + 1)
    q, kv = (eq[:, :d] @ wq).reshape(b, n, d), (fx @ wide).reshape(b, 2 * n, 2 * d + 1)
    k, v = kv[:, :, :d], kv[:, :, d:]

    def looks() -> np.ndarray:
        x = np.matmul(q, k.transpose(0, 2, 1))
        x += bias
        x[head, :, :n] = -1e9
        return x

    att, mixed = exps(looks, lambda z: np.matmul(z, v))
    part = 1 / mixed[:, :, d:]
    mixed *= part
    mixed[:, :, d] = 0
    h = mixed.reshape(-1, d + 1) + eq  # its last column is the constant that biases go with
    # softmax over classes, and over the leaves of each class, row by row in the order of classes
    at, live = (start[:, None] + targets).ravel(), None
    if int(count.min()) < n:
        live = np.flatnonzero((targets < count[:, None]).ravel())
        at = at[live]
    y = groups[at]
    order = np.argsort(y, kind="stable")
    at, y, live = at[order], y[order], order if live is None else live[order]
    y2, hs, dhs = leaves[at].astype(np.int64), h.take(live, axis=0), np.empty((len(live), d), kind)
    o1, o2 = np.concatenate((w["o"], w["b"][None, :])), np.concatenate((w["o2"], w["b2"][:, None, :]), axis=1)
    back1, back2 = np.ascontiguousarray(w["o"].T), np.ascontiguousarray(w["o2"].transpose(0, 2, 1))
    g1, g2 = np.zeros_like(o1), np.zeros_like(o2)
    edge, most = np.searchsorted(y, np.arange(len(w["b"]) + 1)), max(o1.shape[1], o2.shape[2])
    one, space = np.ones((most, 1), kind), np.empty((min(TALL, len(hs)), most), kind)
    for x in range(0, len(hs), TALL):
        z = min(x + TALL, len(hs))
        here, xs = np.arange(z - x), hs[x:z]
        some = [(c, max(edge[c], x) - x, min(edge[c + 1], z) - x) for c in range(int(y[x]), int(y[z - 1]) + 1) if edge[c] < edge[c + 1]]

        def by_leaf(xs=xs, some=some) -> np.ndarray:
            out = space[: len(xs), : o2.shape[2]]
            for c, i, j in some:
                np.matmul(xs[i:j], o2[c], out=out[i:j])
            return out

        s, total = exps(lambda xs=xs: xs @ o1, lambda z: z @ one[: z.shape[1]])
        s.reshape(-1)[here * s.shape[1] + y[x:z]] -= total[:, 0]
        total = 1 / total
        g1 += (xs * total).T @ s
        np.multiply(s @ back1, total, out=dhs[x:z])
        s, total = exps(by_leaf, lambda z: z @ one[: z.shape[1]])
        s[here, y2[x:z]] -= total[:, 0]
        total = 1 / total
        xs, dx = (xs * total).T, np.empty((z - x, d), kind)
        for c, i, j in some:
            g2[c] += xs[:, i:j] @ s[i:j]
            np.matmul(s[i:j], back2[c], out=dx[i:j])
        dx *= total
        dhs[x:z] += dx
    g["o"] += g1[:d]
    g["b"] += g1[d]
    g["o2"] += g2[:, :d]
    g["b2"] += g2[:, d]
    dh = np.zeros((b * n, d + 1), kind)
    dh[live, :d] = dhs
    dh = dh.reshape(b, n, d + 1)
    # and back through the attention
    own = dh[:, :, :d].reshape(-1, d).copy()
    dh *= part
    dh[:, :, d] = -((dh * mixed).reshape(-1, d + 1) @ np.ones(d + 1, kind)).reshape(b, n)
    ds = np.matmul(dh, v.transpose(0, 2, 1))
    ds *= att
    g["near"] += np.bincount(far.ravel(), np.where(dist >= 0, ds.sum(axis=0), 0).ravel(), 2 * n).astype(np.float32)
    dq, dkv = np.matmul(ds, k).reshape(-1, d), np.empty((b, 2 * n, 2 * d), kind)
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :d])
    np.matmul(att.transpose(0, 2, 1), dh[:, :, :d], out=dkv[:, :, d:])
    dkv = dkv.reshape(-1, 2 * d)
    g["q"] += (eq[:, :d].T @ dq) * kind.type(d**-0.5)
    got = fx[:, :d].T @ dkv
    g["k"] += got[:, :d]
    g["v"] += got[:, d:]
    own += dq @ wq.T
    dx = dkv @ wkv.T
    dx.reshape(b, 2 * n, d)[:, n:] += own.reshape(b, n, d)
    # sums by row of the embedding
    r = r.ravel()
    order = np.argsort(r, kind="stable")
    r = r[order]
    cut = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    g["e"][r[cut]] += np.add.reduceat(dx.take(order, axis=0), cut, axis=0)
    return len(live)


def parts(x: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Views of ``x`` in the shapes of ``like``, one after the other in the order of names."""
    at = np.cumsum([0] + [like[k].size for k in sorted(like)])
    return {k: x[a:z].reshape(like[k].shape) for k, a, z in zip(sorted(like), at[:-1], at[1:], strict=True)}


def train(w: dict[str, np.ndarray], m: Layout, ids: np.ndarray, per: np.ndarray, p: Params, steps: int, rate: float, batch: int) -> dict[str, np.ndarray]:
    """The weights after gradient steps, each on the next ``batch`` windows of a shuffled order, which begins anew when all
    windows have had their turn."""
    x, rng = packed(w).astype(np.float32), np.random.default_rng(p.seed)
    w = parts(x, w)
    start, count, before = windows(per, p.block)
    if not len(start):
        return w
    small = lambda x, most: x.astype(np.int16 if most < 1 << 15 else np.int32)
    seen = small(m.row, p.rows).take(ids), small(m.group, p.classes).take(ids), small(m.leaf, p.leaves).take(ids)
    gr, g1, g2, t = (np.zeros_like(x) for _ in range(4))
    g = parts(gr, w)
    order, at = rng.permutation(len(start)), 0
    for step in range(1, steps + 1):
        if at >= len(order):
            order, at = rng.permutation(len(start)), 0
        drawn = order[at : at + batch]
        at += batch
        gr[:] = 0
        n = 0
        for i in range(0, len(drawn), SOME):
            s = drawn[i : i + SOME]
            with np.errstate(over="ignore"):
                n += gradients(w, m, seen, start[s], count[s], before[s], g)
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        gr /= n
        g1 += np.multiply(np.subtract(gr, g1, out=t), np.float32(0.1), out=t)
        gr *= gr
        g2 += np.multiply(np.subtract(gr, g2, out=t), np.float32(0.01), out=t)
        np.sqrt(np.multiply(g2, np.float32(1 / (1 - 0.99**step)), out=t), out=t)
        t += np.float32(1e-8)
        np.divide(g1, t, out=t)
        t *= np.float32(lr / (1 - 0.9**step))
        x -= t
        shut(w, m)
    return w


def model_of(w: dict[str, np.ndarray], m: Layout, p: Params) -> Model:
    return Model(m.row, m.group, m.leaf, m.cond, w["e"], w["q"], w["k"], w["v"], w["o"], w["b"], w["o2"], w["b2"], w["near"], m.end, p.block)


def fit(ids: np.ndarray, per: np.ndarray, id_counts: np.ndarray, end: int, p: Params) -> Model:
    """A model from these texts alone."""
    row, (who, column) = rows_of(id_counts, p), neighbours(ids, end)
    m = layout_of(row, np.bincount(row[who].astype(np.int64) * NEAR + column, minlength=p.rows * NEAR), id_counts, end, p)
    return model_of(train(first_weights(m, p), m, ids, per, p, p.steps, p.rate, p.batch), m, p)


def packed(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float64)


def unpacked(x: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return parts(x.astype(np.float32), like)


# ---------------------------------------------------------------- distributed


def fold(p: Params):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(p.folds))


def counts_of(learn: DataFrame, ranks, store: Store) -> DataFrame:
    """kind 0: (hash of a word, its count); kind 1: (id, count); kind 2: (0, number of texts); kind 3: (id * NEAR + column,
    count) of neighbours, over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokens(ranks.value)
        ids, rows, seen = np.zeros(t.end + 1, np.int64), 0, np.zeros(t.most, np.int64)
        slot, held, near = np.full(t.end + 1, -1, np.int64), 0, np.zeros(1 << 20, np.int64)  # neighbours of ids met so far
        one = lambda kind, key, n: pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n)], names=["kind", "key", "n"])
        for b in batches:
            data, offsets = buffers(b.column("text"))
            rows += len(b)
            for i, j in runs(offsets, RUN):
                w = Words(data, offsets, i, j)
                u, first, inv = distinct(w)
                if len(u) + t.n > t.most:  # counts are kept by the word's index, until the table is emptied
                    yield one(0, signed(t.hash[: t.n]), seen[: t.n])
                    t.clear()
                    seen = np.zeros(max(t.most, len(u)), np.int64)
                flat, _, (_, _, at) = sequences_of(w, t, (u, first, inv))
                n = np.bincount(flat, minlength=len(ids))
                ids += n
                seen += np.bincount(at, minlength=len(seen))
                new = np.flatnonzero((n > 0) & (slot < 0))
                slot[new] = held + np.arange(len(new))
                held += len(new)
                near = grown(near, held * NEAR)
                for who, column in zip(*map(lambda x: np.split(x, 2), neighbours(flat, t.end)), strict=True):
                    np.add.at(near, slot[who] * NEAR + column, 1)
        yield one(0, signed(t.hash[: t.n]), seen[: t.n])
        some = np.flatnonzero(ids[: t.end])  # ends are the texts, kind 2
        yield one(1, some, ids[some])
        some = np.flatnonzero(near)
        yield one(3, np.argsort(slot, kind="stable")[len(slot) - held :][some // NEAR] * NEAR + some % NEAR, near[some])
        yield one(2, np.zeros(1, np.int64), np.array([rows]))

    found = learn.select("text").mapInArrow(lean(run), "kind int, key long, n long")
    return store.save(found.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


RUN = 1 << 20  # bytes of text that are looked at together


def share_of(total: int, words: float) -> float:
    """Share of ``total`` training words that holds about ``words``."""
    return min(1.0, words / max(1, total))


def dealt(learn: DataFrame, share: float, salt: int) -> DataFrame:
    """(h, text): about this share of the training texts, all of them at 1."""
    h = F.xxhash64("doc_id", "text", F.lit(salt))
    return learn.select(h.alias("h"), "text").filter(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)) + 1)


def sampled(learn: DataFrame, share: float, salt: int) -> DataFrame:
    """(h, text): about this share of the training texts, each text of a doc_id once."""
    return dealt(learn, share, salt).dropDuplicates(["h"])


def near_of(counted: DataFrame, row: np.ndarray, p: Params) -> np.ndarray:
    """Counts of neighbours by row and column; ids become rows in tasks, so that the driver gets one number a place at most."""
    spark = counted.sparkSession
    rows = spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(row)), pa.int64()), "row": pa.array(row, pa.int64())}))
    x = counted.filter("kind = 3").select(F.floor(F.col("key") / NEAR).alias("id"), F.pmod("key", F.lit(NEAR)).alias("column"), "n")
    x = x.join(F.broadcast(rows), "id").groupBy((F.col("row") * NEAR + F.col("column")).cast("int").alias("place")).agg(F.sum("n").alias("n")).toArrow()
    near = np.zeros(p.rows * NEAR, np.int64)
    near[x.column("place").to_numpy()] = x.column("n").to_numpy()
    return near


def cut_texts(table: pa.Table, ranks) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each text) of the texts in the order of their hashes."""
    table = table.sort_by("h")
    data, offsets = buffers(table.column("text"))
    t, ids, per = Tokens(ranks.value), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i, j in runs(offsets, RUN):
        x, n, _ = sequences_of(Words(data, offsets, i, j), t)
        ids.append(x)
        per.append(n)
    return np.concatenate(ids), np.concatenate(per)


def refined(learn: DataFrame, total: int, w: dict[str, np.ndarray], m: Layout, ranks, p: Params, store: Store) -> dict[str, np.ndarray]:
    """The mean of the weights that each shard of the training texts arrives at from ``w``, by its number of windows.

    Sums of shards are formed in tasks, 64 at a time, until at most 64 are left for the driver.
    """
    share = min(1.0, p.refine_percent / 100)
    shards = max(1, round(total * share / p.shard_words))
    start = learn.sparkSession.sparkContext.broadcast((w, m))
    rows = dealt(learn, share, p.seed + 1).withColumn("g", F.pmod(F.xxhash64("h"), F.lit(shards)))
    rows = rows.repartition("g").dropDuplicates(["g", "h"])  # texts are shuffled once, for this and for the groups
    schema = "g long, n double, x binary"

    def row(g: int, n: float, x: np.ndarray) -> pa.Table:
        return pa.table({"g": pa.array([g], pa.int64()), "n": pa.array([n]), "x": pa.array([x.tobytes()], pa.binary())})

    def learn_shard(key, table):
        w0, layout = start.value
        ids, per = cut_texts(table, ranks)
        n = int((-(-per // p.block)).sum())
        x = packed(train(w0, layout, ids, per, p, -(-n // p.refine_batch), p.refine_rate, p.refine_batch))
        return row(key[0].as_py(), float(n), n * x)

    def add(key, table):
        table = table.sort_by("from")
        x = sum(np.frombuffer(v.as_py(), np.float64) for v in table.column("x"))
        return row(key[0].as_py(), float(sum(table.column("n").to_pylist())), x)

    parts = store.save(rows.groupBy("g").applyInArrow(learn_shard, schema), "shards")
    while shards > 64:
        shards = -(-shards // 64)
        parts = parts.withColumn("from", F.col("g")).withColumn("g", F.pmod("g", F.lit(shards)))
        parts = store.save(parts.groupBy("g").applyInArrow(add, schema), "sums")
    got = parts.orderBy("g").toArrow()
    n = sum(got.column("n").to_pylist())
    if not n:
        return w
    return shut(unpacked(sum(np.frombuffer(v.as_py(), np.float64) for v in got.column("x")) / n, w), m)


def score(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_ids."""
    spark = docs.sparkSession
    store = Store(spark)
    learn = docs.filter(fold(p).isNotNull() & (fold(p) != p.held)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranks = spark.sparkContext.broadcast(load_ranks(p.tokenizer))
    counted = counts_of(learn, ranks, store)
    whole = counted.filter("kind = 0")
    shape = counted.groupBy("kind").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect()
    shape = {r["kind"]: r for r in shape}
    n_docs = shape[2]["n"] if 2 in shape else 0
    total, distinct_words = (shape[0]["n"], shape[0]["v"]) if 0 in shape else (0, 0)
    total, distinct_words = total + n_docs, distinct_words + (1 if n_docs else 0)
    under = float(total + distinct_words + 1)
    # the words to broadcast: all with at least ``least`` occurrences, the smallest such that they stay within the bound
    levels = whole.groupBy(F.floor(F.log2("n")).cast("int").alias("l")).count().collect()
    least, held = 1 << 62, 0
    for row in sorted(levels, key=lambda r: -r["l"]):
        if held + row["count"] > p.top_words:
            break
        held += row["count"]
        least = 1 << row["l"]
    top = whole.filter(F.col("n") >= least).select("key", "n").toArrow()
    top_hash = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(top_hash)
    top_hash, top_n = top_hash[order], top.column("n").to_numpy()[order]
    # ids over the whole vocabulary, at most one row each
    id_rows = counted.filter("kind = 1").select("key", "n").toArrow()
    end = max(ranks.value.values()) + 1
    id_counts = np.zeros(end + 1, np.int64)
    id_counts[id_rows.column("key").to_numpy()] = id_rows.column("n").to_numpy()
    id_counts[end] = n_docs
    ids, per = cut_texts(sampled(learn, share_of(total, p.sample_words), p.seed).toArrow(), ranks)
    row = rows_of(id_counts, p)
    layout = layout_of(row, near_of(counted, row, p), id_counts, end, p)
    weights = train(first_weights(layout, p), layout, ids, per, p, p.steps, p.rate, p.batch)
    weights = refined(learn, total, weights, layout, ranks, p, store)
    shared = spark.sparkContext.broadcast((model_of(weights, layout, p), top_hash, np.log10((top_n + 1) / under)))
    end_score, end_known = float(np.log10((n_docs + 1) / under)), int(n_docs > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known, logs = shared.value

        def price(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            has = known[at] == h if len(known) else np.zeros(len(h), bool)
            return has, np.where(has, logs[at], 0.0) if len(known) else np.zeros(len(h))

        t = Tokens(ranks.value, price)
        for b in batches:
            data, offsets = buffers(b.column("text"))
            n = len(b)
            n_words, n_known, n_ids = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            base, val = np.zeros(n), np.zeros(n)
            tail_h, tail_n, tail_size = [], [], np.zeros(n, np.int64)
            for i, j in runs(offsets, RUN):
                w = Words(data, offsets, i, j)
                ids, per, (u, inv, at) = sequences_of(w, t)
                n_ids[i:j] = per
                n_words[i:j] = np.diff(w.first)
                hw = t.has[at]
                base[i:j] = np.bincount(w.row, t.log[at], j - i)[: j - i]
                n_known[i:j] = np.bincount(w.row, hw, j - i)[: j - i]
                rest = np.flatnonzero(~hw)
                if len(rest):
                    pair, cnt = np.unique(w.row[rest].astype(np.int64) * len(u) + inv[rest], return_counts=True)
                    tail_h.append(u[pair % len(u)])
                    tail_n.append(cnt)
                    tail_size[i:j] = np.bincount(pair // len(u), minlength=j - i)
                logp = score_ids(ids, per, m)
                edge = np.concatenate(([0], np.cumsum(per)))[:-1]
                val[i:j] = np.add.reduceat(logp, edge)
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("doc_id"), b.column("held_out"), pa.array(n_words + 1), pa.array(n_known + end_known), pa.array(base + end_score), pa.array(val), pa.array(n_ids),
                 to_list(signed(np.concatenate(tail_h)) if tail_h else np.zeros(0, np.int64), tail_size, pa.int64()), to_list(np.concatenate(tail_n) if tail_n else np.zeros(0, np.int64), tail_size, pa.int64())],
                names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_ids", "tail_h", "tail_n"],
            )

    # the number is unique among the rows that are written here, and only those are joined by it
    x = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(p) == p.held, F.lit(False)).alias("held_out"), "text")
    first = store.save(x.mapInArrow(lean(run), "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_ids long, tail_h array<long>, tail_n array<long>"), "scored")
    tail = first.select("rid", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("x")).select("rid", F.col("x.tail_h").alias("key"), F.col("x.tail_n").alias("m"))
    tail = tail.join(whole.filter(F.col("n") < least).select("key", "n"), "key", "left")
    each = F.col("m") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(under))
    tail = tail.groupBy("rid").agg(F.sum(each).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("more_known"))
    out = first.drop("tail_h", "tail_n").join(tail, "rid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", "n_ids",
    )


__all__ = ["Model", "Params", "U", "fit", "mix", "score", "score_ids"]
