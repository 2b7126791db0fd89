"""Benchmark decontamination by the q-gram lemma with banded verification.

Benchmark items are normalised (lower case; everything but letters and digits is one blank) and searched for as
patterns of ``width`` characters that start every ``stride`` characters, so a leaked part of ``width + stride - 1``
characters is found as well as a whole item. A text that holds a pattern of length m with at most e edits shares at
least ``m + 1 - q*(e + 1)`` of its q-grams, all within e + 1 neighbouring diagonals. Hits are counted in bins of e + 1
diagonals; two neighbouring bins form an overlapping band, so the diagonals of every match lie in one band. Bands that
reach the bound are verified by an alignment confined to the band. The filter loses no match; the alignment admits no
false one.

The items' q-grams go to every task, in shards of at most ``shard_chars`` characters (an item beyond that is a shard of
its own): some 15 bytes a character, so below 32 MB. A task holds one shard at a time and takes each batch of texts
through all of them, so every row comes out once, however many shards there are.

Defined results: null or empty texts are clean; rows are judged one by one, also those with equal or NULL doc_ids; an
item shorter than ``least`` normalised characters is searched for exactly and as whole words, one shorter than ``q``
only as a whole text; items with NULL id or text are left out; an empty benchmark leaves everything clean; extra
columns are ignored or, with ``carry``, come along in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import Store, lean
from ._text import U, buffers, mix, runs, sequences, text_of, to_list


@dataclass(frozen=True)
class Params:
    """``q``; ``edits`` allowed as a share of a pattern; ``width`` and ``stride`` of patterns; ``least`` length of an item
    that may have edits; ``shard_chars`` of the benchmark in one shard."""

    q: int = 10
    edits: float = 0.08
    width: int = 100
    stride: int = 25
    least: int = 30
    shard_chars: int = 2 << 20


_MIXED = mix(np.arange(256, dtype=np.uint64))
_KEEP = np.full(256, 0x20, np.uint8)
_KEEP[0x30:0x3A] = np.arange(0x30, 0x3A)
_KEEP[0x61:0x7B] = np.arange(0x61, 0x7B)
_KEEP[0x80:] = np.arange(0x80, 0x100)


def normalised(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of adjacent texts and the new cuts; no text starts with a blank."""
    x = _KEEP[data]
    blank = x == 0x20
    drop = np.zeros(len(x), bool)
    drop[1:] = blank[1:] & blank[:-1]
    heads = cuts[:-1][cuts[:-1] < len(x)]
    heads = heads[blank[heads]] if len(heads) else heads
    drop[heads] = True
    keep = ~drop
    before = np.concatenate(([0], np.cumsum(keep)))
    return x[keep], before[cuts]


def normal_batches(text) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = buffers(pc.utf8_lower(text))
    for i, j in runs(offsets):
        x, cuts = normalised(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, j, x, cuts


@dataclass
class Index:
    """A shard: items one after the other in ``text``; ``grams`` sorted, with the place of each in ``text``; ``bits`` is a
    first sieve; patterns by number, those of an item from ``first`` on; ``tiny``: items shorter than a q-gram."""

    ids: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    first: np.ndarray
    item: np.ndarray
    start: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    grams: np.ndarray
    place: np.ndarray
    bits: np.ndarray
    tiny: dict[bytes, list[int]]


SIEVE = 22
PIECE = 1 << 21  # hits that are expanded at once


def build(items: list[tuple[int, str]], p: Params) -> Index:
    ids, texts, tiny = [], [], {}
    for i, _, x, cuts in normal_batches(pa.array([t or "" for _, t in items], pa.large_string())) if items else ():
        for k in range(len(cuts) - 1):
            t = x[cuts[k] : cuts[k + 1]]
            t = t[:-1] if len(t) and t[-1] == 0x20 else t
            if len(t) >= p.q:
                ids.append(items[i + k][0])
                texts.append(t)
            elif len(t):
                tiny.setdefault(t.tobytes(), []).append(items[i + k][0])
    length = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(length)))[: len(length)]
    text = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
    m = np.minimum(length, p.width)
    regular = -(-(length - m) // p.stride)  # and one more that ends where the item ends
    first = np.concatenate(([0], np.cumsum(regular + 1)))
    item = np.repeat(np.arange(len(length)), regular + 1)
    start = np.minimum((np.arange(first[-1]) - first[item]) * p.stride, (length - m)[item]) + begin[item]
    size = m[item]
    # as many edits as asked for, but never so many that the bound would drop below one shared q-gram
    edits = np.where(length[item] < p.least, 0, np.minimum((size * p.edits).astype(np.int64), size // p.q - 1))
    g = sequences(_MIXED[text], p.q)
    place = np.flatnonzero(np.arange(len(g)) + p.q <= np.repeat(begin + length, length)[: len(g)]) if len(g) else np.zeros(0, np.int64)
    order = place[np.argsort(g[place], kind="stable")]
    bits = np.zeros(1 << SIEVE, bool)
    bits[(g[order] >> U(64 - SIEVE)).astype(np.int64)] = True
    return Index(np.array(ids, np.int64), text, begin, length, first[:-1], item, start, size, edits, g[order], order.astype(np.int32), bits, tiny)


def candidates(x: np.ndarray, cuts: np.ndarray, ix: Index, p: Params) -> tuple[np.ndarray, ...]:
    """(row, pattern, lowest diagonal of the band, width of the band) of the bands that reach the bound."""
    none = (np.zeros(0, np.int64),) * 4
    g = sequences(_MIXED[x], p.q)
    if not len(g) or not len(ix.grams):
        return none
    at = np.flatnonzero(ix.bits[(g >> U(64 - SIEVE)).astype(np.int64)])
    row = np.searchsorted(cuts, at, side="right") - 1
    inside = at + p.q <= cuts[row + 1]
    at, row = at[inside], row[inside]
    lo = np.searchsorted(ix.grams, g[at], side="left")
    n = np.searchsorted(ix.grams, g[at], side="right") - lo
    at, row, lo, n = at[n > 0], row[n > 0], lo[n > 0], n[n > 0]
    if not len(at):
        return none
    shift = 1 << 12  # patterns are short: with it no diagonal is negative
    patterns, bins_of_row = len(ix.item), int(np.diff(cuts).max()) + 2 * shift
    upto = np.concatenate(([0], np.cumsum(n)))
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = 0
    while a < len(at):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + PIECE, side="right")) - 1)
        rep = np.repeat(np.arange(a, z), n[a:z])
        place = ix.place[lo[rep] + np.arange(len(rep)) - np.repeat(upto[a:z] - upto[a], n[a:z])].astype(np.int64)
        # the patterns of the item that hold this q-gram: a run of the regular ones, and perhaps the last
        it = np.searchsorted(ix.begin, place, side="right") - 1
        o = place - ix.begin[it]
        m = np.minimum(ix.length[it], p.width)
        last = ix.length[it] - m
        regular = -(-last // p.stride)
        low = np.maximum(0, -((m - p.q - o) // p.stride))
        many = np.maximum(0, np.minimum(o // p.stride, regular - 1) - low + 1)
        ends = np.flatnonzero(o >= last)
        hit = np.concatenate((np.repeat(np.arange(len(rep)), many), ends))
        k = np.concatenate((np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many), regular[ends]))
        pat = ix.first[it[hit]] + k
        spot = rep[hit]
        diagonal = at[spot] - cuts[row[spot]] - (place[hit] - ix.start[pat]) + shift
        key, count = np.unique((row[spot] * np.int64(patterns) + pat) * bins_of_row + diagonal // (ix.edits[pat] + 1), return_counts=True)
        keys, back = np.unique(np.concatenate((keys, key)), return_inverse=True)
        counts = np.bincount(back, np.concatenate((counts, count)), len(keys)).astype(np.int64)
        a = z
    pair, b = keys // bins_of_row, keys % bins_of_row
    nxt = np.zeros(len(keys), np.int64)
    follows = np.flatnonzero((pair[1:] == pair[:-1]) & (b[1:] == b[:-1] + 1))
    nxt[follows] = counts[follows + 1]
    r, pat = pair // patterns, pair % patterns
    w = ix.edits[pat] + 1
    # a bin and the next one are a band; every run of e + 1 diagonals lies in one
    hit = counts + nxt >= ix.size[pat] + 1 - p.q * w
    return r[hit], pat[hit], b[hit] * w[hit] - shift, 2 * w[hit]


def align(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, pat: np.ndarray, diagonal: np.ndarray, width: np.ndarray, ix: Index) -> np.ndarray:
    """Least edits between each pattern and a stretch of its text [lo, hi), along the band's diagonals only.

    Column c of row r stands for text place ``lo + diagonal + c + r``; a match may start and end anywhere in the band.
    """
    best = np.full(len(pat), 1 << 20)
    for group in np.unique(np.stack([ix.size[pat], width]), axis=1).T.tolist() if len(pat) else []:
        m, w = group
        sel = np.flatnonzero((ix.size[pat] == m) & (width == w))
        for a in range(0, len(sel), 4096):
            s = sel[a : a + 4096]
            cols = np.arange(w + 1)
            d = np.zeros((len(s), w + 1), np.int64)  # row 0: nothing of the pattern is used yet, start where you like
            base = lo[s] + diagonal[s]
            letters = ix.text[ix.start[pat[s]][:, None] + np.arange(m)]
            for r in range(m):
                place = base[:, None] + cols + r
                ok = (place >= lo[s][:, None]) & (place < hi[s][:, None])
                same = ok & (x[np.clip(place, 0, len(x) - 1)] == letters[:, r : r + 1])
                nd = np.where(same, d, d + 1)  # the letter against the text at this place
                nd[:, :-1] = np.minimum(nd[:, :-1], d[:, 1:] + 1)  # the letter is missing from the text
                nd = np.minimum.accumulate(nd - cols, axis=1) + cols  # the text has letters too many
                d = nd
            best[s] = d.min(axis=1)
    return best


def exact(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, pat: np.ndarray, diagonal: np.ndarray, ix: Index) -> np.ndarray:
    """Whether the pattern stands in [lo, hi) on one of the band's two diagonals, letter by letter and as whole words."""
    out = np.zeros(len(pat), bool)
    for m in np.unique(ix.size[pat]).tolist():
        sel = np.flatnonzero(ix.size[pat] == m)
        letters = ix.text[ix.start[pat[sel]][:, None] + np.arange(m)]
        for d in (0, 1):
            s = lo[sel] + diagonal[sel] + d
            fits = (s >= lo[sel]) & (s + m <= hi[sel])
            same = (x[np.clip(s[:, None] + np.arange(m), 0, len(x) - 1)] == letters).all(axis=1)
            left = (s == lo[sel]) | (x[np.clip(s - 1, 0, len(x) - 1)] == 0x20)
            right = (s + m == hi[sel]) | (x[np.clip(s + m, 0, len(x) - 1)] == 0x20)
            out[sel] |= fits & same & left & right
    return out


def search(text, ix: Index, p: Params, items: list[set[int]], edits: list[int | None]) -> None:
    """Add what a shard finds in each text to ``items`` and ``edits``."""

    def found(row: int, item: int, cost: int) -> None:
        items[row].add(item)
        edits[row] = cost if edits[row] is None else min(cost, edits[row])

    for i, _, x, cuts in normal_batches(text):
        r, pat, diagonal, width = candidates(x, cuts, ix, p)
        loose = ix.edits[pat] > 0
        strict = np.flatnonzero(~loose)
        strict = strict[exact(x, cuts[r[strict]], cuts[r[strict] + 1], pat[strict], diagonal[strict], ix)]
        r2, pat2 = r[loose], pat[loose]
        cost = align(x, cuts[r2], cuts[r2 + 1], pat2, diagonal[loose], width[loose], ix)
        ok = np.flatnonzero(cost <= ix.edits[pat2])
        for row, k, c in zip((*r[strict].tolist(), *r2[ok].tolist()), (*pat[strict].tolist(), *pat2[ok].tolist()), (*[0] * len(strict), *cost[ok].tolist()), strict=True):
            found(i + row, int(ix.ids[ix.item[k]]), c)
        for row in np.flatnonzero(np.diff(cuts) <= p.q).tolist() if ix.tiny else ():
            for item in ix.tiny.get(x[cuts[row] : cuts[row + 1]].tobytes().rstrip(b" "), ()):
                found(i + row, item, 0)


def find(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), carry: bool = False) -> DataFrame:
    """One row per document: doc_id, kept, n_items, item_ids (sorted), best_edits (NULL if clean), and with ``carry`` the
    document's own row as the struct ``row``."""
    spark = Store(docs.sparkSession).spark
    usable = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    shards, held, size = [], [], 0
    for r in usable.toLocalIterator():  # one shard at a time on the driver
        if held and size + len(r["text"]) > p.shard_chars:
            shards.append(spark.sparkContext.broadcast(build(held, p)))
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
    shards.append(spark.sparkContext.broadcast(build(held, p)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items: list[set[int]] = [set() for _ in range(len(b))]
            edits: list[int | None] = [None] * len(b)
            for shard in shards:
                search(text_of(b), shard.value, p, items, edits)
                if len(shards) > 1:
                    del shard._value  # a task holds one shard at a time; the next use reads it again
            flat = np.array([y for x in items for y in sorted(x)], np.int64)
            n = np.array([len(x) for x in items])
            out = [b.column("doc_id"), pa.array(n == 0), pa.array(n.astype(np.int64)), to_list(flat, n, pa.int64()), pa.array(edits, pa.int64())]
            names = ["doc_id", "kept", "n_items", "item_ids", "best_edits"]
            yield pa.RecordBatch.from_arrays([*out, b.column("row")], names=[*names, "row"]) if carry else pa.RecordBatch.from_arrays(out, names=names)

    schema = T.StructType.fromDDL("doc_id long, kept boolean, n_items long, item_ids array<long>, best_edits long")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*docs.columns).alias("row") if carry else "text")
    return x.mapInArrow(lean(run), schema.add("row", x.schema["row"].dataType) if carry else schema)
