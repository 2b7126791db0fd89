"""Language identification by language-bitmask n-gram filters.

Training counts 4-byte n-grams (inside words, with the word's edges) per language over all training texts. A
language holds an n-gram if its rate there is at least ``share`` of the highest rate, so that stray passages in
another language do not count. A Bloom filter per language holds its n-grams; the filters are bit-sliced, one
word of language bits per position, so that the AND over an n-gram's positions gives all languages that contain
it at once. A text's n-grams are looked up, counted per language, corrected for the filter's false positives, and
the language with the most decides. The filter has a fixed number of positions, so its size does not depend on
the corpus; it is built by a distributed bitwise OR and broadcast.

Defined results: null text, or one without a letter: ``und`` with score 0; a text with letters but no n-gram that
can be looked up: the most frequent training language with score 0; ties go to the first name; without training
rows everything is ``und``; rows with a NULL doc_id are predicted and never learned from.
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
from pyspark.sql.window import Window as W

from ._store import Store, lean
from ._text import U, buffers, mix, runs, text_of


@dataclass(frozen=True)
class Params:
    """``positions`` of the filter (a power of two), ``hashes`` per n-gram, least ``count`` of an n-gram in a language,
    ``share`` of the top rate that it needs; ``folds`` and ``held``: training leaves out crc32(doc_id) mod folds = held."""

    positions: int = 1 << 20
    hashes: int = 3
    count: int = 2
    share: float = 0.1
    folds: int = 5
    held: int = 0


_LETTER = np.zeros(256, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def ngrams(text) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, codes, row): the n-grams of rows [i, j); letters in lower case, all else is an edge (0)."""
    data, offsets = buffers(pc.utf8_lower(text))
    for i, j in runs(offsets):
        lo, hi = offsets[i], offsets[j]
        size = np.diff(offsets[i : j + 1])
        row = np.repeat(np.arange(j - i, dtype=np.int32), size)
        x = np.zeros(hi - lo + (j - i) + 1, np.uint8)  # one edge before, between and after the texts
        x[np.arange(hi - lo) + row + 1] = _LETTER[data[lo:hi]]
        ok = np.flatnonzero((x[1:-2] != 0) & (x[2:-1] != 0)) if len(x) > 3 else np.zeros(0, np.int64)
        b = x.astype(np.uint32)
        code = (b[ok] << np.uint32(24)) | (b[ok + 1] << np.uint32(16)) | (b[ok + 2] << np.uint32(8)) | b[ok + 3]
        edge = np.cumsum(size + 1) if j > i else np.zeros(0, np.int64)
        yield i, j, code, np.searchsorted(edge, ok + 1, side="right").astype(np.int32)


def slots(codes: np.ndarray, p: Params) -> list[np.ndarray]:
    """The positions of each n-gram in the filter."""
    a = mix(codes.astype(np.uint64) + U(0x1234567))
    step = (a >> U(32)) | U(1)
    return [((a + U(k) * step) & U(p.positions - 1)).astype(np.int64) for k in range(p.hashes)]


@dataclass
class Model:
    """``names`` in order of their bits, ``table`` of shape (ceil(n / 64), positions), ``rate`` of false positives."""

    names: list[str]
    table: np.ndarray
    rate: np.ndarray
    fallback: str | None


def train(docs: DataFrame, p: Params, store: Store) -> Model:
    """Counts over all training documents; what comes to the driver is bounded by the filter's positions."""
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(p.folds))
    rows = docs.select("doc_id", "text", "lang").filter(part.isNotNull() & (part != p.held) & F.col("lang").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        keys, counts, docs_of, held = [], [], {}, 0

        def squeeze():
            k, inv = np.unique(np.concatenate(keys), return_inverse=True)
            return [k], [np.bincount(inv, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)]

        for b in batches:
            lang = np.array([names.setdefault(x, len(names)) for x in b.column("lang").to_pylist()], np.uint64)
            for x, n in zip(*np.unique(lang, return_counts=True), strict=True):
                docs_of[int(x)] = docs_of.get(int(x), 0) + int(n)
            for i, _, code, row in ngrams(b.column("text")):
                k, n = np.unique((lang[i + row] << U(32)) | code.astype(np.uint64), return_counts=True)
                keys.append(k)
                counts.append(n)
                held += len(k)
                if held > 600_000:
                    keys, counts = squeeze()
                    held = len(keys[0])
        if names:
            if keys:
                keys, counts = squeeze()
            k, n = (keys[0], counts[0]) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            by = np.array(list(names), object)
            # a row with code -1 per language: how many documents it has
            ids = np.array(list(docs_of), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((by[(k >> U(32)).astype(np.int64)], by[ids])), pa.string()), pa.array(np.concatenate(((k & U(0xFFFFFFFF)).astype(np.int64), np.full(len(ids), -1)))), pa.array(np.concatenate((n, np.array([docs_of[x] for x in ids.tolist()], np.int64))))],
                names=["lang", "code", "n"],
            )

    grams = rows.mapInArrow(lean(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    grams = store.save(grams, "grams")
    langs = grams.groupBy("lang").agg(F.sum(F.when(F.col("code") >= 0, F.col("n")).otherwise(0)).alias("total"), F.sum(F.when(F.col("code") < 0, F.col("n"))).alias("docs")).collect()
    langs.sort(key=lambda r: r["lang"])
    names = [r["lang"] for r in langs]
    words = max(1, -(-len(names) // 64))
    table = np.zeros((words, p.positions), np.uint64)
    if not names:
        return Model([], table, np.zeros(0), None)
    total = F.create_map(*[F.lit(x) for r in langs for x in (r["lang"], float(max(1, r["total"])))])
    bit = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)])
    g = grams.filter(f"code >= 0 and n >= {p.count}").withColumns({"rate": F.col("n") / total[F.col("lang")], "bit": bit[F.col("lang")]})
    g = g.withColumn("top", F.max("rate").over(W.partitionBy("code"))).filter(F.col("rate") >= p.share * F.col("top")).select("code", "bit")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(slots(b.column("code").to_numpy().astype(np.uint32), p))
            bits = np.tile(b.column("bit").to_numpy().astype(np.int64), p.hashes)
            mask = (U(1) << (bits % 64).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((bits // 64).astype(np.int32)), pa.array(mask)], names=["at", "word", "mask"])

    filled = g.mapInArrow(lean(place), "at long, word int, mask long").groupBy("at", "word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most one row per position
    table[filled.column("word").to_numpy(), filled.column("at").to_numpy()] = filled.column("mask").to_numpy().view(np.uint64)
    fill = np.array([np.count_nonzero((table[k // 64] >> U(k % 64)) & U(1)) / p.positions for k in range(len(names))])
    most = max(langs, key=lambda r: r["docs"] or 0)
    return Model(names, table, fill**p.hashes, most["lang"])


def identify(docs: DataFrame, p: Params = Params(), model: Model | None = None, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the corrected share of n-grams the language holds), and
    with ``carry`` the document's own row as the struct ``row``."""
    store = Store(docs.sparkSession)
    model = model or train(docs, p, store)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.names, "und"], object)
        for b in batches:
            text = text_of(b)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            hits = np.zeros((len(b), max(1, len(m.names))))
            size = np.zeros(len(b))
            for i, j, code, row in ngrams(text):
                if not len(code) or not m.names:
                    continue
                at = slots(code, p)
                first = np.searchsorted(row, np.arange(j - i + 1))
                some = np.flatnonzero(first[1:] > first[:-1])
                size[i:j] += np.diff(first)
                for w in range(len(m.table)):
                    mask = m.table[w][at[0]]
                    for x in at[1:]:
                        mask &= m.table[w][x]
                    for k in range(64 * w, min(len(m.names), 64 * w + 64)):
                        got = ((mask >> U(k % 64)) & U(1)).astype(np.int32)
                        hits[i + some, k] += np.add.reduceat(got, first[some])
            n = np.maximum(size, 1)[:, None]
            share = np.clip((hits / n - m.rate) / np.maximum(1e-9, 1 - m.rate), 0, 1) if m.names else hits
            best = share.argmax(axis=1)
            score = np.where(letters & (size > 0), share[np.arange(len(b)), best], 0.0)
            pred = names[best]
            pred[letters & (score <= 0)] = m.fallback or "und"
            pred[~letters] = "und"
            out = [b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score)]
            kept = ["row"] if carry else []
            yield pa.RecordBatch.from_arrays([*out, *(b.column(c) for c in kept)], names=["doc_id", "held_out", "lang_pred", "score", *kept])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(p.folds)) == p.held, F.lit(False))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.struct(*docs.columns).alias("row") if carry else "text")
    schema = T.StructType.fromDDL("doc_id long, held_out boolean, lang_pred string, score double")
    return x.mapInArrow(lean(run), schema.add("row", x.schema["row"].dataType) if carry else schema)
