"""Removal of long repeated passages by suffix automata of reference shards.

A window is ``words`` consecutive words of one document; every word in a window that also starts in a document
with a smaller id is removed. Windows are judged on the input, never on what is left.

1. Anchors. Winnowing picks, in each window, the smallest of its k-gram hashes (k half a window), so equal
   windows pick equal anchors. An anchor found in two documents is shared; its owner is the smallest id.
2. Shards. Around the anchors that a document owns, its words are reference text. References are dealt to shards
   of bounded size; each shard becomes a suffix automaton whose states know the smallest document they occur in.
   A shard goes to every task that needs it (several for a shard that many documents ask for), never to the driver.
3. Matching statistics. What other documents hold around shared anchors is streamed through the automaton of the
   owner's shard; the state of length ``words`` at each position says whether a smaller document has that window.
4. What is left. A window whose anchor's owner lacks it (the words beyond the owner's copy differ) is looked up
   by its own hash among all such windows; the smallest document with it becomes its reference.

Why that is whole: a window's own anchor is the same in every document that holds it. If the owner of that anchor
holds the window, step 3 finds it for all others; if not, all holders come to step 4 and meet there.

Rows are told apart by doc_id and a hash of their text.

Defined results: a null text has no words; documents of fewer than ``words`` words keep everything; of several
rows with one doc_id, with equal or different texts, neither removes from the other (no smaller id), and each is
shortened by its own text; a NULL doc_id is neither reference nor shortened; an empty table gives no rows; extra columns
are ignored or, with ``carry``, come along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import Store, lean, small
from ._text import Words, buffers, runs, sequences, signed, text_of, to_list


@dataclass(frozen=True)
class Params:
    """``words``: window length; ``anchor``: length of the k-grams that anchors are;
    ``shard_words``: reference words in one automaton; ``task_words``: words that one task streams through it."""

    words: int = 50
    anchor: int = 25
    shard_words: int = 60_000
    task_words: int = 600_000


def winnow(g: np.ndarray, span: int) -> np.ndarray:
    """Positions of the smallest entry (the last on a tie) in every run of ``span`` entries of ``g``."""
    n = len(g)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= span:
        return np.array([n - 1 - int(np.argmin(g[::-1]))], np.int64)
    # sliding minimum by doubling, over (value, position from the end), kept as two arrays
    pos = np.arange(n)
    val, at, width = g, pos, 1
    while width < span:
        step = min(width, span - width)
        a, b = val[: len(val) - step], val[step:]
        take = b <= a
        at = np.where(take, at[step:], at[: len(at) - step])
        val = np.where(take, b, a)
        width += step
    return np.unique(at)


def anchors_of(h: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of one document's word hashes; none below one window."""
    if len(h) < p.words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = sequences(h, p.anchor)
    at = winnow(g, p.words - p.anchor + 1)
    return at, g[at]


def documents(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, offsets = buffers(batch.column("text"))
    for i, j in runs(offsets):
        w = Words(data, offsets, i, j)
        h = w.hashes()
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            yield h[a:b]


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, tid (which tells rows of one doc_id apart), text."""
    return docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")


def anchor_rows(docs: DataFrame, p: Params) -> DataFrame:
    """(fp, doc_id, tid, pos) for every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, at = [], []
            for h in documents(b):
                pos, fp = anchors_of(h, p)
                fps.append(fp)
                at.append(pos)
            if fps:
                who = np.repeat(np.arange(len(b)), [len(x) for x in at])
                ids, tids = (b.column(c).to_numpy()[who] for c in ("doc_id", "tid"))
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(fps))), pa.array(ids), pa.array(tids), pa.array(np.concatenate(at).astype(np.int32))], names=["fp", "doc_id", "tid", "pos"])

    return texts(docs).filter("doc_id is not null and text is not null").mapInArrow(lean(run), "fp long, doc_id long, tid long, pos int")


class Automaton:
    """Suffix automaton of several token sequences; ``least[state]`` is the smallest owner of what the state spells."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 62]

    def add(self, tokens: list[int], owner: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for c in tokens:
            got = nxt[last].get(c)
            if got is not None:  # this prefix's extension is known already, from an earlier sequence
                if length[got] == length[last] + 1:
                    cur = got
                else:
                    cur = self._split(last, c, got)
                if owner < least[cur]:
                    least[cur] = owner
                last = cur
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            least.append(owner)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        k = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        self.least.append(self.least[q])
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = k
            p = link[p]
        link[q] = k
        return k

    def finish(self) -> None:
        """Owners flow from long states to their suffixes."""
        link, least = self.link, self.least
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            up = link[s]
            if up > 0 and least[s] < least[up]:
                least[up] = least[s]

    def windows(self, tokens: list[int], size: int) -> list[int]:
        """For each position, the smallest owner of the ``size`` tokens that end there; 0 past all ids if none has them."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        none = 1 << 62
        out = []
        s, n = 0, 0
        for c in tokens:
            t = nxt[s].get(c)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = nxt[s].get(c)
            if t is None:
                n = 0
            else:
                s = t
                n += 1
                while length[link[s]] >= size if s else False:  # only the last ``size`` tokens matter
                    s = link[s]
                    n = length[s]
            out.append(least[s] if n >= size else none)
        return out


def regions(pos: np.ndarray, n: int, p: Params) -> list[tuple[int, int]]:
    """The stretches of words that hold every window around the anchors at ``pos`` (sorted)."""
    reach = p.words - p.anchor
    lo, hi = np.maximum(0, pos - reach), np.minimum(n, pos + p.words)
    cut = np.flatnonzero(lo[1:] > hi[:-1]) + 1
    a, b = np.concatenate(([0], cut)), np.concatenate((cut, [len(pos)])) - 1
    return list(zip(lo[a].tolist(), hi[b].tolist(), strict=True))


def shard_rows(docs: DataFrame, asked: DataFrame, p: Params) -> DataFrame:
    """Word hashes of references (kind 0) and of what is to be streamed (kind 1), by shard and part.

    ``asked``: doc_id, tid and the list ``at`` of (pos, shard, part, ref), ``ref`` being the number of parts for a
    reference and 0 otherwise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tids = (b.column(c).to_numpy() for c in ("doc_id", "tid"))
            at = b.column("at")
            off = np.concatenate(([0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))))
            flat = at.flatten()
            cols = [flat.field(k).to_numpy() for k in range(4)]
            head: list[tuple] = []
            words: list[np.ndarray] = []
            held = 0

            def flush(head, words):
                h = np.array(head, np.int64).reshape(-1, 6)
                return pa.RecordBatch.from_arrays(
                    [*(pa.array(h[:, c].astype(np.int32)) for c in (0, 1, 2)), pa.array(h[:, 3].copy()), pa.array(h[:, 5].copy()), pa.array(h[:, 4].astype(np.int32)), to_list(signed(np.concatenate(words)), np.array([len(w) for w in words]), pa.int64()), to_list(np.concatenate([w[-1] for w in tails]), np.array([len(w[-1]) for w in tails]), pa.int32())],
                    names=["shard", "part", "kind", "doc_id", "tid", "start", "w", "pos"],
                )

            tails: list[tuple] = []
            for k, h in enumerate(documents(b)):
                pos, shard, part, ref = (c[off[k] : off[k + 1]] for c in cols)
                for s, q, r in sorted(set(zip(shard.tolist(), part.tolist(), ref.tolist(), strict=True))):
                    mine = np.sort(pos[(shard == s) & (part == q) & (ref == r)])
                    for lo, hi in regions(mine, len(h), p):
                        inside = mine[(mine >= lo) & (mine < hi)] - lo
                        for t in range(r) if r else (q,):
                            head.append((s, t, 0 if r else 1, ids[k], lo, tids[k]))
                            words.append(h[lo:hi])
                            tails.append((inside.astype(np.int32),))
                            held += hi - lo
                            if held > 500_000:
                                yield flush(head, words)
                                head, words, held = [], [], 0
                                tails.clear()
            if head:
                yield flush(head, words)
                tails.clear()

    sent = texts(docs).join(asked.hint("merge"), ["doc_id", "tid"])
    return sent.mapInArrow(lean(run), "shard int, part int, kind int, doc_id long, tid long, start int, w array<long>, pos array<int>")


def match(rows: DataFrame, p: Params) -> DataFrame:
    """Stream each shard's documents through its automaton: (doc_id, tid, starts, spans, left_at, left_fp).

    ``starts``/``spans``: stretches of words that a smaller document has; ``left_at``/``left_fp``: windows
    around an anchor that the automaton does not have from a smaller document.
    """
    size, anchor = p.words, p.anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, auto, ready = None, None, False
        for b in batches:
            shard, part, kind, ids, tids, start = (b.column(c).to_numpy() for c in ("shard", "part", "kind", "doc_id", "tid", "start"))
            w, pos = b.column("w"), b.column("pos")
            woff, wval = w.offsets.to_numpy(), w.values.to_numpy()
            poff, pval = pos.offsets.to_numpy(), pos.values.to_numpy()
            out_id, out_t, out_s, out_n, out_la, out_lf = [], [], [], [], [], []
            for k in range(len(b)):
                if (shard[k], part[k]) != key:
                    key, auto, ready = (shard[k], part[k]), Automaton(), False
                x = wval[woff[k] : woff[k + 1]]
                if kind[k] == 0:
                    auto.add(x.tolist(), int(ids[k]))
                    continue
                if not ready:
                    auto.finish()
                    ready = True
                least = np.array(auto.windows(x.tolist(), size), np.int64)[size - 1 :]  # by the window's first word
                got = least < ids[k]
                at = np.flatnonzero(got)
                cut = np.flatnonzero(np.diff(at) > size) + 1
                a, z = (at[np.concatenate(([0], cut))], at[np.concatenate((cut, [len(at)])) - 1]) if len(at) else (at, at)
                # a window holds an anchor if one starts in [its start, its start + size - anchor]
                mine = pval[poff[k] : poff[k + 1]]
                first = np.arange(len(least))
                near = np.searchsorted(mine, first)
                holds = (near < len(mine)) & (mine[np.minimum(near, len(mine) - 1)] <= first + size - anchor)
                left = np.flatnonzero(holds & ~got)
                out_id.append(ids[k])
                out_t.append(tids[k])
                out_s.append(a + start[k])
                out_n.append(z - a + size)
                out_la.append(left + start[k])
                out_lf.append(sequences(x.view(np.uint64), size)[left] if len(left) else np.zeros(0, np.uint64))
            if out_id:
                cat = lambda xs, t: to_list(np.concatenate(xs).astype(t), np.array([len(x) for x in xs]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(out_id, np.int64)), pa.array(np.array(out_t, np.int64)), cat(out_s, np.int32), cat(out_n, np.int32), cat(out_la, np.int32), to_list(signed(np.concatenate(out_lf)), np.array([len(x) for x in out_lf]), pa.int64())],
                    names=["doc_id", "tid", "starts", "spans", "left_at", "left_fp"],
                )

    dealt = rows.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind", "doc_id", "tid", "start")
    return dealt.mapInArrow(lean(run), "doc_id long, tid long, starts array<int>, spans array<int>, left_at array<int>, left_fp array<long>")


def repeated_spans(docs: DataFrame, p: Params, store: Store) -> DataFrame:
    """(doc_id, tid, at array<struct<start,n>>): stretches of words to remove, which may overlap."""
    anchors = store.save(anchor_rows(docs, p), "anchors")
    own = anchors.groupBy("fp").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").select("fp", "owner")
    own = store.save(own, "owners")
    found = store.save(anchors.join(own.hint("merge"), "fp"), "shared")
    store.drop(anchors)
    per = p.words * 0.3  # words of reference text per anchor, about
    load = found.agg(F.count_if(F.col("doc_id") == F.col("owner")).alias("refs")).first()["refs"]
    shards = max(1, round(load * per / p.shard_words))
    found = found.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("int"))
    parts = found.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.count_if(F.col("doc_id") > F.col("owner")) * per / p.task_words)).cast("int").alias("parts"))
    found = found.join(small(parts, shards, 16), "shard")
    is_ref = F.col("doc_id") == F.col("owner")
    item = F.struct("pos", "shard", F.when(is_ref, 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int").alias("part"), F.when(is_ref, F.col("parts")).otherwise(0).alias("ref"))
    asked = store.save(found.groupBy("doc_id", "tid").agg(F.collect_list(item).alias("at")), "asked")
    # the lists grow with the corpus: they meet the texts by a shuffle at every size
    rows = shard_rows(docs, asked, p)
    got = store.save(match(rows, p), "matched")
    left = got.select("doc_id", "tid", F.explode(F.arrays_zip("left_at", "left_fp")).alias("x")).select("doc_id", "tid", F.col("x.left_at").alias("at"), F.col("x.left_fp").alias("fp"))
    first = left.groupBy("fp").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").select("fp", "owner")
    first = store.save(first, "first")
    late = left.join(first.hint("merge"), "fp").filter("doc_id > owner").select("doc_id", "tid", F.col("at").alias("start"), F.lit(p.words).alias("n"))
    spans = got.select("doc_id", "tid", F.explode(F.arrays_zip("starts", "spans")).alias("x")).select("doc_id", "tid", F.col("x.starts").alias("start"), F.col("x.spans").alias("n"))
    return spans.union(late).groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "n")).alias("at"))


def remove_repeats(docs: DataFrame, p: Params = Params(), carry: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, spans (array of [start, end) in words).

    With ``carry`` the document's own row comes along as the struct ``row``.
    """
    store = Store(docs.sparkSession)
    spans = store.save(repeated_spans(docs, p, store), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(text_of(b))
            at = b.column("at")
            lens = at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            aoff = np.concatenate(([0], np.cumsum(lens)))
            flat = at.flatten()
            s, k = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            total, gone, text, cut = [], [], [], []
            for r in range(len(b)):
                words = data[off[r] : off[r + 1]].tobytes().split()  # bytes split at exactly the six separators
                x = slice(aoff[r], aoff[r + 1])
                total.append(len(words))
                if lens[r]:
                    d = np.zeros(len(words) + 1, np.int32)
                    np.add.at(d, s[x], 1)
                    np.add.at(d, s[x] + k[x], -1)
                    keep = np.cumsum(d[:-1]) == 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([True], keep, [True])).astype(np.int8)))
                    cut.append([{"start": int(a), "end": int(z)} for a, z in zip(edge[::2], edge[1::2], strict=True)])
                    words = [words[i] for i in np.flatnonzero(keep)]
                else:
                    cut.append([])
                gone.append(total[-1] - len(words))
                text.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(cut, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "n_words", "n_removed", "kept_text", "spans"],
            )

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for out in run(iter([b])):
                yield pa.RecordBatch.from_arrays([*out.columns, b.column("row")], names=[*out.schema.names, "row"])

    schema = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>"
    if not carry:
        return texts(docs).join(spans.hint("merge"), ["doc_id", "tid"], "left").mapInArrow(lean(run), schema)
    row = F.struct(*docs.columns).alias("row")
    x = docs.select("doc_id", F.xxhash64("text").alias("tid"), row).join(spans.hint("merge"), ["doc_id", "tid"], "left")
    return x.mapInArrow(lean(both), T.StructType.fromDDL(schema).add("row", x.schema["row"].dataType))
