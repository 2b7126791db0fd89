"""MinHash near-duplicates with tensored banding.

A document's set holds its distinct shingles of ``words`` words. Two small collections of minhash groups are computed,
``m`` groups of ``r`` values each; a table key pairs one group of the first with one of the second, so
``2*m*r`` minhashes serve ``m*m`` tables of ``2*r`` values: about the square root of the usual work. With
m = 12 and r = 3 (72 minhashes, 144 tables) a pair at similarity 0.8 is missed with a chance of 0.0004.

Equal sets are one class from the start. Only classes that share a group value on both sides form table keys
(the others cannot meet in any table). Buckets never emit all pairs: members are compared with the smallest one of
their bucket; where a bucket's members are then not in one component, the open members are compared in blocks of
bounded size, so every candidate pair whose ends are not yet in one component is checked. Pairs inside a group's
largest component are left out, as they are linked already. Checks are exact, on whole sets.

Defined results: a NULL doc_id keeps NULL as its component and links with nothing; a null or word-less text has an empty set and links with nothing; fewer words than a shingle has make
one shingle of the whole sequence; repeated documents link; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._store import Store, lean, small
from ._text import U, Words, buffers, mix, runs, sequences, signed, to_list


@dataclass(frozen=True)
class Params:
    """``words`` per shingle, similarity ``percent``, ``groups`` per side of ``rows`` minhashes, ``seed``; ``spread``: members
    of one leader or bucket in one task; ``block``: members of a block of open ones, with ``block_shingles`` at most, about."""

    words: int = 5
    percent: int = 80
    groups: int = 12
    rows: int = 3
    seed: int = 7
    spread: int = 2000
    block: int = 320
    block_shingles: int = 200_000


def shingle_sets(batch_text, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = buffers(batch_text)
    for i, j in runs(offsets):
        w = Words(data, offsets, i, j)
        h = w.hashes(lower=True)
        s = sequences(h, words)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            n = b - a
            if n >= words:
                x = np.sort(s[a : b - words + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif n:
                yield sequences(h[a:b], n)
            else:
                yield x0


x0 = np.zeros(0, np.uint64)


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, text_hash, n_shingles, d0, d1, lefts, rights): set size, 128-bit digest of the set, group keys of both sides."""
    n = p.groups * p.rows * 2
    rng = np.random.default_rng(p.seed)
    mul = rng.integers(0, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)
    add = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    place = mix(rng.integers(1, 1 << 63, p.rows, dtype=np.uint64)) | U(1)
    words, rows = p.words, p.rows
    half = p.groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.zeros(len(b), np.int64)
            dig = np.zeros((len(b), 2), np.int64)
            low = np.zeros((len(b), n), np.uint64)
            for k, s in enumerate(shingle_sets(b.column("text"), words)):
                size[k] = len(s)
                if len(s):
                    dig[k] = np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    best = None
                    for a in range(0, len(s), 1 << 13):  # long texts in blocks, so that the matrix stays small
                        v = ((s[None, a : a + (1 << 13)] ^ add[:, None]) * mul[:, None]).min(axis=1)
                        best = v if best is None else np.minimum(best, v)
                    low[k] = best
            keys = mix((low.reshape(len(b), 2 * half, rows) * place).sum(axis=2, dtype=np.uint64))
            full = np.full(len(b), half)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), b.column("text_hash"), pa.array(size), pa.array(dig[:, 0].copy()), pa.array(dig[:, 1].copy()),
                 to_list(signed(keys[:, :half]).ravel(), full, pa.int64()), to_list(signed(keys[:, half:]).ravel(), full, pa.int64())],
                names=["doc_id", "text_hash", "n_shingles", "d0", "d1", "lefts", "rights"],
            )

    x = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return x.mapInArrow(lean(run), "doc_id long, text_hash long, n_shingles long, d0 long, d1 long, lefts array<long>, rights array<long>")


def table_keys(reps: DataFrame) -> DataFrame:
    """(bucket, rep) over all tables in which the class can meet another one."""
    side = lambda c, s: reps.select("rep", F.lit(s).alias("side"), F.posexplode(c).alias("slot", "key"))
    rows = side("lefts", 0).union(side("rights", 1))
    shared = rows.groupBy("side", "slot", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    hit = rows.join(shared, ["side", "slot", "key"], "left_semi")
    per = hit.groupBy("rep").agg(F.collect_list(F.struct("side", "slot", "key")).alias("k"))  # 2 * groups entries at most
    pick = lambda s: F.filter("k", lambda x: x["side"] == s)
    left = per.select("rep", F.explode(pick(0)).alias("l"), pick(1).alias("r"))
    pair = left.select("rep", "l", F.explode("r").alias("r"))
    return pair.select(F.xxhash64("l.slot", "l.key", "r.slot", "r.key").alias("bucket"), "rep")


def on_bucket(rows: DataFrame, per_bucket: DataFrame, how: str = "inner") -> DataFrame:
    """Join ``rows`` with one row per bucket (bucket, parts, ...), which a hot bucket has under each of its salts."""
    right = per_bucket.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return rows.join(right, ["bucket", "salt"], how)


def bucket_members(keys: DataFrame, p: Params, store: Store) -> DataFrame:
    """(bucket, salt, parts, leader, rep) of buckets with two members or more, without the leader (the smallest) itself;
    of buckets with equal members one is kept. A bucket with many members is dealt over ``parts`` salts."""
    keys = store.save(keys, "tables")
    h = F.xxhash64("rep")
    b = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("leader"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s")).filter("n > 1")
    kept = b.groupBy("n", "leader", "x", "s").agg(F.min("bucket").alias("bucket"))
    kept = store.save(kept.select("bucket", "leader", F.ceil(F.col("n") / p.spread).cast("int").alias("parts")), "buckets")
    hot = kept.filter("parts > 1").select("bucket", F.col("parts").alias("hot"))
    n_hot = hot.count()
    salt = F.pmod(F.xxhash64("rep"), F.coalesce("hot", F.lit(1))).cast("int")
    rows = keys.join(small(hot, n_hot, 24), "bucket", "left") if n_hot else keys.withColumn("hot", F.lit(None).cast("int"))
    rows = rows.select("bucket", "rep", salt.alias("salt"), F.coalesce("hot", F.lit(1)).alias("parts"))
    out = store.save(on_bucket(rows, kept).filter("rep <> leader").select("bucket", "salt", "parts", "leader", "rep"), "members")
    store.drop(keys)
    return out


def send_sets(docs: DataFrame, todo: DataFrame, p: Params, store: Store) -> DataFrame:
    """(leader, part, rep, s): the set of each class ``rep`` once for each of its destinations ``to``."""
    todo = store.save(todo, "todo")
    shape = todo.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("to")).alias("m")).first()
    side = small(todo.withColumnRenamed("rep", "doc_id"), 1, (shape["n"] or 0) * 60 + (shape["m"] or 0) * 32)
    words = p.words

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = b.column("to")
            off = np.concatenate(([0], np.cumsum(to.value_lengths().to_numpy(zero_copy_only=False))))
            flat = to.flatten()
            leaders, parts = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            ids = b.column("doc_id").to_numpy()
            held, head = [], []

            def flush(held=held, head=head):
                h = np.array(head, np.int64).reshape(-1, 3)
                out = pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0].copy()), pa.array(h[:, 1].astype(np.int32)), pa.array(h[:, 2].copy()), to_list(signed(np.concatenate(held)), np.array([len(x) for x in held]), pa.int64())],
                    names=["leader", "part", "rep", "s"],
                )
                held.clear()
                head.clear()
                return out

            size = 0
            for k, x in enumerate(shingle_sets(b.column("text"), words)):
                for t in range(off[k], off[k + 1]):  # a set may go to several places: output batches bounded by bytes
                    held.append(x)
                    head.append((leaders[t], parts[t], ids[k]))
                    size += len(x)
                    if size > 1 << 18:
                        yield flush()
                        size = 0
            if held:
                yield flush()

    return docs.select("doc_id", "text").join(side, "doc_id").mapInArrow(lean(spread), "leader long, part int, rep long, s array<long>")


def verify(docs: DataFrame, pairs: DataFrame, p: Params, store: Store) -> DataFrame:
    """Of distinct (rep, leader) pairs those whose sets are similar enough, as (a, b).

    Each set travels once to each leader that it meets; a leader with many members is dealt to several tasks,
    its own set to each. A task streams its rows: it holds one leader's set and one member's at a time.
    """
    pairs = store.save(pairs, "pairs")
    load = store.save(pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / p.spread).cast("int").alias("parts")), "load")
    hot = load.filter("parts > 1")
    n_hot = hot.count()
    placed = pairs.join(small(hot, n_hot, 24), "leader", "left") if n_hot else pairs.withColumn("parts", F.lit(1))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))).cast("int"))
    own = load.select(F.col("leader").alias("rep"), "leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    todo = placed.select("rep", "leader", "part").union(own)
    todo = todo.groupBy("rep").agg(F.collect_list(F.struct("leader", "part")).alias("to"))
    percent = p.percent

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own_set = None, None
        for b in batches:
            leaders, parts, reps = (b.column(c).to_numpy() for c in ("leader", "part", "rep"))
            s = b.column("s")
            off, flat = s.offsets.to_numpy(), s.values.to_numpy().view(np.uint64)
            out = []
            for k in range(len(b)):
                x = flat[off[k] : off[k + 1]]
                key = (leaders[k], parts[k])
                if key != at:  # the leader's own row comes first
                    at, own_set = key, x.copy()
                    continue
                both = np.count_nonzero(own_set[np.minimum(np.searchsorted(own_set, x), len(own_set) - 1)] == x)
                if 100 * both >= percent * (len(x) + len(own_set) - both):
                    out.append((reps[k], leaders[k]))
            if out:
                o = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(o[:, 0].copy()), pa.array(o[:, 1].copy())], names=["a", "b"])

    sent = send_sets(docs, todo, p, store).repartition("leader", "part").sortWithinPartitions("leader", "part", F.col("rep") != F.col("leader"), "rep")
    return store.save(sent.mapInArrow(lean(compare), "a long, b long"), "links")


def blocks_of(rest: DataFrame, sizes: DataFrame, p: Params, store: Store) -> DataFrame:
    """(g, rep, own, minor, total): the block of each open member in its group.

    Open buckets with a member in common are one group. Blocks 0 to ``minor`` - 1 hold the members outside the group's
    largest component, the others up to ``total`` those inside it, which need no comparing among themselves. A block holds
    about ``block`` members, or fewer if their sets are large.
    """
    low = rest.groupBy("bucket", "parts").agg(F.min("rep").alias("b"))
    group = components(on_bucket(rest, low).select(F.col("rep").alias("a"), "b"), store)
    home = rest.select("rep", "comp").distinct().join(group.select(F.col("id").alias("rep"), F.col("component").alias("g")), "rep").join(sizes, "rep")
    home = store.save(home.groupBy("g", "rep", "comp").agg(F.max("n_shingles").alias("n_shingles")), "groups")
    count = home.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    count = store.save(count, "counts")
    most = count.groupBy("g").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"))
    count = count.join(most, "g").withColumn("major", F.col("comp") == F.col("top"))
    cut = lambda major: F.greatest(
        F.ceil(F.sum(F.when(F.col("major") == major, F.col("n")).otherwise(0)) / p.block), F.ceil(F.sum(F.when(F.col("major") == major, F.col("w")).otherwise(0)) / p.block_shingles)
    ).cast("int")
    count = count.groupBy("g", "top").agg(cut(False).alias("minor"), cut(True).alias("rest")).withColumn("total", F.col("minor") + F.col("rest"))
    x = home.join(count, "g")
    h = F.xxhash64("rep")
    own = F.when(F.col("comp") == F.col("top"), F.col("minor") + F.pmod(h, F.col("rest"))).otherwise(F.pmod(h, F.col("minor"))).cast("int")
    return store.save(x.select("g", "rep", own.alias("own"), "minor", "total"), "blocks")


def block_links(docs: DataFrame, rest: DataFrame, sizes: DataFrame, p: Params, store: Store) -> DataFrame:
    """(a, b) links among members (bucket, salt, parts, rep, comp) of buckets that are still open.

    Every two blocks of a group are a piece, unless both lie in its largest component, and so is each block of the others
    with itself. All pairs of a piece are counted at once by matrix products over the shingles that both sides have, and
    only a spanning set of links leaves the task.
    """
    x = blocks_of(rest, sizes, p, store)
    small_end = F.when(F.col("own") < F.col("minor"), F.col("total")).otherwise(F.col("minor"))
    # pieces (i, j) with i <= j and i below ``minor``; ``part`` tells the sides apart
    x = x.select("g", "rep", "own", F.explode(F.sequence(F.lit(0), small_end - 1)).alias("other"))
    key = F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other"))
    todo = x.select("rep", F.struct(key.alias("leader"), (F.col("own") > F.col("other")).cast("int").alias("part")).alias("to"))
    todo = todo.groupBy("rep").agg(F.collect_list("to").alias("to"))
    percent = p.percent

    def links(ids: list[list[int]], sets: list[list[np.ndarray]]) -> pa.RecordBatch:
        alone = not ids[1]
        if alone:
            ids, sets = [ids[0], ids[0]], [sets[0], sets[0]]
        size = [np.array([len(x) for x in s]) for s in sets]
        cols = [np.concatenate(s) for s in sets]
        rows = [np.repeat(np.arange(len(n)), n) for n in size]
        shared = np.unique(cols[0])
        if not alone:
            shared = np.intersect1d(shared, cols[1])
        for k in (0, 1):
            at = np.minimum(np.searchsorted(shared, cols[k]), len(shared) - 1) if len(shared) else np.zeros(len(cols[k]), np.int64)
            ok = np.flatnonzero(shared[at] == cols[k]) if len(shared) else at[:0]
            order = np.argsort(at[ok], kind="stable")
            cols[k], rows[k] = at[ok][order], rows[k][ok][order]
        both = np.zeros((len(size[0]), len(size[1])), np.float32)
        step = 4096
        for a in range(0, len(shared), step):
            m = []
            for k in (0, 1):
                s = slice(*np.searchsorted(cols[k], [a, a + step]))
                m.append(np.zeros((len(size[k]), step), np.float32))
                m[k][rows[k][s], cols[k][s] - a] = 1
            both += m[0] @ m[1].T
        hit = 100 * both >= percent * (size[0][:, None] + size[1][None, :] - both)
        near = np.argwhere(np.triu(hit, 1) if alone else hit)
        root: dict[int, int] = {}
        out = []
        for i, j in near.tolist():
            a, b = ids[0][i], ids[1][j]
            ra, rb = a, b
            while root.get(ra, ra) != ra:
                root[ra] = ra = root.get(root[ra], root[ra])
            while root.get(rb, rb) != rb:
                root[rb] = rb = root.get(root[rb], root[rb])
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
        o = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(o[:, 0].copy()), pa.array(o[:, 1].copy())], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, at = [[], []], [[], []], None
        for b in batches:
            leaders, part, reps, s = b.column("leader").to_numpy(), b.column("part").to_numpy(), b.column("rep").to_numpy(), b.column("s")
            off, flat = s.offsets.to_numpy(), s.values.to_numpy().view(np.uint64)
            for k in range(len(b)):
                if leaders[k] != at:
                    if ids[0]:
                        yield links(ids, sets)
                    ids, sets, at = [[], []], [[], []], leaders[k]
                ids[part[k]].append(int(reps[k]))
                sets[part[k]].append(flat[off[k] : off[k + 1]].copy())
        if ids[0]:
            yield links(ids, sets)

    sent = send_sets(docs, todo, p, store).repartition("leader").sortWithinPartitions("leader", "part", "rep")
    return store.save(sent.mapInArrow(lean(compare), "a long, b long"), "links")


def link_classes(docs: DataFrame, members: DataFrame, sizes: DataFrame, p: Params, store: Store) -> DataFrame:
    """(a, b) links that connect every pair of candidate classes that is similar enough, directly or by others."""
    # first every bucket's members against its smallest one
    links = verify(docs, members.select("rep", "leader").distinct(), p, store)
    # what is left open lies among the others, where they are not in one component yet
    comp = components(links, store).withColumnRenamed("id", "rep").withColumnRenamed("component", "comp")
    state = members.join(comp, "rep", "left").select("bucket", "salt", "parts", "rep", F.coalesce("comp", "rep").alias("comp"))
    state = store.save(state, "state")
    open_ = state.groupBy("bucket", "parts").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket", "parts")
    rest = store.save(on_bucket(state, open_, "left_semi"), "rest")
    return links.union(block_links(docs, rest, sizes, p, store)) if rest.limit(1).count() else links


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, set_id (the smallest id with an equal set), and
    text_hash (xxhash64 of the text, which tells rows of one doc_id apart)."""
    store = Store(docs.sparkSession)
    sig = store.save(signatures(docs, p), "signatures")
    full = sig.filter("n_shingles > 0 and doc_id is not null")
    same = full.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    same = store.save(same, "classes")
    reps = full.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "lefts", "rights")
    members = bucket_members(table_keys(reps), p, store)
    sizes = full.select(F.col("doc_id").alias("rep"), "n_shingles")
    links = link_classes(docs, members, sizes, p, store)
    comp = store.save(components(links, store), "components")
    # only classes of several documents or with a link need a lookup; a hot class is dealt over salted keys
    salts = 16
    cls = same.join(comp.withColumnRenamed("id", "rep"), "rep", "left").filter("n > 1 or component is not null")
    cls = cls.select("d0", "d1", "rep", F.coalesce("component", "rep").alias("component"), F.explode(F.sequence(F.lit(0), F.when(F.col("n") > 64, salts - 1).otherwise(0))).alias("salt"), (F.col("n") > 64).alias("hot"))
    hot = cls.filter("hot and salt = 0").select("d0", "d1").withColumn("is_hot", F.lit(True))
    hot = small(hot, same.filter("n > 64").count(), 40)
    rows = sig.select("doc_id", "text_hash", "n_shingles", "d0", "d1").join(hot, ["d0", "d1"], "left")
    rows = rows.withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(0).cast("int"))
    out = rows.join(cls.drop("hot"), ["d0", "d1", "salt"], "left")
    out = out.select(
        "doc_id", "text_hash", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("set_id"),
    )
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "set_id", "text_hash")
