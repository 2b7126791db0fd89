"""Embedding near-duplicates by NN-descent.

A neighbour graph of ``k`` entries per vector starts from blocks of vectors that lie side by side in the order of
random hyperplane signatures (several orders, so that an edge of a block in one is inside a block in another), and is
refined through neighbours of neighbours: around each vector its neighbours, in both directions, are compared
with each other, and every vector keeps its best. Rounds end when they find hardly any new link. A vector whose
whole list is at or above the threshold is saturated; lists are then enlarged to all of the vector's component, in
tiles that are compared as matrix products and return counts and not pairs. Tiles of different components with
saturated vectors are compared too, unless their balls (centre and largest angle) lie too far apart for any link, and
components that link are joined.

Recall is audited twice. Probes, made-up neighbours near the threshold of a bounded set of vectors, go through the
whole search and show how often an isolated pair is found; and a bounded set of vectors, half of it with a known link, is
held against all others by brute force. Below ``recall`` in either, further rounds follow, each with new orders. If it is
still not reached, all vectors are compared exactly in tiles.

Equal vectors are one class with a weight, so copies cost nothing. Similarities are in double precision.

Defined results: NULL, empty or zero vectors, and those with NULL or non-finite components, link with nothing and
are their own component; vectors of different lengths never link; every row comes out once; rows that agree in vec_id
and vector count as one; several vectors of one vec_id are judged each for itself; NULL vec_ids keep NULL and link with
nothing; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._store import Store, lean
from ._text import to_list

LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class Params:
    """``threshold``; list length ``k``; at least ``orders`` of ``bits`` hyperplanes, cut into blocks of ``block``; ``rounds`` at
    most and ``more`` if the audit asks for them; ``around``: members compared at once around a vector; ``tile``:
    vectors of a tile; ``audit``: vectors held against all; ``recall`` to reach."""

    threshold: float = 0.9
    k: int = 10
    orders: int = 4
    bits: int = 60
    block: int = 512
    rounds: int = 3
    more: int = 3
    around: int = 48
    tile: int = 256
    audit: int = 256
    recall: float = 0.995
    seed: int = 3


def matrix(col: pa.Array) -> np.ndarray:
    """A list column of one common length as a matrix of doubles."""
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def best_of(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a square similarity matrix its ``k`` best others, as ids and values."""
    sim[ids[:, None] == ids] = -2  # an id may stand in a block twice, where one order ends and the next begins
    k = min(k, len(ids) - 1)
    if k <= 0:
        return np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
    at = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return ids[at], np.take_along_axis(sim, at, axis=1)


def lists(ids: np.ndarray, nb: list[np.ndarray], sim: list[np.ndarray]) -> pa.RecordBatch:
    size = np.array([len(x) for x in nb])
    flat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
    return pa.RecordBatch.from_arrays([pa.array(ids), to_list(flat(nb, np.int64), size, pa.int64()), to_list(flat(sim, np.float32), size, pa.float32())], names=["id", "nb", "sim"])


LIST = "id long, nb array<long>, sim array<float>"


def orders_of(n: int, p: Params) -> int:
    """Signature orders for ``n`` vectors: so many that a pair right at the threshold, with no neighbours to help, shares a
    block of one of them with a chance of ``recall``; ``orders`` at least.

    A bit of the signature splits a pair with its angle over pi; a block holds vectors that agree in about
    log2(n / block) leading bits.
    """
    together = (1 - np.arccos(p.threshold) / np.pi) ** max(0.0, np.log2(max(n, 1) / p.block))
    return max(p.orders, int(np.ceil(np.log(1 - p.recall) / np.log1p(-together)))) if together < 1 else p.orders


def start_lists(v: DataFrame, p: Params, first: int, orders: int) -> DataFrame:
    """Candidate lists from blocks of ``orders`` orders from number ``first`` on."""
    bits, seed = p.bits, p.seed

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = matrix(b.column("v"))
            for t in range(first, first + orders):
                planes = np.random.default_rng((seed, t, x.shape[1])).standard_normal((x.shape[1], bits))
                key = ((x @ planes > 0) * (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), t, np.int32)), pa.array(key), b.column("id"), b.column("v")], names=["ord", "key", "id", "v"])

    rows = v.select("id", "v").mapInArrow(lean(sign), f"ord int, key long, id long, v {dict(v.dtypes)['v']}")
    # a range split deals the order out evenly, however many vectors share a signature
    rows = rows.repartitionByRange("ord", "key", "id").sortWithinPartitions("ord", "key", "id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            b = pa.Table.from_batches([kept, b]).combine_chunks().to_batches()[0] if kept is not None and len(kept) else b
            whole = len(b) // p.block * p.block
            if whole:
                yield from one(b.slice(0, whole))
            kept = b.slice(whole)
        if kept is not None and len(kept):
            yield from one(kept)

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, x = b.column("id").to_numpy(), unit(matrix(b.column("v")))
        out_i, out_n, out_s = [], [], []
        for a in range(0, len(b), p.block):
            s = slice(a, min(a + p.block, len(b)))
            nb, sim = best_of(x[s] @ x[s].T, ids[s], 6)
            out_i.append(ids[s])
            out_n += list(nb)
            out_s += list(sim)
        yield lists(np.concatenate(out_i), out_n, out_s)

    return rows.mapInArrow(lean(blocks), LIST)


def merge_lists(parts: DataFrame, k: int) -> DataFrame:
    """One list of the ``k`` best distinct entries per id from several."""
    g = parts.groupBy("id").agg(F.flatten(F.collect_list("nb")).alias("nb"), F.flatten(F.collect_list("sim")).alias("sim"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nb, sim = b.column("nb"), b.column("sim")
            off, n, s = nb.offsets.to_numpy(), nb.values.to_numpy(), sim.values.to_numpy()
            ids = b.column("id").to_numpy()
            out_n, out_s = [], []
            for i in range(len(b)):
                x, y = n[off[i] : off[i + 1]], s[off[i] : off[i + 1]]
                other = x != ids[i]
                x, y = x[other], y[other]
                u, first = np.unique(x, return_index=True)
                o = np.lexsort((u, -y[first]))[:k]
                out_n.append(u[o])
                out_s.append(y[first][o])
            yield lists(ids, out_n, out_s)

    return g.mapInArrow(lean(run), LIST)


def exact_lists(v: DataFrame, n: int, p: Params, store: Store) -> DataFrame:
    """Lists from comparing all vectors, tile against tile; each keeps at most its ``k`` best links of a pair of tiles."""
    slots = max(1, -(-n // (4 * p.tile)))
    x = v.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(slots))).groupBy("a").agg(F.collect_list(F.struct("id", "v")).alias("ta"))
    tiles = store.save(x, "all")
    left = tiles.select("a", "ta", F.explode(F.sequence(F.col("a"), F.lit(slots - 1).cast("long"))).alias("b"))
    both = left.join(tiles.select(F.col("a").alias("b"), F.col("ta").alias("tb")), "b").select("a", "b", "ta", "tb")
    k, t = p.k, p.threshold - 1e-4

    def half(ids: np.ndarray, others: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero((sim >= t).any(axis=1))
        best = [np.argsort(-sim[i], kind="stable")[:k] for i in some.tolist()]
        best = [o[sim[i, o] >= t] for i, o in zip(some.tolist(), best, strict=True)]
        return lists(ids[some], [others[o] for o in best], [sim[i, o] for i, o in zip(some.tolist(), best, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                one = batch.slice(r, 1)
                fa, fb = one.column("ta").flatten(), one.column("tb").flatten()
                ia, ib = fa.field(0).to_numpy(), fb.field(0).to_numpy()
                sim = unit(matrix(fa.field(1))) @ unit(matrix(fb.field(1))).T
                if one.column("a")[0].as_py() == one.column("b")[0].as_py():
                    np.fill_diagonal(sim, -2)
                    yield half(ia, ib, sim)
                else:
                    yield half(ia, ib, sim)
                    yield half(ib, ia, sim.T)

    return both.mapInArrow(lean(run), LIST)


def descend(graph: DataFrame, v: DataFrame, p: Params, turn: int) -> DataFrame:
    """Candidate lists from comparing, around every vector, its neighbours in both directions with each other."""
    pairs = graph.select("id", F.explode("nb").alias("n"))
    members = pairs.select(F.col("id").alias("c"), F.col("n").alias("id")).union(pairs.select(F.col("n").alias("c"), "id")).distinct()
    x = members.join(v.select("id", "v"), "id")
    # a vector that many others name has its members cut into shuffled stretches, so no centre is unbounded
    x = x.withColumn("o", F.xxhash64("id", F.lit(turn))).repartition("c").sortWithinPartitions("c", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            b = pa.Table.from_batches([kept, b]).combine_chunks().to_batches()[0] if kept is not None else b
            c = b.column("c").to_numpy()
            edge = int(np.searchsorted(c, c[-1])) if len(c) and c[0] != c[-1] and (np.diff(c) >= 0).all() else 0
            if edge == 0 and len(b) and c[0] != c[-1]:
                edge = len(c) - 1 - int(np.argmax(c[::-1] != c[-1])) + 1
            if len(b) - edge > 20_000:  # one centre's members fill the batch: hand over what is there
                edge = len(b)
            yield from one(b.slice(0, edge))
            kept = b.slice(edge)
        if kept is not None:
            yield from one(kept)

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if len(b) < 2:
            return
        c, ids, x = b.column("c").to_numpy(), b.column("id").to_numpy(), unit(matrix(b.column("v")))
        cut = np.concatenate(([0], np.flatnonzero(np.diff(c)) + 1, [len(c)]))
        out_i, out_n, out_s, held = [], [], [], 0
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            for a in range(lo, hi, p.around):
                z = min(a + p.around, hi)
                if z - a < 2:
                    continue
                nb, sim = best_of(x[a:z] @ x[a:z].T, ids[a:z], 4)
                out_i.append(ids[a:z])
                out_n += list(nb)
                out_s += list(sim)
                held += z - a
            if held > 20_000:
                yield lists(np.concatenate(out_i), out_n, out_s)
                out_i, out_n, out_s, held = [], [], [], 0
        if out_i:
            yield lists(np.concatenate(out_i), out_n, out_s)

    return x.mapInArrow(lean(run), LIST)


def link_count(graph: DataFrame, t: float) -> int:
    return graph.select(F.sum(F.size(F.filter("sim", lambda s: s >= t - 1e-4)))).first()[0] or 0


def brute(v: DataFrame, queries: np.ndarray, ids: np.ndarray, t: float) -> dict[int, set[int]]:
    """Links of a bounded set of vectors against all, tile by tile where the vectors are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                i = b.column("id").to_numpy()
                hit = np.argwhere(unit(matrix(b.column("v"))) @ queries.T >= t)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit[:, 1]]), pa.array(i[hit[:, 0]])], names=["q", "id"])

    got: dict[int, set[int]] = {}
    for r in v.select("id", "v").mapInArrow(lean(run), "q long, id long").filter("q <> id").groupBy("q").agg(F.collect_list("id").alias("ids")).collect():
        got[r["q"]] = set(r["ids"])
    return got


def tile_parts(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, weights and unit vectors of a tile."""
    f = col.flatten()
    return f.field(0).to_numpy(), f.field(1).to_numpy().astype(np.int64), unit(matrix(f.field(2)))


def tiles_of(v: DataFrame, comp: DataFrame, p: Params, store: Store) -> DataFrame:
    """(component, slot, slots, t): members of each component, dealt to tiles by a hash."""
    sized = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    x = v.join(comp, "id").join(sized, "component")
    # tiles: members dealt by a hash of the component's size into slots of about ``tile``
    slots = F.greatest(F.lit(1), F.ceil(F.col("n") / p.tile)).cast("long")
    x = x.withColumn("slot", F.pmod(F.xxhash64("id"), slots)).withColumn("slots", slots)
    return store.save(x.groupBy("component", "slot", "slots").agg(F.collect_list(F.struct("id", "m", "v")).alias("t")), "tiles")


def tile_counts(tiles: DataFrame, p: Params) -> DataFrame:
    """(id, n_links) inside components that hold a saturated vector, tile against tile.

    Only tiles of one component meet; each pair of tiles is one matrix product and returns one count per vector, never
    pairs.
    """
    other = F.explode(F.sequence(F.col("slot"), F.col("slots") - 1))
    left = tiles.select("component", F.col("slot").alias("a"), other.alias("b"), F.col("t").alias("ta"))
    right = tiles.select("component", F.col("slot").alias("b"), F.col("t").alias("tb"))
    pairs = left.join(right, ["component", "b"])
    t = p.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                a, b = int(one.column("a")[0].as_py()), int(one.column("b")[0].as_py())
                ia, wa, xa = tile_parts(one.column("ta"))
                ib, wb, xb = (ia, wa, xa) if a == b else tile_parts(one.column("tb"))
                near = xa @ xb.T >= t
                ids, n = ia, near @ wb
                if a == b:
                    n = n - wa  # a vector is no link of itself; its copies are counted with its class
                else:
                    ids, n = np.concatenate((ia, ib)), np.concatenate((n, wa @ near))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], names=["id", "n"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(lean(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def cross_counts(tiles: DataFrame, p: Params, store: Store) -> DataFrame:
    """(id, n, a, b): links of a vector into another component, ``a`` and ``b`` the two components; exact.

    A tile is a ball on the sphere. Two tiles can hold a link only if the angle of their centres is at most both
    radii and the angle of the threshold; those pairs are compared.
    """
    t, reach = p.threshold, float(np.arccos(p.threshold)) + 1e-6

    def ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                x = tile_parts(one.column("t"))[2]
                c = unit(x.mean(axis=0, keepdims=True))
                r = float(np.arccos(np.clip(x @ c[0], -1, 1)).max())
                yield pa.RecordBatch.from_arrays([one.column("component"), one.column("slot"), to_list(c[0], np.array([x.shape[1]]), pa.float64()), pa.array([r])], names=["component", "slot", "c", "r"])

    balls = store.save(tiles.select("component", "slot", "t").mapInArrow(lean(ball), "component long, slot long, c array<double>, r double"), "balls")
    n = max(1, -(-balls.count() // 1024))
    blocks = balls.withColumn("g", F.pmod(F.xxhash64("component", "slot"), F.lit(n))).groupBy("g").agg(F.collect_list(F.struct("component", "slot", "c", "r")).alias("t"))
    blocks = store.save(blocks, "blocks")
    left = blocks.select("g", F.col("t").alias("ta"), F.explode(F.sequence(F.col("g"), F.lit(n - 1).cast("long"))).alias("h"))
    both = left.join(blocks.select(F.col("g").alias("h"), F.col("t").alias("tb")), "h")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                fa, fb = one.column("ta").flatten(), one.column("tb").flatten()
                (ca, sa, xa, ra), (cb, sb, xb, rb) = (((f.field(0).to_numpy(), f.field(1).to_numpy(), matrix(f.field(2)), f.field(3).to_numpy())) for f in (fa, fb))
                hit = (np.arccos(np.clip(xa @ xb.T, -1, 1)) <= ra[:, None] + rb + reach) & (ca[:, None] != cb)
                if one.column("g")[0].as_py() == one.column("h")[0].as_py():
                    hit &= ca[:, None] < cb
                i, j = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array(ca[i]), pa.array(sa[i]), pa.array(cb[j]), pa.array(sb[j])], names=["ca", "sa", "cb", "sb"])

    near = store.save(both.select("g", "h", "ta", "tb").mapInArrow(lean(meet), "ca long, sa long, cb long, sb long"), "meet")
    near = near.join(tiles.select(F.col("component").alias("ca"), F.col("slot").alias("sa"), F.col("t").alias("ta")), ["ca", "sa"])
    near = near.join(tiles.select(F.col("component").alias("cb"), F.col("slot").alias("sb"), F.col("t").alias("tb")), ["cb", "sb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                (ia, wa, xa), (ib, wb, xb) = tile_parts(one.column("ta")), tile_parts(one.column("tb"))
                link = xa @ xb.T >= t
                ids, m = np.concatenate((ia, ib)), np.concatenate((link @ wb, wa @ link)).astype(np.int64)
                ids, m = ids[m > 0], m[m > 0]
                a, b = (np.full(len(ids), one.column(c)[0].as_py(), np.int64) for c in ("ca", "cb"))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(m), pa.array(a), pa.array(b)], names=["id", "n", "a", "b"])

    return store.save(near.select("ca", "cb", "ta", "tb").mapInArrow(lean(run), "id long, n long, a long, b long"), "cross")


def near_duplicates(table: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = table.sparkSession
    store = Store(spark)
    src = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    # equal vectors are one class, found by their bytes
    src = src.withColumn("h", F.when(fine, F.sha2(F.to_json(F.struct(F.transform("v", lambda x: x.cast("string")))), 256)))
    rows = store.save(src.select("vec_id", "h"), "rows")
    v = src.filter("h is not null").groupBy("h").agg(F.min("vec_id").alias("low"), F.first("v").alias("v"))
    weight = rows.filter("h is not null").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("m"))
    v = store.save(v.join(weight, "h"), "classes")
    # a class goes by its smallest vec_id; where several classes have the same one, the others get numbers of their own
    shared = store.save(v.groupBy("low").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("low", F.col("h").alias("h0")), "shared")
    if shared.limit(1).count():
        top = v.agg(F.max("low").alias("top"), F.min("low").alias("least")).first()
        more = v.join(shared, "low").filter("h <> h0").select("h")
        more = store.save(more.select("h", F.monotonically_increasing_id().alias("k")), "numbers")
        most = more.agg(F.max("k")).first()[0]
        fresh = F.lit(top["top"] + 1) + F.col("k") if top["top"] + 1 + most < 1 << 63 else F.lit(top["least"] - 1) - F.col("k")
        v = store.save(v.join(more.select("h", fresh.alias("fresh")), "h", "left").select("h", F.coalesce("fresh", "low").alias("id"), "low", "v", "m"), "vectors")
    else:
        v = v.select("h", F.col("low").alias("id"), "low", "v", "m")
    dims = [r["d"] for r in v.select(F.size("v").alias("d")).distinct().collect()]
    found = [links_of(v.filter(F.size("v") == d) if len(dims) > 1 else v, p, store) for d in dims]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    both = found[0]
    for x in found[1:]:
        both = both.union(x)
    cls = v.select("h", "id", "low", "m").join(both, "id", "left")
    root = cls.filter("component is not null").groupBy("component").agg(F.min("low").alias("root"))
    cls = cls.join(root, "component", "left").select("h", (F.coalesce("n_links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "low").alias("component_id"))
    out = rows.join(cls, "h", "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("vec_id") == comp).alias("kept"))


def links_of(v: DataFrame, p: Params, store: Store) -> DataFrame:
    """(id, n_links, component) of the classes that link with another one."""
    t = p.threshold
    n = v.count()
    pairs, probes = probes_of(v, p)
    searched = store.save(v.select("id", "v").unionByName(probes) if pairs else v.select("id", "v"), "searched")
    used = orders_of(n, p)
    graph = store.save(merge_lists(start_lists(searched, p, 0, used), p.k), "graph")
    seen, truth, reached = link_count(graph, t), None, False
    for turn in range(1, p.rounds + p.more + 1):
        found = graph.union(descend(graph, searched, p, turn))
        if truth is not None:  # the audit was not content: look in new orders too
            fresh = max(p.orders, used // 4)
            found = found.union(start_lists(searched, p, used, fresh))
            used += fresh
        graph = store.save(merge_lists(found, p.k), "graph")
        now = link_count(graph, t)
        settled = now <= seen * 1.001
        seen = now
        if settled or turn >= p.rounds:
            truth = truth if truth is not None else truth_of(graph, v, p)
            got = [r for r in (recall_of(graph, pairs, p), recall_of(graph, truth, p)) if r is not None]
            LOG.info("round %d: %d links, recall %s", turn, now, got)
            reached = bool(got) and min(got) >= p.recall
            if reached:
                break
    full = graph.filter((F.size("nb") >= p.k) & (F.element_at("sim", -1) >= t - 1e-4)).select("id")
    if pairs:  # the probes leave before links are counted
        lo, hi = min(x for _, x in pairs), max(x for _, x in pairs)
        real = lambda c: ~F.col(c).between(lo, hi)
        both = F.filter(F.arrays_zip("nb", "sim"), lambda x: ~x["nb"].between(lo, hi))
        graph = graph.filter(real("id")).select("id", both.alias("x")).select("id", F.col("x.nb").alias("nb"), F.col("x.sim").alias("sim"))
        full = full.filter(real("id"))
    if not reached:
        LOG.warning("recall %s not reached on %d vectors: comparing all of them", p.recall, n)
        graph = store.save(merge_lists(graph.union(exact_lists(v, n, p, store)), p.k), "graph")
        full = full.union(graph.filter((F.size("nb") >= p.k) & (F.element_at("sim", -1) >= t - 1e-4)).select("id"))
    links = graph.select("id", F.explode(F.arrays_zip("nb", "sim")).alias("x")).select("id", F.col("x.nb").alias("n"), F.col("x.sim").alias("s")).filter(F.col("s") >= t - 1e-4)
    # the lists carry single precision; what is kept is decided in double precision
    pairs = links.select(F.greatest("id", "n").alias("a"), F.least("id", "n").alias("b")).distinct()
    a, b = v.select(F.col("id").alias("a"), F.col("v").alias("va")), v.select(F.col("id").alias("b"), F.col("v").alias("vb"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if len(x):
                s = np.einsum("ij,ij->i", unit(matrix(x.column("va"))), unit(matrix(x.column("vb"))))
                yield x.select(["a", "b"]).filter(pa.array(s >= t))

    pairs = store.save(pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb").mapInArrow(lean(exact), "a long, b long"), "links")
    comp = store.save(components(pairs, store), "components")
    deep = comp.join(full.distinct(), "id", "left_semi").select("component").distinct()
    deep = store.save(comp.join(deep, "component", "left_semi"), "saturated")
    # enlarged lists: for vectors of a component with a saturated member all of it is compared, in tiles
    tiles = tiles_of(v.select("id", "m", "v"), deep, p, store)
    # two saturated vectors may link although neither list has room for the other: such components are joined
    cross = cross_counts(tiles, p, store)
    inner = tile_counts(tiles, p).union(cross.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(cross.select("a", "b").distinct(), store).select(F.col("id").alias("component"), F.col("component").alias("to"))
    comp = comp.join(joined, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    w = v.select("id", "m")
    ends = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    plain = ends.join(deep.select(F.col("id").alias("a")), "a", "left_anti").join(w.select(F.col("id").alias("b"), "m"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("m").alias("n"))
    return inner.unionByName(plain).withColumnRenamed("n", "n_links").join(comp, "id")


def probes_of(v: DataFrame, p: Params) -> tuple[list[tuple[int, int]], DataFrame | None]:
    """Made-up vectors for the audit: (vector, its probe) pairs and the probes (id, v).

    Each of ``audit`` vectors gets a neighbour between the threshold and halfway to 1, in a random direction. Probes are
    searched for like any vector, so their recall is that of the hardest case, a pair with no other neighbours.
    """
    rows = v.select("id", "v").orderBy(F.xxhash64("id", F.lit(p.seed + 1))).limit(p.audit).toArrow()
    x = unit(matrix(rows.column("v").combine_chunks())) if rows.num_rows else np.zeros((0, 0))
    if x.shape[1] < 2:
        return [], None
    rng = np.random.default_rng(p.seed)
    away = rng.standard_normal(x.shape)
    away = unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    c = p.threshold + (1 - p.threshold) * (0.001 + 0.499 * rng.random((len(x), 1)))
    y = c * x + np.sqrt(1 - c * c) * away
    ends = v.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    first = ends["hi"] + 1 if ends["hi"] + len(x) < 1 << 63 else ends["lo"] - len(x)
    ids = [first + k for k in range(len(x))]
    made = v.sparkSession.createDataFrame([(i, r.tolist()) for i, r in zip(ids, y, strict=True)], "id long, v array<double>")
    return list(zip(rows.column("id").to_pylist(), ids, strict=True)), made.select("id", F.col("v").cast(v.schema["v"].dataType).alias("v"))


def truth_of(graph: DataFrame, v: DataFrame, p: Params) -> list[tuple[int, int]]:
    """All true links of a bounded set of vectors, half of it vectors with a link in their list."""
    known = graph.filter(F.exists("sim", lambda s: s >= p.threshold)).select("id").join(v.select("id"), "id", "left_semi")
    some = lambda x, k: x.select("id").orderBy(F.xxhash64("id", F.lit(p.seed))).limit(k)
    chosen = some(v, p.audit - p.audit // 2).union(some(known, p.audit // 2)).distinct()
    rows = v.join(F.broadcast(chosen), "id").select("id", "v").toArrow()
    ids = rows.column("id").to_numpy()
    found = brute(v, unit(matrix(rows.column("v").combine_chunks())), ids, p.threshold) if len(ids) else {}
    return [(i, n) for i, x in found.items() for n in sorted(x)]


def recall_of(graph: DataFrame, pairs: list[tuple[int, int]], p: Params) -> float | None:
    """Share of the links that a list of either end holds or that join two saturated ends; None without links."""
    if not pairs:
        return None
    spark = graph.sparkSession
    want = spark.createDataFrame(pairs, "a long, b long")
    near = F.transform(F.filter(F.arrays_zip("nb", "sim"), lambda x: x["sim"] >= p.threshold - 1e-4), lambda x: x["nb"])
    end = lambda c: graph.select(F.col("id").alias(c), near.alias(f"n{c}"))
    x = want.join(end("a"), "a", "left").join(end("b"), "b", "left")
    held = F.array_contains("na", F.col("b")) | F.array_contains("nb", F.col("a")) | ((F.size("na") >= p.k) & (F.size("nb") >= p.k))
    return x.agg(F.count_if(F.coalesce(held, F.lit(False))) / F.count(F.lit(1))).first()[0]


__all__ = ["Params", "near_duplicates"]
