"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, lang, source). What a node can give is what its leaves hold times ``epochs``. From the root
down, a node's budget goes to its children by weight; a child that cannot take its share is filled up and the
shortage goes to its siblings, and only what a whole family cannot take has gone to the parent's siblings before,
because a parent never gets more than its family can give. Each leaf then takes whole seeded epochs of its
documents and, of the next epoch's seeded order, the longest prefix of documents that stays within the rest.

All amounts are whole tokens in whole-number arithmetic. Tables over leaves come from grouped sums. The prefix of
a leaf is found by sums over slices of the order's hash and, inside the one slice that holds the end, document by
document; so no leaf, however large, is sorted in one task.

Defined results: a NULL text has no tokens; NULL domain, language or source is the leaf value ``(none)``; a leaf
without tokens gets nothing (its documents have 0 copies); repeated rows count and are taken one by one, in one
order; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._store import Store, small

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Params:
    """``budget``: tokens to choose, as ``budget[0]`` parts in ``budget[1]`` of the corpus; ``weights``: whole numbers by
    level and name, ``other`` for the rest; ``epochs``: how often a leaf may be used at most; ``slices`` of the order."""

    budget: tuple[int, int] = (3, 5)
    weights: Mapping[str, Mapping[str, int]] = field(
        default_factory=lambda: {"domain": {"web": 5, "books": 3, "forum": 2}, "lang": {"en": 6, "de": 3, "fr": 3, "es": 2}, "source": {}}
    )
    other: int = 1
    epochs: int = 4
    seed: str = "mix-1"
    slices: int = 4096


def domain_of(source: Column) -> Column:
    """Domain by the number in a source's name."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1).try_cast("long") % 3
    return F.when(n == 0, "web").when(n == 1, "books").when(n == 2, "forum").otherwise("(none)")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(docs: DataFrame) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(docs["text"], F.coalesce(docs["lang"], F.lit("(none)")), F.coalesce(docs["source"], F.lit("(none)")))


def with_leaf(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id"), row_hash(docs).alias("row_hash"), domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("(none)")).alias("lang"), F.coalesce("source", F.lit("(none)")).alias("source"),
        tokens_of(F.col("text")).alias("tokens"),
    )


def weight_of(level: str, p: Params) -> Column:
    c = F.lit(p.other)
    for name, w in p.weights.get(level, {}).items():
        c = F.when(F.col(level) == name, w).otherwise(c)
    return c.cast("long")


def pour(children: DataFrame, parent: Sequence[str], level: str, p: Params) -> DataFrame:
    """``alloc`` for each child from its parent's ``budget``, by weight up to its ``cap``."""
    x = children.withColumn("w", weight_of(level, p))
    order = W.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), level) if parent else W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), level)
    whole = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    big = lambda c: c.cast("decimal(38,0)")
    x = x.withColumn("fits", big(F.col("cap")) * big(onward) <= big(F.col("budget") - before) * big(F.col("w")))
    x = x.withColumn("fits", F.min("fits").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    x = x.withColumns(
        {
            "left": F.col("budget") - F.sum(F.when(F.col("fits"), F.col("cap")).otherwise(0)).over(whole),
            "share": F.sum(F.when(F.col("fits"), 0).otherwise(F.col("w"))).over(whole),
        }
    )
    part = F.expr("cast(`left` as decimal(38,0)) * cast(w as decimal(18,0)) div nullif(share, 0)").cast("long")
    return x.withColumn("alloc", F.when(F.col("fits"), F.col("cap")).otherwise(F.least(F.col("cap"), part))).drop("w", "fits", "budget", "left", "share")


def budgets(slim: DataFrame, p: Params, store: Store) -> DataFrame:
    """One row per leaf: domain, lang, source, tokens, alloc."""
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    leaves = store.save(leaves.withColumn("cap", F.col("tokens") * p.epochs), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("cap"), F.lit(0)).alias("c")).first()
    budget = min(int(total["t"]) * p.budget[0] // p.budget[1], int(total["c"]))
    dom = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("budget", F.lit(budget))
    dom = pour(dom, [], "domain", p).select("domain", F.col("alloc").alias("budget"))
    lang = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(dom, "domain")
    lang = pour(lang, ["domain"], "lang", p).select("domain", "lang", F.col("alloc").alias("budget"))
    leaf = leaves.join(lang, ["domain", "lang"])
    return store.save(pour(leaf, ["domain", "lang"], "source", p).select(*LEVELS, "tokens", "alloc"), "budgets")


def order_key(p: Params, epoch: Column) -> Column:
    """The seeded order of one epoch."""
    return F.md5(F.concat_ws(":", F.lit(p.seed), epoch.cast("string"), F.col("doc_id").cast("string")))


def choose(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per document: doc_id, domain, lang, source, tokens, copies (how often it is taken), row_hash."""
    store = Store(docs.sparkSession)
    slim = store.save(with_leaf(docs), "slim")
    leaf = budgets(slim, p, store)
    n = leaf.count()
    leaf = leaf.withColumnRenamed("tokens", "leaf_tokens")
    full = F.coalesce(F.expr("alloc div nullif(leaf_tokens, 0)"), F.lit(0)).cast("long")
    leaf = leaf.withColumn("epoch", full).withColumn("rest", F.col("alloc") - F.col("epoch") * F.col("leaf_tokens"))
    rows = slim.join(small(leaf, n, 120), list(LEVELS))
    rows = rows.withColumn("k", order_key(p, F.col("epoch"))).withColumn("slice", F.conv(F.substring("k", 1, 8), 16, 10).cast("long") % p.slices)
    # the order is by slice, then by key: the slice comes first so that its sums can be taken apart from it
    sums = rows.groupBy(*LEVELS, "slice").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    w = W.partitionBy(*LEVELS).orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = sums.withColumn("upto", F.sum("t").over(w))
    cut = sums.filter("upto > rest").groupBy(*LEVELS).agg(F.min("slice").alias("cut"), F.min_by(F.col("upto") - F.col("t"), "slice").alias("before"))
    cut = store.save(cut, "cuts")
    rows = rows.join(small(cut, n, 120), list(LEVELS), "left")
    inside = W.partitionBy(*LEVELS).orderBy("k", "doc_id", "row_hash").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = rows.filter("slice = cut").withColumn("run", F.col("before") + F.sum("tokens").over(inside))
    # the prefix ends at the first document that would go beyond the rest
    edge = edge.withColumn("over", F.max((F.col("run") > F.col("rest")).cast("int")).over(inside)).withColumn("more", F.col("over") == 0)
    rest = rows.filter("cut is null or slice <> cut").withColumn("more", (F.col("leaf_tokens") > 0) & (F.col("cut").isNull() | (F.col("slice") < F.col("cut"))) & (F.col("rest") > 0))
    cols = ["doc_id", "row_hash", *LEVELS, "tokens", "epoch", "more"]
    both = rest.select(*cols).unionByName(edge.withColumn("more", F.col("more") & (F.col("rest") > 0)).select(*cols))
    return both.select("doc_id", *LEVELS, "tokens", (F.col("epoch") + F.col("more").cast("long")).alias("copies"), "row_hash")


def mix(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The chosen documents with all their columns and ``copies``, which replaces a column of that name.

    Rows that agree in doc_id, text, lang and source become one, which has the copies of all of them.
    """
    store = Store(docs.sparkSession)
    docs = docs.drop("copies")
    picked = choose(docs, p).groupBy("doc_id", "row_hash").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0")
    picked = store.save(picked.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "copies", "rows"), "picked")
    shape = picked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("rows"), F.lit(0)).alias("most")).first()
    # the document's own columns stay inside ``row``, so that no name can clash
    rows = docs.select(F.col("doc_id").alias("_own"), row_hash(docs).alias("_key"), F.struct(*docs.columns).alias("row"))
    out = rows.join(small(picked, shape["n"], 48), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_hash")))
    if shape["most"] > 1:
        out = out.filter("rows = 1").unionByName(out.filter("rows > 1").dropDuplicates(["_id", "_hash"]))
    return out.select("row.*", "copies")
