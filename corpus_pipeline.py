"""The corpus pipeline: documents to a mixture of clean, distinct, uncontaminated ones.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the result is written as Parquet in
the shared folder and read again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, langid, mixing, neardup, substrings
from strandline.llm._store import Store, small

#: A document is rejected by language ID without a language, or if less than this share of its n-grams is in it.
LEAST_LANGUAGE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; ``lang`` stays what it was.

    Rows are judged one by one by their text, also those with NULL or repeated doc_ids. NULL, empty and letterless
    texts have no language and go; very long ones are read whole; an empty table stays empty; columns come through as
    they are, whatever their names.
    """
    found = langid.identify(docs, carry=True)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest doc_id.

    A NULL doc_id links with nothing and stays; texts without words stay; of rows with one doc_id each distinct text is
    judged for itself, and of those that agree in both one stays; an empty table stays empty; extra columns come along.
    """
    store = Store(spark)
    found = store.save(neardup.near_duplicates(docs).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "kept"), "found")
    per = found.filter("_id is not null").groupBy("_id", "_hash").agg(F.every("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    odd = store.save(per.filter("not kept or n > 1"), "odd")
    count = odd.agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("again")).first()
    odd = small(odd, count["n"], 32)
    # the document's own columns stay inside ``row``, so that no name can clash
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.struct(*docs.columns).alias("row"))
    out = rows.join(odd, ["_id", "_hash"], "left_anti")
    if count["again"]:
        out = out.unionByName(rows.join(odd.filter("kept").select("_id", "_hash"), ["_id", "_hash"]).dropDuplicates(["_id", "_hash"]))
    return out.select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; a document with nothing left goes.

    Texts without repeats stay as they are, NULL and empty ones too; a NULL doc_id and rows of one doc_id take nothing
    from each other; an empty table stays empty; extra columns come along.
    """
    x = substrings.remove_repeats(docs, carry=True).filter("n_removed = 0 or n_words > n_removed")
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return x.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Rows are judged one by one by their whole text, also those with NULL or repeated doc_ids; NULL and empty texts are
    clean; an empty table stays empty; columns come through as they are.
    """
    return decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True).filter("kept").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights choose, with ``copies``.

    A NULL doc_id is taken like any other; a text without tokens costs nothing and comes as often as its leaf does; rows
    that agree in doc_id, text, lang and source become one with the copies of all; a column named ``copies`` is replaced; an empty table stays empty.
    """
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmarks", benchmarks),
    ("mixture", mixture),
]

ORACLE_SQL = None  # language ID and shingle sets are beyond SQL; tests hold run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    store = Store(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.save(docs, name)
    return docs
