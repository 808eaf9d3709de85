"""The corpus pipeline: five stages over ``documents``, each an operator of tessera.llm.

Each stage reads what the one before kept.  All but the last return the columns of
documents.  Rejected documents and repeats are gone, secrets are replaced by a mark,
the mix decides how often a document comes, and the last stage gives each document's
tokens as digests with that number of copies already laid out as rows.

Cases: null and empty texts are scored like others, are near-duplicates of nothing and
have no words for the mix to take; rows without an id are judged and compared like
others; of equal rows (same id, same text) near-dedup keeps one; rows that share an id
and differ in text are different documents; texts of any length are whole; an empty
table gives no rows; extra columns, whatever their names, pass through to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, minhash, mixing, quality, secret_scan
from tessera.llm.common import discard, positional, save, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among docs."""
    return docs.where(quality.score_of(docs, table(spark, sf_dir, "labels")) >= quality.THRESHOLD)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, null last (five-word shingles, similarity 0.8)."""
    d, names = positional(docs), docs.columns
    doc_id, text = F.col(f"_{names.index('doc_id')}"), F.col(f"_{names.index('text')}")
    marked = d.withColumn("__row", F.xxhash64(F.lit(1), doc_id, doc_id.isNull(), text))
    groups = minhash.near_duplicates(marked.select("__row", text.alias("text")), key="__row").select("__row", "component_id").distinct()
    ids = marked.groupBy("__row").agg(F.min(doc_id).alias("id"), F.count(F.lit(1)).alias("n"))
    firsts = groups.join(ids, "__row").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("null_id"), "id", "__row", "n")).alias("first"))
    firsts = save(firsts.select("first.__row", "first.n"), "firsts")
    kept = marked.join(firsts.select("__row"), "__row", "left_semi")
    if firsts.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["__row"])
    return kept.select(*d.columns).toDF(*names)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets replaced by a mark."""
    clean = secret_scan.redact(docs)
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return clean.withColumn("n_chars", F.length("text").cast(kind)) if kind else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, as rows; documents that the mix does not take are left out."""
    d, names = positional(docs), docs.columns
    # equal rows have one mark and are interchangeable; nulls are hashed by place, as hashes skip them
    parts = [x for c in d.columns for x in (F.col(c), F.col(c).isNull())]
    marked = d.withColumns({"__r1": F.xxhash64(*parts), "__r2": F.xxhash64(F.lit(1), *reversed(parts))})
    columns = {x: f"_{names.index(c)}" for x, c in (("key", "doc_id"), ("text", "text"), ("source", "source"))}
    copies = mixing.mix(marked, **columns, beside=("__r1", "__r2")).where("copies > 0").groupBy("__r1", "__r2").agg(F.sum("copies").alias("__copies"))
    once = marked.dropDuplicates(["__r1", "__r2"]).join(copies, ["__r1", "__r2"])
    each = once.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return each.select(*d.columns).toDF(*names)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of the mix."""
    return bpe.encoded_digests(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", tokens_stage),
]

#: No SQL: several stages are learned or iterative; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            made = save(made, f"stage{k}")
            discard(docs)  # the stage before
        docs = made
    return docs
