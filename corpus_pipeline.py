"""A training corpus from the raw documents: five stages, each over all that the one before kept.

Toxic documents go, of near duplicates one stays, documents that hold benchmark passages go, personal data is masked, and
what is left becomes token ids. Every stage but the last returns the columns of ``documents``. Each result is written as
Parquet to the shared folder and read again, so a lost executor costs one stage at most.

Rows equal in id and text are one document. Null texts count as empty; they have no toxic words, no shingles and no
benchmark words, so they stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, ngram_join, pii, queries, tables, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; null and empty texts are clean, and without labels all stay."""
    model = queries.toxicity_model(docs, tables.table(spark, sf_dir, "labels"))
    plain, back = tables.set_aside(docs, ("score", "predicted", "margins"))
    return back(toxicity.score(plain, model).filter("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates; rows equal in id and text are one, null and empty texts stay."""
    found = tables.keep(ngram_join.near_duplicates(docs).select("doc_id", "tag", "kept"), "pipeline-near")
    groups = found.groupBy("doc_id", "tag").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    groups = tables.keep(groups.filter("n > 1 OR NOT kept"), "pipeline-copies")
    gone, same = tables.same_document(groups.filter("NOT kept").select("doc_id", "tag"))
    plain, back = tables.set_aside(docs, tables.KEY_NAMES)
    left = tables.keyed(plain).join(tables.sent(gone), same, "left_anti")
    if groups.filter("n > 1 AND kept").count():
        left = left.dropDuplicates(["_id", "_tag"])
    return back(left)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; null and empty texts have none."""
    found = decontaminate.contaminated_words(docs, tables.table(spark, sf_dir, "benchmark"))
    found = tables.keep(found.filter(F.size("spans") > 0).select("doc_id", "tag").distinct(), "pipeline-leaks")
    gone, same = tables.same_document(found)
    plain, back = tables.set_aside(docs, tables.KEY_NAMES)
    return back(tables.keyed(plain).join(tables.sent(gone), same, "left_anti"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and the number of characters counted again; a text without any,
    null or not, stays as it is."""
    found = pii.find(docs).filter(F.size("spans") > 0).select("doc_id", "tag", F.col("spans").alias("_spans"))
    found = tables.keep(found.dropDuplicates(["doc_id", "tag"]), "pipeline-pii")
    found, same = tables.same_document(found)
    plain, back = tables.set_aside(docs, (*tables.KEY_NAMES, "_spans"))
    joined = tables.keyed(plain).join(tables.sent(found), same, "left")
    none = F.col("_spans").isNull()
    masked = joined.withColumn("text", F.when(none, F.col("text")).otherwise(pii.mask(F.col("text"), F.col("_spans"))))
    counted = F.when(none, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return back(masked.withColumn("n_chars", counted))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and a digest of the text that they decode to.

    The ids are written before they are decoded: in one stage every task would need two Python workers at a time.
    """
    vocabulary = bpe.Vocabulary.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary, public_tokenizers.PATTERN)
    decoded = bpe.decode(tables.keep(encoded.drop("text"), "pipeline-ids"), vocabulary)
    return decoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("text_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", mask_personal_data),
    ("byte-level BPE", tokenize),
]

# Neither the classifier of the first stage nor that of the fourth can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = tables.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
