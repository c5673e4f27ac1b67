"""A training corpus from documents, stage by stage; each stage's rows are written as Parquet and read again by the next.

1. Quality classifier: documents that it rejects go.
2. N-gram Jaccard join: of each group of near duplicates the document of smallest id stays.
3. Substring dedup: words go that stand in a passage which also starts in a document of smaller id. A document that
   loses nothing keeps its text as it is; one that loses all its words stays, with an empty text.
4. Secret scan: stretches that hold secrets are replaced by a mark; every document stays.
5. Packing: documents become pieces of sequences.

Nulls and edge cases: a null text is empty in every stage, and is packed as its end mark alone; a null id is scored, scanned and
packed, and is neither a near duplicate nor has a smaller id; rows that repeat both id and text are one document to stage 2 and
stay together; an id with several texts keeps or loses each of them by its own links; of ties the smallest id stays; without labels
every document is kept by stage 1; very long texts go through whole; an empty table gives an empty result; further columns pass
through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varcluster.llm.bpe import tokenizer_file
from varcluster.llm.common import free_name, materialise, table, text_key
from varcluster.llm.jaccard_join import jaccard_join
from varcluster.llm.packing import pack_documents
from varcluster.llm.quality import score_quality, train
from varcluster.llm.secrets import redacted, secret_scan
from varcluster.llm.substring_dedup import substring_dedup


def _with_text(docs: DataFrame, columns: list[str], text) -> DataFrame:
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    predicted = free_name(docs, "predicted")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels"))).where(F.col(predicted) == 1).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, later = free_name(docs, "text_key"), jaccard_join(docs, keyed=True).where("doc_id <> class_id").select(F.col("doc_id").alias("later_id"), F.col("text_key").alias("later_key"))
    rows = docs.withColumn(key, text_key("text"))
    return rows.join(later, (F.col("doc_id") == F.col("later_id")) & (F.col(key) == F.col("later_key")), "left_anti").select(*docs.columns)


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    removed, kept = free_name(docs, "n_removed"), free_name(docs, "kept_text")
    return _with_text(substring_dedup(docs), docs.columns, F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = free_name(docs, "secret_spans")
    return _with_text(secret_scan(docs), docs.columns, redacted(F.col("text"), F.col(spans)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", drop_repeated_substrings),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
