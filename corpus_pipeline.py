"""A training corpus from raw documents, in stages that each write their result before the next reads it.

Toxic documents go; of each group of near-duplicates one document stays; secrets are blotted out;
what is left is packed into sequences. Every stage works on all rows its predecessor kept.

Cases, for every stage: an empty table gives an empty one. Extra columns, whatever their names, are carried along until
the packing, which returns its own. Rows are judged by themselves, so repeated rows and rows without a doc_id are too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fragmill.llm import packing, secrets, simhash, toxicity
from fragmill.llm.common import small_batches, table, temporary, tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half, by a model of labels that aren't held out.

    Cases: null and empty texts stay. Copies stay or go together. Without labels nothing goes.
    """
    small_batches(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.accepted(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles of similarity 0.8 or more connect, the one of least doc_id.

    Cases: texts without a word, null ones included, are alike. Rows of one doc_id with unlike texts are judged apart. A row
    without a doc_id stays only where no row of its group has one. Of rows alike in doc_id and text one stays.
    """
    small_batches(spark)
    return simhash.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark.

    Cases: null and empty texts stay as they are; n_chars follows the text.
    """
    small_batches(spark)
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens.

    Cases: a null or empty text is the end id alone. Repeated rows are separate documents.
    """
    small_batches(spark)
    return packing.packed(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash near-dedup", without_near_duplicates),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: SQL can't express a trained model, a fingerprint or a tokenizer; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = temporary(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
