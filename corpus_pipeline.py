"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each stage's rows as
Parquet in the shared folder and reads them again for the next. All but the last return the columns of
documents. Rows may hold nulls, empty texts and repeats; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, mixing, packing, pii, quality, simhash, tok
from tessera.llm.common import materialize, shared_dir
from tessera.llm.queries import TARGETS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose ledger entry passes policy v2. A null text has no words, so it goes; repeated rows are decided alike; a null
    doc_id, and columns of any name, stay as they are."""
    return quality.passing(docs, "v2")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles with a Jaccard similarity of 0.8 or more, candidates by SimHash's covering tables and by MinHash): the one with the smallest doc_id. Repeated rows count as copies;
    rows that share a doc_id, or have none, go only where their texts are copies."""
    return simhash.representatives(docs, classes=jaccard.classes)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers in their texts replaced by their kind; n_chars follows the text. A null text stays null."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probability, so that sources, languages and topics come near their targets. A null source or
    language counts as another one; a null text weighs nothing; repeated rows are drawn alike."""
    return mixing.sample(docs, TARGETS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces with their place in sequences of 2048 tokens. A null or empty text is its end id alone; a null doc_id is
    packed like others, and so are repeated rows; other columns aren't read."""
    return packing.pack(docs, tok.default_tokenizer(), capacity=2048, end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither SimHash, scored patterns, raking nor packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"{folder}/{i}-{name}")
    return docs
