"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

1. `language`: documents without a language go, the others carry the predicted one.
2. `lines`: lines that three documents or more share stay in one of them.
3. `near_duplicates`: of documents whose SimHash of four-word shingles differs in 4 bits of 64 or fewer, directly or through others, one stays.
4. `mixture`: sources are flattened by a temperature; every document is drawn at least once, none more often than twice.
5. `tokens`: byte-level BPE, with the hash of the decoded bytes.

Every stage but the last returns the columns of `documents`; other columns of the table are not read. Null texts and texts without a
letter end in the first stage, so later ones see neither; a null lang, source or id is a value like any other. Rows alike in id and text
become one row in the third stage, rows that share an id alone stay apart. Of near duplicates the smallest id stays, a null one
before all. Texts of any length go through whole. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsieve.llm import bpe, language, line_dedup, mixing, simhash
from flowsieve.session import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: As the SimHash operator's query: words of a shingle, bits of a fingerprint, and how many may differ.
NEAR_WORDS = 4
NEAR_BITS = 64
NEAR_RADIUS = 4


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts and texts without a letter."""
    predicted = language.predict(docs, language.learn(docs)).where(F.col("lang_pred") != language.UNDETERMINED)
    return predicted.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_frequent_lines(docs, outputs=("kept",)).withColumn("text", F.col("kept").cast("string"))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, radius=NEAR_RADIUS, words=NEAR_WORDS, bits=NEAR_BITS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, target_entropy_share=0.95, max_repeats=2.0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenize(
        docs,
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids", "decoded_sha256"),
        keep=("doc_id", "lang", "source"),
    )


STAGES = [
    ("language", detect_language),
    ("lines", dedupe_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixture", mix_sources),
    ("tokens", encode),
]

#: Fitted models and tokenizers are not to be had in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
