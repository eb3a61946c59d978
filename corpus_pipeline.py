"""From raw documents to token ids, in five stages.

Each stage takes all that the one before kept; its result is written as Parquet
and read again. Stages 1 to 4 return the columns of ``documents``: the quality
rules drop documents, line dedup cuts lines, near-dedup keeps one document of
each group, mixing drops and repeats documents to meet the sources' targets. The
last returns doc_id, n_tokens and ids.

Near-dedup links SimHash fingerprints of five-word shingles by op2's covering code
and checks the pairs exactly. Texts at similarity 0.8 can differ in more bits than
that code reaches, so MinHash bands bring further pairs to the same check (see
``plinth.llm.near_copies``).

Defined cases: what a row with a null doc_id, text, lang or source, an empty or
very long text, a tie or a repeated row comes to is each stage's own, as its module
says; extra columns, whatever their names, pass through stages 1 to 4 as they are;
an empty table gives an empty result.

SQL expresses neither the near-duplicate components nor the encoding, so there
is no ORACLE_SQL; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import bpe, line_dedup, mixing, quality, simhash
from plinth.storage import remove_path, scratch, staging_path

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", spread_lines),
    ("near-dedup", near_duplicates),
    ("mixing to target weights", source_mix),
    ("BPE encoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; all but the last are written and read again.

    What a stage stages for itself goes when it is written, and its input, if an
    earlier stage wrote it, goes with it. The last stage's input stays: the
    result is computed from it.
    """
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = staging_path(spark, f"stage{k}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if held:
            remove_path(spark, held)
        docs, held = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
