"""The corpus pipeline: five stages, each written and read again as the next one's documents.

Every stage takes all that its predecessor kept and applies its operator with production
parameters; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tideline.llm.decontaminate import without_contaminated
from tideline.llm.line_quality import kept_documents
from tideline.llm.mix import sampled
from tideline.llm.ngram_join import first_of_each_group
from tideline.llm.shared import run_folder, stored, table
from tideline.llm.token_store import read_tokens, write_tokens

END_ID = 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line-frequency rule reject go."""
    return kept_documents(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays (null ids
    last). Rows are judged by themselves, whatever their ids; of equal rows one stays, and
    rows without words all do."""
    return first_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken by the probabilities that meet the target weights."""
    return sampled(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the keyed shards hold of each document: start, n_tokens, ids_crc32."""
    folder = run_folder(spark, "pipeline-tokens")
    keys = write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return read_tokens(keys, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("one_of_each_group", one_of_each_group),
    ("without_benchmark", without_benchmark),
    ("mixed", mixed),
    ("token_ids", token_ids),
]
# Token ids come from a tokenizer, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
