"""From documents to packed training sequences: five stages, each written as Parquet and read again as the next one's input.

1. toxicity: documents scored 0.3 or more go. The model learns from the labelled documents of the input.
2. near duplicates: of each component of linked SimHash fingerprints the smallest doc_id stays.
3. repeats: passages of 100 bytes or more that start earlier in the corpus are cut out of the texts.
4. decontamination: documents with a twentieth of their words in benchmark windows go.
5. packing: the pieces of all documents left, with their places in sequences of 1024 tokens.

All but the last return the columns of documents. Rows without doc_id come after all others in stages 2 and 3; a null text
that stays is one end token in the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import decontaminate, packing, simhash, suffixes, toxicity
from rankloom.llm.queries import TOXIC, table, toxicity_model
from rankloom.session import stable

# Learned scores, links, suffixes and packing cannot be said in SQL; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity_model(docs, table(spark, sf_dir, "labels")), TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
