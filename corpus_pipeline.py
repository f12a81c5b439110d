"""A training corpus from raw documents: language identification, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import langid
from rankloom.llm.common import bound_batches, materialize, read_table
from rankloom.llm.encoder import tokenizer_path
from rankloom.llm.exact_dedup import drop_exact_copies
from rankloom.llm.mixing import in_mixed_order
from rankloom.llm.packing import pack_documents
from rankloom.llm.simhash import drop_near_copies


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; those that the models reject, or whose text is null or has no letter, go.

    Rows that repeat are judged alike; a null label teaches nothing; without any label, and for an empty table, the result is empty.
    """
    bound_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs, F.lit(True)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest id. A null text is an empty one; of rows that repeat id and text one stays; an empty table stays empty."""
    return drop_exact_copies(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that of the smallest id. Rows that share an id stay or go together, rows with a null id stay; texts without words are one group; an empty table stays empty."""
    bound_batches(spark)
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a mix that weights sources by their size to the power 0.7.

    A null source is a source of its own, a null or empty text counts as one character; rows that repeat stay; ties of the hashed order are settled by id and size; an empty table stays empty.
    """
    return in_mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences of at most 4096 tokens.

    A scan of the mix's files follows their sizes, so the mix is dealt again: task after task takes the
    documents of later slots, and sequence ids ascend with them up to the examples a packer chooses from.
    """
    bound_batches(spark)
    pieces = pack_documents(in_mixed_order(docs), tokenizer_path("word_bpe_49k.json"), 2, kept_pieces=150_000)  # the workers also served the stages before
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", identify_languages), ("exact_dedup", drop_copies), ("simhash_dedup", drop_similar), ("mixing", mix_sources), ("packing", pack)]

#: Language models, fingerprints and token ids are beyond SQL: tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
