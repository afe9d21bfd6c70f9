"""A training corpus from ``documents`` in five stages.

Each stage takes all rows that the one before kept and calls one operator; all
but the last return the columns of ``documents``.  What a stage returns is
written as Parquet and read again, so a lost executor costs one stage at most.

Defined results: null and empty texts are not toxic, are near duplicates of each
other (one stays), match no test item, have size 0 and so take no part in the
mix.  Columns beyond those of ``documents`` are carried along, whatever their
names; rows with a null id are kept by the same rules as others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import decontam, mixing, simhash, token_files, toxicity
from ledgerlake.llm.common import fold, stage
from ledgerlake.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.3."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), usable=fold("doc_id", 4) != 2)
    return toxicity.drop_toxic(docs, lexicon, threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link."""
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy, edited or not, of a test item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: one row a document."""
    return token_files.read(token_files.write(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token output", write_tokens),
]

#: No SQL has the lexicon's automaton, XXH64, alignment and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
