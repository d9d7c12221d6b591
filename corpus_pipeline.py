"""From raw documents to token ids: the llm operators in one chain.

Each stage takes what the one before it kept.  All but the last return the columns of
``documents``; ``run`` writes each result as Parquet and reads it back, so a lost
executor costs one stage at most.
"""

from pyspark.sql import DataFrame, SparkSession

from photocat.llm import exact_dedup, language_id, ngram_join, piece_lattice, source_mixing
from photocat.llm.common import Scratch, read_table
from photocat.llm.queries import PIECES

# Texts whose language stays open: no letter, or a score below this.  With two languages in a
# family no score is below 0.25; only circular votes of three or more go lower.
LEAST_SCORE = 0.2
MIX = {"domain": {"src0": 4, "src1": 2}, "lang": {"en": 3, "de": 2}}
MIX_SHARE, MIX_SEED = 0.75, 11


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.fit(docs), LEAST_SCORE)


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def one_of_similar_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_each(docs, k=5, num=80, den=100)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.select_rows(docs, share=MIX_SHARE, weights=MIX, epochs=1, seed=MIX_SEED)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_lattice.encode(docs, PIECES, columns=["doc_id", "lang", "source"])


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", one_of_equal_texts),
    ("ngram_join", one_of_similar_texts),
    ("source_mixing", mixed_sources),
    ("pieces", piece_ids),
]

# The language models and the piece lattice are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
