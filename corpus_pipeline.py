"""From raw documents to packed token ids, in stages that are each stored.

language       documents without a letter go, and those of LEAST_CHARACTERS or more that are
               not near any learned language
near_dup       one document of each class of near-duplicates stays
decontaminate  benchmark passages are cut out; documents that mostly consist of them go
mix            documents are repeated or left out so that sources come to their weights
tokens         the documents' token ids are written to packed files and read back

Every stage but the last returns the columns of its documents, whatever else they are called
(columns named lang_pred and score are replaced on the way). Missing and empty texts have no letter
and go in the first stage; rows of equal id and text become one in the second; very long texts are
taken whole; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontaminate, language, mixing, near_dup, tokens
from larder.llm.common import table, written

# Cosines of unrelated vectors scatter by 1 / sqrt(dimensions) around zero; prose of the learned
# languages lies far above four times that. Texts of fewer characters are too short to tell.
LEAST_COSINE = 4 / language.DIMENSIONS ** 0.5
LEAST_CHARACTERS = 100


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names, vectors = language.prototypes(language.learnable(docs))
    found = language.predict(docs, names, vectors)
    near = (F.col("score") >= LEAST_COSINE) | (F.length("text") < LEAST_CHARACTERS)
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & near).select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.without_copies(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.binary_output(docs)


STAGES = [
    ("language", language_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]

ORACLE_SQL = None  # language vectors, sketches and the vocabulary are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
