"""The corpus pipeline: five stages, each one operator over all that the stage before kept.

``run`` applies ``STAGES`` to ``documents``; each result is written as Parquet to the shared folder and
read again as the next stage's documents.  Stages have no SQL form (models, raking, least squares), so there is no oracle; the tests
compare them with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linetrail.llm import language_id, line_dedup, ngram_join, packing
from linetrail.llm.common import written
from linetrail.llm.queries import fold, mixed
from linetrail.llm.tokens import token_path


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; ``lang`` becomes what is recognised."""
    found = language_id.classify(docs, language_id.train(docs, fold() != 2))
    return found.where("accepted").withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line once in all documents; a document whose lines all stand elsewhere goes."""
    return line_dedup.dedup_lines(docs).where("n_dropped < n_lines").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the smallest id."""
    return ngram_join.keep_one(docs)


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of sources, languages and topics."""
    return mixed(docs).where("kept").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, as pieces with their ids."""
    return packing.pack(docs, token_path(), words=WORDS)


#: Words that a packing worker keeps the ids of, beside what the stages before have left in the executor: a third of the operator's own.
WORDS = 200_000
STAGES = [("language id", by_language), ("line dedup", without_repeated_lines), ("n-gram join", without_near_copies),
          ("mixing", mixed_to_targets), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
