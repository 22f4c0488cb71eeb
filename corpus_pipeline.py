"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, personal data, best-fit packing.

Each stage works on all that the one before kept, and takes and returns the columns of documents (the last returns
pieces). ``run`` writes every stage's rows as Parquet in the folder that the cluster shares and reads them back; a stage's
rows go when the next stage has read them.

Defined cases, in every stage: a null text is like an empty one, and is packed as id 0 alone; of rows equal in id and text one
stays (exact dedup), and empty texts are equal to each other; a null id loses against any other in its group, and stays
where there is none; ties go to the smallest id; very long texts are read whole; an empty table gives no rows; columns
besides those of documents come along unchanged up to the last stage, whatever they are called.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spandrel.llm import exact_dedup, jaccard_join, packing, pii, toxicity
from spandrel.llm.common import checkpoint_folder, drop_folder, table

#: No SQL: the lexicon is learned, and packing is an algorithm.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon scores 0.7 or more go."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the smallest id stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five words, the smallest id stays."""
    return jaccard_join.keep_one(docs, width=5, num=80, den=100)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, terms that give it away are generalised or removed."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens at most."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("n-gram Jaccard join", drop_near_copies), ("PII", sanitise), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            drop_folder(spark, f"{folder}/{k - 1}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
