"""A corpus pipeline over ``documents``: each stage works on all rows that the one before it kept.

Every stage but the last returns the columns of its input; the last returns tokens. No stage has SQL: learned models,
minima and lattices can't be stated in it, so the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetline.llm import minhash, mixing, pieces, quality, toxicity
from facetline.llm.shared import Scratch, passing, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below the threshold."""
    p = toxicity.Params()
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"), p)
    return toxicity.scored(docs, model).where(F.col("score") < p.threshold).select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that neither the base rule nor a learned rule rejects."""
    return quality.rated(docs, table(spark, sf_dir, "labels")).where("kept").select("row.*")


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the least doc_id. Rows without a doc_id, or without words, belong
    to no group and stay; rows that share a doc_id but not a text are judged each by its own text."""
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as the mix takes them: none, once or twice."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every row: the ids of its best segmentation, and scores, numbers and checksums of its three best."""
    out = pieces.encoded(docs, pieces.default_model(), with_ids=1)
    return out.select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids_crc32", "round_trip", F.col("segmentations")[0]["ids"].alias("ids"), *(F.col(f"segmentations.{c}").alias(f"nbest_{c}") for c in ("score", "n_tokens", "ids_crc32")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("MinHash near-dedup", keep_one_of_group),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with passing(spark):
            docs = scratch.put(stage(spark, docs, sf_dir), f"stage-{k}")
        scratch.drop(f"stage-{k - 1}")
    return docs
