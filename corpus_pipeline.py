"""From raw documents to token ids: toxic documents go, then copies, near copies and documents that hold
benchmark items; what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again as
the next one's input. All but the last return the columns of `docs`, with the rows that stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbsight.llm import decontaminate, exact_dedup, pieces, simhash, toxicity
from kerbsight.llm.common import table, workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    labels = table(spark, sf_dir, "labels")
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    rows = docs.select("doc_id", "text", others.alias("_row"))
    found = toxicity.score_toxicity(workspace(spark), rows, labels, ["_row"])
    return found.where("score < 0.5").select(
        *(
            F.col("_text").alias("text") if c == "text" else F.col("_row")[c].alias(c)
            for c in docs.columns
        )
    )


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.keep_first(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked texts the document with the smallest id stays."""
    return simhash.keep_one(spark, docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window that is like a benchmark item go."""
    return decontaminate.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: ids of the best segmentation, and the others for sampling."""
    rows = docs.select("doc_id", "lang", "source", F.col("text").cast("string").alias("_text"))
    found = pieces.encode(rows, public_tokenizers.path("piece_bpe_32k.model"))
    best = F.get("n_best", F.lit(0))
    return found.select(
        "doc_id", "lang", "source", best["ids"].alias("ids"), best["score"].alias("score"),
        F.slice("n_best", 2, pieces.N_BEST).alias("others"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("SentencePiece encoding", encode),
]

#: No SQL: the scores, fingerprints and segmentations can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    ws, docs = workspace(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(name.replace(" ", "-"), stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
