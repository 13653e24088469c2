"""Training-corpus pipeline: each stage calls one operator, is written as Parquet and read again by the next.

Stages: documents predicted toxic go; of each near-duplicate group the smallest id stays; word windows that
repeat a smaller document are cut out of the text; documents that hold a benchmark item go; the rest is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modwarden.llm import decontaminate, nearcopies, pieces, substrings, toxicity
from modwarden.llm.queries import fold
from modwarden.session import discard, shared_dir
from modwarden.sources.readers import read_table

# SQL has neither the model nor the tokenizer; tests hold every stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is below the threshold."""
    labels = read_table(spark, sf_dir, "labels").filter(~F.coalesce(fold(4, 2), F.lit(False)))
    index = toxicity.fit(docs, labels)
    return toxicity.predict(docs, index).filter("predicted = 0").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles.

    SimHash links of the operator come first, verified exactly; a prefix filter finds the pairs beyond their radius.
    """
    return nearcopies.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; texts that lose nothing stay as they are, and no document goes."""
    found = substrings.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    cols = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))}
    return found.select(*(cols[c].alias(c) if c in cols else F.col(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window similar to a benchmark item; null texts hold none."""
    return decontaminate.find(docs, read_table(spark, sf_dir, "benchmark")).filter("not contaminated").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the token ids, and of the text decoded from them, by document; null texts count as empty.

    Columns other than id, language and source end here.
    """
    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; what a stage wrote goes once the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
