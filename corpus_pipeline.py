"""The documents on their way to training sequences: STAGES, each on what its predecessor kept, and run()."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtables.llm import decontamination, near_copies, packing, repeated_bytes, toxicity
from sigtables.llm._tables import remove_folder, shared_folder, table

#: SQL cannot express the classifier of the first stage; the stages are tested against brute force.
ORACLE_SQL = None


def _own(docs: DataFrame) -> list[str]:
    """The columns of docs, whatever they are called."""
    return [f"`{c}`" for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict to be toxic.

    It learns from all labels of the documents. Null and empty texts are scored as empty ones; rows with null or repeated ids
    are judged each by its own text; without labels, or with one label only, nothing is predicted to be toxic unless most
    labels say so.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(_own(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each class of copies and near copies (four fifths of their words in the same order).

    Null texts are copies of empty ones; null ids are larger than any; of repeated rows one stays; unrelated documents of one
    id all stay; an empty table stays empty.
    """
    return near_copies.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without byte strings of 50 that an earlier document has; characters that a cut parts go as a whole.

    A document that had text and is left without any goes; n_chars follows the text. Null and empty texts stay; a null id
    is later than any; rows of one id don't cut each other; an empty table stays empty.
    """
    kept = repeated_bytes.remove_repeats(docs, readable=True)
    cut = F.col("n_removed") > 0
    out = kept.withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text"))).where(~cut | (F.length(F.trim("text")) > 0))
    return out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(_own(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, each row judged by its own text, whatever its id; null texts have none.

    Without benchmark items all documents stay.
    """
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null or empty text is one piece of the end id; null and repeated ids are ids like others; no documents, no pieces.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeated bytes", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage on documents.

    What each stage keeps is written to the shared folder and read again, so that a lost executor costs one stage's tasks
    at most; what a stage has read goes once its own result is written. The last result stays for the caller.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove_folder(spark, f"{folder}/{i - 1}")
    return docs
