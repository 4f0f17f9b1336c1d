"""From raw documents to packed training sequences: five stages, each written as Parquet before the next.

What holds for every stage: all rows and whole texts are read, however long. Extra columns pass through, whatever their
names, but for the last stage, which returns its own columns. An empty table gives an empty result. The stages' docstrings
say what nulls, empty texts, ties and repeated rows give.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import line_rules, minhash, packing, sentence_dedup, toxicity
from millrace.llm.common import Scratch, fresh, named


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels of these documents, doesn't call toxic.

    A null or empty text scores by the bias alone, a row without a doc_id by its text. Repeated rows score alike and all
    stay or go. A score that ties with the threshold is toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = toxicity.fit(docs, labels, f"not ({toxicity.held_out()})")
    names = (fresh(docs.columns, "_score"), fresh(docs.columns, "_predicted"))
    return toxicity.score(docs, weights, names=names).where(F.col(names[1]) == 0).select(*named(docs.columns))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their boilerplate lines.

    Copies of a document count once here and the first document with a line keeps it: copies go in the next stage, which
    would find none of a text that was rejected for having been copied. Null and empty texts fail the rules. Rows
    without a doc_id are judged by their text. Repeated rows get one verdict and all stay or go.
    """
    return line_rules.cleaned(docs, line_rules.judged(docs, copies_once=True, first_stays=True))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more, the least doc_id.

    Null and empty texts are like no other and stay, as does every row without a doc_id, which can't be the least of a
    group. Of repeated rows one stays; rows that share a doc_id but not the text are one document and stay together.
    """
    at, digest = fresh(docs.columns, "_id"), fresh(docs.columns, "_hash")
    scratch = Scratch(spark, "kept")
    kept = minhash.near_duplicates(docs, shingle=5, percent=80).where("kept and doc_id is not null").select(F.col("doc_id").alias(at)).distinct()
    rows = docs.join(scratch.save(kept, "kept"), F.col("doc_id") == F.col(at), "left_semi").withColumn(digest, F.xxhash64("text")).dropDuplicates(["doc_id", digest])
    return rows.select(*named(docs.columns)).unionByName(docs.where("doc_id is null"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences of passages that came before.

    Null and empty texts stay as they are, and so does a row of which nothing is left. Rows without a doc_id lose only
    what repeats inside them. Rows with one doc_id don't repeat each other. The least doc_id keeps a passage.
    """
    return sentence_dedup.substring_dedup(docs, counts=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the sequences.

    A null or empty text is the end id alone. A null doc_id stays null. Repeated rows are packed as often as they occur,
    and pieces that tie in length take the slots of that length in any order.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_poor), ("minhash_near_dedup", drop_near_copies), ("substring_dedup", drop_repeats), ("best_fit_packing", pack)]

#: SQL can express neither the fitted model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each stage's result is a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
