"""From raw documents to a mixed, tokenised corpus: each stage takes (spark, docs, sf_dir) and gives a DataFrame.

All stages but the last return the columns of documents. A stage works on what the one before kept, and run() writes
each stage's rows as a table in the shared folder before the next one reads them. The columns doc_id, text, lang,
source and n_chars are expected; further columns are carried along by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cogspark.llm import mixing, ngram_join, pieces, suffix_dedup, toxicity
from cogspark.llm.common import broadcast_if_small, fold, free_name, written

#: SQL cannot express the learned scores and the sampling hashes; the tests hold each stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.5 or more go; it learns from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels, fold("doc_id", 5) != 0, over=toxicity.OVER)
    out = free_name(docs, "toxic")
    return toxicity.score(docs, model, out=out).filter(F.col(out) < 0.5).drop(out)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document with the least id stays, of its repeated rows one.

    Documents without words are in no group and stay; the texts of one id are told apart.
    """
    found = written(ngram_join.ngram_join(docs, firsts=True).filter("grouped"), "groups")
    id, tie = free_name(docs, "id"), free_name(docs, "tie")
    keys = lambda df: broadcast_if_small(df.withColumnsRenamed({"doc_id": id, "tie": tie}))
    same = F.col("doc_id").eqNullSafe(F.col(id)) & (ngram_join.text_tie(F.col("text")) == F.col(tie))
    stay = docs.join(keys(found.filter("not first").select("doc_id", "tie").distinct()), same, "left_anti")
    again = found.filter("first").groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "tie")
    if again.isEmpty():
        return stay
    again = keys(again)
    return stay.join(again, same, "left_anti").unionByName(stay.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What repeated 200-byte strings cover goes out of the texts; n_chars is counted anew.

    A null text stays null, a text that is covered whole becomes empty; no row goes.
    """
    return suffix_dedup.remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Texts that are null or without words are not taken; a null source is a source of its own.
    """
    return mixing.mixed_rows(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids) of each row; the ids of a null text are null, those of an empty one none."""
    return pieces.encode(docs.select("doc_id", "source", "text")).select("doc_id", "source", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_repeated_passages),
    ("source_mixing", mix),
    ("sentencepiece", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
