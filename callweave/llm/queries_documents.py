"""Queries of problems 6, 7 and 8, over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from callweave.llm import contamination, packing, subjects, tokens
from callweave.llm.registry import query, table
from callweave.session import durable, spread

SEQUENCE_LENGTHS = [512, 1024, 2048]


@query("p6_sequences")
def p6_sequences(spark, sf):
    """Where every document lies in training sequences of up to 2,048 tokens."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    counted = durable(tokens.with_token_counts(docs, "text").select("doc_id", "n_tokens"), "tokens")
    return packing.pack(counted, "doc_id", "n_tokens", SEQUENCE_LENGTHS)


def leak_rows(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), narrow=0.5)
    return contamination.leaks(docs, "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


@query("p7_found")
def p7_found(spark, sf):
    return leak_rows(spark, sf).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


@query("p7_kept")
def p7_kept(spark, sf):
    """The documents left once those that hold a test item are removed."""
    bad = leak_rows(spark, sf).select(F.col("doc").alias("doc_id")).distinct()
    return table(spark, sf, "documents").select("doc_id", "source", "lang").join(bad, "doc_id", "left_anti")


def subject_rows(spark, sf):
    names = subjects.closed_set(table(spark, sf, "subjects"), "subject")
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), narrow=0.5)
    bag, model = subjects.topic_model(docs, "doc_id", "text", table(spark, sf, "subject_labels"), names)
    return subjects.assign(bag, model) if model else spark.createDataFrame([], "doc bigint, subject string, share double")


@query("p8_found")
def p8_found(spark, sf):
    labelled = table(spark, sf, "subject_labels").select(F.col("doc_id").alias("doc")).distinct()
    found = subject_rows(spark, sf).join(labelled, "doc", "left_anti")
    return found.select(F.col("doc").alias("doc_id"), "subject").distinct()


@query("p8_composition")
def p8_composition(spark, sf):
    """How many documents each subject has."""
    return subject_rows(spark, sf).groupBy("subject").agg(F.count_distinct("doc").alias("n_docs")).select("subject", "n_docs")
