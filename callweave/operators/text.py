"""Texts and label lists of calls: projections, filters, character TF-IDF."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.functions.scalar import REGION_NAMES, contains_any
from callweave.session import durable


def call_text(df: DataFrame, key: str, order: Sequence[str], text: str) -> DataFrame:
    """``key`` and the texts of its rows joined by one space, in order; a missing text is an empty one. One call is
    one row: calls have to fit into memory."""
    item = F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_t"]), " ").alias("text"))


def document_text(utterances: Column) -> Column:
    """The same from a nested list of utterances."""
    return F.array_join(F.transform(utterances, lambda u: F.coalesce(u["text"], F.lit(""))), " ")


def spoken_texts(utterances: Column, speaker: int | None = None) -> Column:
    """The texts that are not empty, in order, of one speaker or of all."""
    keep = F.filter(utterances, lambda u: F.coalesce(u["text"] != "", F.lit(False)) & (F.lit(True) if speaker is None else F.coalesce(u["speaker"] == speaker, F.lit(False))))
    return F.transform(keep, lambda u: u["text"])


def multi_hot(df: DataFrame, labels: str, classes: Sequence[str], keep: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """``keep`` and a 0/1 column for each class; a null list has none."""
    flags = [F.coalesce(F.array_contains(labels, c).cast("int"), F.lit(0)).alias(n) for c, n in zip(classes, names or classes)]
    return df.select(*keep, *flags)


def kept_labels(labels: Column, classes: Sequence[str]) -> Column:
    """The labels that belong to the set, order and repeats kept; the row stays whatever is left."""
    return F.filter(labels, lambda x: x.isin(list(classes)))


def in_region(address: Column, names: Sequence[str] = REGION_NAMES) -> Column:
    return contains_any(address, names)


def region_report(df: DataFrame, address: str) -> DataFrame:
    a = F.col(address)
    kind = F.when(a.isNull() | (F.trim(a) == ""), "no_address").when(in_region(a), "region").otherwise("other")
    return df.groupBy(kind.alias("region")).agg(F.count(F.lit(1)).alias("n"))


def rejection_reasons(df: DataFrame, **rules: Column) -> DataFrame:
    """``df`` with ``reason``: the first rule that rejects the row, or null."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(list(rules.items())):
        out = F.when(bad, name).otherwise(out)
    return df.withColumn("reason", out)


def only_columns(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """A whitelist projection; nothing else can leak into what is written."""
    return df.select(*[c for c in allowed])


def char_ngrams(text: Column, lo: int, hi: int) -> Column:
    """All substrings of lo to hi characters, in order, of a text of any length."""
    n = F.length(text)

    def of(k: int) -> Column:
        at = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substr(text, i, F.lit(k)))

    parts = [of(k) for k in range(lo, hi + 1)]
    return F.concat(*parts)


def _gram_counts(texts: Iterable[str], lo: int, hi: int) -> Counter[str]:
    """How often each substring of lo to hi characters occurs, in time linear in the texts."""
    c: Counter[str] = Counter()
    for t in texts:
        for k in range(lo, hi + 1):
            c.update(map("".join, zip(*(t[j:] for j in range(k)))))
    return c


def char_tfidf(df: DataFrame, id: str, text: str, lo: int = 2, hi: int = 5, min_df: int = 2, vocabulary: int = 150_000) -> DataFrame:
    """``id, term, weight``: sublinear tf, smooth idf, L2 norm, over the most frequent terms by corpus count (ties by
    term) that at least ``min_df`` documents have. Only texts and sums by term are shuffled; the grams of a document
    are counted in its task, once for the vocabulary and once for the weights. The vocabulary, bounded by its
    parameter, is chosen when this is called and held by the driver and by every worker."""
    docs, chosen = _chosen(df.where(F.col(text).isNotNull()), df.count(), id, text, lo, hi, min_df, vocabulary)
    out = T.StructType([docs.schema[id], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
    return docs.where(F.col(id).isNotNull()).select(id, "_texts").mapInArrow(_weights(chosen, lo, hi), out)


def char_tfidf_vectors(df: DataFrame, id: str, text: str, lo: int = 2, hi: int = 5, min_df: int = 2, vocabulary: int = 150_000) -> DataFrame:
    """The same as one sparse vector a document, ``id, features``, over the vocabulary in order of the terms. Vectors are
    made where grams are counted, in Arrow batches; a null text has no entry."""
    given = df.withColumn(text, F.coalesce(text, F.lit("")))
    docs, chosen = _chosen(given, df.count(), id, text, lo, hi, min_df, vocabulary)
    out = T.StructType([docs.schema[id], T.StructField("features", VectorUDT())])
    return docs.where(F.col(id).isNotNull()).select(id, "_texts").mapInArrow(_sparse(chosen, lo, hi), out)


def _chosen(df: DataFrame, n: int, id: str, text: str, lo: int, hi: int, min_df: int, vocabulary: int):
    """The texts of each document, and the vocabulary with its idf, in order of the terms, as a broadcast."""
    spark = df.sparkSession
    parts = max(3 * spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    docs = df.select(F.col(id), F.col(text).alias("_t")).repartition(parts, id).groupBy(id).agg(F.collect_list("_t").alias("_texts"))
    sums = docs.select("_texts").mapInArrow(_term_sums(lo, hi), "term string, df bigint, cf bigint")
    terms = sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where(F.col("df") >= min_df).orderBy(F.desc("cf"), "term").limit(vocabulary)
    rows = sorted((r["term"], r["df"]) for r in durable(terms.select("term", "df"), "vocabulary").collect())
    return docs, spark.sparkContext.broadcast([(t, math.log((1 + n) / (1 + d)) + 1) for t, d in rows])


def _term_sums(lo: int, hi: int, held: int = 400_000):
    """Partial ``term, df, cf``; at most about ``held`` terms besides those of one document are in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            v = np.fromiter(sums.values(), np.int64, len(sums))
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(v >> 40), pa.array(v & (one - 1))], ["term", "df", "cf"])

        one, sums = 1 << 40, {}  # documents above 40 bits of occurrences
        for b in batches:
            for texts in b.column("_texts"):
                for t, k in _gram_counts(texts.as_py(), lo, hi).items():
                    sums[t] = sums.get(t, 0) + one + k
                if len(sums) >= held:
                    yield batch()
                    sums = {}
        if sums:
            yield batch()

    return run


def _weights(chosen, lo: int, hi: int, rows: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array([t for t, _ in chosen.value], pa.string())
        place = {t: i for i, (t, _) in enumerate(chosen.value)}
        idf = np.array([x for _, x in chosen.value])
        for b in batches:
            which, places, weights, size = [], [], [], 0

            def batch() -> pa.RecordBatch:
                at = np.repeat(which, [len(x) for x in places])
                columns = [b.column(0).take(pa.array(at)), terms.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(weights))]
                return pa.RecordBatch.from_arrays(columns, [b.schema.names[0], "term", "weight"])

            for i, texts in enumerate(b.column(1)):
                c = _gram_counts(texts.as_py(), lo, hi)
                p = np.fromiter(map(place.get, c, repeat(-1)), np.int64, len(c))
                tf = np.fromiter(c.values(), np.int64, len(c))[p >= 0]
                p = p[p >= 0]
                if not len(p):
                    continue
                w = (1 + np.log(tf)) * idf[p]
                which.append(i)
                places.append(p)
                weights.append(w / np.sqrt((w * w).sum()))
                size += len(p)
                if size >= rows:
                    yield batch()
                    which, places, weights, size = [], [], [], 0
            if size:
                yield batch()

    return run


def _sparse(chosen, lo: int, hi: int, rows: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, (t, _) in enumerate(chosen.value)}
        idf = np.array([x for _, x in chosen.value])
        width = max(1, len(idf))
        for b in batches:
            first, places, weights, size = 0, [], [], 0

            def batch(end: int) -> pa.RecordBatch:
                edges = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int32))
                n = end - first
                features = pa.StructArray.from_arrays(
                    [
                        pa.array(np.zeros(n, np.int8)),
                        pa.array(np.full(n, width, np.int32)),
                        pa.ListArray.from_arrays(edges, pa.array(np.concatenate(places).astype(np.int32))),
                        pa.ListArray.from_arrays(edges, pa.array(np.concatenate(weights).astype(float))),
                    ],
                    ["type", "size", "indices", "values"],
                )
                return pa.RecordBatch.from_arrays([b.column(0).slice(first, n), features], [b.schema.names[0], "features"])

            for i, texts in enumerate(b.column(1)):
                c = _gram_counts(texts.as_py(), lo, hi)
                p = np.fromiter(map(place.get, c, repeat(-1)), np.int64, len(c))
                tf = np.fromiter(c.values(), np.int64, len(c))[p >= 0]
                p = p[p >= 0]
                order = np.argsort(p)
                w = (1 + np.log(tf[order])) * idf[p[order]] if len(p) else np.zeros(0)
                places.append(p[order])
                weights.append(w / np.sqrt((w * w).sum()) if len(p) else w)
                size += len(p)
                if size >= rows:
                    yield batch(i + 1)
                    first, places, weights, size = i + 1, [], [], 0
            if places:
                yield batch(b.num_rows)

    return run
