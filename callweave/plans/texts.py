"""From label documents to tagged texts: projection, TF-IDF, one model a symptom, thresholds, blend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.scalar import SYMPTOMS
from callweave.operators import evaluate, ml, text
from callweave.session import durable


def training_rows(calls: DataFrame, classes: Sequence[str] = SYMPTOMS) -> DataFrame:
    """``stem, text`` and a 0/1 column for each class; nothing else of the document gets in."""
    t = calls.select("stem", text.document_text(F.col("utterances")).alias("text"), "symptom")
    return text.multi_hot(t, "symptom", classes, ["stem", "text"])


def tag(rows: DataFrame, id: str, content: str, classes: Sequence[str], train, c: float = 1.0, **tfidf) -> DataFrame:
    """Long rows ``id, label, y, p`` of what is not in ``train`` (a condition on ``rows``)."""
    v = durable(text.char_tfidf_vectors(rows, id, content, **tfidf).join(rows.withColumn("_t", train), id), "vectors")
    out = None
    for label, model in ml.one_vs_rest(v.where("_t"), classes, c).items():
        p = ml.probability(model, v.where("not _t")).select(id, F.lit(label).alias("label"), F.col(label).alias("y"), "p")
        out = p if out is None else out.unionByName(p)
    return out


def tuned(predictions: DataFrame) -> DataFrame:
    """The best threshold of each label and its F1."""
    return evaluate.sweep_f1(predictions, ["label"], "y", "p")
