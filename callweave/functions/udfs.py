"""Arrow UDFs over the functions in :mod:`audio`, and over JSON documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.functions import audio


def _each(s: pd.Series, f):
    return pd.Series([None if x is None or len(x) == 0 else f(np.asarray(x, dtype=float)) for x in s], dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def mfcc_features(s: pd.Series) -> pd.Series:
    """26 values a waveform; null for an empty one."""
    return _each(s, lambda x: audio.mfcc_summary(x).tolist())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def log_mel_features(s: pd.Series) -> pd.Series:
    """Scaled log-Mel pooled to 64 x 24, row by row."""
    return _each(s, lambda x: audio.pool(audio.unit_scale(audio.log_mel(x)), 24).ravel().tolist())


@F.pandas_udf(T.BinaryType())
def two_view_features(s: pd.Series) -> pd.Series:
    return _each(s, lambda x: audio.two_views(x).tobytes())


_ACOUSTIC = ["f0_mean", "f0_median", "f0_std", "voiced_ratio", "tone_concentration", "reliable", "rms", "zcr", "centroid"]
_LEVEL = ["silence_ratio", "clipping_ratio", "zero_ratio", "peak", "rms"]


def _doubles(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


@F.pandas_udf(_doubles(_ACOUSTIC))
def acoustic_features(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([audio.acoustic_summary(x) if x is not None and len(x) else dict.fromkeys(_ACOUSTIC, float("nan")) for x in s], columns=_ACOUSTIC)


@F.pandas_udf(_doubles(_LEVEL))
def level_features(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([audio.level_quality(x if x is not None else []) for x in s], columns=_LEVEL)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def resampled(s: pd.Series) -> pd.Series:
    return _each(s, lambda x: audio.resample_up(x).tolist())


def walk(doc, path: str = "", inner: bool = False) -> Iterator[tuple[str, str, str | None]]:
    """(path, type, value) of every leaf, ``[]`` for list members; an empty list is a leaf without value. With
    ``inner`` also of every object and list, the root as ``$``."""
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(doc)]
    if isinstance(doc, dict) or (isinstance(doc, list) and doc):
        if inner:
            yield path or "$", kind, None
        if isinstance(doc, dict):
            for k, v in doc.items():
                yield from walk(v, f"{path}.{k}" if path else k, inner)
        else:
            for v in doc:
                yield from walk(v, f"{path}[]", inner)
    elif isinstance(doc, list):
        yield path or "$", kind, None
    else:
        yield path or "$", kind, None if doc is None else (doc if isinstance(doc, str) else json.dumps(doc))


def walked(df, id: str, text: str, inner: bool = False):
    """``id, path, type, value`` of every node of JSON texts; what is no JSON gives one row of type ``invalid``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["i"], b["t"]):
                try:
                    rows += [(i, *r) for r in walk(json.loads(t), inner=inner)]
                except (ValueError, TypeError):
                    rows.append((i, "$", "invalid", None))
            if rows:
                yield pd.DataFrame(rows, columns=["id", "path", "type", "value"])

    return df.select(F.col(id).cast("string").alias("i"), F.col(text).alias("t")).mapInPandas(run, "id string, path string, type string, value string")


def find_key(doc, keys: list[str]):
    """Depth-first search for the first of the keys; a key of the same level wins over a nested one."""
    if isinstance(doc, dict):
        for k in keys:
            if k in doc:
                return doc[k]
        children = list(doc.values())
    else:
        children = doc if isinstance(doc, list) else []
    for c in children:
        got = find_key(c, keys)
        if got is not None:
            return got
    return None


def find_string(doc, part: str) -> str | None:
    """The first string, depth-first, that contains the part."""
    if isinstance(doc, str):
        return doc if part in doc else None
    for c in doc.values() if isinstance(doc, dict) else doc if isinstance(doc, list) else []:
        got = find_string(c, part)
        if got is not None:
            return got
    return None


def find_records(doc, key: str):
    """The first list, depth-first, of objects that all have the key."""
    if isinstance(doc, list) and doc and all(isinstance(x, dict) and key in x for x in doc):
        return doc
    for c in doc.values() if isinstance(doc, dict) else doc if isinstance(doc, list) else []:
        got = find_records(c, key)
        if got is not None:
            return got
    return None


def redact(doc, keep: frozenset[str], longest: int = 3):
    """Values under listed keys stay, others show ``<type:redacted>``; lists are cut to a few members, which go by the
    key of their list."""

    def masked(x, shown: bool):
        if isinstance(x, dict):
            return {k: masked(v, k in keep) for k, v in x.items()}
        if isinstance(x, list):
            return [masked(y, shown) for y in x[:longest]]
        return x if shown else f"<{type(x).__name__}:redacted>"

    return masked(doc, False)


def json_udf(f, *args):
    """A string UDF that applies a function to parsed JSON; null for what is no JSON."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            try:
                got = f(json.loads(t), *args)
            except (ValueError, TypeError):
                got = None
            out.append(got if got is None or isinstance(got, str) else json.dumps(got, ensure_ascii=False))
        return pd.Series(out, dtype=object)

    return run


def resolved_address(text, keys=("address", "Address", "addr", "주소"), hint: str = "서울"):
    """The address of a JSON document: known top-level keys in the JVM, the recursive search only where they fail."""
    direct = F.coalesce(*[F.get_json_object(text, f"$['{k}']") for k in keys])
    return F.coalesce(direct, json_udf(find_key, list(keys))(text), json_udf(find_string, hint)(text))
