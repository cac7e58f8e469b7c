"""Writers. Spark's commit protocol makes each write atomic; nothing is overwritten unless asked for."""

from __future__ import annotations

import hashlib
import json
import math
import os
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, fields: Sequence[str], order_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """One CSV with the fields in the given order; lists joined by semicolons."""
    flat = df.select(*[F.array_join(c, ";").alias(c) if dict(df.dtypes)[c].startswith("array") else c for c in fields])
    if order_by:
        flat = flat.orderBy(*order_by)
    flat.coalesce(1).write.mode(mode).csv(path, header=True)


def write_shards(df: DataFrame, path: str, rows: int = 50_000, mode: str = "errorifexists") -> None:
    """Parquet files of bounded size."""
    df.write.mode(mode).option("maxRecordsPerFile", rows).parquet(path)


def write_by_prefix(df: DataFrame, path: str, key: str, n: int = 2, mode: str = "errorifexists") -> None:
    """Folders by the first characters of a hashed key."""
    df.withColumn("prefix", F.substring(key, 1, n)).write.mode(mode).partitionBy("prefix").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def report(df: DataFrame, path: str) -> dict:
    """A small result as a JSON file, written beside and renamed; NaN is an error."""
    rows = [r.asDict(recursive=True) for r in df.limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("too many rows for a report")
    if any(isinstance(v, float) and not math.isfinite(v) for r in rows for v in r.values()):
        raise ValueError("a report may hold no NaN")
    write_text(path, json.dumps({"rows": rows}, ensure_ascii=False, allow_nan=False, default=str))
    return {"rows": rows}


def write_text(path: str, text: str) -> None:
    """All or nothing: a temporary file, forced to disk, takes the name."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def empty_folder(path: str) -> None:
    """The folder, made if needed; one with anything in it is an error."""
    os.makedirs(path, exist_ok=True)
    if os.listdir(path):
        raise FileExistsError(f"{path} is not empty")


def bundle(paths: Sequence[str], out: str) -> dict[str, str]:
    """A zip of files with a manifest of their SHA-256 sums."""
    sums = {}
    with zipfile.ZipFile(out, "x", zipfile.ZIP_DEFLATED) as z:
        for p in paths:
            with open(p, "rb") as f:
                sums[os.path.basename(p)] = hashlib.file_digest(f, "sha256").hexdigest()
            z.write(p, os.path.basename(p))
        z.writestr("manifest.json", json.dumps(sums, sort_keys=True))
    return sums
