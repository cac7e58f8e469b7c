"""Readers of label documents, archives, tables and logs."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.functions.scalar import file_name
from callweave.operators.checks import enforce
from callweave.sources.files import contents

UTTERANCES = "array<struct<id:string,startAt:bigint,endAt:bigint,text:string,speaker:int>>"
LABEL = f"_id string, recordId string, audioPath string, mediaType string, gender string, address string, disasterLarge string, disasterMedium string, urgencyLevel string, sentiment string, triage string, status int, startAt bigint, endAt double, symptom array<string>, utterances {UTTERANCES}"


def label_documents(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """``path, sha256, doc, error``: every JSON file parsed against the label schema. What can't be decoded or parsed,
    or has no list of utterances, keeps its row with an error and a null document."""
    raw = contents(spark, root, glob)
    # bytes that are no UTF-8 turn into replacement characters, which a re-encoding would reveal
    text = F.regexp_replace(F.decode(F.try_validate_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8"), "^﻿", "")

    def judged(t: Column) -> Column:
        error = lambda d: F.when(t.isNull(), "encoding").when(d.isNull() | d["_corrupt"].isNotNull(), "json").when(d["utterances"].isNull(), "no_utterances")
        doc = F.from_json(t, LABEL + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
        return F.transform(F.array(doc), lambda d: F.struct(d.alias("doc"), error(d).alias("error")))[0]

    # bound by a lambda, text and document are made once, also in a filter on the error, which gets a copy of what it is made of
    out = raw.select("path", F.sha2("content", 256).alias("sha256"), F.transform(F.array(text), judged)[0].alias("r")).select("path", "sha256", "r.*")
    return out.select("path", "sha256", F.when(F.col("error").isNull(), F.col("doc").dropFields("_corrupt")).alias("doc"), "error")


def readable(labels: DataFrame) -> DataFrame:
    """Permissive reading: rows with an error are left out."""
    return labels.where("error is null").select("path", "doc.*")


def label_issues(labels: DataFrame) -> DataFrame:
    return labels.where("error is not null").select(F.col("path").alias("file_ref"), F.concat(F.lit("json_"), "error").alias("issue"))


def zip_members(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """``archive, member, name, size, content`` of the members of zip archives, side-cars left out, nothing extracted.
    An archive can't be split: one task reads one, a member at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    for i in z.infolist():
                        name = i.filename.rsplit("/", 1)[-1]
                        if i.is_dir() or not name.endswith(suffix) or name.startswith("._") or "__MACOSX" in i.filename:
                            continue
                        yield pd.DataFrame([(p, i.filename, name, i.file_size, z.read(i))], columns=["archive", "member", "name", "size", "content"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(run, "archive string, member string, name string, size bigint, content binary")


def checked_members(members: DataFrame) -> DataFrame:
    """The same, once it is sure that no two members share a name."""
    twice = members.groupBy("name").count().where("count > 1").limit(1).collect()
    enforce(f"two members are named {twice[0][0]}" if twice else None)
    return members


def tar_members(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """``archive, member, content`` of tar archives, compressed or not; only wanted members are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                with tarfile.open(fileobj=io.BytesIO(c)) as t:
                    for m in t:
                        if m.isfile() and (wanted is None or m.name.rsplit("/", 1)[-1] in wanted):
                            yield pd.DataFrame([(p, m.name, t.extractfile(m).read())], columns=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, content binary")


def csv_table(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header, always with a schema; only the columns asked for are parsed."""
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    return df.select(*columns) if columns else df


def jsonl_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value`` of a text file, or of a folder of them in order of path, from 0. Lines carry a number that grows
    within each partition; one count a partition, put in order of file and place, says where it starts. No line passes
    through Python."""
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    lines = spark.read.text(path).select("value", place.alias("_p"), F.monotonically_increasing_id().alias("_i"))
    sizes = lines.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_low"))
    starts = sizes.select(F.col("_p").alias("_q"), "_low", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return lines.join(starts, F.col("_p") == F.col("_q")).select((F.col("_start") + F.col("_i") - F.col("_low")).cast("bigint").alias("line_no"), "value")


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    doc = F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return numbered_lines(spark, path).where(F.trim("value") != "").withColumn("r", doc)


def jsonl_torn(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log whose last line may be torn; damage anywhere else is an error. Rows carry ``line_no``."""
    p = _parsed(spark, path, schema)
    bad = p.agg(F.max("line_no").alias("last"), F.min(F.when(F.col("r._corrupt").isNotNull(), F.col("line_no"))).alias("first_bad")).first()
    enforce(f"line {bad['first_bad']} is damaged" if bad["first_bad"] is not None and bad["first_bad"] < bad["last"] else None)
    return p.where("r._corrupt is null").select("line_no", F.col("r").dropFields("_corrupt").alias("r")).select("line_no", "r.*")


def jsonl_latest(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A log in which the last line of each key counts; any damage is an error."""
    p = _parsed(spark, path, schema)
    enforce("a line is damaged" if p.where("r._corrupt is not null").limit(1).count() else None)
    rows = p.select("line_no", F.col("r").dropFields("_corrupt").alias("r"))
    return rows.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.max_by("r", "line_no").alias("r")).select("r.*")


def repair_jsonl(path: str, backup: bool = True) -> bool:
    """Cuts a torn last line off a local log, keeping a copy; whether there was one. Only the end of the file is read."""
    with open(path, "rb+") as f:
        size = f.seek(0, 2)
        tail, at = b"", size
        while at > 0 and b"\n" not in tail.rstrip(b"\n"):
            at = max(0, at - (1 << 16))
            f.seek(at)
            tail = f.read(size - at)
        line = tail.rstrip(b"\n").rsplit(b"\n", 1)[-1]
        try:
            json.loads(line or b"null")
            return False
        except ValueError:
            keep = size - len(tail) + len(tail.rstrip(b"\n")) - len(line)
            if backup:
                import shutil

                shutil.copyfile(path, path + ".bak")
            f.truncate(keep)
            return True


def npz_rows(paths: list[str], ids: str, columns: dict[str, str]) -> Iterator[pd.DataFrame]:
    """Arrays of NPZ files as rows with an explicit key, one frame a file: for a one-off conversion to Parquet."""
    import numpy as np

    for p in paths:
        with np.load(p, allow_pickle=False) as z:
            yield pd.DataFrame({"id": z[ids].tolist(), **{name: z[a].tolist() for name, a in columns.items()}})


def convert_npz(spark: SparkSession, paths: list[str], ids: str, columns: dict[str, str], schema: str) -> DataFrame:
    """The same in tasks, one a file; all executors have to see the paths."""
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from npz_rows(b["path"].tolist(), ids, columns)

    return files.mapInPandas(run, schema)


def member_audit(members: DataFrame) -> DataFrame:
    """Per date token of the members' names (its second part): members, unreadable ones, bytes."""
    ok = F.from_json(F.decode("content", "UTF-8"), "map<string,string>").isNotNull()
    return members.groupBy(F.split_part(file_name(F.col("member")), F.lit("_"), F.lit(2)).alias("token")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("n_unreadable"), F.sum("size").alias("bytes")
    )
