"""Streams, and batches that resume: interval union as session windows, idempotent sinks, logs of failures."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from callweave.operators.checks import ContractError, enforce, same_identity


def merged_sessions(df: DataFrame, key: str, start: str, length: Column, watermark: str | None = None) -> DataFrame:
    """Union of intervals ``[start, start + length)`` per key as session windows whose gap is the length: touching
    intervals merge. The same for a batch and, with a watermark, for a stream."""
    d = df.withWatermark(start, watermark) if watermark else df
    # interval seconds of a session window's gap have microseconds
    g = F.session_window(start, F.concat(length.cast("string"), F.lit(" milliseconds")))
    return d.groupBy(key, g.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), "n")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


@contextlib.contextmanager
def single_writer(spark: SparkSession, path: str) -> Iterator[None]:
    """Only one run at a time writes below ``path``, on any file system that can create a file exclusively. A lock that
    a lost driver left behind is named in the error and has to be removed by hand."""
    fs, p = _fs(spark, f"{path.rstrip('/')}/_lock")
    try:
        fs.create(p, False).close()
    except Py4JJavaError as e:
        raise ContractError(f"another writer holds {p.toString()}, or it can't be made") from e
    try:
        yield
    finally:
        fs.delete(p, False)


def pending(jobs: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Jobs whose key is not yet committed. A committed key that no job has, or that is committed twice, belongs to
    other jobs or a broken state, and is an error; so is a key of two jobs."""
    twice = jobs.groupBy(key).count().where("count > 1").limit(1).collect()
    enforce(f"two jobs have the key {twice[0][0]!r}" if twice else None)
    if done is None:
        return jobs
    seen = done.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    bad = seen.join(jobs.select(key, F.lit(True).alias("_known")), key, "left").where("_n > 1 or _known is null").limit(1).collect()
    enforce(None if not bad else f"the key {bad[0][0]!r} is committed twice" if bad[0]["_n"] > 1 else f"the key {bad[0][0]!r} is no job's")
    return jobs.join(done.select(key), key, "left_anti")


def committed(spark: SparkSession, path: str, kind: str = "data") -> DataFrame | None:
    """What runs have committed below ``path``: rows (``data``), or the status of every job worked on (``quality``). A
    batch counts once its marker is there, which is written last."""
    fs, p = _fs(spark, f"{path}/commits")
    if not fs.exists(p):
        return None
    batches = sorted(s.getPath().getName() for s in fs.listStatus(p))
    here = [f"{path}/{kind}/{b}" for b in batches if _exists(spark, f"{path}/{kind}/{b}")]
    return spark.read.parquet(*here) if here else None


def run_pending(jobs: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, identity: str = "") -> int:
    """Works on the jobs that are pending and commits the results: data, then a quality row for every job (``done`` or
    ``failed``, with the error), then a marker. ``work`` gives rows with the key and, where a job failed, ``error``; a job
    without a row has failed, too. Failed jobs are retried by the next run. A run that breaks off leaves no marker, and
    what it wrote is never read. The state belongs to ``identity``, and to one writer at a time. How many jobs were
    done."""
    spark = jobs.sparkSession
    fs, root = _fs(spark, path)
    fs.mkdirs(root)
    with single_writer(spark, path):
        check_cursor(spark, path, identity)
        quality = committed(spark, path, "quality")
        todo = pending(jobs, None if quality is None else quality.where("status = 'done'"), key)
        batch = uuid.uuid4().hex
        got = work(todo)
        if "error" not in got.columns:
            got = got.withColumn("error", F.lit(None).cast("string"))
        got.write.parquet(f"{path}/raw/{batch}")  # worked on once, read twice
        stored = spark.read.schema(got.schema).parquet(f"{path}/raw/{batch}")
        errors = stored.groupBy(key).agg(F.max("error").alias("error"), F.lit(True).alias("_row"))
        status = F.when(F.col("_row").isNull() | F.col("error").isNotNull(), "failed").otherwise("done")
        rated = todo.select(key).join(errors, key, "left").select(key, status.alias("status"), F.when(F.col("_row").isNull(), "no result").otherwise(F.col("error")).alias("error"))
        stored.where("error is null").drop("error").write.parquet(f"{path}/data/{batch}")
        rated.write.parquet(f"{path}/quality/{batch}")
        fs.mkdirs(_fs(spark, f"{path}/commits")[1])
        fs.create(_fs(spark, f"{path}/commits/{batch}")[1], False).close()
        fs.delete(_fs(spark, f"{path}/raw/{batch}")[1], True)
        n = spark.read.parquet(f"{path}/quality/{batch}").where("status = 'done'").count()
        save_cursor(spark, path, identity, {"batch": batch, "done": n})
        return n


def save_cursor(spark: SparkSession, path: str, identity: str, at: dict) -> None:
    """How far the work below ``path`` has come, and whose it is. Written beside and renamed."""
    fs, p = _fs(spark, f"{path}/cursor.json")
    part = _fs(spark, f"{path}/cursor.json.part")[1]
    out = fs.create(part, True)
    out.write(bytearray(json.dumps({"identity": identity, "at": at}, sort_keys=True).encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(part, p)


def check_cursor(spark: SparkSession, path: str, identity: str) -> dict | None:
    """The stored place, or None at the start; a state of another identity is an error."""
    if not _exists(spark, f"{path}/cursor.json"):
        return None
    stored = json.loads(spark.read.text(f"{path}/cursor.json", wholetext=True).first()[0])
    same_identity(stored["identity"], identity)
    return stored["at"]


def pass_gate(spark: SparkSession, path: str, stage: str, *violations: str | None) -> None:
    """Opens the gate behind a stage if nothing is violated; later stages ask with :func:`need_gate`."""
    enforce(*violations)
    fs, p = _fs(spark, f"{path}/_gates/{stage}")
    fs.mkdirs(p.getParent())
    fs.create(p, True).close()


def need_gate(spark: SparkSession, path: str, stage: str) -> None:
    enforce(None if _exists(spark, f"{path}/_gates/{stage}") else f"stage {stage} has not passed")


def upsert_batch(path: str, key: str, buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: rows with a new key are appended. A batch has a folder of its own, which a replay writes
    again, and rows lie in buckets of their key, of which only those that the batch touches are looked through, by key
    alone. Single writer, as the checkpoint is. The sink's columns ``_batch`` and ``_bucket`` are folders."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key]).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        if _exists(spark, path):
            touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # at most ``buckets``
            schema = StructType([*batch.schema.fields, StructField("_batch", LongType()), StructField("_bucket", IntegerType())])
            there = spark.read.schema(schema).parquet(path).where((F.col("_batch") != number) & F.col("_bucket").isin(touched))
            fresh = fresh.join(there.select(key, "_bucket"), [key, "_bucket"], "left_anti")
        fresh.select(*batch.columns, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/_batch={number}")

    return write


def once_each(stream: DataFrame, key: str, time: str, watermark: str) -> DataFrame:
    """The first row of each key of a stream, with state bounded by the watermark."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])


def status_summary(df: DataFrame, status: str = "status") -> DataFrame:
    """Counts of a status column: 0 pending, 1 done, 2 failed."""
    s = F.col(status)
    return df.agg(F.count_if(s == 0).alias("pending"), F.count_if(s == 1).alias("done"), F.count_if(s == 2).alias("failed"), F.count(F.lit(1)).alias("total"))


def unresolved_failures(failures: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Failures whose key was never committed later."""
    return failures.join(done.select(key).distinct(), key, "left_anti")


def eta(df: DataFrame, done: Column, seconds: str, amounts: Sequence[str]) -> DataFrame:
    """Remaining seconds, extrapolated by the number of jobs and by each amount."""
    spent = F.sum(F.when(done, F.col(seconds)))
    out = [(spent / F.count_if(done) * F.count_if(~done)).alias("eta_by_jobs")]
    for a in amounts:
        out.append((spent / F.sum(F.when(done, F.col(a))) * F.sum(F.when(~done, F.col(a)))).alias(f"eta_by_{a}"))
    return df.agg(*out)
