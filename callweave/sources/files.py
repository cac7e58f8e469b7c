"""Listings of files, and audits of audio headers. Contents are read by tasks, never by the driver."""

from __future__ import annotations

import io
import itertools
import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.functions.scalar import file_name, file_stem, nfc


# names, of files and of folders on the way to them, that a scan passes over
HIDDEN = r"(?s)(^|/)(\.|_[^/=]*\z|[^/]*\._COPYING_\z|(?!_metadata|_common_metadata)(_[^/=]*/|[^/]*\._COPYING_/))"
READ_BYTES = 4 << 20


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, size`` of all files below a folder; only metadata is read. A missing folder gives no row."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, size bigint")
    return _binary(spark, root, glob).select("path", F.col("length").alias("size"))


def listing_all(spark: SparkSession, root: str) -> DataFrame:
    """``path, size`` of all files below a folder, also those that a scan never shows because their names begin with a
    dot or an underscore. Where Arrow can open the file system, one task lists the root, and a bounded number of tasks
    share the folders in it; elsewhere the JVM lists metadata as it does to plan a scan, and hands it over in one piece."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], "path string, size bigint")
    if not opens_directly(root):
        text = jvm.org.apache.spark.deploy.SparkHadoopUtil.get().listLeafStatuses(fs, path).mkString("\n")
        found = [(m[1], int(m[2])) for m in re.finditer(r"path=(.*?); isDirectory=false; length=(\d+)", text)]
        return spark.createDataFrame(found, "path string, size bigint")

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                yield from _frames(iter(_entries(p, False)), ["path", "size", "folder"])

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found():
            for b in batches:
                for p, n, folder in zip(b["path"], b["size"], b["folder"]):
                    yield from [(q, m) for q, m, deeper in _entries(p, True) if not deeper] if folder else [(p, n)]

        yield from _frames(found(), ["path", "size"])

    first = spark.createDataFrame([(fs.makeQualified(path).toString(),)], "path string")
    return first.mapInPandas(top, "path string, size bigint, folder boolean").repartition(_tasks(spark)).mapInPandas(below, "path string, size bigint")


def _tasks(spark: SparkSession) -> int:
    """For work on files, of which nobody knows how many there are."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _entries(root: str, recursive: bool) -> list[tuple[str, int, bool]]:
    """Path, size, whether it is a folder, of what a folder holds; a file stands for itself."""
    store, name = _located(root)
    prefix = root[: len(root) - len(name)] if root.endswith(name) else ""
    kinds = (pafs.FileType.File, pafs.FileType.Directory)
    here = store.get_file_info(name)
    found = [here] if here.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(name, recursive=recursive))
    return [(prefix + i.path, i.size or 0, i.type == pafs.FileType.Directory) for i in found if i.type in kinds]


def _frames(rows: Iterator[tuple], columns: list[str], most: int = 10_000) -> Iterator[pd.DataFrame]:
    """Rows of many folders in few frames."""
    while part := list(itertools.islice(rows, most)):
        yield pd.DataFrame(part, columns=columns)


def _binary(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def contents(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, content`` of the files below a folder that a scan shows, and of those without any byte, which it passes
    over. A scan of small files lists every folder for the driver and makes a task of every few files; so where Arrow can
    open the file system, a bounded number of tasks list them and read them, a few MB at a time."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    wanted = file_name(F.col("path")).rlike(f"(?s)^(?:{jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()})\\z")
    empty = (F.col("size") == 0) & ~side_car(F.col("path"))
    if not (opens_directly(root) and fs.exists(path) and fs.getFileStatus(path).isDirectory()):
        none = listing_all(spark, root).where(wanted & empty)
        return _binary(spark, root, glob).select("path", "content").unionByName(none.select("path", F.lit(b"").alias("content")))
    inside = F.col("path").substr(len(fs.makeQualified(path).toString().rstrip("/")) + 2, 1 << 30)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, held, n = [], [], 0
        for b in batches:
            for p in b.column("path").to_pylist():
                with open_file(p) as f:
                    held.append(f.read())
                paths.append(p)
                n += len(held[-1])
                if n >= READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.binary())], ["path", "content"])
                    paths, held, n = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.binary())], ["path", "content"])

    found = listing_all(spark, root).where(wanted & (~inside.rlike(HIDDEN) | empty)).select("path")
    return found.repartition(_tasks(spark), "path").mapInArrow(read, "path string, content binary")


def side_car(path: Column) -> Column:
    """Files that archives and file managers leave beside the real ones."""
    return file_name(path).startswith("._") | path.contains("/__MACOSX/")


def real_files(files: DataFrame) -> DataFrame:
    return files.where(~side_car(F.col("path")))


def ignored_count(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if(side_car(F.col("path"))).alias("ignored"), F.count_if(~side_car(F.col("path"))).alias("kept"))


def folders(files: DataFrame) -> DataFrame:
    """Every folder on the way to a file, with its depth."""
    parts = F.split("path", "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.select(F.explode(upto).alias("folder")).where("folder <> ''").distinct().withColumn("depth", F.size(F.split("folder", "/")))


def folders_with(files: DataFrame, keyword: str) -> DataFrame:
    return folders(files).where(F.lower(file_name(F.col("folder"))).contains(keyword.lower()))


def split_folder(files: DataFrame, name: str) -> DataFrame:
    """The shallowest folder of that name, the first by path on a tie."""
    return folders(files).where(file_name(F.col("folder")) == name).orderBy("depth", "folder").limit(1)


def stem_index(files: DataFrame) -> DataFrame:
    """``stem`` in NFC and its paths, in order."""
    return files.groupBy(nfc(file_stem(F.col("path"))).alias("stem")).agg(F.sort_array(F.collect_list("path")).alias("paths"))


# fixed values: states of a chunk structure and names of sample formats
NO_RIFF, CUT_RIFF, CUT_CHUNK, NO_DATA = "non_RIFF_WAVE_requires_review", "truncated_RIFF", "truncated_chunk", "missing_data_chunk"
SUBTYPES = {(1, 8): "PCM_U8", (1, 16): "PCM_16", (1, 24): "PCM_24", (1, 32): "PCM_32", (3, 32): "FLOAT", (3, 64): "DOUBLE", (6, 8): "ALAW", (7, 8): "ULAW"}


class WavError(ValueError):
    """A file that is no readable WAV."""


def walk_chunks(f: BinaryIO, size: int) -> tuple[str, dict]:
    """State of the chunk structure up to the RIFF boundary, and what the header says: ``format`` (tag), ``bits``,
    ``channels``, ``rate``, ``block``, ``data`` (place and bytes of the samples). Reads twelve bytes, chunk heads and the
    format chunk, and passes over all else by position."""
    head, out = f.read(12), {}
    if len(head) != 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return NO_RIFF, out
    boundary = struct.unpack("<I", head[4:8])[0] + 8
    status, at = (CUT_RIFF if boundary > size else None), 12
    while at + 8 <= min(boundary, size):
        f.seek(at)
        name, n = struct.unpack("<4sI", f.read(8))
        if name == b"fmt " and n >= 16 and "rate" not in out:
            fmt = f.read(min(n, 40))
            if len(fmt) >= 16:
                tag, out["channels"], out["rate"], _, out["block"], out["bits"] = struct.unpack("<HHIIHH", fmt[:16])
                out["format"] = struct.unpack("<H", fmt[24:26])[0] if tag == 0xFFFE and len(fmt) >= 26 else tag
        if name == b"data" and "data" not in out:
            out["data"] = (at + 8, n)
        if at + 8 + n > min(boundary, size):
            status = status or CUT_CHUNK
            break
        at += 8 + n + n % 2
    return status or ("ok" if "data" in out else NO_DATA), out


def riff_status(content: bytes, size: int | None = None) -> str:
    """State of the chunk structure of a whole file."""
    size = len(content) if size is None else size
    if len(content) < size:
        raise ValueError("the chunks of a file can't be followed in its first bytes")
    return walk_chunks(io.BytesIO(content), size)[0]


def _described(head: dict) -> dict:
    out = dict.fromkeys(("sample_rate", "channels", "frames", "duration_s", "subtype", "error"))
    if "rate" not in head or "data" not in head:
        return out | {"error": "WavError: no format chunk" if "rate" not in head else "WavError: no data chunk"}
    kind = SUBTYPES.get((head["format"], head["bits"]))
    if kind is None or not head["block"]:
        return out | {"error": f"WavError: unknown format {head['format']} of {head['bits']} bits"}
    n = head["data"][1] // head["block"]
    return out | {"sample_rate": head["rate"], "channels": head["channels"], "frames": n, "subtype": kind, "duration_s": n / head["rate"] if head["rate"] else None}


def wav_header(content: bytes) -> dict:
    """Rate, channels, frames, duration, sample format; ``error`` names what went wrong."""
    return _described(walk_chunks(io.BytesIO(content), len(content))[1])


HEADER = "path string, size_bytes bigint, sample_rate int, channels int, frames bigint, duration_s double, subtype string, riff_status string, error string"


def wav_headers(spark: SparkSession, root: str) -> DataFrame:
    """One row a WAV file: its header and the state of its chunks, wherever in the file they lie. Only chunk heads are
    read, by position; no content crosses to the driver or the JVM. The frame count is the data chunk's stated size. A
    file system that Arrow can't open is read through Spark, whole files at a time."""
    names = [c.split()[0] for c in HEADER.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[t]) for n, t in map(str.split, HEADER.split(", "))])
    direct = opens_directly(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, (p, n) in enumerate(zip(b.column("path").to_pylist(), b.column("length").to_pylist())):
                try:
                    with open_file(p) if direct else io.BytesIO(b.column("content")[i].as_py()) as f:
                        status, head = walk_chunks(f, n)
                    rows.append({"path": p, "size_bytes": n, "riff_status": status} | _described(head))
                except (OSError, struct.error) as e:
                    rows.append(dict.fromkeys(names) | {"path": p, "size_bytes": n, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    f = real_files(_binary(spark, root, "*.wav"))
    return f.select("path", "length", *([] if direct else ["content"])).mapInArrow(run, HEADER)


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"^(file:)?/", path):
        return pafs.LocalFileSystem(), re.sub(r"^(file:)?/+", "/", path)
    scheme, rest = path.split("://", 1)
    fs, base = pafs.FileSystem.from_uri(f"{scheme}://{rest.split('/', 1)[0]}/")
    return fs, base.rstrip("/") + "/" + rest.split("/", 1)[1] if base.strip("/") else "/" + rest.split("/", 1)[1]


def opens_directly(root: str) -> bool:
    try:
        _located(root.rstrip("/") + "/x")
        return True
    except (OSError, pa.ArrowException, ValueError, ImportError):
        return False


def open_file(path: str) -> BinaryIO:
    """A file of a local or remote file system, for reading by position."""
    fs, name = _located(path)
    return fs.open_input_file(name)


def write_files(df: DataFrame, root: str, name: str, content: str) -> int:
    """One file a row below ``root``, written by the tasks; how many. ``name`` may hold folders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, c in zip(b["n"], b["c"]):
                fs, path = _located(f"{root.rstrip('/')}/{n}")
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(path) as f:
                    f.write(c)
            yield pd.DataFrame({"k": [len(b)]})

    return df.select(F.col(name).alias("n"), F.col(content).cast("binary").alias("c")).mapInPandas(run, "k bigint").agg(F.sum("k")).first()[0] or 0


def _companded(kind: str) -> np.ndarray:
    """The 256 values of A-law or mu-law, in [-1, 1)."""
    c = np.arange(256)
    if kind == "ULAW":
        c = ~c & 0xFF
        v = ((c & 15) << 3) + 132 << (c >> 4 & 7)
        return np.where(c & 128, 132 - v, v - 132) / 32768.0
    c = c ^ 0x55
    e, m = c >> 4 & 7, (c & 15) << 4
    v = np.where(e == 0, m + 8, (m + 264) << np.maximum(e - 1, 0))
    return np.where(c & 128, v, -v) / 32768.0


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1], channels averaged, and the rate; integer, floating-point and companded formats."""
    head = walk_chunks(io.BytesIO(content), len(content))[1]
    known = _described(head)
    if known["error"]:
        raise WavError(known["error"])
    at, n = head["data"]
    whole = min(n, len(content) - at) // head["block"] * head["block"]
    raw, kind, width = content[at : at + whole], known["subtype"], head["bits"] // 8
    if kind == "PCM_U8":
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif kind == "PCM_24":
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
    elif kind in ("ALAW", "ULAW"):
        x = _companded(kind)[np.frombuffer(raw, np.uint8)].astype(np.float32)
    elif kind in ("FLOAT", "DOUBLE"):
        x = np.frombuffer(raw, f"<f{width}").astype(np.float32)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    return x.reshape(-1, head["channels"]).mean(axis=1), head["rate"]


@F.pandas_udf(T.ArrayType(T.FloatType()))
def waveform(content: pd.Series) -> pd.Series:
    """Mono samples of WAV bytes; null where they can't be decoded."""

    def one(c):
        try:
            return decode_wav(bytes(c))[0]
        except (struct.error, TypeError, ValueError):
            return None

    return pd.Series([one(c) for c in content], dtype=object)


def crops(spark: SparkSession, root: str, jobs: DataFrame) -> DataFrame:
    """``jobs``: path and intervals (s, e in seconds). Each file is decoded once for all its crops: ``path, segment,
    start_s, end_s, samples, error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c, iv in zip(b["path"], b["content"], b["intervals"]):
                try:
                    x, rate = decode_wav(bytes(c))
                    fault = None
                except (struct.error, ValueError) as e:
                    x, rate, fault = None, 0, str(e)
                for i, r in enumerate(iv):
                    s, e = r["s"], r["e"]
                    a, z = round(s * rate), round(e * rate)
                    bad = fault or ("Invalid crop" if a < 0 or z <= a or z > len(x) else None)
                    rows.append((p, i, s, e, None if bad else x[a:z], bad))
            if rows:
                yield pd.DataFrame(rows, columns=["path", "segment", "start_s", "end_s", "samples", "error"])

    joined = _binary(spark, root, "*.wav").select("path", "content").join(jobs, "path")
    return joined.mapInPandas(run, "path string, segment int, start_s double, end_s double, samples array<float>, error string")
