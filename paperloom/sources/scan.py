"""Scanning folders of files into the relation (file_id, original_path, file_size_bytes), on any file system that Spark reads."""

from __future__ import annotations

import hashlib
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import SIZE_BOUNDS
from ..session import ship

SCHEMA = "file_id string, original_path string, file_size_bytes bigint"
#: So many bytes of a file, with its size, are its identity.
HEAD = 65_536


def identity(content, length):
    """SRC-4 of contents that are at hand (streams): hash of the first HEAD bytes and the size."""
    return F.sha2(F.concat(F.substring(content, 1, HEAD), length.cast("string").cast("binary")), 256)


@F.pandas_udf(T.StringType())
def head_identity(paths: pd.Series, sizes: pd.Series) -> pd.Series:
    """SRC-4: the same of files by path; only the first HEAD bytes are read, where the task runs."""
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    opened: dict = {}

    def one(path: str, size: int) -> str:
        parts = urlparse(path)
        if parts.scheme in ("", "file"):
            system, name = opened.setdefault("file", fs.LocalFileSystem()), unquote(parts.path)
        else:
            root = f"{parts.scheme}://{parts.netloc}"
            if root not in opened:
                opened[root] = fs.FileSystem.from_uri(path)[0]
            system, name = opened[root], (parts.netloc if parts.scheme.startswith("s3") else "") + unquote(parts.path)
        with system.open_input_stream(name) as f:
            return hashlib.sha256(f.read(HEAD) + str(size).encode()).hexdigest()

    return pd.Series([one(p, s) for p, s in zip(paths, sizes)], dtype="object")


def _status(spark: SparkSession, source: str):
    """(absolute path, whether it is a folder) as Spark's file system sees it; None if there is nothing."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    status = system.getFileStatus(path)
    return status.getPath().toString(), status.isDirectory()


def scan(spark: SparkSession, source: str, patterns: tuple[str, ...] = ("*.pdf",), recursive: bool = True, skip_hidden: bool = True, bounds: tuple[int, int] = SIZE_BOUNDS) -> DataFrame:
    """SRC-1 to SRC-6, DD-1: a missing path gives no rows; one file is taken without size and hidden rules; of equal files the first path stays.

    Files are listed without their contents; the size filter is pushed into the listing, and of the files that pass only the
    first HEAD bytes are read. Links are followed as the file system does; names that start with a dot or an underscore are
    never listed by Spark."""
    ship(spark)
    found = _status(spark, source)
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    root, folder = found
    reader = spark.read.format("binaryFile")
    if folder:
        glob = patterns[0] if len(patterns) == 1 else "{" + ",".join(patterns) + "}"
        files = reader.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(root).select("path", "length").where(F.col("length").between(*bounds))
        if skip_hidden:
            relative = F.substring(F.regexp_replace("path", "^file:/*", "/"), len("/" + root.removeprefix("file:").lstrip("/")) + 1 if root.startswith("file:") else len(root) + 1, 1 << 20)
            files = files.where(~F.regexp_like(relative, F.lit(r"/\.")))
    else:
        if not any(fnmatch(root.rsplit("/", 1)[-1], p) for p in patterns):
            return spark.createDataFrame([], SCHEMA)
        files = reader.load(root).select("path", "length")
    rows = files.select(head_identity("path", "length").alias("file_id"), F.regexp_replace("path", "^file:/*", "/").alias("original_path"), F.col("length").alias("file_size_bytes"))
    return rows.groupBy("file_id").agg(F.min(F.struct("original_path", "file_size_bytes")).alias("s")).select("file_id", "s.*")
