"""What the training-data operators share: table reading, shared storage, word patterns."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words of the size, quality and near-duplicate operators (Java and RE2 agree on it).
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"
#: Words of the decontamination operator, after A-Z became a-z.
TERM_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What is between the same words before they are lowered.
ANY_CASE_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a session on one machine without that setting, as in unit tests, gets a temporary folder of its own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="notarium-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def publish(fs: pafs.FileSystem, attempt: str, final: str) -> None:
    """Give a complete file its name.  Contents depend on the input alone, so a file that another attempt left may stay."""
    if fs.get_file_info(final).type == pafs.FileType.NotFound:
        fs.move(attempt, final)
    else:
        fs.delete_file(attempt)


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files behind a materialised table that no later step reads."""
    spark = df.sparkSession
    base = shared_dir(spark)
    for top in {os.path.dirname(f) for f in df.inputFiles()}:
        if top.startswith(base) or top.removeprefix("file:").lstrip("/").startswith(base.removeprefix("file:").lstrip("/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return what this process has freed to the system: allocators keep it, and a worker lives on after its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that leaves an idle worker no more memory than what it remembers."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else.  lower() does just that to ASCII texts, at a fraction of the cost."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def words(text: Column, separators: str = WORD_SEPARATORS) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def shielded(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """docs with columns of these names renamed out of the way, and what its columns are called then, in order."""
    taken = {c.lower() for c in docs.columns} | set(names)
    now = []
    for c in docs.columns:
        own = c
        while own.lower() in names or (own != c and own.lower() in taken):
            own = f"_own_{own}"
        taken.add(own.lower())
        now.append(own)
    return docs.toDF(*now), now


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod
