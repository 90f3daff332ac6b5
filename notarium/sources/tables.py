"""Tables as versioned folders under numbered pointers: readers see a version as a whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since the tables were read."""


class Store:
    """Named tables under a folder of any file system that Spark can write.

    A version is a small file _versions/N that names the folders of every table; the highest counts.  It is written under
    a name of its own and then renamed to a number that must be free, so that a crash leaves the old version in place,
    and of two writers that began from the same version one gets a Conflict.  That asks for a file system whose rename is
    atomic, as HDFS's is.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.base: int | None = None

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """Within it all reads see one version, and a commit fails if that is no longer the present one."""
        self.base = self.version()
        try:
            yield
        finally:
            self.base = None

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The present version, 0 before the first commit."""
        fs, p = self._fs(f"{self.root}/_versions")
        if not fs.exists(p):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _pointer(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        fs, p = self._fs(f"{self.root}/_versions/{version}")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return dict(line.split("\t") for line in text.split("\n") if line)

    def read(self, name: str, schema: str) -> DataFrame:
        at = self._pointer(self.version() if self.base is None else self.base).get(name)
        return self.spark.read.schema(schema).parquet(at) if at else self.spark.createDataFrame([], schema)

    def stage(self, df: DataFrame) -> DataFrame:
        """df written beside the tables and read back, so that it is computed once."""
        at = f"{self.root}/_staged/{uuid.uuid4().hex}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _claim(self, attempt: str, version: int) -> None:
        """Give a pointer its number, which must be free."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        fs, p = self._fs(attempt)
        _, final = self._fs(f"{self.root}/_versions/{version}")
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(p, final, none)
        except Exception as e:
            if fs.exists(final):
                raise Conflict(f"version {version} belongs to another writer") from e
            raise

    def commit(self, **tables: DataFrame) -> int:
        """Write new versions of some tables and then one pointer; a failure before that changes nothing."""
        base = self.version() if self.base is None else self.base
        now = self._pointer(base)
        for name, df in tables.items():
            at = f"{self.root}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(at)
            now[name] = at
        attempt = f"{self.root}/_versions/{uuid.uuid4().hex}.tmp"
        fs, p = self._fs(attempt)
        out = fs.create(p, False)
        out.write(bytearray("".join(f"{k}\t{v}\n" for k, v in sorted(now.items())), "utf-8"))
        out.close()
        self._claim(attempt, base + 1)
        if self.base is not None:
            self.base = base + 1
        return base + 1
