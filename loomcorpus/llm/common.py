"""Shared plumbing: column choice, tables in the shared folder, Arrow batch slicing."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Columns of the documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Characters of text that one Python step holds at once; bounds worker memory, not results.
SLICE_CHARS = 4_000_000


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, whatever else the table has.

    The first column whose name matches exactly is taken (then the first that matches but for
    case), by position, so extra columns that clash (``Text`` beside ``text``, or a second
    ``text``) don't make the choice ambiguous.
    """
    have = list(df.columns)
    lower = [c.lower() for c in have]
    if len(set(lower)) == len(lower):
        return df.select(*[df[have[lower.index(n.lower())]].alias(n) for n in names])
    at = [have.index(n) if n in have else lower.index(n.lower()) for n in names]
    plain = df.toDF(*[f"_c{i}" for i in range(len(have))])
    return plain.select(*[plain[f"_c{i}"].alias(n) for i, n in zip(at, names)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where the session names none and runs on this machine alone (tests, local runs) a temporary
    folder is set; on a cluster that is an error, as executors would write where only they can read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loom-"))
    return sc.getCheckpointDir().rstrip("/")


class Shared:
    """Tables of one job in the shared folder. They survive the loss of executors, and reading
    them again starts no earlier stage."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        if name not in self.names:
            self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.names.remove(name)

    def only(self, *names: str) -> None:
        """Deletes all tables but those that the result is read from."""
        for name in [x for x in self.names if x not in names]:
            self.drop(name)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of jobs whose results are already written."""
    gc.collect()
    with contextlib.suppress(Exception):
        spark.sparkContext._jvm.System.gc()


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``chars`` bytes of the text column; a longer text is a piece
    of its own. No row is left out."""
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i in range(n):
        if i > start and total + sizes[i] > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(sizes[i])
    yield batch.slice(start, n - start)


def list_array(values, lengths, kind) -> pa.Array:
    """A list column from flat values and the length of each row."""
    import numpy as np

    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
