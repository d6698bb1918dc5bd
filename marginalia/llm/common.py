"""Shared helpers of the training-data operators: tables, the shared folder, row maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}
_in_use: list = []


class Units(dict):
    """What a Python worker keeps of text units from batch to batch: one operator's at a time
    and ``most`` bytes at most; units of over ``LONGEST`` characters go after their batch."""

    LONGEST = 64

    def __init__(self, most: int = 64_000_000):
        self.most, self.size = most, 0

    def ready(self) -> "Units":
        """Say that this memory is in use: that of another operator, whose stage is over, is
        cleared, and this one where it is full."""
        for other in _in_use:
            if other is not self:
                other.forget()
        _in_use[:] = [self]
        if self.size > self.most:
            self.forget()
        return self

    def forget(self) -> None:
        self.clear()
        self.size = 0

    def done(self, new: list[str], each: int, more: int = 0) -> None:
        """After a batch: drop its long units, count ``each`` bytes and the text of the others,
        ``more`` bytes of results in all."""
        for u in new:
            if len(u) > self.LONGEST:
                self.pop(u, None)
            else:
                self.size += each + len(u)
        self.size += more


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a local session (tests, bench) gets a temporary folder;
    a cluster must name one, since a machine-local folder would lose data there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_folder:
        _own_folder[context.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
    return "file://" + _own_folder[context.applicationId]


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it, so that later plans start from the
    files and a lost executor costs no recomputation of what came before. Row groups are small,
    since a writer holds one in memory."""
    path = shared_path(df.sparkSession, label)
    df.write.option("parquet.block.size", 2**25).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, rows: int = 1000, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in parts of ``rows`` rows and about ``size`` bytes at most; a larger row is
    a part of its own."""
    weight = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            weight += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(weight)])
    start = 0
    while start < batch.num_rows:
        end = min(start + rows, int(np.searchsorted(upto, upto[start] + size, "right")) - 1)
        end = max(end, start + 1)
        yield batch.slice(start, end - start)
        start = end


def map_rows(df: DataFrame, f: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Arrow-batched map: ``f`` gets a dict of column lists, of bounded rows and bytes, and returns
    a dict of column lists."""
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = f(part.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(made[x.name], x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's text leaves 1 on division by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
