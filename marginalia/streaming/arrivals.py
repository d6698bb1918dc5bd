"""Incremental ingest of dropped files: each content once, whatever its name and however often it comes."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import decode_text
from ..sources.reports import opened

SCHEMA = "path string, length long, digest string, first_seen timestamp, text string"
_FILES = "path string, modificationTime timestamp, length long, content binary"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(spark: SparkSession, inbox: str, table: str, checkpoint: str, files_per_batch: int = 100_000, max_age: str = "3650d") -> None:
    """Append the files of ``inbox`` (``*.txt``, any depth) not seen before to ``table``, then stop.

    Two memories lie in ``checkpoint``: the paths read, and, as keyed state in RocksDB on the executors, a SHA-256 a content. So a
    path is read once (what changes under a read path is not read again), and a file uploaded again under any name, in the same run
    or a later one, adds no row; which name of equal files of one batch stays is open. Files without a byte give no row, as Spark's
    file sources pass over them. The state holds 32 bytes a content and is never forgotten. A batch that fails is run again and replaces its own rows.
    Files of over ``max_age`` before the newest one are not read, a rule of the file source that bounds its memory of paths.
    The source looks up the files of a batch in a job of its own, by default a task a file up to 10,000; here in some tasks a core.
    """
    stream = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
    files = stream.option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", max_age).load(inbox)
    digest = F.sha2(F.coalesce("content", F.lit(b"")), 256)
    fresh = files.select("path", "length", digest.alias("digest"), F.current_timestamp().alias("first_seen"), decode_text(F.col("content")).alias("text")).dropDuplicates(["digest"])

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    before, listing = spark.conf.get(_PROVIDER), spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(4 * spark.sparkContext.defaultParallelism))  # the source takes the session's, batch by batch
    try:
        spark.conf.set(_PROVIDER, _ROCKS)  # a query takes the settings of its start
        try:
            run = fresh.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        finally:
            spark.conf.set(_PROVIDER, before)
        run.awaitTermination()
    finally:
        spark.conf.set(_LISTING, listing)


def _parts(table: str) -> tuple[dict[int, str], dict[int, str]]:
    """Folders of single batches, and of merged ones by the last batch that they hold; unfinished ones left out."""
    system, base = opened(table.rstrip("/"))
    found: dict[str, dict[int, str]] = {"batch": {}, "merged": {}}
    for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        m = re.fullmatch(r"(batch|merged)=(\d+)", info.base_name)
        if m and system.get_file_info(f"{info.path}/_SUCCESS").type == fs.FileType.File:
            found[m[1]][int(m[2])] = f"{table.rstrip('/')}/{info.base_name}"
    return found["batch"], found["merged"]


def _current(table: str) -> tuple[int, list[str]]:
    """The last batch of a table, and the folders that hold its rows: the newest merged one and the batches after it."""
    batches, merged = _parts(table)
    last = max(merged, default=-1)
    later = {k: v for k, v in batches.items() if k > last}
    return max([last, *later]), ([merged[last]] if merged else []) + [later[k] for k in sorted(later)]


def ingested(spark: SparkSession, table: str) -> DataFrame:
    """The rows of an ingested table (path, length, digest, first_seen, text); none before its first batch."""
    folders = _current(table)[1]
    return spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)


def compact(spark: SparkSession, table: str, bytes_per_file: int = 256 << 20) -> None:
    """Merge the batches of a table, between two runs of ``ingest``, into one folder of larger files.

    Readers take the merged folder from the moment its success mark stands; only then its parts go, so a compaction that is
    broken off loses no row and doubles none, and the next one clears what it left. Input partitions of ``bytes_per_file`` are written
    as they are read, without a shuffle.
    """
    last, folders = _current(table)
    batches, merged = _parts(table)
    if len(folders) > 1:
        size = "spark.sql.files.maxPartitionBytes"
        before = spark.conf.get(size)
        spark.conf.set(size, bytes_per_file)
        try:
            spark.read.schema(SCHEMA).parquet(*folders).write.mode("overwrite").parquet(f"{table.rstrip('/')}/merged={last}")
        finally:
            spark.conf.set(size, before)
        batches, merged = _parts(table)
    system, _ = opened(table)
    newest = max(merged, default=-1)
    for gone in [v for k, v in batches.items() if k <= newest] + [v for k, v in merged.items() if k < newest]:
        system.delete_dir(opened(gone)[1])
