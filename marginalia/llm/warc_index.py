"""WARC archives of pages and their capture index, merged from sorted runs by a loser tree."""

from __future__ import annotations

import gzip
import hashlib
import io
import pickle
import tempfile
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_path

CRLF = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Repeated payloads up to which they (some 60 bytes each) go to every task; payload of an archive.
SMALL, ARCHIVE_BYTES = 200_000, 2**28
#: A capture without a time of its own gets this second plus its id (mod 2**31).
BASE_TIME = 1_700_000_000
_RUN = "url_key string, captured string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, archive string, offset long, run string, seq long"


def decisions(pages: DataFrame, least: int) -> DataFrame:
    """Pages with digest, size and, for revisits, the page they refer to.

    Of payloads of ``least`` bytes or more that are equal, the page with the largest id is
    stored. Ids and digests alone are compared, pre-aggregated a partition; only payloads that
    repeat are joined back, broadcast up to ``SMALL`` of them, so that html stays where it is;
    beyond, in a join that Spark splits where a payload is hot.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    digest, size = F.sha1(html.cast("binary")), F.octet_length(html).cast("long")
    kept = pages.select(digest.alias("payload_digest"), "page_id").where(size >= least)
    kept = kept.groupBy("payload_digest").agg(F.max("page_id").alias("stored_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    kept = cut(kept, "warc-repeated")
    if kept.limit(SMALL + 1).count() <= SMALL:
        kept = F.broadcast(kept)
    found = pages.withColumn("payload_bytes", size).withColumn("payload_digest", digest).join(kept, "payload_digest", "left")
    again = (F.col("payload_bytes") >= least) & (F.col("page_id") < F.col("stored_id"))
    return found.withColumn("refers_to", F.when(again, F.col("stored_id")))


def record_text(date: str | None) -> "F.Column":
    """A WARC record of a decided page, without the blank lines that end it."""
    second = F.lit(BASE_TIME) + F.coalesce(F.pmod(F.col("page_id"), F.lit(2**31)), F.lit(0))
    at = F.coalesce(F.col(date).cast("timestamp"), F.timestamp_seconds(F.lit(BASE_TIME))) if date else F.timestamp_seconds(second)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col("html"), F.lit(""))))
    uri = F.regexp_replace(F.col("url"), "[\\x00-\\x1F\\x7F]", "%20")
    lines = [
        F.lit("WARC/1.1"),
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: <urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT}{CRLF}WARC-Refers-To: <urn:x-page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, least: int = 1000, per_file: int = 2000, date: str | None = None) -> list[str]:
    """Write a WARC record a page to gzipped archives; returns their folders.

    The text sink ends each value by a separator; with two blank lines as that separator its
    files are WARC files byte for byte, committed and retried as any Spark output. An archive
    holds ``per_file`` records and ``ARCHIVE_BYTES`` of payload at most, but for a larger single
    record: pages of like size, by powers of 16, share a folder with its own number of records.
    """
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    bits = F.ceil(F.log2(F.greatest(size, F.lit(1)) / 2**16) / 4)
    level = F.greatest(F.lit(0), bits).cast("int")  # 64 KB, 1 MB, 16 MB, 256 MB, 4 GB
    decided, folders = decisions(pages, least), []
    for (k,) in sorted(tuple(r) for r in pages.select(level).distinct().collect()):
        folders.append(f"{path}/size-{k}")
        records = decided.where(level == k).select(record_text(date).alias("value"))
        most = max(1, min(per_file, ARCHIVE_BYTES // 2 ** (16 + 4 * k)))
        records.write.options(compression="gzip", lineSep=CRLF * 2, maxRecordsPerFile=most).text(folders[-1])
    return folders


def url_key(url: str | None) -> str:
    """Sort-friendly URL: host labels from the right, then path and query; no fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower().removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def parse_archive(content: bytes, archive: str) -> Iterator[dict]:
    """Index entries of one gzipped archive, one record in memory at a time."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        offset = 0
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{archive}: no record at {offset}")
            used, head = len(line), {}
            while (line := f.readline()) not in (b"\r\n", b""):
                used += len(line)
                name, _, value = line.decode().partition(":")
                head[name.lower()] = value.strip()
            block = f.read(int(head["content-length"]))
            used += 2 + len(block) + len(f.read(4))
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
            digest, revisit = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"] == "revisit"
            if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"{archive}: the payload at {offset} is damaged")
            page, refers = (head.get(k, "")[len("<urn:x-page:") : -1] for k in ("warc-record-id", "warc-refers-to"))
            yield {
                "url_key": url_key(head.get("warc-target-uri")), "captured": "".join(c for c in head["warc-date"] if c.isdigit()), "page_id": int(page) if page else None, "record_type": head["warc-type"],
                "refers_to": int(refers) if refers else None, "payload_digest": digest, "payload_bytes": size, "archive": archive, "offset": offset,
            }
            offset += used


def _order(row: dict) -> tuple:
    return row["url_key"], row["captured"], (row["page_id"] is not None, row["page_id"] or 0)


def sorted_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Read archives back; the entries of each, sorted by URL key, time and id, are one run."""
    schema = _schema(spark, _RUN)

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = "/".join(where.rsplit("/", 2)[1:])
                rows = sorted(parse_archive(content.as_py(), name), key=_order)
                for i, row in enumerate(rows):
                    row |= {"run": name, "seq": i}
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, _RUN)


def _schema(spark: SparkSession, text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], text).schema)


def loser_tree(runs: list[Iterator], key: Callable) -> Iterator:
    """Merge sorted iterators: inner nodes hold the losers of their matches, so that taking a
    row replays one path, a comparison a level. Equal keys come in the order of the runs."""
    k = len(runs)
    if not k:
        return
    end = object()
    heads = [next(r, end) for r in runs]
    keys = [None if h is end else (*key(h), i) for i, h in enumerate(heads)]
    tree = [-1] * k

    def beats(a: int, b: int) -> bool:
        return keys[a] is not None and (keys[b] is None or keys[a] < keys[b])

    for i in range(k):
        winner, node = i, (i + k) // 2
        while node:
            if tree[node] < 0:
                tree[node], winner = winner, -1
                break
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        if winner >= 0:
            tree[0] = winner
    while keys[w := tree[0]] is not None:
        yield heads[w]
        heads[w] = next(runs[w], end)
        keys[w] = None if heads[w] is end else (*key(heads[w]), w)
        winner, node = w, (w + k) // 2
        while node:
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner


class SpilledRuns:
    """Runs of one task in an unnamed temporary file, read back in blocks for the merge."""

    def __init__(self, block: int):
        self.file, self.block, self.at = tempfile.TemporaryFile(), block, {}
        self.name, self.rows = None, []

    def add(self, name: str, row: dict) -> None:
        if name != self.name or len(self.rows) >= self.block:
            self.flush()
            self.name = name
        self.rows.append(row)

    def flush(self) -> None:
        if self.rows:
            self.at.setdefault(self.name, []).append(self.file.tell())
            pickle.dump(self.rows, self.file, pickle.HIGHEST_PROTOCOL)
            self.rows = []

    def read(self) -> list[Iterator[dict]]:
        def rows(places):
            for p in places:
                self.file.seek(p)
                yield from pickle.load(self.file)

        self.flush()
        return [rows(places) for places in self.at.values()]


def merged_index(runs: DataFrame, block: int = 512) -> DataFrame:
    """K-way merge of sorted runs to one globally ordered index.

    Range partitions over the whole key (URL key, time, id, so a URL that fills a third of the
    index is spread too) get their part of each run; Spark's sort keeps runs apart and in
    order, and each task merges its runs by a loser tree over blocks on disk. ``shard`` and
    ``shard_pos`` number the result: their order is that of URL key, time and id.
    """
    names = [f.name for f in runs.schema if f.name not in ("run", "seq")]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema if f.name in names) + ", shard int, shard_pos long"
    schema = _schema(runs.sparkSession, out)

    def merge(batches):
        spilled, shard = SpilledRuns(block), TaskContext.get().partitionId()
        for batch in batches:
            for row in batch.to_pylist():
                name = row.pop("run")
                row.pop("seq")
                spilled.add(name, row)
        rows = []
        for n, row in enumerate(loser_tree(spilled.read(), _order)):
            rows.append(row | {"shard": shard, "shard_pos": n})
            if len(rows) == 4096:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        spilled.file.close()

    dealt = runs.repartitionByRange("url_key", "captured", "page_id", "run", "seq").sortWithinPartitions("run", "seq")
    return dealt.mapInArrow(merge, out)


def capture_index(pages: DataFrame, least: int = 1000, date: str | None = None, path: str | None = None) -> DataFrame:
    """Write archives, read them back, merge their runs: one row a page in capture order.

    Null html: an empty payload. Null url: an empty URL key. Null page_id: a response that
    nothing refers to. Repeated rows are captured each; those that share the largest id are
    all responses. No pages: no archives, an empty index. Extra columns are not read.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    columns = ["page_id", "url", "html", *([date] if date else [])]
    folders = write_archives(pages.select(F.col("page_id").cast("long"), *columns[1:]), path, least, date=date)
    runs = sorted_runs(spark, folders) if folders else spark.createDataFrame([], _RUN)
    return merged_index(cut(runs, "capture-runs"))
