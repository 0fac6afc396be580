"""WARC archives as seekable Zstandard bundles: independent frames, a seek table as footer, and an index of records."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.common import text_or_empty
from catalogspark.session import materialize, new_dir

#: Fixed values of the seekable Zstandard format: the skippable frame that holds the seek table, and its footer.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
LEAST_SHARED_BYTES = 100
#: Stored bytes that one task reads back; they unpack to some times as many, a frame at a time.
READ_BYTES = 1 << 27
INDEX = "record_id string, bundle string, frame int, frame_start long, frame_bytes long, offset long, length long"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload binary"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_id(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: Column) -> Column:
    """The page_id in a record identifier; NULL for a page that has none."""
    return F.regexp_extract(record, "^<urn:page:(.*)>$", 1).try_cast("long")


def warc_record(kind: str, rid: str, uri: str, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record whose block is an HTTP response; a revisit has the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to:
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


class BundleWriter:
    """Groups records into Zstandard frames of about `frame_bytes` and closes with the seek table of the seekable format."""

    def __init__(self, out, name: str, frame_bytes: int, level: int = 3):
        self.out, self.name, self.frame_bytes = out, name, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.open, self.size, self.sizes, self.written, self.waiting = [], 0, [], 0, []

    def add(self, rid: str, record: bytes) -> list[tuple]:
        """Index rows of the frames that are complete by now."""
        self.waiting.append((rid, self.size, len(record)))
        self.open.append(record)
        self.size += len(record)
        return self.flush() if self.size >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.open:
            return []
        frame = self.compressor.compress(b"".join(self.open))
        self.out.write(frame)
        rows = [(rid, self.name, len(self.sizes), self.written, len(frame), at, n) for rid, at, n in self.waiting]
        self.sizes.append((len(frame), self.size))
        self.written += len(frame)
        self.open, self.size, self.waiting = [], 0, []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        table = b"".join(struct.pack("<II", *pair) for pair in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        return rows


def seek_table(file, size: int) -> list[tuple[int, int]]:
    """(start, compressed bytes) of every frame, read from the end of the file alone."""
    file.seek(size - 9)
    frames, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    entry = 12 if flags & 0x80 else 8
    file.seek(size - 9 - frames * entry)
    table, start, found = file.read(frames * entry), 0, []
    for i in range(frames):
        n = struct.unpack_from("<I", table, i * entry)[0]
        found.append((start, n))
        start += n
    return found


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, end) of the record that begins at `at`."""
    end = data.index(b"\r\n\r\n", at)
    fields = dict(re.findall(r"([^:\r\n]+): ([^\r\n]*)", data[at:end].decode()))
    n = int(fields["Content-Length"])
    block = data[end + 4 : end + 4 + n]
    return fields, block[block.index(b"\r\n\r\n") + 4 :], end + 4 + n + 4


def _row(fields: dict[str, str], payload: bytes) -> tuple:
    kind = fields["WARC-Type"]
    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha256:")
    return fields["WARC-Record-ID"], kind, fields["WARC-Target-URI"], fields.get("WARC-Refers-To"), digest, payload


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of at least 100 bytes, the smallest page_id is kept and the others refer to it.

    The first page of each payload is found with partial sums. The join back has one row per payload on one side, so
    adaptive execution can split a hot payload. Pages without page_id are all stored in full.
    """
    payload = text_or_empty("html").cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= LEAST_SHARED_BYTES).where("page_id IS NOT NULL")
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = rows.join(first.drop("n"), "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, path: str, *, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 28) -> DataFrame:
    """Write a WARC record per row of `pages` (page_id, url, html) below `path`; returns the index, stored there too.

    Each task writes bundles of about `bundle_bytes` of records under names of its own attempt, and only those that
    the stored index names belong to the archive, so repeated tasks do no harm. A task holds one frame at a time.
    NULL html is an empty payload, other columns are ignored, an empty table gives an empty index. Rows with one
    page_id share a record identifier, and the index has a row for each.
    """
    rows = with_revisits(pages).select(
        F.col("page_id").cast("string"), "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest",
        F.col("refers_to").cast("string"),
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(path)
        fs.create_dir(f"{root}/bundles", recursive=True)
        writer, total = None, 0
        frame = lambda rows: pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
        for batch in batches:
            found = []
            for page, url, payload, digest, refers in batch.itertuples(index=False):
                if writer is None:
                    name = f"bundles/{uuid.uuid4().hex}.warc.zst"
                    writer, total = BundleWriter(fs.open_output_stream(f"{root}/{name}", compression=None), name, frame_bytes), 0
                kind, rid = ("response" if refers is None else "revisit"), record_id(page)
                record = warc_record(kind, rid, quote(url, safe=":/?#[]@!$&'()*+,;=%"), digest, payload or b"", refers and record_id(refers))
                found += writer.add(rid, record)
                total += len(record)
                if total >= bundle_bytes:
                    found += writer.close()
                    writer = None
            yield frame(found)
        if writer is not None:
            yield frame(writer.close())

    rows.mapInPandas(write, INDEX).write.parquet(f"{path}/index")
    return pages.sparkSession.read.parquet(f"{path}/index")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive. The seek tables give the frames, which are dealt by bundle and place to tasks of about `READ_BYTES`.

    So a task reads neighbouring frames, one at a time, and neither few nor unequal bundles decide how many tasks share the work.
    """
    index = spark.read.parquet(f"{path}/index")
    stored = index.select("bundle", "frame_start", "frame_bytes").distinct().agg(F.sum("frame_bytes")).first()[0] or 0
    shares = max(spark.sparkContext.defaultParallelism, -(-stored // READ_BYTES))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(path)
        for batch in batches:
            for name in batch["bundle"]:
                with fs.open_input_file(f"{root}/{name}") as file:
                    found = [(name, start, n) for start, n in seek_table(file, file.size())]
                yield pd.DataFrame(found, columns=["bundle", "start", "n"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(path)
        for batch in batches:
            for name, frames in batch.sort_values("start").groupby("bundle"):
                with fs.open_input_file(f"{root}/{name}") as file:
                    for start, n in zip(frames["start"], frames["n"]):
                        file.seek(start)
                        data = zstandard.ZstdDecompressor().decompress(file.read(n))
                        at, rows = 0, []
                        while at < len(data):
                            fields, payload, at = parse_record(data, at)
                            rows.append(_row(fields, payload))
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])

    frames = index.select("bundle").distinct().mapInPandas(find, "bundle string, start long, n long")
    return frames.repartitionByRange(shares, "bundle", "start").mapInPandas(read, RECORD)


def fetch_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records named in `wanted` (record_id): each is one seek and one frame, by its place in the index."""
    places = spark.read.parquet(f"{path}/index").join(wanted.select("record_id").distinct(), "record_id")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(path)
        for batch in batches:
            for (name, start), rows in batch.groupby(["bundle", "frame_start"]):
                with fs.open_input_file(f"{root}/{name}") as file:
                    file.seek(start)
                    data = zstandard.ZstdDecompressor().decompress(file.read(int(rows["frame_bytes"].iloc[0])))
                found = [_row(*parse_record(data, int(at))[:2]) for at in rows["offset"]]
                yield pd.DataFrame(found, columns=[c.split()[0] for c in RECORD.split(", ")])

    return places.mapInPandas(read, RECORD)


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archive, read it back, and return what its records say: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response come from the payload read back, those of a revisit from the response that it refers to.
    There is a row for each row of `pages`; NULL page_ids, ties and repeated rows as in `write_bundles`.
    """
    spark = pages.sparkSession
    path = path or new_dir(spark, "warc")
    write_bundles(pages, path)
    read = read_bundles(spark, path).select(
        page_of(F.col("record_id")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )
    records = materialize(read, "warc-records")
    full = records.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("full_bytes")
    )
    joined = records.where("record_type = 'revisit'").join(full.distinct(), ["refers_to", "payload_digest"])
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = joined.withColumn("payload_bytes", F.col("full_bytes")).select(*columns)
    return records.where("record_type = 'response'").select(*columns).unionByName(revisits)
