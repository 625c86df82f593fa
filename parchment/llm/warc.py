"""WARC archives: written as one gzip stream each, rewritten with a member for every record, read back by offset.

An archive is a row (archive, data), so that any store that Spark writes can hold it and a lost task leaves nothing
behind. Archives have about ARCHIVE_BYTES of records, or one record if that is longer. The sidecar index is a table of its
own, one row a record. Records hold HTTP responses, whose entity is the payload; revisits hold the head alone.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import saved

ARCHIVE_BYTES = 4 << 20
MIN_REVISIT_BYTES = 100
#: Records, of 16 bytes each, up to which an index is broadcast to its archives; a larger one is joined by a shuffle.
MAX_BROADCAST_RECORDS = 1 << 20
GZIP = 31  # zlib's window bits for the gzip format
ARCHIVE_SCHEMA = "archive string, data binary"
NORMAL_SCHEMA = "archive string, data binary, offsets array<struct<record_id: string, offset: long, length: long>>"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, intact boolean"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def make_record(page_id, url, kind: str, refers_to, size: int, digest: str, payload: bytes) -> bytes:
    """A WARC/1.1 record of an HTTP response. Revisits have its head alone, which states the payload's size all the same."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None:  # line ends can't stand in a header
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """The fields below the first line of a head, by lower-case name."""
    fields = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in fields}


def split_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head, whole record) of each record of an inflated archive, in order."""
    while True:
        head = b""
        while not head.endswith(b"\r\n\r\n"):
            line = stream.readline()
            if not line:
                if head:
                    raise ValueError("an archive ends inside a head")
                return
            head += line
        fields = parse_head(head[:-4])
        if "content-length" not in fields:
            raise ValueError("a record states no length")
        rest = stream.read(int(fields["content-length"]) + 4)
        if not rest.endswith(b"\r\n\r\n"):
            raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
        yield fields, head + rest


class _Inflated(io.RawIOBase):
    """The content of gzip members, one after the other, inflated once and piece by piece as it is read. Zeros may follow the
    last member; anything else that isn't a whole member is an error."""

    def __init__(self, data: bytes):
        self.data, self.at, self.unzip = memoryview(data), 0, zlib.decompressobj(GZIP)

    def readable(self):
        return True

    def readinto(self, out):
        while True:
            if self.unzip.eof:
                self.at -= len(self.unzip.unused_data)
                while self.at < len(self.data) and self.data[self.at] == 0:
                    self.at += 1
                if self.at >= len(self.data):
                    return 0
                self.unzip = zlib.decompressobj(GZIP)
            if self.at >= len(self.data) and not self.unzip.unconsumed_tail:
                raise ValueError("an archive's gzip stream is cut off")
            try:
                piece = self.unzip.decompress(self.unzip.unconsumed_tail or self._more(), len(out))
            except zlib.error as error:
                raise ValueError("an archive has what isn't gzip") from error
            if piece:
                out[: len(piece)] = piece
                return len(piece)

    def _more(self):
        piece = self.data[self.at : self.at + (1 << 16)]
        self.at += len(piece)
        return piece


def normalise(data: bytes) -> tuple[bytes, list[dict]]:
    """One gzip stream over all records, or several with any number of records each, as one member for each record, and
    where each member lies."""
    out, offsets = io.BytesIO(), []
    for fields, record in split_records(io.BufferedReader(_Inflated(data), 1 << 16)):
        zip_ = zlib.compressobj(6, zlib.DEFLATED, GZIP)
        member = zip_.compress(record) + zip_.flush()
        offsets.append({"record_id": fields.get("warc-record-id"), "offset": out.tell(), "length": len(member)})
        out.write(member)
    return out.getvalue(), offsets


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) for each row of pages.

    Of rows with equal payloads of min_bytes or more, those with the smallest page_id are responses and the others
    revisit it; rows without a page_id revisit too, unless no row of the payload has one. Shorter payloads are all
    responses. Null html is an empty payload. Only digests that occur twice are joined with; where Spark finds those too
    many to broadcast, rows are shuffled by digest once, and a digest of very many rows is a skewed key that it can split.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2("html", 256)})
    repeated = saved(
        rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null").drop("n")
    )
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(repeated, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first_id")).alias("refers_to"),
    )


def _id(value) -> int | None:
    return None if pd.isna(value) else int(value)


def write_archives(marked: DataFrame) -> DataFrame:
    """Archives of one gzip stream each, from rows as mark_revisits gives them."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, zip_, parts, size = TaskContext.get().partitionId(), 0, zlib.compressobj(1, zlib.DEFLATED, GZIP), [], 0
        for batch in batches:
            for page_id, url, html, n_bytes, digest, kind, refers_to in batch.itertuples(index=False, name=None):
                payload = html.encode() if kind == "response" else b""
                record = make_record(_id(page_id), url, kind, _id(refers_to), n_bytes, digest, payload)
                parts.append(zip_.compress(record))
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"archive": [f"pages-{part:06d}-{n:06d}.warc.gz"], "data": [b"".join([*parts, zip_.flush()])]})
                    n, zip_, parts, size = n + 1, zlib.compressobj(1, zlib.DEFLATED, GZIP), [], 0
        if parts:
            yield pd.DataFrame({"archive": [f"pages-{part:06d}-{n:06d}.warc.gz"], "data": [b"".join([*parts, zip_.flush()])]})

    ids = marked.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})  # floats would round null columns' ids
    return ids.select("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to").mapInPandas(write, ARCHIVE_SCHEMA)


def normalise_archives(archives: DataFrame) -> DataFrame:
    """Archives with a gzip member for every record, each with its offsets."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["archive"], batch["data"]):
                normal, offsets = normalise(data)
                yield pd.DataFrame({"archive": [name], "data": [normal], "offsets": [offsets]})

    return archives.mapInPandas(rewrite, NORMAL_SCHEMA)


def sidecar_index(normal: DataFrame) -> DataFrame:
    """(archive, record_id, offset, length), one row a record, of archives as normalise_archives gives them."""
    return normal.select("archive", F.inline("offsets"))


def read_record(member: bytes) -> dict:
    """The fields of RECORD_SCHEMA of one gzip member; intact tells whether a response has the digest and size it states."""
    (fields, record), = split_records(io.BytesIO(zlib.decompress(member, GZIP)))
    block = record[len(record) - 4 - int(fields["content-length"]) : -4]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(parse_head(http)["content-length"])
    whole = fields["warc-type"] == "revisit" or (hashlib.sha256(payload).hexdigest() == digest and len(payload) == size)
    url = fields.get("warc-target-uri")
    return {"page_id": fields.get("page-id"), "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "record_type": fields["warc-type"],
            "refers_to": fields.get("refers-to-page-id"), "payload_bytes": size, "payload_digest": digest, "payload": payload, "intact": whole}


def read_archives(archives: DataFrame, index: DataFrame) -> DataFrame:
    """The records of archives (archive, data) that the index (archive, offset, length) names, each inflated alone from its
    offset; RECORD_SCHEMA. The places of one archive, of about ARCHIVE_BYTES, meet in one row."""
    text_ids = RECORD_SCHEMA.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data, places in zip(batch["data"], batch["places"]):
                yield pd.DataFrame([read_record(data[x["offset"] : x["offset"] + x["length"]]) for x in places])

    places = index.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))
    few = index.count() <= MAX_BROADCAST_RECORDS
    records = archives.select("archive", "data").join(F.broadcast(places) if few else places, "archive").select("data", "places").mapInPandas(read, text_ids)
    return records.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})
