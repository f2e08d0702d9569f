"""WARC archives: one gzip member per record, written by partition and read sequentially.

An archive is a run of whole members. ``write`` makes one row per archive (name, bytes), cut at about
``archive_bytes``, so that archives live in any table or file system that Spark reaches; ``read`` walks
each archive with an incremental decompressor, frames records by Content-Length and verifies payload
digests. ``read_files`` reads archives that lie as files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, slices, table

#: Payloads of fewer bytes are stored again instead of referred to.
SMALL = 1000
DATE = "2024-01-01T00:00:00Z"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member. A revisit has no payload; its digest is that of the payload it stands for."""
    kind = "response" if refers_to is None else "revisit"
    block = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n") + packer.flush()


class Reader:
    """Records of one archive in order; ``pull`` gives its next bytes, or none at its end."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.compressed = chunks, b""

    def members(self) -> Iterator["Member"]:
        while True:
            if not self.compressed:
                self.compressed = next(self.chunks, b"")
                if not self.compressed:
                    return
            member = Member(self)
            yield member
            member.finish()


class Member:
    """One gzip member, decompressed as it is read."""

    def __init__(self, reader: Reader):
        self.reader, self.unpack, self.plain = reader, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Decompress a piece; false at the member's end."""
        while not self.unpack.eof:
            data = self.reader.compressed or next(self.reader.chunks, b"")
            if not data:
                raise ValueError("the archive ends inside a record")
            piece = self.unpack.decompress(data, 1 << 16)
            self.reader.compressed = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if piece:
                self.plain += piece
                return True
        return False

    def head(self) -> dict[str, str]:
        while (at := self.plain.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise ValueError("a record without a complete header")
        lines = self.plain[:at].decode().split("\r\n")
        self.plain = self.plain[at + 4 :]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.plain and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            piece, self.plain = self.plain[:n], self.plain[n:]
            n -= len(piece)
            yield piece

    def finish(self) -> None:
        while self.more():
            pass
        if self.plain != b"\r\n\r\n":
            raise ValueError("a record goes on after its Content-Length")


def _number(urn: str | None):
    inner = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def records(chunks: Iterator[bytes], with_payload: bool = True) -> Iterator[dict]:
    """Every record of an archive, its payload digest verified where the record holds the payload."""
    for member in Reader(chunks).members():
        head = member.head()
        sha, kept = hashlib.sha1(), []
        for piece in member.take(int(head["content-length"])):
            sha.update(piece)
            if with_payload:
                kept.append(piece)
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "response" and sha.hexdigest() != digest:
            raise ValueError(f"payload digest of {head['warc-record-id']} doesn't hold")
        yield {
            "page_id": _number(head["warc-record-id"]),
            "url": head.get("warc-target-uri"),
            "payload_bytes": int(head["warc-payload-length"]),
            "payload_digest": digest,
            "record_type": head["warc-type"],
            "refers_to": _number(head.get("warc-refers-to")),
            "payload": b"".join(kept) if head["warc-type"] == "response" else None,
        }


def with_referrals(pages: DataFrame, salts: int = 16) -> DataFrame:
    """page_id, url, html, payload_digest, refers_to.

    Of pages with equal payloads of at least ``SMALL`` bytes, the one with the largest page_id is
    stored and the others refer to it. A null html is an empty payload. Rows that repeat the largest
    page_id are all stored; null page_ids refer to any other, and are stored where there is none. The
    join carries ids and digests only, and deals the pages of a digest over ``salts`` tasks; pages are
    joined by the page's own id. An empty table gives an empty result.
    """
    pages = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("payload_digest", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    big = pages.filter(F.octet_length("html") >= SMALL).select("page_id", "payload_digest")
    target = big.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 AND refers_to IS NOT NULL")
    # A payload may stand on a large share of all pages.
    target = target.drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    refer = (
        big.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
        .join(target, ["payload_digest", "salt"])
        .filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .distinct()
        .select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), "refers_to")
    )
    # The digest is in the key too: rows that share a page_id may have different payloads.
    return pages.join(refer, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")), "left").drop("p", "d")


def write(pages: DataFrame, archive_bytes: int = 4 << 20) -> DataFrame:
    """Archives of ``with_referrals``' rows: one row (records, archive) per archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("records", pa.int64()), ("archive", pa.binary())])
        made, size = [], 0
        full = lambda: pa.RecordBatch.from_arrays([pa.array([len(made)], pa.int64()), pa.array([b"".join(made)], pa.binary())], schema=schema)
        for batch in slices(batches):
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                page_id, url, html, digest, refers_to = row
                made.append(record(page_id, url, (html or "").encode(), digest, refers_to))
                size += len(made[-1])
                if size >= archive_bytes:
                    yield full()
                    made, size = [], 0
        if made:
            yield full()

    return pages.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(run, "records long, archive binary")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, error string"


def read(archives: DataFrame, archive_col: str = "archive", payload: bool = True, strict: bool = False) -> DataFrame:
    """The records of every archive, in bounded batches; without ``payload`` that column is left out.

    An archive that breaks off, or has a record that is ill-formed or whose payload isn't that of its
    digest, gives what comes before and one row with nothing but ``error``, as nothing says where the
    next record begins; with ``strict`` it ends the job. A null cell gives no rows. Revisits hold no
    payload, so their length and digest are what their header says. Repeated archives give repeated rows.
    """
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    if payload:
        kinds["payload"] = pa.binary()
    kinds["error"] = pa.string()

    def kept(found: Iterator[dict]) -> Iterator[dict]:
        try:
            yield from found
        except (ValueError, KeyError, zlib.error) as e:
            if strict:
                raise
            yield {"error": str(e) or type(e).__name__}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(kinds.items()))
        for batch in batches:
            for cell in batch.column(0):
                data = cell.as_buffer() if cell.is_valid else b""
                view = memoryview(data)
                rows, size = [], 0
                for r in kept(records((bytes(view[i : i + (1 << 20)]) for i in range(0, len(view), 1 << 20)), payload)):
                    rows.append(r)
                    size += len(r.get("payload") or b"")
                    if len(rows) >= 1000 or size >= 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select(archive_col).mapInArrow(run, RECORD if payload else RECORD.replace(", payload binary", ""))


def read_files(spark: SparkSession, path: str, payload: bool = True, strict: bool = False) -> DataFrame:
    """Records of the ``.warc.gz`` files under a path of any file system that Spark reads."""
    return read(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path), "content", payload, strict)


def op3_warc(spark, sf_dir):
    """Pages written as archives and read back: a row per page."""
    stored = checkpointed(write(with_referrals(table(spark, sf_dir, "pages"))))
    return read(stored, payload=False, strict=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), t AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN t.top IS NULL OR t.top = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN t.top <> p.page_id THEN t.top END AS refers_to
FROM p LEFT JOIN t ON t.d = p.d AND p.n >= 1000
"""
