"""Web archives: one gzip member per record, written and read back as a sequence.

A task writes one archive file into a folder that all executors share and hands back the file's path; the
files are read by tasks of their own, each as a stream: members are decompressed piece by piece, a record
is framed by its content-length, and both digests are checked. Memory holds one record's payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmap.llm.rows import map_rows

CHUNK = 1 << 16
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: WARC-Date must be given; tables without a fetch time get this one.
UNKNOWN_DATE = "1970-01-01T00:00:00Z"

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = UNKNOWN_DATE) -> bytes:
    """One WARC/1.1 record as a gzip member of its own. A revisit keeps the HTTP head only."""
    head = HTTP_HEAD % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", _sha1(block)),
        ("WARC-Payload-Digest", _sha1(payload)),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(f"%{b:02X}" if b < 33 or b == 127 else chr(b) for b in url.encode("utf-8", "surrogatepass"))))
    if refers_to is not None:
        fields.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode("latin-1") + block + b"\r\n\r\n") + packer.flush()


def _members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The gzip members one after the other, each as its decompressed pieces."""
    rest = stream.read(CHUNK)
    while rest:
        inflate = zlib.decompressobj(31)
        left = [rest]

        def pieces(inflate=inflate, left=left) -> Iterator[bytes]:
            while not inflate.eof:
                data = left[0] or stream.read(CHUNK)
                if not data:
                    raise ValueError("archive ends inside a member")
                out = inflate.decompress(data, CHUNK)
                left[0] = inflate.unconsumed_tail if not inflate.eof else inflate.unused_data
                if out:
                    yield out

        whole = pieces()
        yield whole
        for _ in whole:  # to the member's end, if the caller stopped early
            pass
        rest = left[0] or stream.read(CHUNK)


class _Framed:
    """Reads lines and exact lengths from pieces."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held = pieces, bytearray()

    def line(self) -> bytes:
        while (at := self.held.find(b"\r\n")) < 0:
            self._more()
        out = bytes(self.held[:at])
        del self.held[: at + 2]
        return out

    def exactly(self, n: int) -> bytes:
        out = bytearray()
        while len(out) < n:
            if not self.held:
                self._more()
            part = self.held[: n - len(out)]
            out += part
            del self.held[: len(part)]
        return bytes(out)

    def at_end(self) -> bool:
        return not self.held and next(self.pieces, None) is None

    def _more(self) -> None:
        piece = next(self.pieces, None)
        if piece is None:
            raise ValueError("record ends before its length")
        self.held += piece


def _page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_records(stream: BinaryIO) -> Iterator[tuple]:
    """Rows of RECORDS from one archive. A wrong frame or digest raises ValueError.

    A revisit has no payload of its own (null); its payload_bytes come from the HTTP head.
    """
    for member in _members(stream):
        framed = _Framed(member)
        if framed.line() != b"WARC/1.1":
            raise ValueError("not a WARC/1.1 record")
        fields: dict[str, str] = {}
        while line := framed.line():
            name, _, value = line.decode("latin-1").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = framed.exactly(int(fields["content-length"]))
        if framed.exactly(4) != b"\r\n\r\n" or not framed.at_end():
            raise ValueError("record does not end where its length says")
        if fields["warc-block-digest"] != _sha1(block):
            raise ValueError("block digest differs")
        head, _, payload = block.partition(b"\r\n\r\n")
        length = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))[15:])
        kind = fields["warc-type"]
        if kind == "response" and (len(payload) != length or fields["warc-payload-digest"] != _sha1(payload)):
            raise ValueError("payload digest differs")
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        refers = _page_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
        yield _page_of(fields["warc-record-id"]), length, digest, kind, refers, fields.get("warc-target-uri"), payload if kind == "response" else None


def _filesystem(folder: str):
    """The file system of a folder's URI and the path there; a plain path is local."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def mark_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is set on the rows that repeat another page's payload.

    Of rows with equal payloads of at least ``least_bytes`` bytes the largest page_id is the response.
    """
    sized = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha2("html", 256)
    keys = sized.where(F.octet_length("html") >= least_bytes).select("page_id", digest.alias("digest"))
    shared = keys.groupBy("digest").agg(F.max("page_id").alias("kept"), F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n"))
    shared = shared.where("n > 1 and kept is not null").select("digest", "kept")
    return (
        sized.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, digest))
        .join(shared, "digest", "left")
        .select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as ``*.warc.gz`` into ``folder``; (path, records) per file.

    ``folder`` must be shared by all executors. A file appears under its final name when it is complete;
    a task that runs twice leaves a file that nobody lists. A null html is an empty payload, a null url
    leaves the target out, a null page_id gives an empty record id. Rows that repeat the largest page_id
    and its payload are responses too.
    """
    run_id = uuid.uuid4().hex

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        system, path = _filesystem(folder)
        system.create_dir(path, recursive=True)
        context = TaskContext.get()
        name = f"{path}/{run_id}-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, n = None, 0
        for page_id, url, html, refers_to in rows:
            out = out or system.open_output_stream(f"{name}.part", compression=None)
            out.write(record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to))
            n += 1
        if out:
            out.close()
            system.move(f"{name}.part", name)
            yield name, n

    return map_rows(mark_revisits(pages, least_bytes), run, "path string, records long")


def read_archives(paths: DataFrame, folder: str) -> DataFrame:
    """RECORDS rows of the files listed in ``paths`` (column path) below ``folder``, one stream per file."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        system, _ = _filesystem(folder)
        for (path,) in rows:
            with system.open_input_stream(path, compression=None) as stream:
                yield from read_records(stream)

    n = max(1, paths.count())
    return map_rows(paths.select("path").repartition(n, "path"), run, RECORDS)
