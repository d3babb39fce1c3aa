"""Operator 11: WARC archives, written once per payload and read by byte ranges.

*Writing.* Pages are dealt by the digest of their payload, so that equal payloads follow each other in one task: the first
one is a ``response``, the others ``revisit`` it without a payload. A payload that holds more than a 10,000th of all
pages is decided by a broadcast of these (fewer than 10,000) digests and its pages are spread. Every record is a gzip
member of its own. A ``warcinfo`` record begins each file, and all its records name it.

*Reading.* Files are cut into byte ranges, each a row and a task's work. A task scans its range for the gzip
magic, decodes the headers of each candidate member to see whether it is a record, and owns the records that
start inside; the last one is read beyond the range's end. Where a file's records name their ``warcinfo``, a
candidate must name it too, so an archive inside a payload is never taken for a record. Payloads are
hashed as they are decoded and held only if asked for.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.llm.shared import kept, lean, plain_path, shared_folder, small_batches, store

#: A payload with more than this share of all pages is decided by broadcast.
HOT = 10_000
MAGIC = b"\x1f\x8b\x08"
#: Bytes of a file that are read at a time.
BLOCK = 1 << 20
#: Longest block of record or HTTP headers.
HEADERS = 1 << 20
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FILE = "file string, bytes long, records long"
RECORDS = ("file string, at long, length long, record_type string, record_id string, refers_to string, target_uri string, "
           "headers map<string,string>, payload_bytes long, payload_digest string, payload binary, problem string")
_RECORDS = pa.schema([
    ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
    ("refers_to", pa.string()), ("target_uri", pa.string()), ("headers", pa.map_(pa.string(), pa.string())),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])


# Writing

def _uri(url: str) -> str:
    """A header holds neither white space nor control characters: they are written as %XX."""
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)


def _record(kind: str, name: str, info: str, date: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date),
            *([("WARC-Warcinfo-ID", info)] if kind != "warcinfo" else []), *fields, ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(VERSION + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def _random() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


class _Archive:
    """The files of one task: a new one is begun when the last has ``most`` bytes."""

    def __init__(self, folder: str, part: int, date: str, most: int):
        self.store, self.root = store(folder)
        self.part, self.date, self.most = part, date, most
        self.out, self.done = None, []

    def add(self, kind: str, name: str, fields: list[tuple[str, str | None]], block: bytes) -> None:
        if self.out is not None and self.bytes >= self.most:
            self.close()
        if self.out is None:
            self.store.create_dir(self.root, recursive=True)
            self.file = f"part-{self.part:06d}-{len(self.done):04d}-{uuid.uuid4().hex}.warc.gz"
            self.out, self.bytes, self.records, self.info = self.store.open_output_stream(f"{self.root}/{self.file}", compression=None), 0, 0, _random()
            self._put(_record("warcinfo", self.info, "", self.date, [("WARC-Filename", self.file), ("Content-Type", "application/warc-fields")],
                              b"software: corpusqa\r\nformat: WARC File Format 1.1\r\n"))
        self._put(_record(kind, name, self.info, self.date, fields, block))
        self.records += 1

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.bytes += len(raw)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.file, self.bytes, self.records))
            self.out = None


def write(pages: DataFrame, folder: str, min_bytes: int = 1000, file_bytes: int = 1 << 30, parts: int | None = None,
          date: str | None = None) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) into ``folder`` and returns the manifest
    (``file``, ``bytes``, ``records``), which names the files that count; what failed attempts left is not in it.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one with the largest page_id is a response, the others
    revisit it. All smaller ones are responses. The page_id is the header ``X-Page-ID``, that of the response
    ``X-Refers-To-Page-ID``.

    Null html: an empty payload. Null url: no target. Null page_id: no such header, smaller than all others.
    Repeated rows: one response, the others revisit it (such rows meet in one task). Empty table: no file.
    Other columns are not read.
    """
    folder, date = plain_path(folder), date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    large = F.col("size") >= min_bytes
    sums = kept(rows.where(large).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")), "payloads")
    total = sums.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(sums.where(F.col("n") > total / HOT).select("digest", "keeper", F.lit(True).alias("hot")))
    rows = rows.join(hot, "digest", "left").withColumn("kind", F.when(~large, 0).when(F.col("hot").isNull(), 1)
                                                       .when(F.col("page_id").eqNullSafe(F.col("keeper")), 2).otherwise(3))
    # 0 small, 1 equal payloads meet here, 2 may be the response of a hot payload, 3 revisits one
    with_payload = F.when(F.col("kind") < 3, F.col("payload"))
    deal = F.when(F.col("kind") == 1, F.xxhash64("digest")).when(F.col("kind") == 2, F.xxhash64("digest", "page_id")).otherwise(F.xxhash64("digest", "page_id", "url"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("page_id", "url", with_payload.alias("payload"), "digest", "size", "kind", "keeper", deal.alias("deal"))
    order = dealt.repartition(n, "deal").sortWithinPartitions("digest", F.desc_nulls_last("page_id"), "url").drop("deal")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Archive(folder, TaskContext.get().partitionId(), date, file_bytes)
        last, first = None, None  # the large payload of the row before, and the page that holds it
        for batch in small_batches(batches, 64):
            for page, url, body, digest, size, kind, keeper in zip(*(c.to_pylist() for c in batch.columns)):
                again = kind == 3 or (kind > 0 and digest == last)
                if kind in (1, 2) and not again:
                    last, first = digest, page
                page_of = (keeper if kind > 1 else first) if again else None
                whole = f"<urn:uuid:{uuid.UUID(digest[:32], version=5)}>"  # the only response with this payload
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
                files.add("revisit" if again else "response", whole if kind and not again else _random(), [
                    ("WARC-Target-URI", None if url is None else _uri(url)),
                    ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"),
                    ("WARC-Profile", PROFILE if again else None), ("WARC-Refers-To", whole if again else None),
                    ("X-Page-ID", None if page is None else str(page)),
                    ("X-Refers-To-Page-ID", None if page_of is None else str(page_of)),
                    ("Content-Type", "application/http;msgtype=response")], http if again else http + body)
        files.close()
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in files.done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         names=["file", "bytes", "records"])

    order.mapInArrow(lean(put), _FILE).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_FILE).parquet(f"{folder}/manifest")


# Reading

class _Inflater:
    """The decoded bytes of the gzip member that begins at ``at``."""

    def __init__(self, fetch: Callable[[int], bytes], at: int):
        self.fetch, self.fed, self.unpack = fetch, at, zlib.decompressobj(31)

    def read(self, most: int = BLOCK) -> bytes:
        """The next bytes, none at the member's end."""
        while not self.unpack.eof:
            raw = self.unpack.unconsumed_tail
            if not raw:
                raw = self.fetch(self.fed)
                self.fed += len(raw)
                if not raw:
                    raise ValueError("cut off")
            try:
                out = self.unpack.decompress(raw, most)
            except zlib.error as e:
                raise ValueError(f"not a gzip member: {e}") from None
            if out:
                return out
        return b""

    @property
    def end(self) -> int:
        return self.fed - len(self.unpack.unused_data)

    def until(self, mark: bytes, held: bytearray) -> int:
        """Reads into ``held`` up to ``mark``; the place behind it."""
        seen = 0
        while (at := held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(held)
            piece = self.read(256)  # so that headers are seen where what follows is damaged
            if not piece or seen > HEADERS:
                raise ValueError("headers without an end")
            held += piece
        return at + len(mark)


def _fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _head(member: _Inflater, held: bytearray) -> tuple[dict[str, str], int, int]:
    """Header fields of the record, where its block begins, and the block's length."""
    held += member.read(256)
    if not held.startswith(b"WARC/"):
        raise ValueError("not a record")
    begin = member.until(b"\r\n\r\n", held)
    fields = _fields(bytes(held[:begin]))
    length = fields.get("content-length", "")
    if not length.isdigit() or "warc-type" not in fields or "warc-record-id" not in fields:
        raise ValueError("not a record")
    return fields, begin, int(length)


def _digest(labelled: str | None) -> str | None:
    """``sha1:`` and base 32 or hex digits as lower-case hex digits; null for anything else."""
    kind, _, digits = (labelled or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(digits.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", digits) else digits.lower() if re.fullmatch(r"[0-9A-Fa-f]{40}", digits) else None


def _decoded(member: _Inflater, held: bytearray, fields: dict[str, str], begin: int, length: int, with_payload: bool) -> dict:
    """A whole record. The payload is what follows the HTTP headers, or the block where there are none."""
    kind, size, skip = fields["warc-type"], None, begin
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        del held[:begin]
        skip = member.until(b"\r\n\r\n", held)
        size = _fields(bytes(held[:skip])).get("content-length", "")
        length, begin = length - skip, 0
    else:
        skip = begin
    if length < 0:
        raise ValueError("a block shorter than its headers")
    sha, got, kept_, tail = hashlib.sha1(), 0, bytearray(), bytearray()
    piece = bytes(held[skip:])
    while True:
        mine = piece[: max(0, length - got)]
        sha.update(mine)
        got += len(mine)
        if with_payload:
            kept_ += mine
        tail += piece[len(mine):]
        if len(tail) > 4 or not (piece := member.read()):
            break
    problem = None
    if got < length or bytes(tail) != b"\r\n\r\n":
        raise ValueError("a record shorter or longer than it says")
    said, found = _digest(fields.get("warc-payload-digest")), sha.hexdigest()
    if kind == "revisit":
        found, got = said, int(size) if size and size.isdigit() else None
    elif said is not None and said != found:
        problem = "the payload has another digest"
    return {"record_type": kind, "record_id": fields["warc-record-id"], "refers_to": fields.get("warc-refers-to"),
            "target_uri": fields.get("warc-target-uri"), "headers": list(fields.items()), "payload_bytes": got, "payload_digest": found,
            "payload": bytes(kept_) if with_payload and kind != "revisit" else None, "problem": problem}


def _info(fetch: Callable[[int], bytes]) -> str | None:
    """The id of a file's ``warcinfo`` record, if the record behind it names it."""
    try:
        first, held = _Inflater(fetch, 0), bytearray()
        fields, _, _ = _head(first, held)
        while first.read():
            pass
        after, _, _ = _head(_Inflater(fetch, first.end), bytearray())
    except ValueError:
        return None
    name = fields["warc-record-id"]
    return name if fields["warc-type"] == "warcinfo" and after.get("warc-warcinfo-id") == name else None


def records_of(fetch: Callable[[int], bytes], start: int, stop: int, with_payload: bool) -> Iterator[dict]:
    """The records that start in ``[start, stop)``. ``fetch`` gives some bytes from a place on, none at the end.

    A member that begins like a record but cannot be read to its end is a row with a ``problem``; the scan goes on
    behind its first byte."""
    info = _info(fetch)
    at = start
    while at < stop:
        raw = fetch(at)
        if not raw:
            return
        if len(raw) < len(MAGIC):
            raw += fetch(at + len(raw))
        found = raw.find(MAGIC)
        if found < 0:
            at += max(1, len(raw) - len(MAGIC) + 1)
            continue
        at += found
        if at >= stop:
            return
        member, held = _Inflater(fetch, at), bytearray()
        try:
            fields, begin, length = _head(member, held)
            if info is not None and info not in (fields.get("warc-warcinfo-id"), fields["warc-record-id"]):
                raise ValueError("a record of another file")
        except ValueError:
            at += 1
            continue
        try:
            row = _decoded(member, held, fields, begin, length, with_payload)
        except ValueError as e:
            yield {"at": at, "record_type": fields["warc-type"], "record_id": fields["warc-record-id"], "headers": list(fields.items()), "problem": str(e)}
            at += 1
            continue
        yield row | {"at": at, "length": member.end - at}
        at = member.end


def archives(spark: SparkSession, folder: str, glob: str = "*.warc.gz") -> DataFrame:
    """(file, bytes) of all archives below ``folder``, listed by Spark; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def read(files: DataFrame, folder: str | None = None, split: int = 64 << 20, with_payload: bool = False) -> DataFrame:
    """``RECORDS`` of the archives in ``files`` (file, bytes; names within ``folder``, or whole paths).

    ``payload_bytes`` and ``payload_digest`` (SHA-1, lower-case hex) are counted from the payload; for a revisit they
    are what its headers say of the whole payload. ``headers`` has lower-case names. ``problem`` tells what is wrong with a
    record that is damaged or whose payload has another digest; it is null otherwise.

    Empty files and bytes that are no record: no rows. Files that are listed twice are read twice.
    """
    spark = files.sparkSession
    root = None if folder is None else plain_path(folder)
    pieces = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                disk, path = store(plain_path(file) if root is None else f"{root}/{file}")
                yield from _ranged(disk, path, file, size, start)

    def _ranged(disk: pafs.FileSystem, path: str, file: str, size: int, start: int) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        with disk.open_input_file(path) as source:
            def fetch(at: int) -> bytes:
                if at >= size:
                    return b""
                n = at // BLOCK
                if n not in held:
                    if len(held) > 1:
                        held.clear()
                    held[n] = source.read_at(min(BLOCK, size - n * BLOCK), n * BLOCK)
                return held[n][at - n * BLOCK:]

            rows, weight = [], 0
            for row in records_of(fetch, start, min(start + split, size), with_payload):
                rows.append(row | {"file": file})
                weight += 1000 + len(row.get("payload") or b"")
                if weight > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                    rows, weight = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pieces.repartition(n, "file", "start").mapInArrow(lean(get), RECORDS)


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records of pages. A damaged record is an error."""
    def page(name: str) -> Column:
        return F.col("headers")[name].cast("long")

    sound = F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat("file", F.lit(": "), "problem")))
    rows = records.where("problem is not null or record_type in ('response', 'revisit')")
    return rows.select(page("x-page-id").alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"),
                       page("x-refers-to-page-id").alias("refers_to"))


def round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``pages`` written to a new folder in the shared one and read back."""
    folder = f"{shared_folder(pages.sparkSession)}/corpusqa-warc-{uuid.uuid4().hex}"
    return pages_of(read(write(pages, folder, min_bytes), folder))


SQL = """
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keeper END AS refers_to
FROM (SELECT page_id, h, strlen(h) >= 1000 AND row_number() OVER of_payload > 1 AS again, first_value(page_id) OVER of_payload AS keeper
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)
      WINDOW of_payload AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST))
"""
