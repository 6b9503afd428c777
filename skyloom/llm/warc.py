"""Operator 9, WARC archives compressed record by record with a dictionary of their own.

Each task writes one archive: a Zstandard dictionary is built from its first records (DICTIONARY_SAMPLE bytes at most), stands in a leading
skippable frame, and every record is a frame of its own. Frames go through Spark's text writer, whose commit protocol drops what lost tasks
have written and which writes to any store; its line separator here is an empty skippable frame, which readers of Zstandard pass over.

Duplicates are found by a shuffle of digests alone (min by digest, so a payload that a third of all rows share is one partial row a task).

Defined cases: null html is an empty payload; a null url gives a record without target; a null page_id is never the original unless all its
copies are null, then each is a response; ids that are strings are percent-encoded in headers; rows that repeat the smallest page_id are each a response; an empty table gives no records; only
the id, url and html columns are read, so that other names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.scratch import folder
from skyloom.shipping import ship

LEVEL = 5
DICTIONARY_SAMPLE, DICTIONARY_BYTES = 2 << 20, 48 << 10
DICTIONARY_MAGIC, EMPTY_FRAME = 0x184D2A5D, "P*M\x18\x00\x00\x00\x00"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SPACE = uuid.UUID("5b1f9d3e-7c1a-4f0e-9a65-2f6f4a0d9c11")
RECORDS = "page_id {id}, url string, record_type string, refers_to {id}, payload_bytes long, payload_digest string, intact boolean"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(page) -> str:
    """An id as a header field has it: control characters, spaces and % of a string are escaped."""
    return quote(page, safe="!\"#$&'()*+,/:;<=>?@[\\]^`{|}~") if isinstance(page, str) else str(page)


def _urn(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page))}>"


def record(page, url: str | None, payload: bytes, refers_to, date: str = DATE) -> bytes:
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if page is not None:
        head.append(f"X-Page-ID: {_plain(page)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page-ID: {_plain(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary; of few or tiny records their bytes themselves."""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, records)) // 20))
    try:
        return zstandard.train_dictionary(size, records, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[:2048] for r in records)[-size:]


def _dictionary_frame(raw: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(raw)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def frames(blob: bytes) -> Iterator[tuple[int, int, bool]]:
    """(begin, end, skippable) of each frame, by the frame and block headers of the public format."""
    at, n = 0, len(blob)
    while at + 4 <= n:
        magic = struct.unpack_from("<I", blob, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + struct.unpack_from("<I", blob, at + 4)[0]
            yield at, end, True
            at = end
            continue
        if magic != 0xFD2FB528:
            raise ValueError(f"no Zstandard frame at byte {at}")
        flags = blob[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        while True:
            head = int.from_bytes(blob[end : end + 3], "little")
            end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            if head & 1:
                break
        end += 4 * (flags >> 2 & 1)
        yield at, end, False
        at = end


def read_archive(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    plain = zstandard.ZstdDecompressor()
    own = plain
    for i, (a, b, skip) in enumerate(frames(blob)):
        if skip:
            if i == 0 and struct.unpack_from("<I", blob, a)[0] == DICTIONARY_MAGIC:
                own = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain.decompress(blob[a + 8 : b])))
            continue
        data = own.decompress(blob[a:b])
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        yield fields, rest[: int(fields["content-length"])]


def resolved(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is null for responses."""
    key = [F.sha2("payload", 256).alias("sha"), F.length("payload").alias("size")]
    few = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    groups = few.filter(F.length("payload") >= least_bytes).select("page_id", *key).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("sha", "size", "first")
    joined = few.select("*", *key).join(groups, ["sha", "size"], "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = DATE) -> str:
    """Archives of ``pages`` (page_id, url, html) below ``path``, as part-*.warc.zst."""
    spark = ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[bytes] = []
        size, compressor = 0, None

        def begin() -> Iterator[bytes]:
            nonlocal compressor
            raw = dictionary(first)
            compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
            info = b"software: skyloom\r\nformat: WARC File Format 1.1\r\n"
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_urn('info')}\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            yield _dictionary_frame(raw) + compressor.compress(head.encode() + info + b"\r\n\r\n")
            yield from map(compressor.compress, first)
            first.clear()

        def out(rows: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["frame"])

        for batch in batches:
            rows: list[bytes] = []
            for page, url, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                r = record(page.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), date)
                if compressor is None:
                    first.append(r)
                    size += len(r)
                    if size >= DICTIONARY_SAMPLE:
                        rows += begin()
                else:
                    rows.append(compressor.compress(r))
            if rows:
                yield out(rows)
        if compressor is None and first:
            yield out(list(begin()))

    made = resolved(pages, least_bytes).mapInArrow(run, "frame binary")
    made.select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME).text(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(fs_path(path)):
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.rename(status.getPath(), fs_path(path, name.split(".")[0].split("-c000")[0] + ".warc.zst"))
    return path


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row for each response and revisit record of the archives: RECORDS. intact: the payload has the digest that the header states.

    A file is read whole by one task, so files should stay well below 2 GB; write() makes one for each of Spark's partitions.
    """
    ship(spark)
    number = id_type != "string"
    kind = pa.int64() if number else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (lambda x: None if x is None else int(x)) if number else (lambda x: None if x is None else unquote(x))
        for batch in batches:
            for blob in batch.column(0):
                rows = []
                for f, block in read_archive(blob.as_py()):
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    stated, size = f["warc-payload-digest"].removeprefix("sha1:"), int(f["x-payload-length"])
                    payload = block.partition(b"\r\n\r\n")[2]
                    if f["warc-type"] == "response":
                        intact = (size, stated) == (len(payload), d := digest(payload))
                        size, stated = len(payload), d
                    else:
                        intact = not payload
                    rows.append((own(f.get("x-page-id")), f.get("warc-target-uri"), f["warc-type"], own(f.get("x-refers-to-page-id")), size, stated, intact))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                types = (kind, pa.string(), pa.string(), kind, pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    return files.mapInArrow(run, RECORDS.format(id=id_type))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = write(pages, folder(spark, "warc"))
    return read(spark, path, pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVE = "(" + " + ".join(f"(instr('0123456789abcdef', substr(x, g * 5 + {k + 1}, 1)) - 1) * {16 ** (4 - k)}" for k in range(5)) + ")"
#: Five hexadecimal digits are four of base 32.
SQL = f"""
with p as (select page_id, coalesce(html, '') as h from pages),
f as (select h, min(page_id) as first, sha1(h) as x from p group by h)
select page_id, strlen(h)::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda g: {" || ".join(f"substr('{_DIGITS}', ({_FIVE} // {32 ** (3 - k)}) % 32 + 1, 1)" for k in range(4))}), '') as payload_digest,
  case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from p join f using (h)"""
