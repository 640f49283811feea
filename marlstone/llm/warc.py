"""WARC archives: an index first, then coalesced byte-range reads.

Pages are written as gzipped WARC records, one member each, by the tasks that hold
them, into the cluster's shared folder. Each task yields an index row for every
record (file, offset, length, URL, digest), and the index is a table that is
committed before anything is read; a task that is run again writes another file,
and only files in the index count. Reading sorts the selected index rows by file
and offset, joins neighbouring ranges into one read and parses the records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.heavy import join_by_key
from marlstone.llm.storage import fresh_path, small_batches, stage_table

#: Bytes after which a task begins another archive; gap that a read bridges; bytes of one read.
FILE_BYTES, GAP, READ_BYTES = 256 << 20, 64 << 10, 8 << 20
#: Bytes of archives that one reading task is meant to have.
TASK_BYTES = 8 << 20
#: All records carry one date: equal pages give equal archives.
DATE = "2024-01-01T00:00:00Z"
_INDEX = "page_id long, url string, digest string, file string, offset long, length long, record_type string"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """One WARC record and the digest of its payload; with ``refers_to`` a revisit, whose block has the HTTP head alone."""
    digest = payload_digest(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + " ".join((url or "urn:x-page:none").split()), "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse_record(data: bytes) -> dict:
    """Fields of an unpacked record. The payload of a response is digested anew and must agree with its head."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")

    def page(name: str) -> int | None:
        number = fields.get(name, "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(number) if number not in ("", "none") else None

    return {"page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": page("WARC-Refers-To"), "payload": payload if kind == "response" else None}


def coalesce_ranges(offsets: np.ndarray, lengths: np.ndarray, gap: int = GAP, most: int = READ_BYTES) -> list[tuple[int, int]]:
    """Runs ``(first, past)`` of records, sorted by offset, to be read at once: gaps up to ``gap``, ``most`` bytes unless one record is longer."""
    runs, first = [], 0
    for i in range(1, len(offsets) + 1):
        if i == len(offsets) or offsets[i] - (offsets[i - 1] + lengths[i - 1]) > gap or offsets[i] + lengths[i] - offsets[first] > most:
            runs.append((first, i))
            first = i
    return runs


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(folder: str, file_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if sink is None or at >= file_bytes:
                    if sink is not None:
                        sink.close()
                    name, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    store, path = _open(name)
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    sink = store.open_output_stream(path, compression=None)
                data, digest = record(page_id, url, (html or "").encode(), refers_to)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(data) + packer.flush()
                sink.write(member)
                rows.append((page_id, url, digest, name, at, len(member), "response" if refers_to is None else "revisit"))
                at += len(member)
            if sink is not None:
                sink.flush()
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            names = ["page_id", "url", "digest", "file", "offset", "length", "record_type"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        if sink is not None:
            sink.close()

    return run


def write_archives(pages: DataFrame, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all ``pages`` (``page_id, url, html``) and return the index, a row for each record.

    Of pages with equal payloads of ``min_bytes`` or more the one of the least id is a
    response, the others revisit it. A null html is an empty payload. Pages without an
    id revisit one with an id; among themselves all are responses, as are repeated rows
    of the least id. A null URL is written as a URN. Other columns are ignored; an empty
    table has an empty index.
    """
    spark = pages.sparkSession
    small_batches(spark)
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.sha1(html).alias("_sha"), F.octet_length(html).alias("_n"))
    owners = source.select("page_id", "_sha", "_n").where(F.col("_n") >= min_bytes).groupBy("_sha").agg(F.min("page_id").alias("_owner"), F.count("*").alias("_copies")).where("_copies > 1 and _owner is not null")
    # a payload that very many pages share finds its owner where the pages lie
    marked = join_by_key(source, stage_table(owners, "owners"), ["_sha"], "_copies", pages.count(), "left")
    refers_to = F.when(F.col("_owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_owner")), F.col("_owner"))
    rows = marked.select("page_id", "url", "html", refers_to.alias("refers_to"))
    return stage_table(rows.mapInArrow(_write(fresh_path(spark, "warc"), file_bytes), _INDEX), "warc-index")


def _read(payloads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        if payloads:
            kinds["payload"] = pa.binary()
        name, source = None, None
        for batch in batches:
            files = np.array(batch.column(0).to_pylist(), dtype=object)
            offsets, lengths = (batch.column(k).to_numpy() for k in (1, 2))
            for start in np.append(0, np.flatnonzero(files[1:] != files[:-1]) + 1) if len(files) else []:
                same = np.flatnonzero(files[start:] != files[start])
                stop = start + int(same[0]) if len(same) else len(files)
                if files[start] != name:
                    name = files[start]
                    store, path = _open(name)
                    source = store.open_input_file(path)
                for first, past in coalesce_ranges(offsets[start:stop], lengths[start:stop]):
                    begin = int(offsets[start + first])
                    data = source.read_at(int(offsets[start + past - 1] + lengths[start + past - 1]) - begin, begin)
                    found = [parse_record(zlib.decompress(data[offsets[i] - begin : offsets[i] - begin + lengths[i]], 31)) for i in range(start + first, start + past)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in kinds.items()], list(kinds))

    return run


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the index rows given (all, or a selection), read by coalesced ranges of each file.

    Tasks are as many as the bytes of the records ask for; each has a run of the order by file and offset, also within one file.
    """
    small_batches(index.sparkSession)
    total = index.agg(F.sum("length")).first()[0] or 0
    ranges = index.select("file", "offset", "length").repartitionByRange(max(1, -(-total // TASK_BYTES)), "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return ranges.mapInArrow(_read(payloads), schema + (", payload binary" if payloads else ""))


def op4_warc_index_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written, then all records read back."""
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
o AS (SELECT h, min(page_id) AS owner FROM h WHERE n >= 0 GROUP BY h),
d AS (SELECT page_id, n, owner, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h.h, CAST(1 + 5 * i AS INTEGER), 5) AS BIGINT) >> s) & 31) + 1, 1)), '')), '') AS digest
  FROM h JOIN o USING (h))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM d
"""
