"""WARC archives: written as monolithic gzip streams, normalised to one member per record, indexed, read back.

1. Payload digests are grouped by (SHA-1, length) in one narrow shuffle; of equal payloads of at least
   `least_bytes` bytes the largest page id is written as a response, the others as revisits of it.
2. Each task writes its pages as WARC records into archives of bounded size, each one single gzip stream.
3. The normaliser inflates every such stream once, in pieces, rewrites each record as a gzip member of
   its own, and returns a sidecar index (archive, offset, length, record id), written as Parquet.
4. Readers fetch records by the index, parse them and take the digest of a revisit's payload from its
   header, so that every page is answered from the archives alone.

Archives are written through pyarrow's filesystems under an attempt's own name, and the table of written
archives names only those of successful attempts, so a lost executor leaves at most unused files. No
archive, record list or page group passes through the driver. Null html is an empty payload; null urls
are written as an empty target; repeated page ids are separate records; an empty table gives no archives.
Records are dated by the run that wrote them.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.llm.common import picked, save, scratch

ARCHIVE_BYTES, LEAST_BYTES, LEVEL, PIECE = 64 << 20, 1000, 2, 1 << 20
BROADCAST_ROWS = 50_000
GZIP = 31  # zlib's window bits for gzip members


def _open(uri: str):
    found, path = fs.FileSystem.from_uri(uri)
    return found, path


def record(key: uuid.UUID, date: str, page_id: int | None, url: str, payload: bytes, sha1: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has no payload of its own but states the length and digest of it.

    Page ids are headers of our own, as they may be null or repeat and a record's id may not.
    """
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{key}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{sha1}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join([*head, "", ""]).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record; the body must be as long as stated and match its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record's length is not as stated")
    if headers["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != headers["WARC-Payload-Digest"].removeprefix("sha1:"):
        raise ValueError("a payload does not match its digest")
    return headers, body


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Cuts one inflated stream into records, holding one record and one piece at a time."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while (end := held.find(b"\r\n\r\n")) >= 0:
            at = held.find(b"\r\nContent-Length: ", 0, end) + 18
            stop = end + 8 + int(held[at : held.find(b"\r\n", at)])
            if len(held) < stop:
                break
            yield bytes(held[:stop])
            del held[:stop]
    if held:
        raise ValueError("the stream ends within a record")


def inflate(source) -> Iterator[bytes]:
    unzip = zlib.decompressobj(GZIP)
    while piece := source.read(PIECE):
        while piece:
            yield unzip.decompress(piece, PIECE)
            piece = unzip.unconsumed_tail
    yield unzip.flush()
    if not unzip.eof:
        raise ValueError("the gzip stream is cut short")


def record_kinds(pages: DataFrame, least_bytes: int = LEAST_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`pages` (page_id, url, payload) with record_type and refers_to.

    Repeated rows of the largest page id are responses all; null page ids refer to a page that has one.
    """
    keyed = pages.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.length("payload"))
    groups = keyed.filter(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = save(groups.select("sha1", "bytes", "first"), "payload-groups")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    if groups.count() <= broadcast_rows:
        found = keyed.join(F.broadcast(groups), ["sha1", "bytes"], "left")
    else:  # payloads move by their page, not by a digest that very many pages may share
        told = keyed.select("page_id", "sha1", "bytes").join(groups, ["sha1", "bytes"]).filter(again).distinct()
        told = told.select(F.col("page_id").alias("of_page"), F.col("sha1").alias("of_sha1"), F.col("bytes").alias("of_bytes"), "first")
        found = keyed.join(told, F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("sha1") == F.col("of_sha1")) & (F.col("bytes") == F.col("of_bytes")), "left")
    return found.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows (page_id, url, payload, record_type, refers_to) as monolithic archives; (archive, n_records)."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        where.create_dir(path, recursive=True)
        name, sink, pack, count, size = "", None, None, 0, 0

        def close() -> pa.RecordBatch:
            sink.write(pack.flush())
            sink.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": [count]})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "record_type", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, payload, kind, refers_to = (c[i].as_py() for c in columns)
                if sink is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink, pack = where.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=GZIP)
                key = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{count}")
                raw = record(key, date, page_id, (url or "").replace("\r", "%0D").replace("\n", "%0A"), payload, hashlib.sha1(payload).hexdigest(), kind, refers_to)
                sink.write(pack.compress(raw))
                count, size = count + 1, size + len(raw)
                if size >= archive_bytes:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    return save(pages.mapInArrow(run, "archive string, n_records bigint"), "archives")


def normalise_archives(spark: SparkSession, archives: DataFrame, source: str, folder: str) -> DataFrame:
    """Rewrites monolithic archives with one gzip member per record; the index (archive, offset, length, record_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (here, old), (there, new) = _open(source), _open(folder)
        there.create_dir(new, recursive=True)
        for batch in batches:
            for name, expected in zip(batch.column("archive").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                out, at, count, index = f"{uuid.uuid4().hex}.warc.gz", 0, 0, {"archive": [], "offset": [], "length": [], "record_id": []}
                with here.open_input_stream(f"{old}/{name}", compression=None) as raw, there.open_output_stream(f"{new}/{out}", compression=None) as sink:
                    for item in records(inflate(raw)):
                        pack = zlib.compressobj(LEVEL, wbits=GZIP)
                        member = pack.compress(item) + pack.flush()
                        sink.write(member)
                        key = item[: item.index(b"\r\n\r\n")].split(b"WARC-Record-ID: ", 1)[1].split(b"\r\n", 1)[0].decode()
                        for c, v in zip(index, (out, at, len(member), key), strict=True):
                            index[c].append(v)
                        at, count = at + len(member), count + 1
                if count != expected:
                    raise ValueError(f"{name} has {count} of {expected} records")
                yield pa.RecordBatch.from_pydict(index)

    spread = archives.repartition(max(1, archives.count()))
    return save(spread.mapInArrow(run, "archive string, offset bigint, length bigint, record_id string"), "warc-index")


RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every indexed record, fetched at its offset, inflated alone and verified against its digest."""

    def number(text: str | None) -> int | None:
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        opened, source = None, None
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if name != opened:
                    if source:
                        source.close()
                    opened, source = name, where.open_input_file(f"{path}/{name}")
                source.seek(offset)
                headers, _ = parse(zlib.decompress(source.read(length), GZIP))
                rows.append({
                    "page_id": number(headers["X-Page-ID"]), "url": headers["WARC-Target-URI"], "payload_bytes": int(headers["X-Payload-Length"]),
                    "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": headers["WARC-Type"], "refers_to": number(headers.get("X-Refers-To-Page")),
                })
            schema = pa.schema([(c, pa.string() if k == "string" else pa.int64()) for c, k in (x.split() for x in RECORDS.split(", "))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = index.select("archive").distinct().count()
    return index.select("archive", "offset", "length").repartitionByRange(max(1, n), "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes `pages` to normalised archives in `folder`/warc and returns their index."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b""))
    rows = picked(pages, page_id=F.col(f"`{id_col}`").cast("long"), url=url_col, payload=payload)
    kinds = record_kinds(rows, least_bytes)
    raw, final = f"{folder}/monolithic", f"{folder}/warc"
    return normalise_archives(spark, write_archives(kinds, raw, archive_bytes), raw, final)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    index = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(index, f"{folder}/warc").drop("url")


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM g
"""
