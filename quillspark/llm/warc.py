"""WARC archives, index first.

Every task writes its pages as gzip members of one archive in the shared folder and returns an
index row a record: archive, offset, length, URL, digest. The index is a table; readers select
records from it, sort them by archive and offset, and fetch neighbouring byte ranges in one read.

Equal payloads of 100 bytes or more are stored once: the record with the smallest page_id is a
response and the others revisit it. Digests are counted by aggregation with map-side combination
and only repeated ones are joined back, so a payload with a third of all pages costs a task one
row. An archive's name holds a random part, so a task that runs again leaves no doubt: only what
the index names counts.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import blocks, table
from quillspark.runtime import shared_path, stash

#: Payloads shorter than this are never revisits.
LEAST_SHARED = 100
#: Ranges this near are read together, up to so many bytes.
GAP, READ = 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"
LEVEL = 1


def record_id(page_id, digest: str) -> str:
    """Id of the response record of a page, which its revisits name as well."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record(url: str | None, page_id, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """One WARC record. A revisit has the headers of its payload but not the payload; besides the standard
    reference to the response's record it names its page in a header of our own, which readers need no index for."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    own = record_id(page_id, digest) if refers_to is None else record_id(f"{page_id} {url} revisits {refers_to}", digest)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {own}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _line(text: str | None) -> str:
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def parse(raw: bytes) -> dict:
    """Headers and payload of one record; a revisit's length is that of the payload it stands for."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if headers["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload does not match its digest")
    page, refers = headers["WARC-Page-ID"], headers.get("WARC-Refers-To-Page")
    return {
        "page_id": int(page) if page else None,
        "url": headers["WARC-Target-URI"],
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": headers["WARC-Type"],
        "refers_to": int(refers) if refers else None,
        "payload": payload if headers["WARC-Type"] == "response" else None,
    }


def _zip(raw: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


INDEX = ["archive", "offset", "length", "page_id", "url", "digest"]
INDEX_SCHEMA = "archive string, offset long, length long, page_id long, url string, digest string"


def _write(root: str):
    def run(batches):
        out = archive = None
        offset = 0
        try:
            for batch in blocks(batches, "html"):
                if out is None:
                    archive = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    fs, path = pafs.FileSystem.from_uri(archive)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                rows = []
                for page, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    member = _zip(record(url, page, (html or "").encode(), digest, refers))
                    out.write(member)
                    rows.append((archive, offset, len(member), page, url, digest))
                    offset += len(member)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], INDEX)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to archives under ``root`` and return their index.

    A null html is the empty payload. Of rows that repeat a page_id and payload one is the response
    and the others revisit that same page_id. Rows with a null page_id are responses. Extra columns
    are ignored; an empty table gives an empty index and no archive.
    """
    spark = pages.sparkSession
    root = root or shared_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    long = rows.where(F.octet_length("html") >= LEAST_SHARED).where("page_id is not null").select("digest", "page_id")
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = stash(firsts, "warc-firsts").df
    shared = stash(long.join(firsts, "digest").select("page_id", "digest", "first").distinct(), "warc-shared").df
    # After the join the rows of one page_id and payload lie together; the first of them is the record.
    turn = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url"))
    marked = rows.join(shared, ["page_id", "digest"], "left").withColumn("turn", F.when(F.col("first").isNotNull(), turn))
    refers = F.when((F.col("first") != F.col("page_id")) | (F.col("turn") > 1), F.col("first"))
    index = marked.select("page_id", "url", "html", "digest", refers.alias("refers_to")).mapInArrow(_write(root), INDEX_SCHEMA)
    return stash(index, "warc-index").df


def _read(batches):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    opened: tuple[str | None, object] = (None, None)

    def fetch(ranges: list[tuple[int, int]]):
        nonlocal opened
        archive = ranges[0][0]
        if opened[0] != archive:
            fs, path = pafs.FileSystem.from_uri(archive)
            opened = archive, fs.open_input_file(path)
        first, last = ranges[0][1], ranges[-1][1] + ranges[-1][2]
        raw = opened[1].read_at(last - first, first)
        found = [parse(zlib.decompress(raw[a - first : a - first + n], 31)) for _, a, n in ranges]
        rows = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["url"], r["payload"]) for r in found]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    near: list[tuple[str, int, int]] = []
    for batch in batches:
        for place in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
            if near:
                archive, offset, length = near[-1]
                apart = place[1] - offset - length
                if place[0] != archive or not 0 <= apart <= GAP or place[1] + place[2] - near[0][1] > READ:
                    yield fetch(near)
                    near = []
            near.append(place)
    if near:
        yield fetch(near)


def read_records(index: DataFrame) -> DataFrame:
    """The records that ``index`` selects, read by coalesced byte ranges; payloads are checked
    against their digests. ``html`` is null for revisits."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"
    places = index.select("archive", "offset", "length").sortWithinPartitions("archive", "offset")
    return places.mapInArrow(_read, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_records(write_archives(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: What the archives must give back.
ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS head FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.head IS NULL OR f.head = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.head = p.page_id THEN NULL ELSE f.head END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND p.payload_bytes >= 100
"""
