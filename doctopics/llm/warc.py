"""WARC archives: written as monolithic gzip files, rewritten with one gzip member per record, and read back.

``write_archives`` puts a record per page into whole-file gzip streams with Spark's own text writer, the record terminator
being its line separator. Such a file cannot be entered in the middle. ``normalise_archives`` inflates each stream once,
window by window, writes every record as its own gzip member into a new archive and the members' places into a sidecar
index of JSON lines. ``read_archives`` opens the normalised archives member by member.

A response holds its payload; a revisit names the response with the same payload (equal SHA-1) by its record id and keeps
its payload's length in ``WARC-Payload-Length``. All files lie below a folder that all executors share. A task writes
under a name of its own and moves the file into place, so a repeated task gives the same archive.

A stream is bounded by records and by bytes. Pages are told apart by size class (equal payloads are of one class), and the
larger ones go into streams of fewer records, so that no file outgrows what one value can hold. Archives are rewritten and
read back in as many tasks as there are archives.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctopics.llm.base import materialise, shared_root

WINDOW = 1 << 20
FILE_RECORDS = 5_000
FILE_BYTES = 1 << 28
# Pages below so many bits of size share streams.
SIZE_BITS = (16, 20, 24, 28)
RECORD_END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
ID = "urn:page:"
MADE = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "archive string, offset long, length long"
)


def _header(*pairs: tuple[str, Column]) -> Column:
    parts = [F.lit("WARC/1.1\r\n")]
    for name, value in pairs:
        parts.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*parts, F.lit("\r\n"))


def base32_of_hex(hex_digest: Column) -> Column:
    """RFC 4648 base32, upper case, of 20 bytes given in hexadecimal: four groups of 40 bits, eight letters each."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.conv(F.substring(hex_digest, 1 + 10 * g, 10), 16, 10).cast("long") for g in range(4)]
    five = [F.shiftright(v, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1 for v in groups for i in range(8)]
    return F.concat(*[F.substring(F.lit(letters), f.cast("int"), 1) for f in five])


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``html``, ``sha1``, ``n_bytes`` and ``first``: the largest page id of an equal payload.

    Payloads are compared by digest; only digests are grouped, with a map-side maximum, and joined back. ``first`` is null
    for the page itself and for payloads below ``min_bytes``. Pages that share the largest id are all responses, as is a
    page without an id whose payload no page with an id has.
    """
    plain = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    plain = plain.withColumns({"sha1": F.sha1(F.col("html").cast("binary")), "n_bytes": F.octet_length("html").cast("long")})
    # equal payloads need their ids compared only where there are several
    most = plain.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisit = (F.col("n_bytes") >= min_bytes) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return plain.join(most, "sha1", "left").withColumn("first", F.when(revisit, F.col("last"))).drop("last")


def records(pages: DataFrame) -> DataFrame:
    """One column ``value``: a whole WARC record without its terminator, for ``with_revisits`` rows."""
    revisit = F.col("first").isNotNull()
    payload = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    name = F.lit(f"<{ID}")
    head = _header(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.concat(name, F.col("page_id"), F.lit(">"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.regexp_replace("url", r"\p{Cntrl}", "")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        ("WARC-Payload-Length", F.col("n_bytes").cast("string")),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(revisit, F.concat(name, F.col("first"), F.lit(">")))),
        ("Content-Type", F.lit("text/html")),
        ("Content-Length", F.octet_length(payload).cast("string")),
    )
    return F.concat(head, payload).alias("value")


def size_class(pages: DataFrame) -> Column:
    """Which of the size classes a page is of; the last one has no bound."""
    size = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col("url").cast("string")), F.lit(0))
    out = F.lit(len(SIZE_BITS))
    for k in reversed(range(len(SIZE_BITS))):
        out = F.when(size < 1 << SIZE_BITS[k], k).otherwise(out)
    return out


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES
) -> None:
    """Write all pages into monolithic ``*.txt.gz`` streams of at most ``file_records`` records each.

    Pages of 2**28 bytes or more stand alone; the streams of others have at most ``file_bytes`` bytes of pages. Payloads are
    shuffled once, by digest, and written where they land.
    """
    made = [r[0] for r in pages.select(size_class(pages).alias("k")).distinct().collect()]  # five at most
    for k in sorted(made) or [0]:
        most = max(1, file_bytes >> SIZE_BITS[k]) if k < len(SIZE_BITS) else 1
        marked = with_revisits(pages.filter(size_class(pages) == k), min_bytes)
        lines = marked.select(records(marked)).write.option("lineSep", RECORD_END.decode()).option("compression", "gzip")
        lines.option("maxRecordsPerFile", min(file_records, most)).text(f"{folder}/size={k}")


# ---------------------------------------------------------------- normalising


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def split_records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and whole record (with its terminator) of each record; holds one record and one window at a time."""
    have = bytearray()
    stream = iter(stream)
    while True:
        end = have.find(RECORD_END)
        while end < 0:
            more = next(stream, None)
            if more is None:
                if have.strip():
                    raise ValueError("archive ends within a header")
                return
            at = max(0, len(have) - 3)
            have += more
            end = have.find(RECORD_END, at)
        fields = parse_header(bytes(have[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        while len(have) < size:
            more = next(stream, None)
            if more is None:
                raise ValueError("archive ends within a record")
            have += more
        if have[size - 4 : size] != RECORD_END:
            raise ValueError("record without terminator")
        yield fields, bytes(have[:size])
        del have[:size]


def inflate(data: bytes) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or more members, window by window."""
    view, at = memoryview(data), 0
    while at < len(view):
        unzip = zlib.decompressobj(31)
        while not unzip.eof:
            if not unzip.unconsumed_tail and at >= len(view):
                raise ValueError("gzip stream is cut off")
            feed = unzip.unconsumed_tail
            if not feed:
                feed = view[at : at + WINDOW]
                at += len(feed)
            out = unzip.decompress(feed, WINDOW)
            if out:
                yield out
        at -= len(unzip.unused_data)


def member(record: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all machines share; ``s3a`` is what Spark calls ``s3``."""
    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"))


def _rewrite(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column("path")[i].as_py()
                name = hashlib.sha1(path.encode()).hexdigest()[:20]
                own = f"{root}/.{name}-{uuid.uuid4().hex}"
                index, at = [], 0
                with store.open_output_stream(f"{own}.warc.gz", compression=None) as out:
                    for fields, record in split_records(inflate(batch.column("content")[i].as_buffer())):
                        packed = member(record)
                        out.write(packed)
                        index.append((at, len(packed), fields.get("warc-record-id")))
                        at += len(packed)
                with store.open_output_stream(f"{own}.index.jsonl", compression=None) as out:
                    for a, n, record_id in index:
                        out.write(json.dumps({"offset": a, "length": n, "record_id": record_id}).encode() + b"\n")
                store.move(f"{own}.index.jsonl", f"{root}/{name}.index.jsonl")
                store.move(f"{own}.warc.gz", f"{root}/{name}.warc.gz")
                yield pa.record_batch([pa.array([f"{name}.warc.gz"]), pa.array([len(index)]), pa.array([at])], names=["archive", "records", "bytes"])

    return run


def normalise_archives(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Rewrite every ``*.gz`` below ``source`` into ``folder``; ``(archive, records, bytes)`` of what was written."""
    store, root = open_folder(folder)
    store.create_dir(root, recursive=True)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True)
    files = found.load(source).select("path", "content")
    return materialise(files.mapInArrow(_rewrite(folder), "archive string, records long, bytes long"), "archives")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows: list[tuple] = []
                with store.open_input_file(f"{root}/{name}") as archive:
                    places = store.open_input_stream(f"{root}/{name.removesuffix('.warc.gz')}.index.jsonl", compression=None).read()
                    for place in map(json.loads, places.splitlines()):
                        archive.seek(place["offset"])
                        record = zlib.decompress(archive.read(place["length"]), 31)
                        rows.append((*parse_record(record), name, place["offset"], place["length"]))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 8
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in MADE.split(", ")]
                )

    return run


def _page(value: str | None) -> int | None:
    found = re.fullmatch(rf"<{ID}(-?\d+)>", value or "")
    return int(found[1]) if found else None


def parse_record(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """Page id, payload length, payload digest, type and the page a revisit refers to; a response's payload is verified."""
    head, _, rest = record.partition(RECORD_END)
    fields = parse_header(head)
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    payload = rest[: int(fields["content-length"])]
    size = len(payload)
    if kind == "revisit":
        size = int(fields["warc-payload-length"])
    elif base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("payload does not match its digest")
    return _page(fields.get("warc-record-id")), size, digest, kind, _page(fields.get("warc-refers-to"))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the normalised archives, each opened at its place in the sidecar index.

    The names are dealt out in turn to as many tasks as there are archives; a number given is not merged at run time.
    """
    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(_read(folder), MADE)


def archive_pages(pages: DataFrame, min_bytes: int = 0, file_records: int = FILE_RECORDS) -> DataFrame:
    """Write, normalise and read back all ``pages``: a row for each page with its type, digest and place.

    Null html is an empty payload, a null url leaves the header out, a null page id gives a record without an id. Empty
    payloads count as equal to each other. An empty table gives no rows.
    """
    spark = pages.sparkSession
    base = f"{shared_root(spark)}/doctopics/warc-{uuid.uuid4().hex}"
    write_archives(pages, f"{base}/streams", min_bytes, file_records)
    return read_archives(normalise_archives(spark, f"{base}/streams", f"{base}/archives"), f"{base}/archives")
