"""Web archives (WARC 1.1) compressed with a dictionary of their own.

An archive is a `.warc.zst` file: a skippable frame that holds a Zstandard
dictionary, then one frame per record, so a record can be read alone. The
dictionary is built from all records of the archive, at most `ARCHIVE_BYTES` of
them at a time, so it follows the pages it is for and nothing is gathered from
the whole table. An archive with too few records for a dictionary has none.

Of the pages with equal payloads, the one with the largest page_id is a response;
the others are revisits that name it and carry its digest and length, no payload.
Only row numbers and digests are shuffled to find them.

Writing is repeatable: rows are numbered once in a stored copy, an archive holds
rows of one task in their order, and it is moved into place when complete. A task
that runs again replaces its archives with the same bytes. `index` in the folder
lists the archives; readers take no others. Folders are opened by pyarrow, so
they may lie on any file system it knows.

Defined results: a null payload is empty; a page without a url gets one made from
its row; characters no header may hold are percent-encoded in a url; a null
page_id is smaller than all others and comes back null; of repeated rows with the
largest page_id one is the response; an empty table gives no archives; further
columns are ignored. Memory is bounded by one archive, or one page if it is larger.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.session import as_table

# Record bytes after which an archive is closed.
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 110 << 10
# A dictionary is made from this many times its size, or it is made smaller.
SAMPLE_FACTOR = 16
LEVEL = 3
# Payloads of fewer bytes are always stored.
LEAST_BYTES = 0
# The pages bring no time of capture.
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_BREAK = b"\r\n"
_INDEX = "archive string, records bigint, record_bytes bigint, file_bytes bigint"
_WRITTEN = "row page_id url sha1 n_bytes html refers_row refers_to refers_url".split()
_RECORDS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def numbered(pages: DataFrame) -> DataFrame:
    """The pages with a row number, the length and digests of their payload, stored once."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    return as_table(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "page_id",
            "url",
            "html",
            F.octet_length("html").cast("bigint").alias("n_bytes"),
            F.unhex(F.sha1("html")).alias("sha1"),
            F.unhex(F.sha2("html", 256)).alias("content"),
        ),
        "pages",
    )


def revisits(rows: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """row, refers_row, refers_to, refers_url of the pages that repeat another's payload."""
    marks = rows.filter(F.col("n_bytes") >= least_bytes).select("row", "page_id", "url", "content")
    response = F.max_by(F.struct("row", "page_id", "url"), F.struct(F.col("page_id"), -F.col("row"))).alias("response")
    repeated = marks.groupBy("content").agg(response, F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = marks.select("row", "content").join(repeated, "content").filter("row <> response.row")
    return found.select(
        "row",
        F.col("response.row").alias("refers_row"),
        F.col("response.page_id").alias("refers_to"),
        F.col("response.url").alias("refers_url"),
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Writes a record per page (page_id, url, html) to archives in `folder`."""
    rows = numbered(pages)
    again = as_table(revisits(rows, least_bytes), "revisits")
    nothing = {"refers_row": "bigint", "refers_to": "bigint", "refers_url": "string"}
    whole = rows.join(again.select("row"), "row", "left_anti")
    whole = whole.withColumns({c: F.lit(None).cast(kind) for c, kind in nothing.items()})
    brief = rows.drop("html", "content").join(again, "row").withColumn("html", F.lit(None).cast("binary"))
    both = whole.select(*_WRITTEN).unionByName(brief.select(*_WRITTEN)).sortWithinPartitions("row")

    def write(batches):
        import pyarrow as pa

        part = TaskContext.get().partitionId()
        held, size, done = [], 0, []

        def close():
            name = f"pages-{part:06d}-{len(done):06d}.warc.zst"
            records = [_info(name, folder, date), *held]
            data = compressed(records)
            _store(folder, name, data)
            done.append((name, len(held), size, len(data)))

        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(len(_WRITTEN))), strict=True):
                held.append(record(folder, date, *(x.as_py() for x in row)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    close()
                    held, size = [], 0
        if held:
            close()
        columns = zip(*done, strict=True) if done else [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in _INDEX.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    both.mapInArrow(write, _INDEX).write.parquet(f"{folder}/index")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload of
    each record, read from the archives; payload is null for revisits, and for all
    without `payloads`. A payload that does not have its digest is an error."""

    def read(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in _RECORDS.split(", ")]

        def sent(rows):
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

        rows, size = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for data in records_of(_opened(folder, name)):
                    headers, block = parsed(data)
                    if headers["warc-type"] == "warcinfo":
                        continue
                    *told, payload = page_of(headers, block)
                    rows.append((*told, payload if payloads else None))
                    size += len(block) if payloads else 0
                    if len(rows) >= 10_000 or size >= ARCHIVE_BYTES:
                        yield sent(rows)
                        rows, size = [], 0
        if rows:
            yield sent(rows)

    index = spark.read.parquet(f"{folder}/index").select("archive")
    tasks = max(1, min(index.count(), 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return index.repartition(tasks).mapInArrow(read, _RECORDS)


def record(folder, date, row, page_id, url, sha1, n_bytes, html, refers_row, refers_to, refers_url) -> bytes:
    """One response, or a revisit where it refers to another row."""
    from base64 import b32encode

    again = refers_row is not None
    headers = {
        "WARC-Type": "revisit" if again else "response",
        "WARC-Record-ID": record_id(folder, row),
        "WARC-Date": date,
        "WARC-Target-URI": header_url(url, row),
        "WARC-Payload-Digest": "sha1:" + b32encode(sha1).decode(),
        "Page-ID": page_id,
    }
    if again:
        headers |= {
            "WARC-Profile": REVISIT_PROFILE,
            "WARC-Refers-To": record_id(folder, refers_row),
            "WARC-Refers-To-Target-URI": header_url(refers_url, refers_row),
            "WARC-Refers-To-Date": date,
            "Refers-To-Page-ID": refers_to,
        }
    answer = _lines("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": n_bytes})
    return _record(headers, "application/http; msgtype=response", answer + (b"" if again else html))


def _info(name: str, folder: str, date: str) -> bytes:
    headers = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(folder, name), "WARC-Date": date, "WARC-Filename": name}
    return _record(headers, "application/warc-fields", b"software: paperfold\r\nformat: WARC File Format 1.1\r\n")


def _record(headers: dict, kind: str, block: bytes) -> bytes:
    return _lines("WARC/1.1", headers | {"Content-Type": kind, "Content-Length": len(block)}) + block + _BREAK * 2


def _lines(first: str, headers: dict) -> bytes:
    """A start line and headers; those without a value are left out."""
    lines = [first, *(f"{name}: {value}" for name, value in headers.items() if value is not None)]
    return b"".join(line.encode() + _BREAK for line in lines) + _BREAK


def record_id(folder: str, row) -> str:
    """The same for a row whenever it is written to a folder."""
    from uuid import NAMESPACE_URL, uuid5

    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'{folder}#{row}')}>"


def header_url(url: str | None, row: int) -> str:
    import re

    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or f"urn:page:{row}")


def dictionary_of(records: list[bytes]):
    """A dictionary from all records, or None where they are too few."""
    import zstandard

    size = min(DICTIONARY_BYTES, sum(map(len, records)) // SAMPLE_FACTOR)
    if len(records) < 8 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, records, k=256, d=8, f=18, accel=4)
    except zstandard.ZstdError:  # says so where the records have too little in common
        return None


def compressed(records: list[bytes]) -> bytes:
    """The bytes of an archive."""
    import struct

    import zstandard

    known = dictionary_of(records)
    by = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
    frames = [by.compress(x) for x in records]
    if known is not None:
        raw = known.as_bytes()
        frames.insert(0, struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    return b"".join(frames)


def records_of(stream, chunk: int = 1 << 16):
    """The records of an archive, one at a time."""
    import struct

    import zstandard

    head = stream.read(8)
    known = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        known, head = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0])), b""
    by = zstandard.ZstdDecompressor(dict_data=known)
    rest = head or stream.read(chunk)
    while rest:
        frame, parts = by.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                break
            rest = stream.read(chunk)
            if not rest:
                raise ValueError("an archive ends inside a record")
        yield b"".join(parts)
        rest = frame.unused_data or stream.read(chunk)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = data.partition(_BREAK * 2)
    version, *lines = head.decode().split("\r\n")
    headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    end = int(headers["content-length"])
    if not version.startswith("WARC/") or rest[end:] != _BREAK * 2:
        raise ValueError("not a WARC record")
    return headers, rest[:end]


def page_of(headers: dict[str, str], block: bytes):
    """The page a record is of: as `read_archives` gives it."""
    from base64 import b32encode
    from hashlib import sha1

    head, _, payload = block.partition(_BREAK * 2)
    answer = dict(line.lower().split(": ", 1) for line in head.decode().split("\r\n")[1:])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    kind, n_bytes = headers["warc-type"], int(answer["content-length"])
    if kind == "response" and (len(payload) != n_bytes or b32encode(sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{headers['warc-record-id']} does not hold the payload it names")
    page_id, refers_to = (int(x) if x is not None else None for x in (headers.get("page-id"), headers.get("refers-to-page-id")))
    return page_id, headers["warc-target-uri"], kind, n_bytes, digest, refers_to, payload if kind == "response" else None


def _place(folder: str):
    """File system and path of a folder."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    scheme, _, path = folder.partition(":")
    return fs.FileSystem.from_uri(f"file://{path}" if scheme == "file" and not path.startswith("//") else folder)


def _store(folder: str, name: str, data: bytes) -> None:
    """Puts a file in place as a whole."""
    from uuid import uuid4

    from pyarrow import fs

    system, path = _place(folder)
    unfinished, finished = f"{path}/_unfinished/{uuid4().hex}", f"{path}/{name}"
    system.create_dir(f"{path}/_unfinished", recursive=True)
    with system.open_output_stream(unfinished, compression=None) as out:
        out.write(data)
    if system.get_file_info(finished).type == fs.FileType.File:  # by an earlier attempt; not all systems replace
        system.delete_file(finished)
    system.move(unfinished, finished)


def _opened(folder: str, name: str):
    system, path = _place(folder)
    return system.open_input_stream(f"{path}/{name}", compression=None)
