"""WARC files that are one gzip stream, made seekable.

A file that was compressed as a whole is inflated once, as a stream; every record is written as a
gzip member of its own, and a sidecar index (Parquet, beside the new file) says where each begins,
so that any record can be read without the ones before it. Files are read and written piece by
piece: memory holds one record's rest at most. A new file appears only when it is whole, under the
name of its source, so a task that runs again does no harm.

Defined results: a file of no bytes gives a file of no records. Files of several members, or not
compressed, are read alike. A record that is cut short or malformed ends its file: the records before
it stand, and one index row with status 'truncated' or 'malformed' and no length says where. Pages
with a null url get no target URI, a null html gives an empty payload and reads back as empty; rows
repeated are records each; long pages are records like others; a table without rows gives no file; a
file named twice is rewritten once; other columns are ignored whatever their names; a null page_id has no id header and stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import pick, scratch

FILE_BYTES = 32 << 20
PIECE = 1 << 20
INDEX = pa.schema([("record_no", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("record_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("status", pa.string())])


def record(page_id: int | None, url: str | None, payload: bytes) -> bytes:
    """One response record; its content is an HTTP response with the payload."""
    content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = ["WARC/1.1", "WARC-Type: response", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"Content-Length: {len(content)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def inflated(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of gzip members, one after another, or of a file that is not compressed."""
    unzip, plain, head = None, False, b""
    for piece in pieces:
        if unzip is None and not plain:
            head += piece
            if len(head) < 2:
                continue
            plain, piece = head[:2] != b"\x1f\x8b", head
            head = b""
        if plain:
            yield piece
            continue
        while piece:
            unzip = unzip or zlib.decompressobj(31)
            out = unzip.decompress(piece, 4 * PIECE)
            if out:
                yield out
            if unzip.eof:
                piece, unzip = unzip.unused_data, None
                if piece.strip(b"\0") == b"":
                    piece = b""
            else:
                piece = unzip.unconsumed_tail
    if head:
        yield head


def records(stream: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes, str]]:
    """(headers, whole record, content, status) in turn; a bad record is the last."""
    held, source = bytearray(), iter(stream)

    def fill(n: int) -> bool:
        while len(held) < n:
            try:
                more = next(source, None)
            except zlib.error:
                more = None
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while fill(1) and held[:1] in (b"\r", b"\n"):
            del held[:1]
        if not held:
            return
        at = held.find(b"\r\n\r\n")
        while at < 0:
            n = len(held)
            if n >= 5 and held[:5] != b"WARC/" or not fill(n + 1):
                yield {}, bytes(held), b"", "malformed" if n >= 5 and held[:5] != b"WARC/" else "truncated"
                return
            at = held.find(b"\r\n\r\n", max(0, n - 3))
        head = {}
        for line in bytes(held[:at]).decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                head[name.strip().lower()] = value.strip()
        length = head.get("content-length", "")
        if held[:5] != b"WARC/" or not (length.isascii() and length.isdigit()):
            yield head, bytes(held[:at]), b"", "malformed"
            return
        end = at + 4 + int(length)
        if not fill(end):
            yield head, bytes(held), b"", "truncated"
            return
        yield head, bytes(held[:end]) + b"\r\n\r\n", bytes(held[at + 4 : end]), "ok"
        del held[:end]


def payload(content: bytes) -> bytes:
    """What follows the headers of an HTTP message."""
    if content[:5] != b"HTTP/":
        return content
    return content.partition(b"\r\n\r\n")[2]


def _read(uri: str) -> Iterator[bytes]:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path, compression=None) as f:
        while piece := f.read(PIECE):
            yield piece


def normalise_file(source: str, target: str) -> list[dict]:
    """Rewrites source as target with one member a record, and target.idx.parquet; returns the index."""
    import uuid

    store, path = fs.FileSystem.from_uri(target)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part, index, at = f"{path}.{uuid.uuid4().hex}", [], 0
    with store.open_output_stream(part, compression=None) as out:
        for head, whole, content, status in records(inflated(_read(source))):
            row = {"record_no": len(index), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "record_id": head.get("warc-record-id"), "offset": at, "length": None, "payload_bytes": None, "status": status}
            if status == "ok":
                zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = zipped.compress(whole) + zipped.flush()
                out.write(member)
                row |= {"length": len(member), "payload_bytes": len(payload(content))}
                at += len(member)
            index.append(row)
    table = pa.Table.from_pylist(index, INDEX)
    pq.write_table(table, part + ".idx", filesystem=store)
    store.move(part + ".idx", path + ".idx.parquet")
    store.move(part, path)
    return index


def read_record(handle, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and content of the one member at offset, read alone."""
    handle.seek(offset)
    data = handle.read(length)
    unzip = zlib.decompressobj(31)
    whole = unzip.decompress(data)
    if not unzip.eof or unzip.unused_data:
        raise ValueError(f"no single member of {length} bytes at {offset}")
    head, _, content, status = next(records([whole]))
    if status != "ok":
        raise ValueError(f"a record that is {status} at {offset}")
    return head, content


def normalise(spark: SparkSession, sources: list[str] | DataFrame, folder: str) -> DataFrame:
    """(source, target, index columns) of the files named by sources, rewritten into folder.

    Each file is one task's: a gzip stream cannot be entered midway.
    """
    names = sources if isinstance(sources, list) else [r.source for r in pick(sources, "source").distinct().collect()]  # one row a file
    names = sorted({s for s in names if s is not None})
    files = spark.createDataFrame(list(enumerate(names)), "part int, source string")
    schema = pa.schema([("source", pa.string()), ("target", pa.string()), *INDEX])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for source in rb.column(0).to_pylist():
                target = f"{folder}/{source.rpartition('/')[2]}"
                rows = [{"source": source, "target": target, **r} for r in normalise_file(source, target)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    # By number: adaptive execution would merge rows as small as these into one task.
    spread = files.repartitionById(max(1, len(names)), F.col("part")).select("source")
    return spread.mapInArrow(run, "source string, target string, record_no long, record_type string, target_uri string, record_id string, offset long, length long, payload_bytes long, status string")


def write_monolithic(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages as WARC files of one gzip stream each, of about file_bytes; (source, records) per file."""
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    total = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    # With the row's number, so that rows repeated without end don't meet in one file.
    rows = rows.withColumn("file", F.pmod(F.xxhash64("page_id", "url", F.monotonically_increasing_id()), F.lit(files)).cast("int")).repartitionById(files, F.col("file")).sortWithinPartitions("file", "page_id", "url")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        name, out, zipped, n, part, store = None, None, None, 0, "", None

        def close():
            out.write(zipped.flush())
            out.close()
            store.move(part, fs.FileSystem.from_uri(name)[1])
            return pa.RecordBatch.from_pylist([{"source": name, "records": n}], pa.schema([("source", pa.string()), ("records", pa.int64())]))

        for rb in batches:
            for page_id, url, html, file in zip(*(c.to_pylist() for c in rb.columns)):
                if name != f"{folder}/pages-{file:06d}.warc.gz":
                    if out is not None:
                        yield close()
                    name = f"{folder}/pages-{file:06d}.warc.gz"
                    store, path = fs.FileSystem.from_uri(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    part = f"{path}.{uuid.uuid4().hex}"
                    out, zipped, n = store.open_output_stream(part, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0
                out.write(zipped.compress(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"))))
                n += 1
        if out is not None:
            yield close()

    return rows.mapInArrow(run, "source string, records long")


def read_back(index: DataFrame, files: int | None = None) -> DataFrame:
    """(page_id, url, html) of index rows, each by a read of its own member; files is how many they lie in."""
    files = files or max(1, index.select("target").distinct().count())
    rows = index.filter("status = 'ok'").select("target", "offset", "length").repartition(files, "target").sortWithinPartitions("target", "offset")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, handle = None, None
        for rb in batches:
            out = []
            for target, offset, length in zip(*(c.to_pylist() for c in rb.columns)):
                if target != name:
                    store, path = fs.FileSystem.from_uri(target)
                    name, handle = target, store.open_input_file(path)
                head, content = read_record(handle, offset, length)
                page = head.get("warc-record-id", "").removeprefix("<urn:page:").removesuffix(">")
                out.append({"page_id": int(page) if page else None, "url": head.get("warc-target-uri"), "html": payload(content).decode("utf-8", "replace")})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]))

    return rows.mapInArrow(run, "page_id long, url string, html string")


def _normalised(pages: DataFrame) -> tuple[DataFrame, int]:
    """The index of pages_normalised, and the number of files."""
    spark = pages.sparkSession
    at = scratch(spark, "warc")
    written = [r.source for r in write_monolithic(pages, f"{at}/monolithic").collect()]  # one row a file
    return normalise(spark, written, f"{at}/records"), len(written)


def pages_normalised(pages: DataFrame) -> DataFrame:
    """Pages written as monolithic WARC files, normalised: the index of all their records."""
    return _normalised(pages)[0]


def page_index(pages: DataFrame) -> DataFrame:
    """(page_id, url, file, record_no, offset, length, payload_bytes, status)."""
    got = pages_normalised(pages)
    return got.select(F.regexp_extract("record_id", r"page:(-?\d+)", 1).try_cast("long").alias("page_id"), F.col("target_uri").alias("url"), F.regexp_extract("target", "[^/]+$", 0).alias("file"), "record_no", "offset", "length", "payload_bytes", "status")


def page_round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload_sha256): pages read back by the sidecar index, member by member."""
    back = read_back(*_normalised(pages))
    return back.select("page_id", "url", F.sha2("html", 256).alias("payload_sha256"))
