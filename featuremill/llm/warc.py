"""WARC archives as chunked record tables: payloads travel as (record, chunk number) rows with incremental digests."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, stage_folder

CHUNK = 1 << 20
#: A writing task starts a new file beyond this many compressed bytes, so that reading has enough tasks.
FILE_BYTES = 64 << 20
MOST_TASKS = 20_000
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def _base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


# Chunks ---------------------------------------------------------------------------------------


def chunks_of(rows: DataFrame, id: str, payload: str, url: str, size: int = CHUNK) -> DataFrame:
    """(record_id, row, chunk_no, data): the payload's UTF-8 bytes in runs of ``size``; at least one chunk, null as empty.

    ``row`` names the record: its id and a hash of its content, which tells rows that repeat an id apart. The chunks of a record
    leave in order and side by side.
    """
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / size)).cast("int")
    return (
        rows.select(F.col(id).cast("long").alias("record_id"), row_name(id, url, payload), data.alias("data"))
        .select("record_id", "row", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"), "data")
        .select("record_id", "row", "chunk_no", F.substring(F.col("data"), F.col("chunk_no") * size + 1, F.lit(size)).alias("data"))
    )


def row_name(id: str, url: str, payload: str) -> Column:
    """Id and a hash of the other two columns, nulls and their places included."""
    marked = [x for c in (url, payload) for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return F.concat_ws(":", F.coalesce(F.col(id).cast("string"), F.lit("")), F.hex(F.xxhash64(*marked))).alias("row")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha, n, seen = hashlib.sha1(), 0, None
    done: list[tuple] = []
    for batch in batches:
        for record, row, no, data in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
            if no == 0:
                if seen is not None:
                    done.append((*seen, n, _base32(sha)))
                sha, n, seen = hashlib.sha1(), 0, (record, row)
            part = data.as_buffer()
            sha.update(part)
            n += part.size
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, d)) for d in done], schema=_DIGESTS)
            done = []
    if seen is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, (*seen, n, _base32(sha))))], schema=_DIGESTS)


_DIGESTS = pa.schema([("record_id", pa.int64()), ("row", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def digests(chunks: DataFrame) -> DataFrame:
    """(record_id, row, payload_bytes, payload_digest) from chunks that lie in order: one pass, one chunk in memory."""
    return chunks.mapInArrow(_digest, "record_id long, row string, payload_bytes long, payload_digest string")


def in_order(chunks: DataFrame) -> DataFrame:
    """Chunks of a table in any order, brought together by record. A record's chunks are streamed by one task, never held."""
    return chunks.repartition("row").sortWithinPartitions("row", "chunk_no")


# Which record holds a payload -----------------------------------------------------------------


def plan_revisits(digested: DataFrame, least: int = 0) -> DataFrame:
    """digested with refers_to and refers_row: of equal payloads of at least ``least`` bytes the record with the largest id keeps the payload.

    Null for records that hold their payload. Ties on the id go to the larger row hash, null ids come last.
    Copies are combined in each task before the shuffle. ``held_once`` says that further rows equal to this one refer to it, or to what it refers to.
    """
    best = F.struct("record_id", "row")
    keeper = digested.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max(best).alias("__keeper"))
    out = digested.join(keeper, ["payload_digest", "payload_bytes"], "left")
    other = F.col("__keeper").isNotNull() & ~best.eqNullSafe(F.col("__keeper"))
    refers = lambda c: F.when(other, F.col("__keeper")[c]).alias(f"refers_{c}")
    return out.select(*digested.columns, other.alias("revisit"), refers("record_id"), refers("row"), (F.col("payload_bytes") >= least).alias("held_once"))


# Files ----------------------------------------------------------------------------------------


def _urn(row: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{row}#{copy}' if copy else row)}>"


class _Archive:
    """One compressed WARC file: a gzip member for each record, written as chunks arrive, renamed into place when complete."""

    def __init__(self, folder: str, name: str):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.final = f"{base}/{name}"
        self.attempt = f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out, self.size = self.fs.open_output_stream(self.attempt, compression=None), 0
        self.member = None

    def put(self, data: bytes) -> None:
        if packed := self.member.compress(data):
            self.out.write(packed)
            self.size += len(packed)

    def begin(self, headers: list[tuple[str, str]], block: bytes) -> None:
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
        self.put(f"WARC/1.1\r\n{lines}\r\n".encode() + block)

    def end(self) -> None:
        self.put(_END)
        tail = self.member.flush()
        self.out.write(tail)
        self.size += len(tail)
        self.member = None

    def close(self) -> None:
        self.out.close()
        if self.fs.get_file_info(self.final).type == pafs.FileType.NotFound:
            self.fs.move(self.attempt, self.final)
        else:  # an earlier attempt at this task has come as far, with the same rows
            self.fs.delete_file(self.attempt)


def _headers(r: dict, copy: int = 0) -> tuple[list[tuple[str, str]], bytes]:
    """WARC header fields and the HTTP header that opens the block, for a row or one of its further copies."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n".encode()
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in r["url"] or "")
    number = lambda x: "" if x is None else str(x)
    out = [
        ("WARC-Type", "revisit" if r["revisit"] else "response"), ("WARC-Record-ID", _urn(r["row"], copy)), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
        ("X-Record-Number", number(r["record_id"])), ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if r["revisit"]:
        out += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(r["refers_row"])), ("X-Refers-To-Number", number(r["refers_record_id"]))]
    out.append(("Content-Length", str(len(block) + (0 if r["revisit"] else r["payload_bytes"]))))
    return out, block


def _write(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, archive, before = TaskContext.get().partitionId(), None, None
        files: list[str] = []
        now, payload = None, bytearray()  # the record being written, and its payload if its copies repeat it

        def finish() -> None:
            if now is None:
                return
            archive.end()
            for copy in range(1, now["copies"]):
                if now["held_once"]:
                    refers = now if now["revisit"] else now | {"revisit": True, "refers_row": now["row"], "refers_record_id": now["record_id"]}
                    archive.begin(*_headers(refers, copy))
                else:
                    archive.begin(*_headers(now, copy))
                    archive.put(payload)
                archive.end()

        for batch in batches:
            fields = batch.drop_columns(["data"])
            for r, data in zip(fields.to_pylist(), batch.column("data")):
                here = (r["row"], r["chunk_no"])
                if here == before:
                    continue  # of a row that repeats another in every column
                before = here
                if r["chunk_no"] == 0:
                    finish()
                    if archive is not None and archive.size >= file_bytes:
                        archive.close()
                        archive = None
                    if archive is None:
                        archive = _Archive(folder, f"part-{task:06d}-{len(files):05d}.warc.gz")
                        files.append(archive.final)
                    now = r
                    payload.clear()
                    archive.begin(*_headers(r))
                if not r["revisit"]:
                    archive.put(data.as_buffer())
                    if r["copies"] > 1 and not r["held_once"]:
                        payload += data.as_buffer()
        if archive is not None:
            finish()
            archive.close()
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], ["file"])

    return run


def write_archives(chunks: DataFrame, records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write WARC files below ``folder`` and give their names.

    ``records`` is what :func:`plan_revisits` gives, with url and copies, the number of equal rows: as many records are written, of which one
    holds the payload unless it is too short to be referred to (such a payload is held while its copies are written). Of records that only refer, the first chunk stands for the
    record, without its bytes. A task writes chunks as they come, each file under a name of the attempt, and renames
    it when complete, so a lost or repeated task leaves no half file under a final name.
    """
    if "copies" not in records.columns:
        records = records.withColumn("copies", F.lit(1))
    uri = folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    fs, base = pafs.FileSystem.from_uri(uri)
    fs.create_dir(base, recursive=True)
    # The join finds the chunks dealt by record, so payloads are shuffled once and a record stays in one task.
    told = chunks.repartition("row").join(records.drop("record_id"), "row").filter("chunk_no = 0 or not revisit")
    told = told.withColumn("data", F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("data")))
    return cut_lineage(told.sortWithinPartitions("row", "chunk_no").mapInArrow(_write(uri, file_bytes), "file string"))


class _Reader:
    """Bytes of a multi-member gzip file, read and inflated a piece at a time."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.raw = fs.open_input_stream(path, compression=None)
        self.inflate, self.packed, self.held = zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.packed = self.inflate.unused_data or self.packed
                self.inflate = zlib.decompressobj(31)
            if not self.packed:
                self.packed = self.raw.read(1 << 16)
                if not self.packed:
                    return False
            got = self.inflate.decompress(self.packed, CHUNK)
            self.packed = self.inflate.unconsumed_tail if not self.inflate.eof else b""
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (i := self.held.find(mark)) < 0:
            if not self.more():
                return None
        out, self.held = self.held[:i], self.held[i + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends inside a record")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


_READ = pa.schema([
    ("urn", pa.string()), ("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_urn", pa.string()), ("chunk_no", pa.int32()),
    ("last", pa.bool_()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("stated_digest", pa.string()), ("data", pa.binary()),
])
_READ_SQL = "urn string, record_id long, url string, record_type string, refers_to long, refers_urn string, chunk_no int, last boolean, bytes_so_far long, digest_so_far string, stated_digest string, data binary"


def _records(reader: _Reader, chunk: int, with_data: bool) -> Iterator[dict]:
    while (head := reader.until(_END)) is not None:
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        number = lambda k: int(fields[k]) if fields.get(k) else None
        size = int(fields["Content-Length"])
        http = reader.until(_END)
        left = size - len(http) - len(_END)
        base = {"urn": fields["WARC-Record-ID"], "refers_urn": fields.get("WARC-Refers-To"), "record_id": number("X-Record-Number"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Number"), "stated_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}
        sha, n, no, part, pending = hashlib.sha1(), 0, 0, bytearray(), left
        for piece in reader.take(left):
            sha.update(piece)
            n, pending = n + len(piece), pending - len(piece)
            if with_data:
                part += piece
            if (len(part) >= chunk if with_data else n - no * chunk >= chunk) and pending:
                yield base | {"chunk_no": no, "last": False, "bytes_so_far": n, "digest_so_far": _base32(sha), "data": bytes(part) if with_data else None}
                no, part = no + 1, bytearray()
        yield base | {"chunk_no": no, "last": True, "bytes_so_far": n, "digest_so_far": _base32(sha), "data": bytes(part) if with_data else None}
        if reader.until(_END) != b"":
            raise ValueError("a record does not end where it says")


def _read(chunk: int, with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in _records(_Reader(file), chunk, with_data):
                    rows.append(row)
                    held += 400 + len(row["data"] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return run


def read_archives(spark: SparkSession, folder: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of all WARC files of a folder: a row per chunk with the bytes and the digest so far.

    On the last chunk of a response these are those of the payload. Spark lists the files, a task reads whole
    files, and no more than a chunk of a record is held.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    uri = F.regexp_replace("path", "^file:/+", "file:///")
    tasks = max(1, min(files.count(), MOST_TASKS))  # stated, or the few bytes of the names would be merged into one task
    return files.select(uri.alias("path")).repartition(tasks, "path").mapInArrow(_read(chunk, with_data), _READ_SQL)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder of the session."""
    return f"{stage_folder(spark)}/warc-{uuid.uuid4().hex}"


def archive(pages: DataFrame, folder: str, id: str = "page_id", payload: str = "html", url: str = "url", least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write a record for each row (see :func:`plan_revisits` for which hold their payload); gives the files.

    Null payloads and urls are empty, a null id is a record without a number. Rows that repeat an id, or another row in every column, are
    records of their own. An empty table writes no file; other columns are not read.
    """
    chunks = chunks_of(pages, id, payload, url, chunk)
    counted = digests(chunks).groupBy("record_id", "row", "payload_bytes", "payload_digest").agg(F.count(F.lit(1)).alias("copies"))
    records = plan_revisits(cut_lineage(counted), least)
    urls = pages.select(row_name(id, url, payload), F.col(url).alias("url")).distinct()
    return write_archives(chunks, records.join(urls, "row"), folder)


def payload_table(read: DataFrame) -> DataFrame:
    """(record_id, record_type, payload_bytes, payload_digest, refers_to) of a read table; a revisit has the figures of the record it refers to.

    Fails when a payload does not have the digest that its record states.
    """
    checked = F.when((F.col("record_type") == "response") & (F.col("digest_so_far") != F.col("stated_digest")), F.raise_error(F.lit("digest differs"))).otherwise(F.col("digest_so_far"))
    last = cut_lineage(read.filter("last").select("urn", "record_id", "record_type", "refers_to", "refers_urn", F.col("bytes_so_far").alias("payload_bytes"), checked.alias("payload_digest")))
    held = last.filter("record_type = 'response'")
    of = held.select(F.col("urn").alias("refers_urn"), "payload_bytes", "payload_digest")
    seen = last.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(of, "refers_urn", "left")
    return held.unionByName(seen).drop("urn", "refers_urn")
