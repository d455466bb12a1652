"""WARC archives: writing, normalising to one gzip member a record, reading by offset.

Some crawlers compress a whole archive as one gzip stream, which can only be read
from its start.  The normaliser inflates such a stream once, in pieces, rewrites every
record as a gzip member of its own and writes a sidecar index of offsets, so that
later any record is read alone.  One task handles one archive, whatever its size, in
bounded memory.  Files go to a folder that all executors share, under names that hold
the task attempt; only those that a finished task reports count, so a lost executor
leaves at most unused files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shared_path, stored

#: Payloads below so many bytes are never revisits.
LEAST_REVISIT = 1000
CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"

_TABS = pa.csv.ParseOptions(delimiter="\t", quote_char=False)
_TYPES = pa.csv.ConvertOptions(column_types={"offset": pa.int64(), "length": pa.int64(), "kind": pa.string(), "record_id": pa.string()})


def _open_folder(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder that has a scheme, as :func:`shared_path` gives it, and the path there."""
    scheme, colon, rest = folder.partition(":")
    if not colon:
        raise ValueError(f"{folder} has no scheme, so Spark and others may take it for different places")
    # Spark writes file:/x where others write file:///x
    files, path = pa.fs.FileSystem.from_uri(folder if rest.startswith("//") else f"{scheme}://{rest}")
    files.create_dir(path, recursive=True)
    return files, path


def _attempt() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():05d}-{task.taskAttemptId()}"


# --- planning --------------------------------------------------------------------


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) for each page.

    Of equal payloads of LEAST_REVISIT bytes or more, the one with the largest page_id
    is the response (all rows with that page_id are); others revisit it.  A null html
    is an empty payload; pages without an id revisit like others but are never referred
    to unless the whole group has none, in which case all are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", payload.alias("payload"))
    sized = own.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    large = F.col("payload_bytes") >= LEAST_REVISIT
    groups = (
        sized.where(large)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
        .where("n > 1 and response_id is not null")
        .drop("n")
    )
    # small payloads are never joined; groups are stored, so that Spark may split the join where very many pages are alike
    met = sized.where(large).join(stored(groups, "warc-groups"), ["payload_digest", "payload_bytes"], "left")
    alone = sized.where(~large).withColumn("response_id", F.lit(None).cast(groups.schema["response_id"].dataType))
    joined = met.unionByName(alone)
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response_id")).alias("refers_to"),
    )


# --- records ---------------------------------------------------------------------


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to) -> bytes:
    """One WARC 1.1 record; a revisit has the payload's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    name = "" if page_id is None else page_id
    headers = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_ID}{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or f'{_ID}{name}', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        headers += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _page(value: str | None) -> int | None:
    name = (value or "").removeprefix(f"<{_ID}").removesuffix(">")
    return int(name) if name else None


# --- writing ---------------------------------------------------------------------


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the planned ``records`` as one monolithic gzip archive for each partition.

    Returns a lazy table (archive, n_records); store it, and the archives exist.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open_folder(folder)
        name, n = f"{path}/{_attempt()}.warc.gz", 0
        with files.open_output_stream(name, compression=None) as out:
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            for batch in batches:
                for row in range(batch.num_rows):
                    one = [column[row].as_py() for column in batch.columns]
                    out.write(packer.compress(record(*one)))
                    n += 1
            out.write(packer.flush())
        yield pa.RecordBatch.from_pydict({"archive": [name], "n_records": pa.array([n], pa.int64())})

    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.select(*columns).mapInArrow(write, "archive string, n_records long")


# --- normalising -----------------------------------------------------------------


class _Inflated:
    """A gzip file, of one member or many, as a stream of plain bytes."""

    def __init__(self, source) -> None:
        self._source, self._packed, self._plain, self._inflate = source, b"", bytearray(), zlib.decompressobj(31)

    def _fill(self) -> bool:
        if not self._packed:
            self._packed = self._source.read(CHUNK)
            if not self._packed:
                return False
        if self._inflate.eof:
            self._inflate = zlib.decompressobj(31)
        self._plain += self._inflate.decompress(self._packed, 16 * CHUNK)
        self._packed = self._inflate.unconsumed_tail or self._inflate.unused_data
        return True

    def head(self) -> bytes | None:
        """Up to the next blank line; None at the end."""
        seen = 0
        while (at := self._plain.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(self._plain) - 3)
            if not self._fill():
                if self._plain.strip():
                    raise ValueError("the archive ends within a record's headers")
                return None
        head = bytes(self._plain[:at])
        del self._plain[: at + 4]
        return head

    def body(self, size: int) -> Iterator[bytes]:
        while size:
            if not self._plain and not self._fill():
                raise ValueError("the archive ends within a record")
            part = bytes(self._plain[:size])
            del self._plain[:size]
            size -= len(part)
            if part:
                yield part


def normalise_stream(source, write: Callable[[bytes], int]) -> Iterator[tuple[dict[str, str], int, int]]:
    """Rewrite an archive record by record: (headers, offset, length) of each member written."""
    stream, offset = _Inflated(source), 0
    while (head := stream.head()) is not None:
        headers = parse_headers(head)
        packer, length = zlib.compressobj(6, zlib.DEFLATED, 31), 0
        length += write(packer.compress(head + b"\r\n\r\n"))
        for part in stream.body(int(headers["content-length"]) + 4):
            length += write(packer.compress(part))
        length += write(packer.flush())
        yield headers, offset, length
        offset += length


def normalise(archives: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Rewrite every ``archive`` into ``folder``, each with a sidecar index of offsets.

    Returns a lazy table (archive, sidecar, n_records); store it, and the files exist.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open_folder(folder)
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                name = f"{path}/{source.rpartition('/')[2].removesuffix('.warc.gz')}-{_attempt()}.warc.gz"
                n = 0
                with (
                    files.open_input_stream(source, compression=None) as packed,
                    files.open_output_stream(name, compression=None) as out,
                    files.open_output_stream(f"{name}.idx", compression=None) as index,
                ):

                    def write(part: bytes) -> int:
                        if part:
                            out.write(part)
                        return len(part)

                    for headers, offset, length in normalise_stream(packed, write):
                        index.write(f"{offset}\t{length}\t{headers['warc-type']}\t{headers['warc-record-id']}\n".encode())
                        n += 1
                yield pa.RecordBatch.from_pydict({"archive": [name], "sidecar": [f"{name}.idx"], "n_records": pa.array([n], pa.int64())})

    dealt = archives.where("n_records > 0").select("archive").repartition(tasks, "archive")
    return dealt.mapInArrow(rewrite, "archive string, sidecar string, n_records long")


def read_index(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, offset, length, kind, record_id) of every record, from the sidecars of ``archives``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _open_folder(folder)
        for batch in batches:
            for archive, sidecar, n in zip(*(batch.column(c).to_pylist() for c in ("archive", "sidecar", "n_records"))):
                seen = 0
                with files.open_input_stream(sidecar, compression=None) as lines:
                    for part in pa.csv.open_csv(lines, pa.csv.ReadOptions(column_names=["offset", "length", "kind", "record_id"]), _TABS, _TYPES):
                        seen += part.num_rows
                        yield pa.RecordBatch.from_arrays([pa.array([archive] * part.num_rows, pa.string()), *part.columns], names=["archive", *part.schema.names])
                if seen != n:
                    raise ValueError(f"{sidecar} has {seen} records, not {n}")

    return archives.select("archive", "sidecar", "n_records").mapInArrow(read, "archive string, offset long, length long, kind string, record_id string")


# --- reading ---------------------------------------------------------------------


def read_member(packed: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """One member: its WARC headers, HTTP headers and payload."""
    plain = zlib.decompress(packed, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    headers = parse_headers(head)
    http, _, payload = rest[: int(headers["content-length"])].partition(b"\r\n\r\n")
    return headers, parse_headers(http), payload


def read_records(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Read every record of ``index`` at its offset: the columns of the plan, checked.

    A response's size and digest are those of the payload that was read; reading fails
    if the record's own differ.  A revisit's are those its record states.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _open_folder(folder)
        name, archive = None, None
        for batch in batches:
            rows = []
            for at in batch.to_pylist():
                if at["archive"] != name:
                    if archive:
                        archive.close()
                    name, archive = at["archive"], files.open_input_file(at["archive"])
                headers, http, payload = read_member(archive.read_at(at["length"], at["offset"]))
                digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                kind = headers["warc-type"]
                if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"a payload in {name} at {at['offset']} isn't what its record states")
                row = (_page(headers["warc-record-id"]), size, digest, kind, _page(headers.get("warc-refers-to")))
                rows.append((*row, payload) if payloads else row)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            columns = list(zip(*rows)) or [()] * (5 + payloads)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names[: len(columns)])
        if archive:
            archive.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return index.mapInArrow(read, schema + ", payload binary" * payloads)


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them and read all records back.

    One row for each row of ``pages``, repeated ones too; an empty table gives no rows.
    Page ids are whole numbers or null; a null html is an empty payload, a null URL one
    made of the page id.  Rows of one page_id with different payloads are records of
    their own, and a payload is referred to by the largest page_id that has it, however
    many rows have that one.  Payloads may be of any length; other columns are not looked
    at.
    """
    spark = bounded_batches(pages).sparkSession
    folder = shared_path(spark, "warc")
    archives = stored(write_archives(plan_records(pages), f"{folder}/monolithic"), "warc-archives")
    n = archives.where("n_records > 0").count()
    members = stored(normalise(archives, f"{folder}/members", max(1, n)), "warc-members")
    # an archive's records are read where its sidecar is, one after the other
    index = read_index(members.repartition(max(1, n), "archive"), f"{folder}/members")
    return read_records(index, f"{folder}/members", payloads)

