"""WARC archives of pages, each record a Zstandard frame of its own over a dictionary of the archive's.

An archive is written by the task that scans the pages, so payloads are not shuffled: the places of rows
that revisit another row's payload are found over digests alone and looked up in sorted files. The first
records of a task make its dictionary, which stands in a skippable frame at the head of each archive.
Each task names its archives, and their stretches of whole frames, once it has written them; readers
take these names, so files of tasks that died are never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm import sorted_shards, workspace

#: Fixed values of the format: the skippable frame that holds a dictionary, and the profile of revisits.
MAGIC, PROFILE = 0x184D2A5D, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Where whole frames lie in an archive.
STRETCHES = "path string, start long, length long, records long"
RECORDS = "record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_LEAST_SAMPLES = 16


def sha1_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, locator: str) -> str:
    """A record's name: the page's id, and the digest of where its row lies, so that rows that repeat an
    id have names of their own."""
    return f"<urn:page:{'' if page is None else page}:{hashlib.sha256(locator.encode()).hexdigest()[:24]}>"


def page_of(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)?:\w+>", name)
    return int(found[1]) if found and found[1] else None


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record's bytes. Headers of null are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page: int | None, url: str | None, payload: bytes, locator: str, date: str, kept: tuple[int | None, str, str | None] | None) -> bytes:
    """A page's response, or its revisit of kept(page, locator, url). A revisit has the HTTP head of the
    whole payload, but not the payload."""
    uri = lambda u: None if u is None else quote(u, safe="!#$&'()*+,/:;=?@[]-._~")
    headers = [("WARC-Record-ID", record_id(page, locator)), ("WARC-Date", date), ("WARC-Target-URI", uri(url)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1_digest(payload)}")]
    head = _HTTP % len(payload)
    if kept is None:
        return record("response", headers, head + payload)
    of, at, its_url = kept
    return record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(of, at)), ("WARC-Refers-To-Target-URI", uri(its_url)), ("WARC-Truncated", "length")], head)


def dictionary(samples: list[bytes], size: int):
    """A dictionary of at most `size` bytes from records; None where they are too few or too small, as
    the archive is then written without one."""
    import zstandard

    if len(samples) < _LEAST_SAMPLES or sum(map(len, samples)) < 8 * size:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


class Writer:
    """Writes records to archives of a folder. Those up to `training` bytes wait for the dictionary that
    they make; an archive ends with the record that fills it."""

    def __init__(self, folder: str, level: int = 3, training: int = 4 << 20, dictionary_bytes: int = 1 << 16, archive_bytes: int = 1 << 30, stretch_bytes: int = 8 << 20):
        self.folder, self.level, self.training, self.size = folder, level, training, dictionary_bytes
        self.archive_bytes, self.stretch_bytes = archive_bytes, stretch_bytes
        self.waiting: list[bytes] = []
        self.held, self.press, self.out, self.done = 0, None, None, []

    def add(self, data: bytes) -> None:
        if self.press is None:
            self.waiting.append(data)
            self.held += len(data)
            if self.held >= self.training:
                self._begin()
        else:
            self._put(data)

    def _begin(self) -> None:
        import zstandard

        made = dictionary(self.waiting, self.size)
        self.head = b"" if made is None else struct.pack("<II", MAGIC, len(made)) + made.as_bytes()
        self.press = zstandard.ZstdCompressor(level=self.level, dict_data=made, write_content_size=True) if made else zstandard.ZstdCompressor(level=self.level, write_content_size=True)
        waiting, self.waiting = self.waiting, []
        for data in waiting:
            self._put(data)

    def _open(self) -> None:
        fs, at = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.path, self.out = f"{self.folder}/{name}", fs.open_output_stream(f"{at}/{name}", compression=None)
        info = self.press.compress(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: itemforge\r\nformat: WARC File Format 1.1\r\n"))
        self.out.write(self.head + info)
        self.start = self.at = len(self.head) + len(info)
        self.n = 0

    def _put(self, data: bytes) -> None:
        if self.out is None:
            self._open()
        frame = self.press.compress(data)
        self.out.write(frame)
        self.at += len(frame)
        self.n += 1
        if self.at - self.start >= self.stretch_bytes:
            self._stretch()
        if self.at >= self.archive_bytes:
            self._close()

    def _stretch(self) -> None:
        if self.n:
            self.done.append((self.path, self.start, self.at - self.start, self.n))
        self.start, self.n = self.at, 0

    def _close(self) -> None:
        if self.out is not None:
            self._stretch()
            self.out.close()
            self.out = None

    def close(self) -> list[tuple[str, int, int, int]]:
        """STRETCHES of all archives, which are then whole."""
        if self.press is None and self.waiting:
            self._begin()
        self._close()
        return self.done


def head_dictionary(stream: BinaryIO):
    """The dictionary at an archive's head; None if it has none."""
    import zstandard

    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != MAGIC:
        return None
    data = stream.read(struct.unpack("<II", head)[1])
    if data[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may be compressed itself
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return zstandard.ZstdCompressionDict(data)


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a plain stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record ends early")
        yield headers, block


def frames(data: bytes, dict_data) -> BinaryIO:
    """The plain stream of whole frames."""
    import zstandard

    press = zstandard.ZstdDecompressor(dict_data=dict_data) if dict_data else zstandard.ZstdDecompressor()
    return io.BufferedReader(press.stream_reader(io.BytesIO(data), read_across_frames=True), 1 << 18)


def page_row(headers: dict[str, str], block: bytes) -> tuple | None:
    """RECORDS of a page's record; None for others. A response whose payload is not what its digest says
    raises."""
    kind = headers.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or sha1_digest(payload) != digest):
        raise ValueError(f"the payload of {headers['warc-record-id']} is damaged")
    url = headers.get("warc-target-uri")
    return kind, page_of(headers["warc-record-id"]), None if url is None else unquote(url), size, digest, page_of(headers.get("warc-refers-to", "")), payload if kind == "response" else None


def read(stretches: DataFrame, payloads: bool = True) -> DataFrame:
    """RECORDS of archives from their STRETCHES, each read by one task; without payloads on request."""
    spark = stretches.sparkSession
    workspace.ship(spark)
    schema = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, length, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as f:
                    known = head_dictionary(f)
                    f.seek(start)
                    data = f.read(length)
                rows, held = [], 0
                for headers, block in parse(frames(data, known)):
                    if (row := page_row(headers, block)) is not None:
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(block)
                    if rows and (len(rows) >= 2000 or payloads and held >= 4 << 20):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return stretches.select("path", "start", "length", "records").mapInArrow(run, RECORDS)


def revisits(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", min_bytes: int = 0) -> DataFrame:
    """(at, locator, keep_id, keep_locator, keep_url) of the rows of a located table that repeat the
    payload of another: of equal payloads of at least min_bytes, the row with the greatest id, and of
    equal ids the one whose locator is last, is kept. Payloads are held equal by their SHA-256."""
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), workspace.locator(pages).alias("locator"), F.octet_length(payload).alias("bytes"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    rows = workspace.saved(rows.where(F.col("bytes") >= min_bytes).drop("bytes"), "warc-digests")
    shared = rows.groupBy("digest").agg(F.max(F.struct("id", "locator", "url")).alias("keep"), F.count("*").alias("n")).where("n > 1")
    met = rows.select("digest", "locator").join(shared, "digest").where(F.col("locator") != F.col("keep.locator"))
    return met.select(F.xxhash64("locator").alias("at"), "locator", F.col("keep.id").alias("keep_id"), F.col("keep.locator").alias("keep_locator"), F.col("keep.url").alias("keep_url"))


def write(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", **settings) -> DataFrame:
    """STRETCHES of the archives written to a folder that all executors share: a record for each row.

    Of equal payloads of at least min_bytes the row with the greatest id is a response and the others
    revisit it; shorter ones are all responses. A null payload is empty, a null URL is left out, a null
    id is least, and of rows that repeat id and payload the last in the files is kept. Other columns are
    not read; an empty table makes no archive. All records have the date given. `settings` are
    Writer's.
    """
    spark, pages = pages.sparkSession, workspace.located(pages)
    workspace.ship(spark)
    again = sorted_shards.write(revisits(pages, id_column, url_column, payload_column, min_bytes), "at")
    locator = workspace.locator(pages)
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(payload_column).cast("string"), F.lit("")).cast("binary").alias("payload"), locator.alias("locator"), F.xxhash64(locator).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, lookup = Writer(folder, **settings), sorted_shards.Lookup(again, "at")
        for b in batches:
            locators, kept = b.column(3).to_pylist(), {}
            for which, at, table in lookup.find(b.column(4).to_numpy()):
                for k, i in zip(which.tolist(), at.tolist(), strict=True):
                    while i < table.num_rows and table["at"][i] == b.column(4)[k]:  # keys are hashes
                        if table["locator"][i].as_py() == locators[k]:
                            kept[k] = tuple(table[c][i].as_py() for c in ("keep_id", "keep_locator", "keep_url"))
                            break
                        i += 1
            for k, (page, url, payload) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)):
                writer.add(page_record(page, url, payload.as_py(), locators[k], date, kept.get(k)))
        done = writer.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "start", "length", "records"])

    return workspace.saved(rows.mapInArrow(run, STRETCHES), "warc-stretches")
