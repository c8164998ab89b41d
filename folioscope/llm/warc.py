"""WARC archives in Zstandard: a dictionary in a leading skippable frame, one frame per record; writing, reading and validation."""

from __future__ import annotations

import hashlib
import struct
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_file, shared_folder, stored, write_file

#: Fixed values of the formats: the skippable frame that holds a dictionary, Zstandard's own frames and dictionaries.
DICTIONARY_MAGIC, FRAME_MAGIC, RAW_DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Sample of payloads that a dictionary is trained on: rows, and bytes of each. The dictionary only makes frames smaller.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 65_536
ARCHIVE_BYTES = 32 << 20
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long"


class InvalidArchive(ValueError):
    """An archive that breaks the format; the message names the archive, the place and the rule."""


def digest_of(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def _head(lines: list[tuple[str, str]], first: str) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def _identity(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record_bytes(page_id, url, payload: bytes, size: int, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One record. A revisit has the head of the response, with the payload's length, and no payload."""
    block = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))], "HTTP/1.1 200 OK") + (payload if kind == "response" else b"")
    lines = [("WARC-Type", kind), ("WARC-Record-ID", _identity(page_id)), ("WARC-Date", date)]
    if url is not None:
        lines.append(("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)))
    lines.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if kind == "revisit":
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _identity(refers_to))]
    lines += [("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _head(lines, VERSION) + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at `at` ends, from the sizes in its block headers; raises IndexError or struct.error past the end."""
    if struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ValueError("no frame starts here")
    kind = data[at + 4]
    single = kind >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[kind & 3] + (single, 2, 4, 8)[kind >> 6]
    last = False
    while not last:
        head = int.from_bytes(bytes(data[at : at + 3]), "little")
        if at + 3 > len(data):
            raise IndexError("block header")
        last, form, size = head & 1, head >> 1 & 3, head >> 3
        at += 3 + (1 if form == 1 else size)
    at += 4 * (kind >> 2 & 1)
    if at > len(data):
        raise IndexError("frame")
    return at


def _fields(head: bytes, name: str) -> tuple[str, dict[str, str]]:
    first, *rest = head.decode("utf-8").split("\r\n")
    fields = {}
    for line in rest:
        key, colon, value = line.partition(":")
        if not colon:
            raise InvalidArchive(f"{name}: a header line has no colon")
        fields[key.strip().lower()] = value.strip()
    return first, fields


def parse_record(raw: bytes, name: str) -> tuple:
    """Validate one record: version, required headers, lengths, the record's end, digests of block and payload. Returns a row of RECORD."""
    head, gap, body = raw.partition(b"\r\n\r\n")
    first, fields = _fields(head, name)
    needed = ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest")
    if not gap or not first.startswith("WARC/1."):
        raise InvalidArchive(f"{name}: no WARC version line")
    if missing := [k for k in needed if k not in fields]:
        raise InvalidArchive(f"{name}: headers missing: {', '.join(missing)}")
    if not fields["content-length"].isdigit() or len(body) != int(fields["content-length"]) + 4 or body[-4:] != b"\r\n\r\n":
        raise InvalidArchive(f"{name}: Content-Length {fields['content-length']} does not fit a block of {len(body) - 4} bytes")
    block = body[:-4]
    if fields.get("warc-block-digest", "sha1:" + digest_of(block)) != "sha1:" + digest_of(block):
        raise InvalidArchive(f"{name}: the block has another digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = _fields(http, name)[1].get("content-length", "")
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if not gap or not length.isdigit():
        raise InvalidArchive(f"{name}: the HTTP head is incomplete")
    if kind not in ("response", "revisit"):
        raise InvalidArchive(f"{name}: record type {kind}")
    if kind == "response" and (len(payload) != int(length) or digest_of(payload) != digest):
        raise InvalidArchive(f"{name}: the payload has another length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise InvalidArchive(f"{name}: a revisit holds a payload or refers to nothing")
    number = lambda value: int(x) if (x := value.removeprefix("<urn:x-page:").rstrip(">")) else None
    return number(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, int(length), digest, number(fields["warc-refers-to"]) if kind == "revisit" else None


def read_archive(data: bytes, name: str = "archive") -> Iterator[tuple]:
    """Rows of RECORD: loads the dictionary from the leading skippable frame, then decodes and validates one record per frame."""
    import zstandard

    view, at = memoryview(data), 0
    plain = zstandard.ZstdDecompressor()
    reader = plain
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_MAGIC:
        at = 8 + struct.unpack_from("<I", view, 4)[0]
        if at > len(view):
            raise InvalidArchive(f"{name}: the dictionary frame is cut short")
        held = bytes(view[8:at])
        if held[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
            held = plain.decompressobj().decompress(held)
        if held:
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
    while at < len(view):
        where = f"{name}, byte {at}"
        try:
            end = frame_end(view, at)
            if (size := zstandard.frame_content_size(view[at:end])) < 0:
                raise InvalidArchive(f"{where}: a frame without a content size")
            raw = reader.decompress(view[at:end], max_output_size=size)
        except InvalidArchive:
            raise
        except (zstandard.ZstdError, IndexError, ValueError, struct.error) as error:
            raise InvalidArchive(f"{where}: {error}") from error
        yield parse_record(raw, where)
        at = end


def train_dictionary(pages: DataFrame, payload: str = "payload") -> bytes:
    """A dictionary from the heads of at most SAMPLE_ROWS payloads; empty where they are too few to train one."""
    import zstandard

    rows = pages.select(F.substring(payload, 1, SAMPLE_BYTES).alias("p")).filter(F.length("p") > 0).limit(SAMPLE_ROWS).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["p"]) for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def mark_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """(page_id, uri, payload, payload_bytes, payload_digest as hex, record_type, refers_to): of equal payloads of `least` bytes or more the row of the
    largest page_id is the response. Repeated rows that share that id are responses alike; payloads whose rows have no id are responses."""
    made = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("uri"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    made = made.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.length("payload").cast("long"))
    chosen = made.groupBy("payload_digest").agg(F.max("page_id").alias("chosen"))
    refers = F.when((F.col("payload_bytes") >= least) & ~F.col("chosen").eqNullSafe(F.col("page_id")), F.col("chosen"))
    out = made.join(chosen, "payload_digest").withColumn("refers_to", refers).drop("chosen")
    return out.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def write_archives(records: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write the rows of `mark_revisits` to archives of about `archive_bytes` in `folder`; returns the manifest (path, records, bytes).

    Each task writes its own rows; each archive has a name of its own, so a task that runs again never meets files of an attempt that was
    lost, and the manifest names only those of the attempts that ended.
    """
    held = records.sparkSession.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES

    def run(batches):
        import zstandard

        kept = zstandard.ZstdCompressionDict(held.value) if held.value else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=kept, write_checksum=True, write_content_size=True)
        lead = dictionary_frame(held.value)
        frames, size = [lead], len(lead)

        def close():
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            write_file(path, b"".join(frames))
            return pd.DataFrame({"path": [path], "records": [len(frames) - 1], "bytes": [size]})

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                digest = b32encode(bytes.fromhex(r.payload_digest)).decode()
                ids = [None if pd.isna(x) else int(x) for x in (r.page_id, r.refers_to)]
                frame = packer.compress(record_bytes(ids[0], r.uri, r.payload, r.payload_bytes, digest, r.record_type, ids[1], date))
                frames.append(frame)
                size += len(frame)
                if size >= archive_bytes:
                    yield close()
                    frames, size = [lead], len(lead)
        if len(frames) > 1:
            yield close()

    return stored(records.select("page_id", "uri", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to").mapInPandas(run, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Rows of RECORD from the archives of a manifest (path, ...), one task per archive at most; an archive that breaks the format ends the job."""

    def run(batches):
        for pdf in batches:
            for path in pdf["path"]:
                rows = list(read_archive(read_file(path), path))
                out = pd.DataFrame(rows, columns=["page_id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInPandas(run, RECORD)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write every row of `pages` as a record and read the archives back: one row of RECORD per row.

    Null html is an empty payload, a null url is left out of the record, a null page_id stays null. An empty table writes no archive.
    """
    marked = mark_revisits(pages, page_id, url, html, least)
    dictionary = train_dictionary(pages.select(F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")))
    folder = shared_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(marked, folder, dictionary))


