"""WARC archives: records written as gzip members, and a reader that splits files at any byte.

Writing: every task appends its records to one archive in the shared folder and
returns its name and size; the manifest is committed by Spark, so an archive of a
lost or repeated attempt is never read.  Of pages with equal payloads the one
with the largest id is a response, the others are revisit records without a body.

Reading: archives are cut into byte ranges and the ranges dealt out.  A task
looks for the gzip magic in its range, accepts a candidate only if it decodes to
the start of a WARC record with a header, and owns the records that start inside
its range, reading past its end to finish the last one.

Files are opened through pyarrow's file systems by URI, so the folder may be any
store they reach.

Nulls and edge cases: a null payload is empty; a null id never is the largest,
is written as no id and comes back as null; rows that repeat the response's id
and payload are responses too; records shorter than ``least_bytes`` are all
responses; an empty table gives no archives and no records; other columns are
not read.  Payloads larger than a range or a block are handled like others.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import new_folder, stored, text_bytes

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
SPLIT_BYTES = 8 << 20
SALTS = 64
#: Most tasks that read archives; beyond it a task reads several ranges.
MOST_READERS = 65_536
#: Spark's names of stores and those of the readers inside tasks.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
DATE = "1970-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MANIFEST = "path string, bytes bigint, records bigint"
RECORDS = "page_id string, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to string, payload binary, path string, start bigint"
NO_ID = "none"


def file_system(uri: str):
    """File system and path of a URI; a bare path is local, and schemes that only Spark knows are those of the same store."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    if colon:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    return fs.FileSystem.from_uri(f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def base32_sha1(payload: Column) -> Column:
    """Bare base32 of the SHA-1: 5 hexadecimal digits are 4 letters."""
    letters = F.lit(BASE32)
    digits = F.sha1(payload)
    parts = []
    for i in range(8):
        number = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, (F.shiftright(number, s).bitwiseAND(31) + 1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def planned(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, payload, digest, response_id and is_response of every page.

    Equal payloads are summed per salt first, so a hot payload is a few rows and
    its pages spread over the salts.
    """
    page = F.col(f"`{id_col}`").alias("page_id")
    salt = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(SALTS)).cast("int").alias("salt")
    payload = text_bytes(html_col)
    digests = stored(pages.select(page, salt, base32_sha1(payload).alias("digest")), "page-digests")
    parts = digests.groupBy("digest", "salt").agg(F.max("page_id").alias("largest"))
    best = parts.groupBy("digest").agg(F.max("largest").alias("response_id"))
    found = parts.select("digest", "salt").join(best, "digest")
    rows = pages.select(page, salt, F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"), base32_sha1(payload).alias("digest"))
    joined = rows.join(found, ["digest", "salt"])
    first = F.col("page_id").eqNullSafe(F.col("response_id")) | F.col("response_id").isNull() | (F.octet_length("payload") < least_bytes)
    return joined.select("page_id", "url", "payload", "digest", "response_id", first.alias("is_response"))


def record_bytes(page_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit of that page's record."""
    address = "".join((url or "").split()) or "about:blank"
    body = b"" if refers_to is not None else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {address}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return packer.compress(head + http + body + b"\r\n\r\n") + packer.flush()


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Archives of a plan's pages in ``folder``; the stored manifest (path, bytes, records)."""

    def write(frames):
        files, base = None, None
        path, out, size, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for frame in frames:
            for page_id, url, payload, digest, refers_to in frame.itertuples(index=False):
                if out is None:
                    files, base = file_system(folder)
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}", compression=None)
                member = record_bytes(page_id, url, payload, digest, refers_to)
                out.write(member)
                size += len(member)
                records += 1
        if out is not None:
            out.close()
            yield pd.DataFrame([(path, size, records)], columns=["path", "bytes", "records"])

    def name(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(NO_ID))

    rows = plan.select(name("page_id").alias("page_id"), "url", "payload", "digest", F.when(~F.col("is_response"), name("response_id")).alias("refers_to"))
    return stored(rows.mapInPandas(write, MANIFEST), "warc-manifest")


def _header(data: bytes) -> dict[str, str] | None:
    """Fields of a record that starts ``data``, or None if it is not one or its header is cut off."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return fields if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


class RangeReader:
    """Records that start in bytes [start, end) of a file."""

    def __init__(self, source, size: int, start: int, end: int):
        self.source, self.size, self.start, self.end = source, size, start, end
        self.window, self.base = b"", start

    def _more(self) -> bool:
        at = self.base + len(self.window)
        if at >= self.size:
            return False
        self.source.seek(at)
        got = self.source.read(min(BLOCK, self.size - at))
        self.window += got
        return bool(got)

    def _drop(self, before: int) -> None:
        """Forgets bytes in front of a place in the file."""
        self.window, self.base = self.window[before - self.base :], before

    def _member(self, at: int) -> tuple[bytes, int] | None:
        """Decoded member at a place in the window and its length, or None if none decodes to a record there.

        Its first bytes must be those of a record; the rest is decoded only then.
        """
        unpacker = zlib.decompressobj(31)
        data, fed = bytearray(), at - self.base
        checked = False
        while True:
            chunk = self.window[fed : fed + BLOCK]
            if not chunk and not self._more():
                return None
            chunk = chunk or self.window[fed : fed + BLOCK]
            try:
                data += unpacker.decompress(chunk if checked else chunk[:4096])
            except zlib.error:
                return None
            fed += len(chunk) if checked else len(chunk[:4096])
            if not checked and len(data) >= 7:
                if not data.startswith(b"WARC/1."):
                    return None
                checked = True
            if unpacker.eof:
                return bytes(data), fed - len(unpacker.unused_data) - (at - self.base)

    def records(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """(start, header fields, content block) in file order."""
        at = self.start
        while at < self.end:
            if at - self.base >= BLOCK:
                self._drop(at)
            while len(self.window) - (at - self.base) < len(MAGIC) and self._more():
                pass
            found = self.window.find(MAGIC, at - self.base)
            if found < 0:
                at = max(at, self.base + len(self.window) - len(MAGIC) + 1)
                if not self._more():
                    return
                continue
            at = self.base + found
            if at >= self.end:
                return
            member = self._member(at)
            fields = _header(member[0]) if member else None
            if fields is None:
                at += 1
                continue
            data, length = member
            block = data[data.find(b"\r\n\r\n") + 4 :]
            yield at, fields, block[: int(fields["content-length"])]
            at += length


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Every record of the archives of a manifest, read by byte ranges."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint")))
    ranges = manifest.where("bytes > 0").select("path", "bytes", starts.alias("start"))

    def read(frames):
        for frame in frames:
            for path, size, start in frame.itertuples(index=False):
                files, name = file_system(path)
                with files.open_input_file(name) as source:
                    yield from _frames(path, RangeReader(source, size, start, min(size, start + split_bytes)))

    def _frames(path, reader):
        rows, held = [], 0
        for start, fields, block in reader.records():
            row = _row(fields, block)
            rows.append((*row, path, start) if with_payload else (*row[:-1], None, path, start))
            held += len(block)
            if len(rows) >= 2000 or held > 16 * BLOCK:
                yield _frame(rows)
                rows, held = [], 0
        if rows:
            yield _frame(rows)

    # an explicit number from the bytes to read: the ranges themselves are so small that they would be merged into one task
    wanted = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    return ranges.repartitionByRange(max(1, min(int(wanted), MOST_READERS)), "path", "start").mapInPandas(read, RECORDS)


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])


def _urn(value: str | None) -> str | None:
    return value.removeprefix("<urn:page:").removesuffix(">") if value else None


def _row(fields: dict[str, str], block: bytes):
    """Digest and length of a response are those of the payload read; a revisit states them."""
    payload = block[block.find(b"\r\n\r\n") + 4 :]
    digest, length = fields.get("warc-payload-digest", "").removeprefix("sha1:"), int(fields.get("x-payload-length", 0))
    if fields["warc-type"] == "response":
        stated = digest
        digest, length = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
        if stated and stated != digest:
            raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
    page = _urn(fields.get("warc-record-id"))
    return page, fields.get("warc-target-uri"), fields["warc-type"], digest, length, _urn(fields.get("warc-refers-to")), payload


def archived_pages(spark: SparkSession, pages: DataFrame, least_bytes: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Pages written to archives in the shared folder and read back: one row per record."""
    manifest = write_archives(planned(pages, least_bytes), new_folder(spark, "warc"))
    read = read_archives(manifest, split_bytes, with_payload=False)
    kind = pages.schema["page_id"].dataType

    def number(column: str) -> Column:
        return F.nullif(F.col(column), F.lit(NO_ID)).cast(kind)

    return read.select(number("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
