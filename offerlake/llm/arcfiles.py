"""Conversion of legacy ARC archives into WARC records.

An ARC file opens with a version block, ``filedesc://`` record line, version line and the list of fields that every later
record line has: five in version 1 (URL, IP address, date, type, length), ten in version 2 (result code, checksum,
location, offset and file name come before the length). Records are cut by their declared lengths. Each becomes a WARC
record with a type, a date in ISO form, block and payload digests (SHA-1 in base 32) and an identifier made from the
record's own name, date and digest, so that converting a file again gives the same identifiers.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm import columnar as C
from offerlake.llm.shared import hot_pieces, with_piece

SCHEMA = (
    "arc_file string, arc_version int, arc_offset bigint, warc_type string, warc_record_id string, warc_date string, target_uri string, "
    "ip_address string, content_type string, content_length bigint, block_digest string, payload_digest string, http_status int, block_offset bigint, state string"
)
_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    """An identifier by content: the MD5 of its parts in the form of a UUID."""
    return f"<urn:uuid:{uuid.UUID(hashlib.md5('|'.join(parts).encode()).hexdigest())}>"


def iso_date(stamp: str) -> str | None:
    """YYYYMMDD with any of hhmmss behind it, as in WARC; None for anything else."""
    if not stamp.isascii() or not stamp.isdigit() or not 8 <= len(stamp) <= 14 or len(stamp) % 2:
        return None
    s = stamp.ljust(14, "0")
    if not (1 <= int(s[4:6]) <= 12 and 1 <= int(s[6:8]) <= 31 and int(s[8:10]) < 24 and int(s[10:12]) < 60 and int(s[12:]) < 61):
        return None
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:]}Z"


def unpack(content: bytes) -> bytes:
    """The bytes of an archive that may be compressed, as a whole or a member a record; a cut member gives what it has."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(content))
            out.append(member.flush())
        except zlib.error:
            break
        content = member.unused_data
    return b"".join(out)


def _line(data: bytes, at: int) -> tuple[bytes | None, int]:
    end = data.find(b"\n", at)
    return (None, len(data)) if end < 0 else (data[at:end].rstrip(b"\r"), end + 1)


def _fields(line: bytes, n: int) -> list[str] | None:
    """The n fields of a record line. A URL with spaces in it takes what is left over in front."""
    parts = line.decode("utf-8", "replace").split(" ")
    if len(parts) < n or not parts[-1].isascii() or not parts[-1].isdigit():
        return None
    return [" ".join(parts[: len(parts) - n + 1]), *parts[len(parts) - n + 1 :]]


def _http(block: bytes) -> tuple[bytes, int | None]:
    """Payload and status of an HTTP response; the block itself where there is no response head."""
    if not block.startswith(b"HTTP/"):
        return block, None
    status = block.split(b"\n", 1)[0].split()
    code = int(status[1]) if len(status) > 1 and status[1].isdigit() and len(status[1]) == 3 else None
    ends = [(block.find(mark), len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if mark in block]
    at, size = min(ends) if ends else (len(block), 0)
    return block[at + size :], code


def convert(name: str, content: bytes | None) -> Iterator[tuple]:
    """Rows of SCHEMA for one archive, in its order.

    state is ``ok``; ``truncated`` for a record whose declared length goes beyond the file, which keeps what there is;
    ``malformed`` for a record line without a URL or a valid date, and for a stretch that is no record; ``empty`` for an
    archive without content. A malformed record whose declared length leads to the end of a line is kept by that length, and
    its URL or date is null; any other malformed stretch is skipped up to the next line that can be a record's, and its row,
    like an empty one, has no type, identifier, digest or block. block_offset is where a record's block of content_length
    bytes begins in the unpacked archive.
    """
    data = unpack(content or b"")
    blank = lambda state, at, n, version=None: (name, version, at, None, None, None, None, None, None, n, None, None, None, None, state)
    if not data:
        yield blank("empty", 0, 0)
        return
    at, version, n = 0, 1, 5
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        begin = at
        line, at = _line(data, at)
        opening = line is not None and line.startswith(b"filedesc://")
        fields = _fields(line, 5 if opening else n) if line is not None else None
        date = iso_date(fields[2]) if fields else None
        flawed = fields is not None and (date is None or ":" not in fields[0])
        if fields is None or flawed and data[at + int(fields[-1]) :][:1] not in (b"", b"\r", b"\n"):
            while at < len(data):
                following, after = _line(data, at)
                f = _fields(following, n) if following is not None else None
                if f and iso_date(f[2]) and ":" in f[0]:
                    break
                at = after
            yield blank("malformed", begin, at - begin, version)
            continue
        length = int(fields[-1])
        block, start = data[at : at + length], at
        at += length
        state = "malformed" if flawed else "ok" if len(block) == length else "truncated"
        uri, ip, kind = fields[0] if ":" in fields[0] else None, fields[1], fields[3]
        if opening:
            head = block.split(b"\n", 2)
            version = 2 if head[0].split(b" ", 1)[0] == b"2" else 1
            n = len(head[1].split()) if len(head) > 1 and head[1].startswith(b"URL") else (10 if version == 2 else 5)
            n = max(n, 5)
            warc_type, payload, code = "warcinfo", block, None
        else:
            payload, code = _http(block)
            if code is None and n >= 10 and fields[4].isdigit():
                code = int(fields[4])
            scheme = (uri or "").split(":", 1)[0].lower()
            warc_type = "response" if block.startswith(b"HTTP/") else "resource" if scheme in ("dns", "ftp", "file", "whois", "http", "https", "data") else "metadata"
        whole = digest(block)
        content_type = "application/http; msgtype=response" if warc_type == "response" else "application/warc-fields" if warc_type == "warcinfo" else kind
        yield (name, version, begin, warc_type, record_id(warc_type, uri or "", date or "", whole), date, uri, ip, content_type, len(block), whole, digest(payload), code, start, state)


def to_warc(arcs: DataFrame, name_col: str = "name", content_col: str = "content", blocks: bool = False) -> DataFrame:
    """WARC records of the archives in a table of (name, content), plain or gzip; see convert() for what isn't a record.

    With blocks, a last column has the block of each record, which warc_record() writes; it is null for what isn't one.

    A null name stays null (and is empty in identifiers); a null or empty content gives one row of state ``empty``;
    repeated rows each give theirs, with equal identifiers; other columns aren't read. Nothing is shuffled.
    """
    C.small_batches(arcs.sparkSession)

    def run(batches):
        for batch in batches:
            if blocks:
                yield from held(batch)
                continue
            rows = [row for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in convert(name, content)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays(table(columns), names=_NAMES)

    def table(columns) -> list[pa.Array]:
        kinds = {"arc_version": pa.int32(), "http_status": pa.int32(), "arc_offset": pa.int64(), "content_length": pa.int64(), "block_offset": pa.int64()}
        return [pa.array(c, kinds.get(k, pa.string())) for k, c in zip(_NAMES, columns, strict=True)]

    def held(batch):
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, data = list(convert(name, content)), unpack(content or b"")
            own = [None if r[_NAMES.index("block_offset")] is None else data[r[_NAMES.index("block_offset")] :][: r[_NAMES.index("content_length")]] for r in rows]
            yield pa.RecordBatch.from_arrays([*table(list(zip(*rows, strict=True))), pa.array(own, pa.binary())], names=[*_NAMES, "block"])

    source = arcs.select(F.col(f"`{name_col}`").alias("name"), F.col(f"`{content_col}`").alias("content"))
    return source.mapInArrow(run, SCHEMA + ", block binary" * blocks)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """WARC records of the ARC files of a path or pattern, each file read whole by one task."""
    return to_warc(spark.read.format("binaryFile").load(path), "path", "content")


def warc_record(row: dict, block: bytes) -> bytes:
    """A record in WARC form: head, blank line, block and two line breaks."""
    head = {
        "WARC-Type": row["warc_type"], "WARC-Record-ID": row["warc_record_id"], "WARC-Date": row["warc_date"], "WARC-Target-URI": row["target_uri"], "WARC-IP-Address": row["ip_address"],
        "WARC-Block-Digest": row["block_digest"], "WARC-Payload-Digest": row["payload_digest"], "Content-Type": row["content_type"], "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.0\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


PAGES_PER_FILE = 50


def archive(pages: DataFrame, per_file: int = PAGES_PER_FILE) -> DataFrame:
    """ARC archives of pages (page_id, url, html), some pages to a file by their numbers: file, name and content.

    Files of an even number are in version 1, others in version 2. A null url or html is empty; pages of a null number are
    in a file of their own. A file of over 8 times per_file rows, as one of null or much repeated numbers can be, is cut
    into some of about that size, by a hash, and their part is in their names. This stands for a crawl's archives and
    shuffles the pages once; converting doesn't.
    """
    number = F.floor(F.coalesce("page_id", F.lit(-1)) / per_file)
    id_text = F.coalesce("page_id", F.lit(-1)).cast("string")
    html = F.coalesce("html", F.lit(""))
    url = F.coalesce(F.regexp_replace("url", r"[ \r\n]", "%20"), F.lit(""))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), html)
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_000_000_000) + F.coalesce("page_id", F.lit(0))), "yyyyMMddHHmmss")
    pieces = {False: [url, F.lit("10.0.0.1"), stamp, F.lit("text/html")], True: [url, F.lit("10.0.0.1"), stamp, F.lit("text/html"), F.lit("200"), F.md5(html), F.lit("-"), F.lit("0"), F.lit("crawl.arc")]}
    line = {v: F.concat_ws(" ", *p, F.octet_length(block).cast("string")) for v, p in pieces.items()}
    rows = pages.select(number.alias("file"), "page_id", F.encode(F.concat(F.when(number % 2 == 0, line[False]).otherwise(line[True]), F.lit("\n"), block, F.lit("\n")), "UTF-8").alias("record"), id_text.alias("tie"))
    hot = hot_pieces(pages.select(number.alias("file")), "file", 8 * per_file)
    grouped = with_piece(rows, hot, "file", "tie", "record").groupBy("file", "piece").agg(F.array_sort(F.collect_list(F.struct("page_id", "tie", "record"))).alias("records"))
    first = F.when(F.col("file") % 2 == 0, F.lit(f"1 0 crawl\n{V1}\n")).otherwise(F.lit(f"2 0 crawl\n{V2}\n"))
    name = F.concat(F.lit("crawl-"), F.col("file").cast("string"), F.when(F.col("piece") > 0, F.concat(F.lit("-"), F.col("piece").cast("string"))).otherwise(""), F.lit(".arc"))
    head = F.concat(F.lit("filedesc://"), name, F.lit(" 0.0.0.0 20010909014640 text/plain "), F.octet_length(first).cast("string"), F.lit("\n"), first, F.lit("\n"))
    whole = F.aggregate("records", F.encode(head, "UTF-8"), lambda a, r: F.concat(a, r["record"]))
    return grouped.select("file", name.alias("name"), whole.alias("content"))


def _base32(hexed: str) -> str:
    """Base 32 of a SHA-1 in hex: 40 digits are 8 groups of 20 bits, each 4 characters."""
    part = f"CAST(('0x' || substr({hexed}, CAST(5 * (i // 4) + 1 AS BIGINT), 5)) AS BIGINT)"
    return f"list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({part} >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '')"


SQL = f"""
WITH files AS (
  SELECT file, 'crawl-' || file || '.arc' AS name, CASE WHEN file % 2 = 0 THEN '1 0 crawl' || chr(10) || '{V1}' ELSE '2 0 crawl' || chr(10) || '{V2}' END || chr(10) AS block
  FROM (SELECT DISTINCT page_id // {PAGES_PER_FILE} AS file FROM pages)
), shaped AS (
  SELECT page_id // {PAGES_PER_FILE} AS file, page_id, 'response' AS warc_type, regexp_replace(url, '[ \\r\\n]', '%20', 'g') AS uri, '10.0.0.1' AS ip,
    strftime(make_timestamp((1000000000 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS warc_date, 200 AS status,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || html AS block, html AS payload,
    ' 10.0.0.1 YYYYMMDDhhmmss text/html ' || CASE WHEN page_id // {PAGES_PER_FILE} % 2 = 0 THEN '' ELSE '200 ' || md5(html) || ' - 0 crawl.arc ' END AS fields
  FROM pages
  UNION ALL
  SELECT file, -1, 'warcinfo', 'filedesc://' || name, '0.0.0.0', '2001-09-09T01:46:40Z', NULL, block, block, ' 0.0.0.0 20010909014640 text/plain ' FROM files
), measured AS (
  SELECT *, CAST(octet_length(encode(block)) AS BIGINT) AS content_length, CAST(octet_length(encode(uri || fields || CAST(octet_length(encode(block)) AS VARCHAR))) AS BIGINT) + 1 AS head FROM shaped
), placed AS (
  SELECT *, CAST(coalesce(sum(head + content_length + 1) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS arc_offset FROM measured
), hashed AS (
  SELECT *, sha1(block) AS block_sha, sha1(payload) AS payload_sha FROM placed
), named AS (
  SELECT *, 'sha1:' || {_base32("block_sha")} AS block_digest, 'sha1:' || {_base32("payload_sha")} AS payload_digest FROM hashed
)
SELECT 'crawl-' || file || '.arc' AS arc_file, CAST(1 + file % 2 AS INT) AS arc_version, arc_offset, warc_type,
  '<urn:uuid:' || regexp_replace(md5(concat_ws('|', warc_type, uri, warc_date, block_digest)), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') || '>' AS warc_record_id,
  warc_date, uri AS target_uri, ip AS ip_address, CASE warc_type WHEN 'response' THEN 'application/http; msgtype=response' ELSE 'application/warc-fields' END AS content_type,
  content_length, block_digest, payload_digest, CAST(status AS INT) AS http_status, arc_offset + head AS block_offset, 'ok' AS state
FROM named
"""
