"""WARC archives in ZIP packages: written by tasks, read by ranges.

A package holds ``archive/*.warc.gz``, stored (each record is a gzip member of its own), and ``indexes/*.cdx`` with a line for
each record. The reader takes the end of a file, its central directory (ZIP64, too) and the members' local headers; an index
gives the records' places, and records are read by ranges straight from the package, which is never unpacked. Spans of
neighbouring records are dealt over tasks, so that one large package is read by many.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import qualified, store_of
from .common import durable, hot_join, shared_folder, table
from .exact import bloom_of, possibly_in, repeated_keys

#: Equal payloads of so many bytes are stored once.
LEAST_BYTES = 100
#: A package ends after so many bytes or records; bytes of neighbouring records that are read at once; of one task's spans.
PACKAGE_BYTES, PACKAGE_RECORDS, SPAN, TASK_BYTES = 1 << 30, 200_000, 1 << 20, 16 << 20
DATE = "2024-01-01T00:00:00Z"
#: Fixed value of the format: how a revisit says that its payload is that of another record.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "key string, url string, digest string, n_bytes long, record_type string, refers_to string, payload binary"
MEMBERS = "archive string, member string, method int, start long, packed long, size long, error string"
SPANS = "archive string, member string, start long, length long, error string"
READ = "archive string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, declared_bytes long, payload binary, error string"


# Which record each row becomes


def planned(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """(key, url, digest, n_bytes, record_type, refers_to, payload) of every row of ``pages``; revisits carry no payload.

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest key (null last, then by url) is the
    response, and all others revisit it. A Bloom filter of hashes that may come twice lets all other rows pass as they stand;
    of possible copies only one payload for each task and text moves, and revisits go as counts of (digest, key, url), which are
    dealt over several tasks where a text has very many.

    A null payload is an empty one. Rows alike in all columns are records of their own. Other columns play no part.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload")).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    hashed = rows.withColumn("_hash", F.xxhash64("payload"))
    large = hashed.filter(F.col("n_bytes") >= least)
    test = possibly_in(pages.sparkSession, bloom_of(durable(repeated_keys(large.select(F.col("_hash").alias("key")), large.count()))))
    marked = hashed.withColumn("_maybe", test("_hash") & (F.col("n_bytes") >= least))

    first = F.struct(F.col("key").isNull().alias("n"), F.col("key").alias("k"), F.col("url").isNull().alias("m"), F.col("url").alias("u"))
    digest = F.sha2("payload", 256)
    copies = marked.filter("_maybe").withColumn("digest", digest)
    facts = durable(copies.groupBy("digest", "key", "url").agg(F.count(F.lit(1)).alias("times"), F.max("n_bytes").alias("n_bytes")))
    met = facts.groupBy("digest").agg(F.count(F.lit(1)).alias("_rows"), F.min(first).alias("_first"))
    joined = hot_join(facts, met, "digest", "_rows", ["key", "url"], facts.count())
    again = F.col("times") - F.when(first.eqNullSafe(F.col("_first")), 1).otherwise(0)
    revisits = joined.filter(again > 0).select("key", "url", "digest", "n_bytes", F.lit("revisit").alias("record_type"), F.col("_first.k").alias("refers_to"), F.lit(None).cast("binary").alias("payload"), F.explode(F.sequence(F.lit(1), again.cast("int")))).drop("col")

    best = copies.groupBy("digest").agg(F.min_by(F.struct("key", "url", "n_bytes", "payload"), first).alias("_row")).select("_row.*", "digest")
    responses = marked.filter(~F.col("_maybe")).select("key", "url", "n_bytes", "payload", digest.alias("digest")).unionByName(best)
    responses = responses.select("key", "url", "digest", "n_bytes", F.lit("response").alias("record_type"), F.lit(None).cast(pages.schema[key].dataType).alias("refers_to"), "payload")
    out = responses.unionByName(revisits)
    return out.withColumns({"key": F.col("key").cast("string"), "refers_to": F.col("refers_to").cast("string")})


# Writing


def record_name(key: str | None) -> str:
    return "<urn:page:" + ("" if key is None else "k" + quote(key, safe="")) + ">"


def record_key(name: Column) -> Column:
    """The key of ``record_name``; keys are percent-encoded, null is empty."""
    return F.when(name.startswith("<urn:page:k"), F.call_function("url_decode", F.regexp_replace(F.regexp_extract(name, "^<urn:page:k(.*)>$", 1), r"\+", "%2B")))


def sort_key(url: str) -> str:
    """The host's labels turned round, then the path: what the index is sorted by."""
    m = re.match(r"[^:/]+://(?:www\.)?([^/:?#]*)[^/?#]*(.*)", url)
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/") if m else url


def warc_record(key: str | None, url: str | None, digest: str, n_bytes: int, kind: str, refers_to: str | None, payload: bytes | None, date: str = DATE) -> bytes:
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url is not None else None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    content = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_name(key)}", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {target}"] if target is not None else []
    lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {record_name(refers_to)}"] if kind == "revisit" else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(content)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, package_records: int = PACKAGE_RECORDS, date: str = DATE) -> DataFrame:
    """(archive, records, bytes) of the packages that the rows of ``planned`` were written to, a stored table.

    Every attempt of a task writes files of its own, and the table names those of the attempts that ended well: what a lost
    executor leaves behind is never read. A package ends at a bound, so a task holds one package's index and one record.
    """
    address = qualified(records.sparkSession, folder)
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def packages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(address)
        store.create_dir(base, recursive=True)
        rows = (row for b in batches for k in range(b.num_rows) for row in [tuple(b.column(c)[k].as_py() for c in range(len(names)))])
        row = next(rows, None)
        while row is not None:
            name = f"{uuid.uuid4().hex}.zip"
            index, at = [], 0
            with store.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
                with package.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=True) as member:
                    while row is not None and at < package_bytes and len(index) < package_records:
                        squeeze = zlib.compressobj(wbits=31)
                        data = squeeze.compress(warc_record(*row, date)) + squeeze.flush()
                        member.write(data)
                        place = {"url": row[1], "digest": f"sha256:{row[2]}", "offset": at, "length": len(data), "filename": "data.warc.gz"}
                        index.append(f"{sort_key(quote(row[1] or '', safe=':/?#=&%'))} {re.sub('[^0-9]', '', date)} {json.dumps(place)}\n")
                        at += len(data)
                        row = next(rows, None)
                package.writestr(zipfile.ZipInfo("indexes/index.cdx"), "".join(sorted(index)))
            yield pa.RecordBatch.from_arrays([pa.array([f"{address.rstrip('/')}/{name}"]), pa.array([len(index)], pa.int64()), pa.array([at], pa.int64())], ["archive", "records", "bytes"])

    return durable(records.select(*names).mapInArrow(packages, "archive string, records long, bytes long"))


# Reading


def zip_directory(file, size: int) -> list[tuple[str, int, int, int, int]]:
    """(name, method, start of its data, stored bytes, bytes) of each member, by ranges of the file's end, directory and local headers.

    ``file`` has ``read_at(length, offset)``. Counts and places of 64 bits come from the ZIP64 directory and extra fields; bytes
    before the package are allowed for.
    """
    from_ = max(0, size - (1 << 16) - 22)
    tail = file.read_at(size - from_, from_)
    ends = [m.start() for m in re.finditer(rb"PK\x05\x06", tail) if m.start() + 22 <= len(tail) and m.start() + 22 + struct.unpack_from("<H", tail, m.start() + 20)[0] == len(tail)]
    if not ends:
        raise ValueError("no end of a central directory")
    end = from_ + ends[-1]
    members, length, start = struct.unpack_from("<HLL", tail, ends[-1] + 10)
    stop = end
    sign, _, place, _ = struct.unpack("<4sLQL", file.read_at(20, end - 20)) if end >= 76 else (b"", 0, 0, 0)
    if sign == b"PK\x06\x07":
        for stop in (place, end - 76):
            wide = file.read_at(56, stop) if 0 <= stop <= end - 76 else b""
            if wide[:4] == b"PK\x06\x06":
                members, length, start = struct.unpack_from("<QQQ", wide, 32)
                break
        else:
            raise ValueError("no ZIP64 end of the central directory")
    shift = stop - length - start
    if shift < 0:
        raise ValueError("the central directory does not fit the file")
    listing, at, out = file.read_at(length, start + shift), 0, []
    for _ in range(members):
        head = struct.unpack_from("<4s4B4HL2L5H2L", listing, at)
        if head[0] != b"PK\x01\x02":
            raise ValueError("a broken entry of the central directory")
        flags, method, packed, whole, name_n, extra_n, note_n, local = head[5], head[6], head[10], head[11], head[12], head[13], head[14], head[18]
        name = listing[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = listing[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                whole, packed, local = [wide.pop(0) if v == 0xFFFFFFFF else v for v in (whole, packed, local)]
            extra = extra[4 + n :]
        at += 46 + name_n + extra_n + note_n
        first = file.read_at(30, local + shift)
        if first[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        out.append((name, method if not flags & 1 else -1, local + shift + 30 + sum(struct.unpack_from("<HH", first, 26)), packed, whole))
    return out


def _fault(error: Exception) -> str:
    """What an archive's own fault is called in its row; a store that does not answer, or memory that ends, is the task's failure and raised."""
    if isinstance(error, MemoryError) or isinstance(error, OSError) and not isinstance(error, FileNotFoundError):
        raise error
    return f"{type(error).__name__}: {error}"


def _by_archive(archives: DataFrame, work, schema: str) -> DataFrame:
    """Rows of ``work(address, file, size)`` for each archive; a bad archive is a row with its error."""
    width = len(schema.split(", "))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for address in f["archive"]:
                try:
                    store, path = store_of(address)
                    with store.open_input_file(path) as file:
                        out = list(work(address, file, file.size()))
                except Exception as e:  # a bad file is a row of the report, not the end of the job
                    out = [(address, *[None] * (width - 2), _fault(e))]
                yield pd.DataFrame(out, columns=names).astype(object)

    return archives.select("archive").mapInPandas(run, schema)


def members(archives: DataFrame) -> DataFrame:
    """(archive, member, method, start, packed, size, error): the directory of each package of the column ``archive``."""
    return _by_archive(archives, lambda address, file, size: [(address, *m, None) for m in zip_directory(file, size)], MEMBERS)


def spans(archives: DataFrame, span: int = SPAN) -> DataFrame:
    """(archive, member, start, length, error): where records stand in the packages, neighbours together up to ``span`` bytes.

    The places come from the packages' indexes. A member that no index tells of is one span. Members that are compressed in the
    package cannot be read by ranges and are rows with an error.
    """

    def places(address: str, file, size: int) -> Iterator[tuple]:
        found = zip_directory(file, size)
        known: dict[str, list] = {}
        for name, method, start, packed, _ in found:
            if name.startswith("indexes/") and name.endswith((".cdx", ".cdxj")) and method == 0:
                for line in file.read_at(packed, start).decode().splitlines():
                    if "{" in line:
                        entry = json.loads(line[line.index("{") :])
                        known.setdefault(entry["filename"], []).append((int(entry["offset"]), int(entry["length"])))
        for name, method, start, packed, _ in found:
            if not name.startswith("archive/") or not name.endswith((".warc", ".warc.gz")):
                continue
            if method != 0:
                yield address, name, None, None, "the member is not stored as it is"
                continue
            first, last = 0, 0
            for at, n in sorted(known.get(name.removeprefix("archive/"), [(0, packed)])):
                if at + n > packed:
                    raise ValueError(f"the index points behind the end of {name}")
                if last > first and (at != last or at + n - first > span):
                    yield address, name, start + first, last - first, None
                    first = at
                first, last = (at if last <= first else first), at + n
            if last > first:
                yield address, name, start + first, last - first, None

    return _by_archive(archives, places, SPANS)


def packed_records(file, start: int, length: int, block: int = SPAN) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of gzip members one after the other; a block at a time is read."""
    at, end, begun, parts, squeeze = start, start + length, start, [], zlib.decompressobj(31)
    while at < end:
        data = file.read_at(min(block, end - at), at)
        if not data:
            raise EOFError("the archive ends within a record")
        at += len(data)
        while data:
            parts.append(squeeze.decompress(data))
            data = squeeze.unused_data
            if squeeze.eof:
                yield begun, b"".join(parts)
                begun, parts, squeeze = at - len(data), [], zlib.decompressobj(31)
    if begun < end:
        raise EOFError("the archive ends within a record")


def plain_records(file, start: int, length: int) -> Iterator[tuple[int, bytes]]:
    """The same of records that are not compressed."""
    at, end = start, start + length
    while at < end:
        head = b""
        while b"\r\n\r\n" not in head:
            more = file.read_at(min(8192, end - at - len(head)), at + len(head))
            if not more:
                raise EOFError("the archive ends within a record")
            head += more
        n = head.index(b"\r\n\r\n") + 4 + int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", head)[1]) + 4
        yield at, file.read_at(n, at)
        at += n


def parsed(record: bytes) -> tuple:
    """(type, id, uri, refers_to, digest, declared length, payload) of one record."""
    if not record.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in head.decode().split("\r\n")[1:])}
    content = rest[: int(fields["content-length"])]
    if len(content) < int(fields["content-length"]):
        raise EOFError("the record is cut short")
    declared, payload = None, content
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = content.partition(b"\r\n\r\n")
        said = re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)
        declared = int(said[1]) if said else None
    kind = fields["warc-type"]
    return kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest"), declared, None if kind == "revisit" else payload


def read_records(archives: DataFrame, span: int = SPAN, batch: int = 8 << 20) -> DataFrame:
    """All records of the packages of the column ``archive``: (archive, offset, record_type, record_id, target_uri, refers_to, payload_digest, declared_bytes, payload, error).

    ``archives`` should be a stored table. Tasks get about ``TASK_BYTES`` of spans each. A package or span that cannot be read
    is a row with its error; what stands before the fault is kept. Failures of the store or the task are raised, so that Spark tries again.
    """
    places = durable(spans(archives, span))
    bad = places.filter("error IS NOT NULL").select("archive", *[F.lit(None).cast(f.dataType).alias(f.name) for f in _schema(archives.sparkSession, READ)[1:-1]], "error")
    bytes_ = places.agg(F.sum("length")).first()[0] or 0
    names = [x.split()[0] for x in READ.split(", ")]
    shape = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in READ.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for address, member, start, length in zip(*(b.column(k).to_pylist() for k in range(4))):
                try:
                    store, path = store_of(address)
                    with store.open_input_file(path) as file:
                        for offset, record in (packed_records if member.endswith(".gz") else plain_records)(file, start, length):
                            held.append((address, offset, *parsed(record), None))
                            size += len(record)
                            if size > batch:
                                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], shape)
                                held, size = [], 0
                except Exception as e:  # as above
                    held.append((address, start, *[None] * 7, _fault(e)))
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], shape)

    parts = max(archives.sparkSession.sparkContext.defaultParallelism, -(-bytes_ // TASK_BYTES))
    good = places.filter("error IS NULL").select("archive", "member", "start", "length").repartition(parts, "archive", "start")
    return good.mapInArrow(read, READ).unionByName(bad)


def _schema(spark: SparkSession, text: str):
    return spark.createDataFrame([], text).schema


def page_report(records: DataFrame, strict: bool = False) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of records that ``read_records`` could read.

    With ``strict`` a row with an error ends the job: pages that are missing would look like a result.

    A response's figures are those of the payload that was read; a revisit's are the full payload's, as its headers tell.
    """
    whole = F.col("record_type") == "response"
    said = F.raise_error(F.concat_ws(": ", F.lit("not all records could be read"), "archive", "error")).cast("boolean")
    good = F.when(F.col("error").isNotNull(), said if strict else F.lit(False)).otherwise(True)
    return records.filter(good).select(
        record_key(F.col("record_id")).alias("key"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        record_key(F.col("refers_to")).alias("refers_to"),
    )


def op13_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page, written to packages in the shared folder and read back from them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    written = write_packages(planned(pages), f"{shared_folder(spark)}/packages-{uuid.uuid4().hex}")
    report = page_report(read_records(written), strict=True)
    return report.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP13_SQL = """
WITH p AS (
    SELECT row_number() OVER () AS r, page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), ranked AS (
    SELECT *, row_number() OVER g AS place, first_value(page_id) OVER g AS first_id
    FROM p WINDOW g AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST, r)
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN place = 1 OR payload_bytes < 100 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 AND payload_bytes >= 100 THEN first_id END AS refers_to
FROM ranked
"""
