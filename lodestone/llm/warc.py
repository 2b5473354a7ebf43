"""WARC archives of pages with a two-level capture index.

``write_archives`` turns pages into WARC/1.1 records, one for each row, and
writes them as plain ``.warc`` parts through Spark's own writer, so archives go to any
file system that Spark knows and a lost task's part is written again whole. The
writer's line separator is the CRLF CRLF that ends each record. Of records with
equal payloads of at least ``least`` bytes, that of the smallest page_id carries the
payload as ``response``; the others are ``revisit`` records that name it.

``write_index`` reads the archives record by record and sorts captures by their
reversed-host key (``com,example)/path``), range-partitioned; runs of ``block_lines``
lines are compressed into blocks with their first and last key, and a sparse directory
keeps the keys of each range of blocks. ``lookup`` finds one URL's captures by binary search
in the directory, then in the blocks, and then reads only the records' byte ranges.
``locate`` does so for a table of URLs of any size: each key finds its ranges by binary search
in the directory, meets their blocks in key order, and is searched for in the lines.
``read_back`` reads the byte ranges found, in the order of archives, neighbouring
ranges together, so that no archive moves to another task.

Defined results: a null html is an empty payload; a null URL is an empty target;
a record of a null page_id revisits the response of its payload if some page_id has
it, else it is a response; every row of the smallest page_id of a payload is a
response, since a record can't revisit itself. CR and LF in URLs are percent-encoded in headers.
An empty table gives an empty archive and index. Extra columns are ignored. URLs that no
capture has give no rows, repeated URLs give their captures once.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import zlib
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import table, work_dir, written

CRLF = "\r\n"
SEPARATOR = b"\r\n\r\n"
#: Payload bytes from which equal payloads are stored once.
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
LINE = "key string, page_id long, path string, offset long, length long"


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null for a response) of each row."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    # Only digests that occur more than once meet the pages again. They are written first, so that the planner
    # knows their size and moves the pages only where there are too many of them to send to all tasks.
    first = base.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    both = base.join(written(first), "payload_digest", "left")
    return both.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when((F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def _urn(page_id):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def record_text():
    """The text of a record without the separator that ends it."""
    target = F.replace(F.replace(F.replace(F.col("url"), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    body = F.concat(http, F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(""))
    more = F.when(F.col("refers_to").isNull(), "").otherwise(
        F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), _urn(F.col("refers_to")), F.lit(CRLF))
    )
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _urn(F.col("page_id")), F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), target,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("payload_digest"), F.lit(CRLF), more,
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2),
    )
    return F.concat(head, body)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = 16 << 20, most_bytes: int = 1 << 30) -> None:
    """Writes the records of ``pages`` as archives of about ``archive_bytes`` in ``path``, never above ``most_bytes`` but for one record.

    Spark bounds a file by its number of records, here from the mean size of a page.
    Pages far above the mean go to archives of their own, with fewer records.
    """
    size = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0))
    mean, longest = pages.agg(F.coalesce(F.avg(size), F.lit(0.0)), F.coalesce(F.max(size), F.lit(0))).first()
    room = lambda a_page: a_page + 4096
    records_ = max(1, int(archive_bytes / (mean + 600)))
    limit = most_bytes // records_ - 4096
    made = records(pages)

    def write(df: DataFrame, most: int, mode: str) -> None:
        df.select(record_text().alias("value")).write.mode(mode).option("lineSep", CRLF * 2).option("maxRecordsPerFile", most).text(path)

    if longest <= limit:
        return write(made, records_, "error")
    write(made.where(F.col("payload_bytes") <= limit), records_, "error")
    write(made.where(F.col("payload_bytes") > limit), max(1, most_bytes // room(longest)), "append")


def parse(data: bytes, at: int) -> tuple[dict[str, str], int, int]:
    """Headers of the record at byte ``at``, where its block begins, and where the record (with separator) ends."""
    stop = data.index(SEPARATOR, at)
    lines = data[at:stop].decode("utf-8").split(CRLF)
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at byte {at}")
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    begin = stop + len(SEPARATOR)
    end = begin + int(head["content-length"])
    if data[end : end + 4] != SEPARATOR:
        raise ValueError(f"the record at byte {at} doesn't end as it says")
    return head, begin, end + len(SEPARATOR)


def content(data: bytes, at: int) -> dict:
    """What the record at byte ``at`` holds; payload is None for a revisit."""
    head, begin, end = parse(data, at)
    http, _, payload = data[begin : end - len(SEPARATOR)].partition(SEPARATOR)
    size = int(re.search(rb"(?im)^Content-Length:\s*(\d+)", http)[1])
    ident = re.fullmatch(r"<urn:page:(-?\d*)>", head["warc-record-id"])[1]
    refers = re.fullmatch(r"<urn:page:(-?\d+)>", head["warc-refers-to"])[1] if "warc-refers-to" in head else None
    return {
        "page_id": int(ident) if ident else None, "url": unquote(head["warc-target-uri"]) if "%" in head["warc-target-uri"] else head["warc-target-uri"],
        "record_type": head["warc-type"], "payload_bytes": size, "payload_digest": head["warc-payload-digest"].removeprefix("sha256:"),
        "refers_to": int(refers) if refers else None, "payload": payload if head["warc-type"] == "response" else None,
    }


def surt(url: str) -> str:
    """Reversed-host sort key of a URL; ``url`` itself where it has no ``://``."""
    scheme, sep, rest = url.partition("://")
    if not sep:
        return url
    m = re.match(r"([^/?#]*)([^#]*)", rest)
    host = re.sub(r":(80|443)$", "", m[1].rpartition("@")[2].lower())
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """key, page_id, path, offset and length of every record of the archives in ``path``."""

    def run(batches):
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, at, rows = data.as_py(), 0, []
                while at < len(data):
                    head, _, end = parse(data, at)
                    ident = head["warc-record-id"][10:-1]
                    uri = head["warc-target-uri"]
                    rows.append((surt(unquote(uri) if "%" in uri else uri), int(ident) if ident else None, where, at, end - at))
                    at = end
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "path", "offset", "length"])

    return _files(spark, path).mapInArrow(run, LINE)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(F.col("length") > 0).select("path", "content")


def write_index(spark: SparkSession, archives: str, path: str, block_lines: int = 1000) -> None:
    """Writes blocks (first_key, last_key, n, lines, part) of the capture lines, sorted by key; ``part`` numbers the ranges of keys."""

    def run(batches):
        def block(lines):
            return lines[0][0], lines[-1][0], len(lines), zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode(), 6)

        held, out = [], []
        for batch in batches:
            held.extend(map(list, zip(*(c.to_pylist() for c in batch.columns), strict=True)))
            while len(held) >= block_lines:
                out.append(block(held[:block_lines]))
                held = held[block_lines:]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["first_key", "last_key", "n", "lines"])
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[block(held)], strict=True)], ["first_key", "last_key", "n", "lines"])

    lines = written(captures(spark, archives))
    # Equal keys are spread over ranges by page_id and offset: a host may hold a third of all pages.
    ordered = lines.repartitionByRange("key", "page_id", "path", "offset").sortWithinPartitions("key", "page_id", "path", "offset")
    blocks = ordered.mapInArrow(run, "first_key string, last_key string, n long, lines binary")
    blocks.withColumn("part", F.spark_partition_id()).write.parquet(path)


def directory(spark: SparkSession, index: str) -> list[tuple[str, str, int, int]]:
    """The sparse directory: first key, last key, number and lines of each range of blocks, in key order.

    It has a row for each task that wrote the index, so its size is that of
    ``spark.sql.shuffle.partitions`` and doesn't grow with the pages.
    """
    ranges = spark.read.parquet(index).groupBy("part").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last"), F.sum("n").alias("n"))
    return sorted((r["first"], r["last"], r["part"], r["n"]) for r in ranges.collect())


def _ranges_of(key: str, firsts: list[str], lasts: list[str]) -> range:
    """Which ranges of the directory may hold ``key``; equal keys may fill several."""
    return range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))


def _lines_of(key: str, lines: list) -> list:
    """The lines of a block that have ``key``."""
    return lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) : bisect.bisect_right(lines, key, key=lambda x: x[0])]


def _opened(block: bytes) -> list:
    return [json.loads(x) for x in zlib.decompress(block).decode().split("\n")]


def lookup(spark: SparkSession, index: str, url: str, sparse: list[tuple[str, str, int, int]] | None = None) -> list[dict]:
    """The captures of one URL, by two binary searches and a range read for each record."""
    key = surt(url)
    sparse = sparse if sparse is not None else directory(spark, index)
    parts = [sparse[i][2] for i in _ranges_of(key, [x[0] for x in sparse], [x[1] for x in sparse])]
    if not parts:
        return []
    blocks = spark.read.parquet(index).where(F.col("part").isin(parts) & (F.col("first_key") <= key) & (F.col("last_key") >= key))
    return [content(_range(spark, path, offset, length), 0) for r in blocks.select("lines").collect() for _, _, path, offset, length in _lines_of(key, _opened(r["lines"]))]


FOUND = "page_id long, path string, offset long, length long"


def _found(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in FOUND.split(", ")])


def all_lines(spark: SparkSession, index: str) -> DataFrame:
    """page_id, path, offset and length of everything that the index lists."""

    def run(batches):
        for batch in batches:
            for block in batch.column(0):
                yield _found([x[1:] for x in _opened(block.as_py())])

    return spark.read.parquet(index).select("lines").mapInArrow(run, FOUND)


def locate(spark: SparkSession, index: str, urls: DataFrame) -> DataFrame:
    """page_id, path, offset and length of the captures of all ``urls`` (first column; null: the empty URL).

    Keys go to the ranges that the directory names for them, where keys and blocks
    pass in one order; a block is opened once, for the first key inside it.
    """
    sparse = directory(spark, index)
    firsts, lasts, parts = ([x[i] for x in sparse] for i in range(3))

    def keys(batches):
        for batch in batches:
            wanted = {surt(u or "") for u in batch.column(0).to_pylist()}
            rows = [(k, parts[i]) for k in sorted(wanted) for i in _ranges_of(k, firsts, lasts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32()), strict=True)], ["key", "part"])

    def search(batches):
        at, held = None, []  # blocks whose keys reach the current one: [last_key, bytes, lines once opened]
        for batch in batches:
            rows = []
            for part, key, last, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = [b for b in held if b[0] >= key] if part == at else []
                at = part
                if block is not None:
                    held.append([last, block, None])
                    continue
                for b in held:
                    b[2] = b[2] or _opened(b[1])
                    rows.extend(x[1:] for x in _lines_of(key, b[2]))
            if rows:
                yield _found(rows)

    asked = urls.select(F.col(urls.columns[0]).cast("string").alias("url")).mapInArrow(keys, "key string, part int").distinct()
    blocks = spark.read.parquet(index).select("part", F.col("first_key").alias("key"), "last_key", "lines")
    both = blocks.unionByName(asked, allowMissingColumns=True)
    # A range goes to the task of its number; blocks come before the keys that equal their first.
    dealt = both.repartitionById(max(parts, default=0) + 1, F.col("part")).sortWithinPartitions("part", "key", F.col("lines").isNull())
    return dealt.mapInArrow(search, FOUND)


def _range(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    """``length`` bytes of a file from ``offset``, through the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


READ = "path string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, stated string"
#: Ranges less than GAP bytes apart are read together, up to about TOGETHER bytes.
GAP, TOGETHER = 1 << 16, 8 << 20


def _made(rows):
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)


def _checked(record: dict, path: str, offset: int, payload: bool) -> dict:
    """A record with digest and length of the payload read (null without one); ``stated`` is the header's digest."""
    body = record["payload"]
    sha = None if body is None else hashlib.sha256(body).hexdigest()
    return record | {
        "path": path, "offset": offset, "stated": record["payload_digest"], "payload_digest": sha,
        "payload_bytes": None if body is None else len(body), "payload": body if payload or body is None else b"",
    }


def _batched(records):
    """Batches of at most 1000 records or about 4 MB of payload."""
    rows, held = [], 0
    for record in records:
        rows.append(record)
        held += len(record["payload"] or b"")
        if len(rows) == 1000 or held > 4 << 20:
            yield _made(rows)
            rows, held = [], 0
    if rows:
        yield _made(rows)


def _store(path: str):
    """The file system of ``path`` for range reads within tasks, and the path in it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        return fs.LocalFileSystem(), "/" + (rest or path).lstrip("/")
    host, _, inner = rest.lstrip("/").partition("/")
    store, root = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host}/")
    return store, f"{root.rstrip('/')}/{inner}"


def read_ranges(lines: DataFrame, payload: bool = True) -> DataFrame:
    """The records at path, offset and length of ``lines``, each archive in order, neighbouring ranges in one read.

    Tasks get like numbers of records in the order of archives, so large archives are split between them.
    """

    def runs(batches):
        run = []
        for batch in batches:
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run and (path != run[0][0] or offset - run[-1][1] - run[-1][2] > GAP or offset + length - run[0][1] > TOGETHER):
                    yield run
                    run = []
                run.append((path, offset, length))
        if run:
            yield run

    def records(batches):
        name, file = None, None
        for run in runs(batches):
            path, begin, _ = run[0]
            if path != name:
                store, inner = _store(path)
                name, file = path, store.open_input_file(inner)
            data = file.read_at(run[-1][1] + run[-1][2] - begin, begin)
            for _, offset, _ in run:
                yield _checked(content(data, offset - begin), path, offset, payload)

    ordered = lines.select("path", "offset", "length").repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    return ordered.mapInArrow(lambda batches: _batched(records(batches)), READ)


def read_records(spark: SparkSession, archives: str, payload: bool = True) -> DataFrame:
    """Every record of the archives with its path and offset, archive by archive from end to end through Spark's reader."""

    def records(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, at = data.as_py(), 0
                while at < len(data):
                    yield _checked(content(data, at), path, at, payload)
                    at = parse(data, at)[2]

    return _files(spark, archives).mapInArrow(lambda batches: _batched(records(batches)), READ)


def read_back(spark: SparkSession, archives: str, index: str, payload: bool = True, urls: DataFrame | None = None) -> DataFrame:
    """The records of ``urls`` (None: every record that the index lists), read at the byte ranges that the index gives.

    Digest and length come from the payload read, for a revisit from its response's, which
    is read too where it belongs to none of the URLs. Stores that Arrow can't open
    are read whole by Spark, and joined to the ranges by path and offset.
    """
    try:
        _store(archives)
        read = read_ranges
    except (pa.ArrowException, NotImplementedError, OSError):
        def read(lines, payload):
            return read_records(spark, archives, payload).join(lines.select("path", "offset"), ["path", "offset"])

    lines = written(all_lines(spark, index) if urls is None else locate(spark, index, urls))
    found = written(read(lines, False))
    had = ["page_id", "stated", "payload_bytes", "payload_digest"]
    responses = found.where("payload IS NOT NULL AND page_id IS NOT NULL").select(had)
    named = written(found.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("page_id"), "stated").distinct())
    others = named.join(responses, ["page_id", "stated"], "left_anti").select("page_id").distinct()
    if urls is not None and not others.isEmpty():
        more = written(all_lines(spark, index).join(others, "page_id", "left_semi"))
        responses = responses.unionByName(read(more, False).where("payload IS NOT NULL").select(had))
    said = responses.join(named, ["page_id", "stated"], "left_semi").groupBy(F.col("page_id").alias("refers_to"), "stated")
    said = written(said.agg(F.min(F.struct("payload_bytes", "payload_digest")).alias("of")))
    found = (read(lines, True) if payload else found).drop("path", "offset")
    own = lambda c: F.coalesce(c, F.col(f"of.{c}")).alias(c)
    names = [c for c in found.columns if c != "stated"]
    return found.join(said, ["refers_to", "stated"], "left").select(*[own(c) if c in ("payload_bytes", "payload_digest") else c for c in names])


def op3_warc(spark, sf_dir):
    """Writes all ``pages`` as archives and an index, and reads the records of all their URLs back through it."""
    archives, index = work_dir(spark), work_dir(spark)
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, archives)
    write_index(spark, archives, index)
    found = read_back(spark, archives, index, payload=False, urls=pages.select("url"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p JOIN f USING (payload_digest)
"""
