"""WARC archives written and read back.

Writing: one record per page; of equal payloads the smallest page id holds the payload, the others revisit it. Spark's
text sink writes the records, with the blank lines that end a record as its line separator, so the archives appear in
any store that Spark writes to and under its commit protocol.

Reading: a payload may hold the very line that begins a record, so a match is only a candidate. Tasks list the candidates
of ranges of bytes with the offset of the record that would follow; pointer jumping from the start of each file then keeps
the chain of records and drops everything else. Headers and bodies are read for the records of the chain alone, so that a
payload of very many magics takes no more than its length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, new_path, open_range_reader, reads_ranges, small, stage, unstage

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
DATE = "1970-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of an archive at most, and the largest payload among so many; an archive of payloads twice as large, or up to
#: that, has half as many, and so on, so that none but one of a single record goes beyond their product (64 MB).
RECORDS_A_FILE, SMALL_BYTES = 1000, 1 << 16
#: Bytes that a task looks through for candidates, and that are read on at a time.
RANGE_BYTES, MORE_BYTES = 16 << 20, 1 << 20


def base32(sha1: Column) -> Column:
    """A SHA-1 in hexadecimal digits as upper-case base 32 without a prefix: five bytes are eight letters."""
    parts = [F.translate(F.lpad(F.upper(F.conv(F.substring(sha1, 1 + 10 * i, 10), 16, 32)), 8, "0"), DIGITS, BASE32) for i in range(4)]
    return F.concat(*parts)


def _one_line(text: Column) -> Column:
    """What may stand in a header field: line ends would end it."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")


def with_roles(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (text), payload_bytes, payload_digest, record_type and refers_to of each page.

    Equal payloads of at least least_bytes bytes share one response: that of the smallest id (null ids last, then the
    smallest url); of wholly equal rows any one, for nothing tells them apart. Null html is the empty payload.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32(F.sha1(payload.cast("binary"))).alias("payload_digest"))
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.col("url").isNull().alias("no_url"))
    # Copies of a payload by the rows that hold it, each kind of row once: n > 1 are wholly equal rows.
    kinds = base.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", order.alias("row")).agg(F.count("*").alias("n"))
    shared = kinds.groupBy("payload_digest").agg(F.min(F.struct("row", "n")).alias("first"), F.sum("n").alias("copies")).filter("copies > 1")
    shared = stage(shared.select(F.col("payload_digest").alias("digest"), F.col("first.row").alias("first"), F.col("first.n").alias("equals")), "shared")
    joined = base.join(small(shared), (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") >= least_bytes), "left")
    holds = F.col("digest").isNull() | (order == F.col("first"))
    columns = ("page_id", "url", "payload", "payload_bytes", "payload_digest")
    role = lambda first: (F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("first.page_id")).alias("refers_to"))
    if not shared.filter("equals > 1").limit(1).count():
        return joined.select(*columns, *role(holds))
    # Equal rows that would all hold the payload are made again from their number: one holds it, the others revisit it.
    tied = F.coalesce(holds & (F.col("equals") > 1), F.lit(False))
    again = joined.filter(tied).groupBy("page_id", "url", "payload_bytes", "payload_digest", "first", "equals").agg(F.first("payload").alias("payload")).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("equals"))))
    return joined.filter(~tied).select(*columns, *role(holds)).unionByName(again.select(*columns, *role(F.col("k") == 1)))


def record(rows: DataFrame, *, date: str = DATE, least_bytes: int = 0) -> DataFrame:
    """One string column: the record without the blank lines that end it, which the sink adds. It has the fields that WARC
    1.0 asks of every record, an id of its own among them, and the page's ids in fields of their own."""
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    held = F.concat(F.lit("<urn:sha1:"), "payload_digest", F.lit(">"))
    # The one response of a payload is named by it, any other record by chance.
    own = F.when((F.col("record_type") == "response") & (F.col("payload_bytes") >= least_bytes), held).otherwise(F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))
    text = F.concat(
        F.lit(MAGIC),
        F.concat(F.lit("WARC-Type: "), "record_type", F.lit("\r\n")),
        field("WARC-Record-ID", own),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", _one_line(F.col("url"))),
        field("WARC-Refers-To", F.when(F.col("record_type") == "revisit", held)),
        field("WARC-Profile", F.when(F.col("record_type") == "revisit", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        field("X-Page-ID", F.col("page_id").cast("string")),
        field("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        field("X-Payload-Length", F.col("payload_bytes").cast("string")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    return rows.select(text.alias("value"))


def write_archives(pages: DataFrame, path: str, *, date: str = DATE, **options) -> None:
    """Write WARC files under path, one record per page, no page shuffled unless its payload's table of copies is large. Pages
    carry no time of their own, so all records have the given date, by default a fixed one: reruns write the same but for
    the ids of revisits."""
    rows = with_roles(pages, **options)
    doublings = lambda size: F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)) / SMALL_BYTES))).cast("int")
    sizes = pages.select(doublings(F.coalesce(F.octet_length(named(options.get("html_col", "html"))), F.lit(0))).alias("n"))
    kinds = sorted(r["n"] for r in sizes.distinct().collect()) or [0]  # 15 kinds are 2 GB
    rows = rows.withColumn("doublings", doublings(F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)))
    kinds = sorted({0, *kinds}) if len(kinds) > 1 or kinds[0] else kinds  # revisits have no payload
    for n in kinds:  # mostly one
        part = rows if len(kinds) == 1 else rows.filter(F.col("doublings") == n)
        record(part, date=date, least_bytes=options.get("least_bytes", 0)).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", max(1, RECORDS_A_FILE >> n)).text(path)


class _Window:
    """A file's bytes from an offset on; it reads on as far as it is asked to."""

    def __init__(self, read: Callable[[str, int, int], bytes], path: str, at: int, length: int, size: int):
        self.read, self.path, self.at, self.size = read, path, at, size
        self.data = bytes(read(path, at, min(length, size - at)))

    def reach(self, offset: int) -> bool:
        """Whether the bytes up to an offset of the file are there, after reading them if need be."""
        there = self.at + len(self.data)
        if offset > there and there < self.size:
            self.data += bytes(self.read(self.path, there, min(max(offset - there, MORE_BYTES), self.size - there)))
        return offset <= self.at + len(self.data)


def _places(pattern: bytes, data: bytes) -> list[int]:
    return [m.start() for m in re.finditer(re.escape(pattern), data)]


def _in_range(w: _Window, length: int) -> list[tuple[int, int, int | None]]:
    """(offset, offset of the body, its length or None) of the magics that begin in the first `length` bytes of a window."""
    w.reach(min(w.at + length + len(MAGIC), w.size))
    magic = MAGIC.encode()
    starts = [p for p in _places(magic, w.data) if p < length]
    if not starts:
        return []
    while w.data.find(END.encode(), starts[-1] + len(magic)) < 0 and w.at + len(w.data) < w.size:
        w.reach(w.at + len(w.data) + MORE_BYTES)
    # Ends of headers and lengths are looked for once, not for each magic.
    ends = _places(END.encode(), w.data)
    sizes = [(m.start(), int(m[1])) for m in re.finditer(rb"\r\nContent-Length: ([0-9]{1,18})(?=\r\n)", w.data)]
    at_size, out = [s for s, _ in sizes], []
    for p in starts:
        i = bisect_left(ends, p + len(magic) - 2)  # a header without fields ends with its own line
        if i == len(ends):
            continue
        j = bisect_left(at_size, p + len(magic) - 2)
        size = sizes[j][1] if j < len(sizes) and sizes[j][0] < ends[i] else None
        out.append((w.at + p, w.at + ends[i] + len(END), size))
    return out


def candidates(spark, files: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """(file, path, at, next, body, size) of every place in the files (path, total) where the magic stands and a header ends:
    tasks look through ranges of bytes, or through `content` where files have it. file is a hash of the path; next is where the record after it would begin, null
    where that cannot be told or lies beyond the file."""
    range_bytes = range_bytes or RANGE_BYTES
    if "content" in files.columns:
        ranges, range_bytes = files.filter("total > 0").select("path", "total", F.lit(0).cast("long").alias("at"), "content"), 1 << 40
    else:
        starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
        ranges = files.filter("total > 0").select("path", "total", starts.alias("at")).repartition(spark.sparkContext.defaultParallelism * 4, "path", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranged = open_range_reader()
        for b in batches:
            for r in b.to_pylist():
                read = _within(r["content"]) if "content" in r else ranged
                w = _Window(read, r["path"], r["at"], range_bytes + MORE_BYTES, r["total"])
                rows = _in_range(w, range_bytes)
                follows = [body + size + len(END) if size is not None and body + size + len(END) <= r["total"] else None for _, body, size in rows]
                columns = [[r["path"]] * len(rows), [x[0] for x in rows], follows, [x[1] for x in rows], [x[2] for x in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 4), strict=True)], names=["path", "at", "next", "body", "size"])

    return ranges.mapInArrow(run, "path string, at long, next long, body long, size long").select(F.xxhash64("path").alias("file"), "*")


def _fields(head: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.split("\r\n"):
        name, colon, value = line.partition(": ")
        if colon and value:
            out.setdefault(name, value)
    return out


def _within(content: bytes) -> Callable[[str, int, int], bytes]:
    return lambda _, start, length: content[start : start + length]


def _record_rows(kept: DataFrame, files: DataFrame) -> DataFrame:
    """The fields of records (path, at, body, size), and the SHA-1 of their bodies, read where they lie. Records that lie
    together are read together; a body is hashed piece by piece."""
    wanted = {"record_type": "WARC-Type", "page_id": "X-Page-ID", "refers_to": "X-Refers-To-Page-ID", "url": "WARC-Target-URI", "payload_length": "X-Payload-Length", "digest": "WARC-Payload-Digest"}
    if "content" in files.columns:
        near = files.join(kept.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "body", "size"))).alias("records")), "path").select("path", "content", "records")
    else:
        near = kept.select("path", "at", "body", "size", F.floor(F.col("at") / RANGE_BYTES).alias("near"))
        near = near.repartition(kept.sparkSession.sparkContext.defaultParallelism * 4, "path", "near").sortWithinPartitions("path", "at").drop("near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranged, path, at, data, totals = open_range_reader(), None, 0, b"", {}
        read = ranged

        def piece(where: str, start: int, stop: int) -> bytes:
            nonlocal path, at, data
            if where != path or start < at or stop > at + len(data):
                length = max(stop - start, min(MORE_BYTES, totals[where] - start))
                path, at, data = where, start, bytes(read(where, start, length))
            return data[start - at : stop - at]

        for b in batches:
            out, rows = [], b.to_pylist()
            totals.clear()
            if rows and "content" in rows[0]:
                contents = {r["path"]: r["content"] for r in rows}
                read, path = lambda where, start, length, c=contents: c[where][start : start + length], None
                rows = [{"path": r["path"], **x} for r in rows for x in r["records"]]
            for r in rows:
                totals[r["path"]] = max(totals.get(r["path"], 0), r["body"] + r["size"] + len(END))
            for r in rows:
                head = _fields(piece(r["path"], r["at"] + len(MAGIC), r["body"] - len(END)).decode("utf-8", "replace"))
                sha1, stop = hashlib.sha1(), r["body"] + r["size"]
                for start in range(r["body"], stop, MORE_BYTES):
                    sha1.update(piece(r["path"], start, min(stop, start + MORE_BYTES)))
                out.append({**{k: head.get(v) for k, v in wanted.items()}, "size": r["size"], "body_sha1": sha1.hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*((k, pa.string()) for k in wanted), ("size", pa.int64()), ("body_sha1", pa.string())]))

    return near.mapInArrow(run, ", ".join(f"{k} string" for k in wanted) + ", size long, body_sha1 string")


def reachable(found: DataFrame) -> DataFrame:
    """(file, at) of the candidates on the chain from offset 0 of each file, by pointer jumping: a step doubles the
    reach of every pointer, so a chain of n records takes about log2(n) joins on (file, offset)."""
    nodes = stage(found.select("file", "at", F.col("next").alias("to")), "jump0")
    jump = nodes
    seen = stage(jump.filter("at = 0").select("file", "at"), "seen0")
    n, step = seen.count(), 0
    while True:
        step += 1
        ahead = seen.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).join(nodes, ["file", "at"], "left_semi")
        more = stage(seen.unionByName(ahead).distinct(), f"seen{step}")
        m = more.count()
        unstage(seen)
        seen = more
        if m == n:
            return seen
        n = m
        far = stage(jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.at"))).select("a.file", "a.at", "b.to"), f"jump{step}")
        if jump is not nodes:
            unstage(jump)
        jump = far


def read_archives(spark, path: str) -> DataFrame:
    """The records of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are those of the bytes that were read; a revisit carries its payload's in its
    header. Bytes that no chain from a file's start reaches, such as a magic within a payload, give no rows, nor does a
    record that its file cuts short.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", F.col("length").alias("total"))
    if not reads_ranges(files):  # only Spark can open them: each is then one row, of 2 GB at most
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", F.col("length").alias("total"), "content")
    found = stage(candidates(spark, files), "candidates")
    chain = reachable(found)
    records = _record_rows(found.filter("next is not null").join(chain, ["file", "at"], "left_semi"), files)
    holds = F.col("record_type") == "response"
    number = lambda c: F.col(c).try_cast("bigint")
    out = records.select(
        number("page_id").alias("page_id"),
        F.when(holds, F.col("size")).otherwise(number("payload_length")).alias("payload_bytes"),
        F.when(holds, base32(F.col("body_sha1"))).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        "url",
    )
    out = stage(out, "records")
    unstage(found, chain)
    return out


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    path = new_path(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path)


ORACLE = """
with p as (
  select page_id, coalesce(url, '') as url, coalesce(html, '') as h from pages
), d as (
  select page_id, url, strlen(h)::bigint as payload_bytes, sha1(h) as hex,
         row_number() over (partition by sha1(h) order by page_id nulls last, url) as k,
         first_value(page_id) over (partition by sha1(h) order by page_id nulls last, url) as first_id
  from p
)
select page_id, payload_bytes,
       (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                                 1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::bigint >> (35 - 5 * (i % 8))) & 31)::int, 1), '' order by i)
        from range(32) t(i)) as payload_digest,
       case when k = 1 then 'response' else 'revisit' end as record_type,
       case when k > 1 then first_id end as refers_to,
       nullif(regexp_replace(url, '[\\r\\n]+', ' ', 'g'), '') as url
from d
"""
