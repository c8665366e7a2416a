"""WARC archives of pages, and a capture index merged from locally sorted runs.

Pages are written as WARC/1.1 records, one gzip member each. Of pages with equal payloads
the one with the smallest id is a response; the others are revisits that refer to it and
carry no payload. Each task sorts its captures by URL key and time and writes archives of
bounded size, so each archive is a sorted run. Reading an archive back yields its index
rows; runs are then dealt out by ranges of (URL key, time, id), and in each range a loser
tree merges the runs' slices: the ranges, one after the other, are the global order.

Defined cases: a null payload is empty (and equal to other empty ones); a null URL has the
empty key and sorts first; pages that repeat an id and its payload are all responses; a null
id is never referred to, and is a response if no equal page has an id; line breaks in a URL
are percent-encoded, and those of an id (of any type) come back as they were; a very long payload is one record; captures
equal in URL, time and id (ties) stand in the order of their archives; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.llm.common import files_dealt, shared_dir, slices, small_batches, spread_join, written
from pricelode.llm.files import open_file, read_tables, write_file

ARCHIVE_BYTES = 32 << 20
#: Rows of repeated payloads up to which they are broadcast (some 60 bytes each).
BROADCAST_REPEATS = 200_000
#: Bits of Spark's row numbers below the number of their part.
PART_BITS = 33
#: Captures of a range, about.
RANGE_ROWS = 100_000
#: The time of page 0 where pages have no time of their own; each id is a second later.
FIRST_SECOND = 1_704_067_200
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """A sortable key: the host's labels reversed, then path and query, in lower case, without
    scheme, credentials, port, a leading www and fragment."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"#.*$", "")
    parts = r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@]*@)?(?:www\.)?([^/:?]*)(?::\d*)?(.*)$"
    host, rest = F.regexp_extract(bare, parts, 1), F.regexp_extract(bare, parts, 2)
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest)))


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value) -> str:
    """A value that is one line of a header, whatever it holds."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _value(header: str) -> str:
    return header.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url: str | None, second: int, payload: bytes, refers_to, revisit: bool, key: str) -> bytes:
    """One WARC record as a gzip member."""
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {datetime.fromtimestamp(second, UTC):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"X-Url-Key: {_header(key)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {_header(page_id)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {_header(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def members(raw: bytes, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        unpack, begin, found = zlib.decompressobj(31), at, []
        while not unpack.eof:
            piece = view[at : at + step]
            if not piece:
                raise ValueError("a record is cut off")
            found.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        yield begin, at - begin, b"".join(found)


def parse(content: bytes) -> dict:
    """The fields of a record; a response's payload is held against its digest."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        if len(payload) != size or digest32(payload) != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return fields | {"payload": payload, "size": size, "digest": digest}


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", second: Column | None = None) -> DataFrame:
    """Writes the archives; returns their manifest: path, n_records, n_bytes. ``second`` is
    the time of capture, in seconds since 1970."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "warc")
    when = F.coalesce(F.col(page_id).cast("string").try_cast("long"), F.lit(0)) + FIRST_SECOND if second is None else second
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"), when.alias("second"))
    digests = written(own.select("page_id", F.sha1(F.col("payload").cast("binary")).alias("sha1")), "digests")
    repeats = written(digests.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first_id").isNotNull()).drop("n"), "repeats")
    known = own.withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    other = F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull())
    beside: str | None = None
    if repeats.count() <= BROADCAST_REPEATS:
        known = known.join(F.broadcast(repeats), "sha1", "left").withColumn("_row", F.lit(None).cast("long"))
    else:  # rows meet by digest without payloads; what they refer to is read by the task that has them, so payloads stay where they are
        known = written(known.withColumn("_row", F.monotonically_increasing_id()), "pages")
        refers = spread_join(known.select("_row", "page_id", "sha1"), repeats, "sha1").where(other)
        beside = shared_dir(spark, "refers")
        refers.select("_row", "first_id", F.shiftright("_row", PART_BITS).alias("part")).repartition("part").write.partitionBy("part").parquet(beside)
        known = known.withColumn("first_id", F.lit(None).cast(repeats.schema["first_id"].dataType))
    # 1970 to 9999: what a WARC date can hold
    second = F.least(F.greatest(F.coalesce(F.col("second"), F.lit(0)), F.lit(0)), F.lit(253_402_300_799)).cast("long")
    rows = known.select("page_id", "url", "payload", second.alias("second"), F.when(other, F.col("first_id")).alias("refers_to"), url_key(F.col("url")).alias("key"), "_row")
    rows = rows.sortWithinPartitions("key", "second", "page_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        parts: dict[int, dict] = {}  # by part of the written table, what its rows refer to

        def referred(numbers: list[int]) -> list:
            for n in {x >> PART_BITS for x in numbers} - parts.keys():
                some = read_tables(f"{beside}/part={n}", ["_row", "first_id"])
                parts[n] = {k: v for t in some for k, v in zip(t["_row"].to_pylist(), t["first_id"].to_pylist(), strict=True)}
            return [parts[x >> PART_BITS].get(x) for x in numbers]

        def flush() -> pa.RecordBatch:
            nonlocal size
            path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            write_file(path, b"".join(held))
            out = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "n_bytes"])
            held.clear()
            size = 0
            return out

        for batch in batches:
            for part in slices(batch, "payload"):
                *columns, numbers = (c.to_pylist() for c in part.columns)
                if beside:
                    columns[4] = referred(numbers)
                for p, u, x, s, r, k in zip(*columns, strict=True):
                    made = record(p, u, s, x.encode(), r, r is not None, k)
                    if held and size + len(made) > ARCHIVE_BYTES:
                        yield flush()
                    held.append(made)
                    size += len(made)
        if held:
            yield flush()

    return written(rows.mapInArrow(write, "path string, n_records long, n_bytes long"), "archives")


INDEX = (
    ("url_key", "string"), ("captured_at", "long"), ("page_id", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"),
    ("refers_to", "string"), ("archive", "string"), ("offset", "long"), ("length", "long"), ("seq", "int"),
)
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def read_archives(manifest: DataFrame) -> DataFrame:
    """An index row for each record, in the order of its archive (``seq``): sorted runs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for seq, (at, length, content) in enumerate(members(open_file(path))):
                    f = parse(content)
                    second = int(datetime.strptime(f["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
                    page, refers = (_value(f[x]) if x in f else None for x in ("X-Page-Id", "X-Refers-To-Page"))
                    rows.append((_value(f["X-Url-Key"]), second, page, f["size"], f["digest"], f["WARC-Type"], refers, path, at, length, seq))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, (_, k) in zip(zip(*rows, strict=True), INDEX, strict=True)], [n for n, _ in INDEX])

    schema = ", ".join(f"{n} {k}" for n, k in INDEX)
    return files_dealt(manifest.select("path")).mapInArrow(read, schema)


class LoserTree:
    """Merges sorted lists: every inner node holds the loser of its match, so the next row
    costs one comparison a level."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * self.k
        winner = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.top = winner[1] if self.k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        """Does run a's next row come before run b's? A run that is used up comes last."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.at[self.top] < len(self.runs[self.top]):
            run = self.top
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            node = (run + self.k) // 2
            while node:
                if self._first(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.top = run


def merge_runs(index: DataFrame, ranges: int | None = None) -> DataFrame:
    """The index (written: it is read twice) in global order of url_key, captured_at and
    page_id (as a number; -1 if it is none): ``part`` numbers the ranges and ``place`` the rows of a range."""
    spark = index.sparkSession
    if ranges is None:
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), index.count() // RANGE_ROWS)
    number = F.coalesce(F.col("page_id").try_cast("long"), F.lit(-1))
    # archive and seq part captures that are equal in all else
    dealt = index.withColumn("_number", number).repartitionByRange(ranges, "url_key", "captured_at", "_number", "archive", "seq")
    dealt = dealt.sortWithinPartitions("archive", "seq").withColumn("_part", F.spark_partition_id())
    names = [n for n, _ in INDEX[:-1]]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        part, kept = 0, []
        for batch in batches:
            if batch.num_rows:
                part = batch.column(len(INDEX) + 1)[0].as_py()
                base = sum(b.num_rows for b in kept)
                kept.append(batch)
                keys = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(len(INDEX)).to_pylist())
                for i, (archive, *key) in enumerate(zip(batch.column(7).to_pylist(), *keys, strict=True)):
                    runs.setdefault(archive, []).append((*key, base + i))
        if kept:
            order = pa.array([row[-1] for row in LoserTree(list(runs.values()))], pa.int64())
            table = pa.Table.from_batches(kept).take(order).combine_chunks()
            for at in range(0, len(order), 10_000):
                some = table.slice(at, 10_000).to_batches()[0]
                n = some.num_rows
                yield pa.RecordBatch.from_arrays([*some.columns[: len(names)], pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], [*names, "part", "place"])

    schema = ", ".join(f"{n} {k}" for n, k in INDEX[:-1])
    return dealt.mapInArrow(merge, f"{schema}, part int, place long")


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", second: Column | None = None) -> DataFrame:
    """Writes all pages, reads the archives back and merges their index: one row per page."""
    kind = pages.schema[page_id].dataType.simpleString()
    index = written(read_archives(write_archives(pages, page_id, url, payload, second)), "runs")
    merged = merge_runs(index)
    return merged.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
