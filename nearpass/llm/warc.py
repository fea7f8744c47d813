"""WARC archives of pages: writing them, and reading any archive by verified record boundaries.

Archives are read by Spark as lines, so a large file is shared by many tasks and
none of them knows at first where its records begin.  Every line that looks like
the start of a record is a candidate; its header tells where the next record
has to begin.  Inside a task's block the successors are followed to the first
offset behind the block.  From there pointer jumping goes on: starting at the
first byte of each file, jumps over 1, 2, 4, ... blocks reach every block that a
chain enters.  Only candidates on the chain are records; a page that quotes a
whole record, magic and lengths included, stays payload.

Records are cut where a task found candidates or its block ended; pieces of one
record are put together again by its offset.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearpass.llm.work import Work, meets, misses

END = "\r\n\r\n"
LEAST = 100  # payload bytes from which equal payloads are stored once
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\Z")
FIELD = re.compile(rb"[!-9;-~]+:")
HTTP_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]+)[ \t]*\r\n", re.IGNORECASE)
FLUSH = 4 << 20


def _name(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("<urn:x-record>")).otherwise(
        F.concat(F.lit("<urn:x-record:"), F.url_encode(value.cast("string")), F.lit(">"))
    )


def write_warc(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
    date: str = "1970-01-01T00:00:00Z", compression: str | None = None,
) -> None:
    """Write one record per page as WARC files below `path`.

    Of pages with equal payloads of LEAST bytes or more, those with the smallest
    key are responses and the others revisits, which name that key and hold no
    payload.  A null payload is an empty one.  Repeated rows are records of
    their own, and rows without a key never the ones that others revisit.  Line
    breaks in an address are percent-encoded.  Other columns are not read.

    The files are text with the end of a record as separator, so Spark writes
    and commits them like any table; `compression` is one of its codecs.
    """
    work = Work(pages.sparkSession)
    rows = pages.select(
        F.col(key).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")
    )
    rows = rows.withColumn("bytes", F.octet_length("payload")).withColumn("digest", F.sha2("payload", 256))
    large = rows.filter(F.col("bytes") >= LEAST)
    copies = large.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = work.save(copies.filter("n > 1 AND first IS NOT NULL").select("digest", "first"))
    # Pages without a copy stay where they are.
    nothing = F.lit(None).cast(copies.schema["first"].dataType)
    rows = misses(rows, copies, "digest").withColumn("first", nothing).unionByName(
        meets(rows, copies, "digest").join(copies, "digest", "left").select(*rows.columns, "first")
    )
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END)
    )
    body = F.when(again, F.lit(b"")).otherwise(F.col("payload"))
    address = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _name(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), address),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(again, F.lit(f"WARC-Profile: {REVISIT}")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), _name(F.col("first")))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string")),
    )
    record = F.concat(header.cast("binary"), F.lit(END.encode()), http.cast("binary"), body).cast("string")
    writer = rows.select(record.alias("value")).write.option("lineSep", END)
    (writer.option("compression", compression) if compression else writer).text(path)


HEAD = "size_of_header bigint, length bigint, type string, name string, refers_to string, target string, digest string"
_HEAD = pa.struct(
    [("size_of_header", pa.int64()), ("length", pa.int64())]
    + [(n, pa.string()) for n in ("type", "name", "refers_to", "target", "digest")]
)


def parse_header(data: bytes) -> dict | None:
    """Fields of the record header that `data` begins with; None if it is none, or not all of it."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].split(b"\r\n")
    if not MAGIC.match(lines[0] + b"\r"):
        return None
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if line[:1] in (b" ", b"\t"):
            continue  # a folded line goes on with the value before it, which none of the fields below does
        if not colon or not FIELD.match(line):
            return None
        fields.setdefault(name.decode().lower(), value.strip().decode("utf-8", "replace"))
    length = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        return None
    return {
        "size_of_header": end + 4, "length": int(length), "type": fields.get("warc-type"), "name": fields.get("warc-record-id"),
        "refers_to": fields.get("warc-refers-to"), "target": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest"),
    }


def unfinished(data: bytes) -> bool:
    """Whether a header that begins with `data` may go on behind it."""
    if b"\r\n\r\n" in data:
        return False
    lines = data.split(b"\r\n")[:-1]
    return all(FIELD.match(x) or x[:1] in (b" ", b"\t") for x in lines[1:])


def body_of(block: bytes) -> tuple[int, str, int | None, bytes]:
    """Bytes and SHA-256 of the payload of an HTTP message, the length its header states, and the payload."""
    length, payload = None, block
    if block.startswith(b"HTTP/"):
        head, _, payload = block.partition(b"\r\n\r\n")
        stated = HTTP_LENGTH.search(head + b"\r\n")
        length = int(stated[1]) if stated and len(stated[1]) <= 18 else None
    return len(payload), hashlib.sha256(payload).hexdigest(), length, payload


BODY = "n_bytes bigint, sha256 string, stated bigint, payload binary"
SPAN = f"file string, block bigint, first boolean, start bigint, size bigint, head struct<{HEAD.replace(' ', ':').replace(',:', ',')}>, open boolean, {BODY}, content binary"
_SPAN = pa.schema(
    [
        ("file", pa.string()), ("block", pa.int64()), ("first", pa.bool_()), ("start", pa.int64()), ("size", pa.int64()), ("head", _HEAD),
        ("open", pa.bool_()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("stated", pa.int64()), ("payload", pa.binary()),
        ("content", pa.binary()),
    ]
)


class _Cutter:
    """Cuts the lines of a task's blocks at candidates and at the ends of blocks."""

    def __init__(self, with_payload: bool):
        self.with_payload = with_payload
        self.rows: list[tuple] = []
        self.held = 0
        self.file, self.block = None, None
        self.lines: list[bytes] = []

    def enter(self, file: str, block: int) -> None:
        self.close(ends=True)
        self.file, self.block = file, block
        self.start, self.first = 0, True
        self.expected = 0 if block == 0 else -1  # the next offset on the chain, known from the first byte of a file on

    def close(self, ends: bool) -> None:
        """The lines since the last cut are one span; `ends`: the block ends here."""
        if not self.lines:
            return
        content = b"\n".join(self.lines) + b"\n"
        self.lines = []
        head = parse_header(content) if MAGIC.match(content.partition(b"\n")[0]) else None
        is_open = ends and head is None and bool(MAGIC.match(content.partition(b"\n")[0])) and unfinished(content)
        body = (None, None, None, None)
        if head and self.start == self.expected:
            total = head["size_of_header"] + head["length"] + 4
            self.expected = self.start + total
            if total == len(content):  # on the chain and whole: no other record needs these bytes
                body = body_of(content[head["size_of_header"] : -4])
                body = (*body[:3], body[3] if self.with_payload else None)
        kept = None if body[0] is not None else content
        self.rows.append((self.file, self.block, self.first, self.start, len(content), head, is_open, *body, kept))
        self.held += len(kept or b"") + len(body[3] or b"") + 500
        self.start, self.first = self.start + len(content), False

    def table(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True))
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPAN, strict=True)], schema=_SPAN)


def _spans(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(with_payload)
        for batch in batches:
            lines = batch.column("line").to_pylist()
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
            for line, file, block in zip(lines, files, blocks, strict=True):
                if block != cutter.block or file != cutter.file:
                    cutter.enter(file, block)
                elif line[:5] == b"WARC/" and MAGIC.match(line):
                    cutter.close(ends=False)
                    if cutter.held >= FLUSH:
                        yield cutter.table()
                cutter.lines.append(line)
        cutter.close(ends=True)
        if cutter.rows:
            yield cutter.table()

    return run


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers that a block's end had cut, as far as they are known now."""
    for batch in batches:
        data = batch.column("data").to_pylist()
        heads = pa.array([parse_header(x) for x in data], _HEAD)
        columns = [heads, pa.array([unfinished(x) for x in data], pa.bool_())]
        kept = [batch.column(c) for c in ("file", "block", "at", "ends", "data")]
        yield pa.RecordBatch.from_arrays([*kept, *columns], ["file", "block", "at", "ends", "data", "head", "open"])


def _exits(_key: tuple, group: pa.Table) -> pa.Table:
    """Where the chain from each candidate of a block leaves the block; -1 if it breaks."""
    group = group.sort_by("at")
    at, after = group.column("at").to_numpy(), group.column("next").to_numpy()
    edge = group.column("edge").to_numpy()
    to = np.searchsorted(at, after).tolist()
    out = after.tolist()
    for i in range(len(out) - 1, -1, -1):
        if out[i] < edge[i]:
            out[i] = out[to[i]] if to[i] < len(out) and at[to[i]] == after[i] else -1
    return pa.table({"file": group.column("file"), "block": group.column("block"), "at": at, "next": after, "exit": out})


def _marks(_key: tuple, group: pa.Table) -> pa.Table:
    """The candidates of a block that its entry reaches."""
    group = group.sort_by("at")
    at, after = group.column("at").to_numpy(), group.column("next").to_numpy()
    to = np.searchsorted(at, after).tolist()
    real = group.column("entry").to_numpy(zero_copy_only=False).copy()
    for i in range(len(at)):
        if real[i] and to[i] < len(at) and at[to[i]] == after[i]:
            real[to[i]] = True
    return pa.table({"file": group.column("file"), "at": at}).filter(pa.array(real))


def _assembled(with_payload: bool):
    def run(_key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        head = group.column("size_of_header")[0].as_py()
        content = b"".join(group.column("content").to_pylist())
        size, digest, stated, payload = body_of(content[head : head + group.column("length")[0].as_py()])
        columns = {"file": group.column("file")[:1], "record": group.column("record")[:1], "n_bytes": [size], "sha256": [digest]}
        kept = pa.array([payload if with_payload else None], pa.binary())
        return pa.table({**columns, "stated": pa.array([stated], pa.int64()), "payload": kept})

    return run


def chain(candidates: DataFrame, work: Work) -> DataFrame:
    """(file, at) of the candidates (file, block, edge, at, next) that a chain from offset 0 of their file reaches."""
    schema = "file string, block bigint, at bigint, next bigint, exit bigint"
    walked = work.save(candidates.groupBy("file", "block").applyInArrow(_exits, schema))
    reached = work.save(walked.filter("at = 0").select("file", "at"))
    jumps = walked.filter("exit >= 0").select("file", "at", F.col("exit").alias("to"))
    jumps = work.save(jumps.join(walked.select("file", F.col("at").alias("to")), ["file", "to"], "left_semi"))
    while True:
        more = work.save(reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at")))
        if more.isEmpty():
            break
        reached = work.save(reached.unionByName(more))
        second = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        jumps = work.save(jumps.join(second, ["file", "to"]).select("file", "at", F.col("then").alias("to")))
    entry = reached.withColumn("entry", F.lit(True))
    marked = walked.join(entry, ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.groupBy("file", "block").applyInArrow(_marks, "file string, at bigint")


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record on the chain of its file.

    Columns: file, at (offset of the record), type, name, refers_to, target,
    digest (as the header states them), length (of the block), n_bytes and
    sha256 of the payload found, stated (payload length by the HTTP header,
    null if there is none) and payload (null unless asked for).  The payload of
    a record that is not an HTTP message is its whole block.

    Files may be compressed by a codec Spark knows; offsets are those of the
    plain bytes.  Lines that only look like records, records that a broken
    header cuts off from the start of the file, and a record that the end of the
    file cuts short give no rows; nor do empty files.
    """
    work = Work(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    spans = work.save(lines.mapInArrow(_spans(with_payload), SPAN))
    # The lines of a block begin where those of the blocks before it end.
    blocks = spans.groupBy("file", "block").agg(F.sum("size").alias("total"))
    running = F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumn("edge", running).withColumn("base", F.col("edge") - F.col("total"))
    blocks = work.save(blocks.select("file", "block", "base", "edge"))
    placed = spans.join(blocks, ["file", "block"]).withColumn("at", F.col("base") + F.col("start"))
    placed = placed.withColumn("ends", F.col("at") + F.col("size"))

    known = placed.filter("head IS NOT NULL").select("file", "block", "at", "head")
    cut = work.save(placed.filter("open").select("file", "block", "at", "ends", F.col("content").alias("data")))
    heads = placed.filter("first").select("file", F.col("at").alias("ends"), F.col("ends").alias("on"), F.col("content").alias("more"))
    while not cut.isEmpty():  # headers that lie in several blocks
        joined = cut.join(heads, ["file", "ends"]).select(
            "file", "block", "at", F.col("on").alias("ends"), F.concat("data", "more").alias("data")
        )
        head = SPAN[SPAN.index("head struct") : SPAN.index(", open")]
        joined = work.save(
            joined.mapInArrow(_headers, f"file string, block bigint, at bigint, ends bigint, data binary, {head}, open boolean")
        )
        known = known.unionByName(joined.filter("head IS NOT NULL").select("file", "block", "at", "head"))
        cut = joined.filter("open").select("file", "block", "at", "ends", "data")
    known = work.save(known.select("file", "block", "at", "head.*").withColumn("next", F.expr("at + size_of_header + length + 4")))

    candidates = known.join(blocks, ["file", "block"]).select("file", "block", "edge", "at", "next")
    real = chain(candidates, work)
    size = blocks.groupBy("file").agg(F.max("edge").alias("file_size"))
    records = known.join(real, ["file", "at"]).join(size, "file").filter("next <= file_size").drop("file_size")
    records = work.save(records.withColumn("is_record", F.lit(True)))

    # A span belongs to the last record that begins at it or before it.
    slim = placed.select("file", "block", "at", F.col("n_bytes").isNotNull().alias("whole"))
    slim = slim.join(records.select("file", "at", "is_record"), ["file", "at"], "left")
    begins = F.when(F.col("is_record"), F.col("at"))
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    slim = slim.withColumn("own", F.last(begins, ignorenulls=True).over(inside))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = slim.groupBy("file", "block").agg(F.max(begins).alias("latest"))
    carried = carried.withColumn("carried", F.last("latest", ignorenulls=True).over(before)).drop("latest")
    slim = slim.join(carried, ["file", "block"]).withColumn("record", F.coalesce("own", "carried"))
    pieces = slim.filter("NOT whole AND record IS NOT NULL").select("file", "at", "record")
    of = records.select("file", F.col("at").alias("record"), "size_of_header", "length", "next")
    pieces = pieces.join(of, ["file", "record"]).filter("at < next").drop("next")
    pieces = placed.select("file", "at", "content").filter("content IS NOT NULL").join(pieces, ["file", "at"])
    parts = pieces.groupBy("file", "record").applyInArrow(_assembled(with_payload), f"file string, record bigint, {BODY}")
    body = ["n_bytes", "sha256", "stated", "payload"]
    whole = placed.filter("n_bytes IS NOT NULL").select("file", "at", *body)
    bodies = whole.unionByName(parts.withColumnRenamed("record", "at"))
    columns = ["type", "name", "refers_to", "target", "digest", "length"]
    return records.join(bodies, ["file", "at"]).select("file", "at", *columns, *body)


def named(value: str, kind: str) -> Column:
    """The key in a record's name."""
    text = F.regexp_extract(value, "^<urn:x-record:(.*)>$", 1)
    return F.when(F.col(value).rlike("^<urn:x-record:.*>$"), F.url_decode(text)).cast(kind)


def archived(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write the pages to archives below `path` and read them back.

    One row per page: key, payload_bytes, payload_digest, record_type,
    refers_to.  Bytes and digest of a response are those of the payload read;
    of a revisit, those that the record states of the payload it leaves out.
    An empty table gives no rows.
    """
    write_warc(pages, path, key, url, payload)
    records = read_warc(pages.sparkSession, path, with_payload=False)
    kind = pages.schema[key].dataType.simpleString()
    again = F.col("type") == "revisit"
    return records.select(
        named("name", kind).alias(key),
        F.when(again, F.col("stated")).otherwise(F.col("n_bytes")).alias("payload_bytes"),
        F.when(again, F.substring_index("digest", ":", -1)).otherwise(F.col("sha256")).alias("payload_digest"),
        F.col("type").alias("record_type"), named("refers_to", kind).alias("refers_to"),
    )
