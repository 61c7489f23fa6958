"""Legacy archive converter (operator 12): ARC files to WARC files.

An ARC file begins with a version block, whose last line names the fields of every header line that follows (five in version
1, ten in version 2). A record is its header line and as many bytes as the line declares. Both kinds of archive are read as
streams of lines that are put together again by declared lengths, one file in one task, however large it is; a task holds
one record and one Arrow batch of lines. The converter gives each record a WARC identifier (made from file, place and content,
so that a task that runs again gives the same), a date in the WARC form, its type and SHA-1 digests of block and payload.

Of records with equal payloads, the one with the largest key (an HTTP header of the record, then the last in order of file and place)
is written whole; the others are revisits of it, with HTTP headers but no payload. The winners come from a first pass over the
archives and an aggregation; where more than ``most_broadcast`` payloads repeat, records meet them in a shuffled
join that deals hot payloads over many parts, else in a broadcast one.

Nulls: a null payload is empty, a null url is "-" in ARC and urn:unknown in WARC, a null key is no header and less than any
other. Empty payloads are payloads like others. Repeated rows are equal payloads with equal keys: one is written whole.
Empty tables give archives without records. Very long texts are one line of one record. Other columns are ignored.
A record cut off by the end of its file is kept with WARC-Truncated; a header line that has no length is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm.frames import map_arrow, new_path, skew_join, table, written

#: Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNKNOWN = "urn:unknown"
KEY_HEADER = "X-Page-Id"
NO_DATE = "19700101000000"
_HEADER = re.compile(rb"\r?\n\r?\n")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Stream:
    """One file's bytes, put together from its lines."""

    def __init__(self, lines: Iterator[bytes]):
        self.lines, self.rest, self.at = lines, b"", 0

    def _next(self) -> bytes | None:
        if self.rest:
            rest, self.rest = self.rest, b""
            return rest
        line = next(self.lines, None)
        return None if line is None else line + b"\n"

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        line = self._next()
        if line is not None:
            self.at += len(line)
            line = line.rstrip(b"\r\n")
        return line

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end of the file."""
        parts, left = [], n
        while left and (line := self._next()) is not None:
            if len(line) > left:
                line, self.rest = line[:left], line[left:]
            parts.append(line)
            left -= len(line)
        self.at += n - left
        return b"".join(parts)


def head_of(block: bytes) -> tuple[bytes, bytes]:
    """HTTP headers (with the empty line) and payload of a record; no headers where it isn't HTTP."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    found = _HEADER.search(block)
    return (block, b"") if found is None else (block[: found.end()], block[found.end() :])


def header(head: bytes, name: str) -> str | None:
    for line in head.split(b"\n"):
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,19}", text) else None


def warc_date(stamp: str, otherwise: str = NO_DATE) -> str:
    """Up to 14 digits of an ARC date as a WARC date; what is missing is the least possible."""
    digits = re.sub(r"\D", "", stamp)
    if len(digits) < 4:
        digits = otherwise
    d = (digits + "00000101000000"[len(digits) :])[:14]
    return f"{d[:4]}-{max('01', min('12', d[4:6]))}-{max('01', min('31', d[6:8]))}T{min('23', d[8:10])}:{min('59', d[10:12])}:{min('59', d[12:14])}Z"


def arc_records(name: str, lines: Iterator[bytes]) -> Iterator[dict]:
    """The records of one ARC file, each with the fields of its header line, its place and its block."""
    stream, fields, started = Stream(lines), None, NO_DATE
    while True:
        place = stream.at
        line = stream.line()
        if line is None:
            return
        if not line:
            continue
        first = line.startswith(b"filedesc:")
        if not first and fields is None:
            raise ValueError(f"{name}: an ARC file begins with a version block")
        text = line.decode("utf-8", "replace")
        values = text.split(" ") if first else text.rsplit(" ", len(fields) - 1)  # old addresses may hold spaces
        if len(values) < 3 or not first and len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"{name}: no ARC header line at {place}")
        size = int(values[-1])
        block = stream.take(size)
        if first:
            about = block.split(b"\n")
            fields = about[1].decode("ascii", "replace").split() if len(about) > 1 else []
            version = about[0].split(b" ")[0].decode("ascii", "replace")
            if not fields or fields[-1] != "Archive-length" or not {"URL", "Archive-date"} <= set(fields):
                raise ValueError(f"{name}: unknown ARC version block")
            started = values[2]
            continue
        found = dict(zip(fields, values))
        yield {"place": place, "version": version, "block": block, "truncated": len(block) < size, "url": found["URL"], "ip": found.get("IP-address", "-"), "date": warc_date(found["Archive-date"], started), "mime": found.get("Content-type", "-")}


def warc_records(name: str, lines: Iterator[bytes]) -> Iterator[dict]:
    """The records of one WARC file: named header fields (in lower case), place and block."""
    stream = Stream(lines)
    while True:
        place = stream.at
        line = stream.line()
        if line is None:
            return
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC record at {place}")
        fields = {}
        while line := stream.line():
            key, _, value = line.partition(b":")
            fields[key.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
        yield fields | {"place": place, "block": stream.take(int(fields["content-length"]))}


def lines_of(spark: SparkSession, folder: str) -> DataFrame:
    """(name, line) of all archives in a folder, compressed or not; a compressed file is one task's, in order."""
    read = spark.read.option("wholetext", False).text(folder, lineSep="\n")
    return read.select(F.col("_metadata.file_name").alias("name"), F.col("value").cast("binary").alias("line"))


def _files(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
    rows = ((n, x) for b in batches for n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    for name, lines in groupby(rows, key=lambda r: r[0]):
        yield name, (x for _, x in lines)


def _lots(records: Iterator[dict], columns: list[str], most_bytes: int = 4_000_000) -> Iterator[dict[str, list]]:
    """Records as columns, in lots of bounded size."""
    out: dict[str, list] = {c: [] for c in columns}
    size = 0
    for r in records:
        for c in columns:
            out[c].append(r[c])
        size += 500 + len(r.get("block") or b"")
        if size > most_bytes:
            yield out
            out, size = {c: [] for c in columns}, 0
    yield out


ARC_ROW = "name string, place long, record_id string, url string, ip string, date string, mime string, digest string, payload_bytes long, key long"
ARC_BLOCK = "block binary, head_bytes int, block_digest string, head_digest string, truncated boolean, version string"


def read_arc(spark: SparkSession, folder: str, blocks: bool = True, key_header: str = KEY_HEADER) -> DataFrame:
    """One row for each record of the ARC files in ``folder``, with its synthesised identifier, date and digests."""
    columns = [c.split(" ")[0] for c in ARC_ROW.split(", ") + ARC_BLOCK.split(", ") * blocks]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        def records() -> Iterator[dict]:
            for name, lines in _files(batches):
                for r in arc_records(name, lines):
                    head, payload = head_of(r["block"])
                    digest = base32_sha1(payload)
                    r |= {"name": name, "digest": digest, "payload_bytes": len(payload), "key": number(header(head, key_header))}
                    r["record_id"] = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}:{r['place']}:{digest}"))
                    if blocks:
                        r |= {"head_bytes": len(head), "block_digest": base32_sha1(r["block"]), "head_digest": base32_sha1(head)}
                    yield r

        yield from _lots(records(), columns)

    return map_arrow(lines_of(spark, folder), run, ARC_ROW + f", {ARC_BLOCK}" * blocks)


def _in_front(record: Column, first: Column) -> Column:
    """The record, with ``first`` before it where it is the first of its partition, and so of its file."""
    return F.when(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0, F.concat(first, record)).otherwise(record)


def write_arc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", stamp: str = "20000101000000") -> None:
    """Pages as ARC files, versions 1 and 2 in turn, one file for each partition of ``pages``."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    owner = F.coalesce(F.concat(F.lit(f"{KEY_HEADER}: "), F.col(key).cast("string"), F.lit("\r\n")), F.lit(""))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n"), owner, F.lit("\r\n"), body)
    place = F.coalesce(F.nullif(F.regexp_replace(F.col(url).cast("string"), r"[\x00-\x20\x7F]", "%20"), F.lit("")), F.lit("-"))
    begin = [place, F.lit(f"0.0.0.0 {stamp} text/html")]
    size = F.octet_length("block").cast("string")
    second = F.spark_partition_id() % 2 == 1
    line = F.when(second, F.concat_ws(" ", "place", F.lit(f"0.0.0.0 {stamp} text/html 200 - - 0 -"), size)).otherwise(F.concat_ws(" ", "place", F.lit(f"0.0.0.0 {stamp} text/html"), size))

    def version(v: int) -> Column:
        about = f"{v} 0 rastrum\n{ARC_FIELDS[v]}\n"
        rest = " 200 - - 0 pages.arc" if v == 2 else ""
        return F.lit(f"filedesc://pages.arc 0.0.0.0 {stamp} text/plain{rest} {len(about)}\n{about}\n")

    rows = pages.select(begin[0].alias("place"), block.alias("block"))
    record = F.concat(line, F.lit("\n"), F.col("block"))
    rows.select(_in_front(record, F.when(second, version(2)).otherwise(version(1))).alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", 0).option("lineSep", "\n").text(folder)


def winners(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """For payloads of at least ``least_bytes`` that more than one record has: the record that is written whole, and how many there are."""
    order = F.struct(F.col("key").isNotNull().alias("known"), "key", "name", "place")
    best = F.max_by(F.struct("key", "name", "place", "record_id", "url", "date"), order)
    found = records.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "payload_bytes").agg(best.alias("whole"), F.count("*").alias("n"))
    return found.where("n > 1")


def warc_record() -> Column:
    """The text of a record, from the columns of ``read_arc`` and ``whole`` (the record that has its payload, or null)."""
    again = F.col("again")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    known = lambda url: F.when(url == "-", F.lit(UNKNOWN)).otherwise(url)
    http = F.col("head_bytes") > 0
    block = F.when(again, F.substring(F.col("block"), F.lit(1), F.col("head_bytes"))).otherwise(F.col("block"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").when(http, "response").otherwise("resource")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), "record_id", F.lit(">"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", known(F.col("url"))),
        line("WARC-IP-Address", F.when(~F.col("ip").isin("-", "0.0.0.0"), F.col("ip"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(again, F.col("head_digest")).otherwise(F.col("block_digest")))),
        line("WARC-Truncated", F.when(F.col("truncated") & ~again, "length")),
        F.when(again, F.concat(
            line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), "whole.record_id", F.lit(">"))), line("WARC-Refers-To-Target-URI", known(F.col("whole.url"))),
            line("WARC-Refers-To-Date", F.col("whole.date")), line("X-Refers-To-Key", F.col("whole.key").cast("string")), line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        )).otherwise(F.lit("")),
        line("Content-Type", F.when(http, "application/http;msgtype=response").when(F.col("mime") == "-", "application/octet-stream").otherwise(F.col("mime"))),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block.cast("string"),
    )


def convert(spark: SparkSession, arc: str, warc: str, least_bytes: int = 0, key_header: str = KEY_HEADER, most_broadcast: int = 100_000) -> None:
    """The ARC files of a folder as WARC files in another one, which must be new."""
    found = written(winners(read_arc(spark, arc, False, key_header), least_bytes), "winners")
    records = read_arc(spark, arc, True, key_header)
    if found.count() <= most_broadcast:
        joined = records.join(F.broadcast(found), ["digest", "payload_bytes"], "left")
    else:
        alone = records.join(found.select("digest", "payload_bytes"), ["digest", "payload_bytes"], "left_anti").withColumn("whole", F.lit(None).cast(found.schema["whole"].dataType))
        joined = skew_join(records, found, ["digest", "payload_bytes"], "n").select(alone.columns).unionAll(alone)
    own = (F.col("whole.name") == F.col("name")) & (F.col("whole.place") == F.col("place"))
    about = "software: rastrum\r\nformat: WARC File Format 1.1\r\n"
    info = F.lit(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, about)}>\r\nWARC-Date: {warc_date(NO_DATE)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n{about}\r\n\r\n")
    marked = joined.withColumn("again", F.col("whole").isNotNull() & ~F.coalesce(own, F.lit(False)))
    marked.select(_in_front(warc_record(), info).alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", 0).option("lineSep", "\r\n\r\n").text(warc)


WARC_ROW = "name string, place long, record_type string, record_id string, url string, date string, key long, payload_bytes long, payload_digest string, refers_to long, intact boolean"


def read_warc(spark: SparkSession, folder: str, key_header: str = KEY_HEADER, payloads: bool = False) -> DataFrame:
    """One row for each record but warcinfo. payload_digest and payload_bytes are those of the whole payload: of a revisit as its header gives
    them; ``intact``: whether digests of what is there agree with the header. ``payloads`` adds the bytes of the payload, null for revisits."""
    schema = WARC_ROW + ", payload binary" * payloads
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        def records() -> Iterator[dict]:
            for name, lines in _files(batches):
                for r in warc_records(name, lines):
                    if r["warc-type"] == "warcinfo":
                        continue
                    head, payload = head_of(r["block"])
                    again = r["warc-type"] == "revisit"
                    told = r.get("warc-payload-digest", "").removeprefix("sha1:")
                    digest = told if again else base32_sha1(payload)
                    yield {
                        "name": name, "place": r["place"], "record_type": r["warc-type"], "record_id": r["warc-record-id"].removeprefix("<urn:uuid:").removesuffix(">"),
                        "url": None if r.get("warc-target-uri", UNKNOWN) == UNKNOWN else r["warc-target-uri"], "date": r["warc-date"], "key": number(header(head, key_header)),
                        "payload_bytes": number(r.get("x-payload-length")) if again else len(payload), "payload_digest": digest, "refers_to": number(r.get("x-refers-to-key")),
                        "intact": digest == told and r.get("warc-block-digest", "").removeprefix("sha1:") == base32_sha1(r["block"]), "block": r["block"], "payload": None if again else payload,
                    }

        yield from _lots(records(), columns)

    return map_arrow(lines_of(spark, folder), run, schema)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    whole = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a WARC record doesn't agree with its digests")))
    return read_warc(spark, warc).select(F.col("key").alias("page_id"), "payload_bytes", whole.alias("payload_digest"), "record_type", "refers_to")


#: Twenty bits of the digest are five hexadecimal and four base-32 digits.
OP12_SQL = """
select page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((('0x' || substr(digest, cast(k // 4 * 5 + 1 as int), 5))::int >> (15 - k % 4 * 5)::int) & 31 as int) + 1, 1)), 'string_agg', '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to
from (select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as digest, max(page_id) over (partition by coalesce(html, '')) as top from pages)
"""
