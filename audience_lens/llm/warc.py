"""WARC archives: one transaction a capture, written as records and assembled again from them.

Writing. Each capture becomes a request, a response (or a revisit of an equal payload) and a metadata record; the two
others name the response as concurrent. Everything is column arithmetic: the records of a capture are one text, and the
text sink puts the blank lines that end a record behind it, so its files are archives, compressed with gzip as a whole,
on any store that Spark writes to.

Reading. The text source cut at blank lines returns the bytes of a file in order (a gzip file is one task's);
a task keeps the record it is in and cuts by ``Content-Length``, so blank lines inside a payload mean nothing.

Assembly. Records of a transaction are joined through their concurrent-to identifiers, whichever of them carries the
link, also over one record between, and each capture becomes one nested row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from audience_lens.llm.common import Scratch, arrow_map, lookup, record, saved, small, table
from audience_lens.sources.workspace import workspace

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_RESPONSE, HTTP_REQUEST, FIELDS = "application/http; msgtype=response", "application/http; msgtype=request", "application/warc-fields"

BLANK = "\r\n\r\n"
FILE_ROWS = 1 << 14  # captures of a file, at most
CAPTURED = ("response", "revisit", "resource")  # what a transaction is about
DATE = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def sha1_base32(content: Column) -> Column:
    """SHA-1 in base 32: four runs of 40 bits, each eight digits of base 32 in another alphabet."""
    runs = [F.lpad(F.conv(F.substring(F.sha1(content), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*runs), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _id(kind: str) -> Column:
    """Identifier of a capture's record, the same whenever a task is repeated."""
    mark = F.md5(F.concat_ws("|", F.lit(kind), F.col("row").cast("string"), F.col("id").cast("string"), "digest", "url"))
    parts = [F.substring(mark, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(value: Column) -> Column:
    """A header value: a line feed inside it would end the header."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record(kind: Column | str, content_type: str, block: Column, body: Column | None = None, length: Column | None = None,
            **headers: Column) -> Column:
    """A record without the blank lines behind it; headers without a value are left out. A ``body`` of known ``length``
    follows the block, so that it is copied once and not measured."""
    named = {"WARC-Type": F.lit(kind) if isinstance(kind, str) else kind,
             **{n.replace("_", "-"): v for n, v in headers.items()},
             "Content-Type": F.lit(content_type), "Content-Length": (F.octet_length(block) + (F.lit(0) if length is None else length)).cast("string")}
    lines = [F.concat(F.lit(f"\r\n{n}: "), v) for n, v in named.items()]
    return F.concat(F.lit(VERSION), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(BLANK), block,
                    *([] if body is None else [body]))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   least: int = 0, at: Column | None = None) -> None:
    """Writes a transaction a row to ``path``. Of rows with equal payloads of at least ``least`` bytes the one with the
    smallest id (then the earliest row; rows without an id last) is the response, and the others revisit it.

    A null payload is an empty one; a row without a url or id lacks that header or field; line ends in urls are
    percent-encoded; repeated rows are captures of their own. Other columns are ignored. No rows, no records.
    """
    scratch = Scratch()
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": sha1_base32(F.col("payload")), "size": F.octet_length("payload"),
                             "row": F.monotonically_increasing_id()})
    rows = scratch.saved(rows, "captures")
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row", "url", "digest")).alias("first")
    equal = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.count("*").alias("n"), first).filter("n > 1")
    equal = equal.select("digest", "first.row", "first.id", "first.url").withColumns({"first_id": _id("response"), "first_url": _line(F.col("url"))})
    equal = scratch.saved(equal.select("digest", F.col("row").alias("first_row"), "first_id", "first_url"), "equal")
    rows = lookup(rows, "digest", equal, "row")
    again = (F.col("size") >= least) & (F.col("first_row") != F.col("row"))
    again = F.coalesce(again, F.lit(False))

    def if_again(value: Column | str) -> Column:
        return F.when(again, value if isinstance(value, Column) else F.lit(value))

    own, uri = _id("response"), _line(F.col("url"))
    date = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()) if at is None else at, DATE)
    shared = {"WARC_Date": date, "WARC_Target_URI": uri}
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit(BLANK))
    body = F.when(again, "").otherwise(F.col("payload").cast("string"))
    response = _record(
        F.when(again, "revisit").otherwise("response"), HTTP_RESPONSE, head, body, F.when(again, 0).otherwise(F.col("size")), WARC_Record_ID=own, **shared,
        WARC_Payload_Digest=F.concat(F.lit("sha1:"), "digest"), WARC_Profile=if_again(PROFILE),
        WARC_Refers_To=if_again(F.col("first_id")), WARC_Refers_To_Target_URI=if_again(F.col("first_url")),
        WARC_Refers_To_Date=if_again(date))
    place = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", 1)
    target = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", 2)
    asked = F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)),
                     F.lit(" HTTP/1.1\r\nHost: "), place, F.lit(BLANK))
    request = _record("request", HTTP_REQUEST, F.coalesce(asked, F.lit("")), WARC_Record_ID=_id("request"), **shared, WARC_Concurrent_To=own)
    noted = F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit("\r\n"))
    metadata = _record("metadata", FIELDS, F.coalesce(noted, F.lit("")), WARC_Record_ID=_id("metadata"), **shared, WARC_Concurrent_To=own)
    (rows.select(F.concat_ws(BLANK, request, response, metadata).alias("value"))
     .write.option("lineSep", BLANK).option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path))
    scratch.clear()


RECORD = pa.schema([
    ("file", pa.string()), ("record_id", pa.string()), ("kind", pa.string()), ("uri", pa.string()), ("date", pa.string()),
    ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("head", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("intact", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
RECORD_DDL = ("file string, record_id string, kind string, uri string, date string, concurrent_to array<string>, refers_to string, "
              "head string, payload_bytes long, payload_digest string, intact boolean, fields map<string,string>, payload binary")


def _headers(head: bytes) -> list[tuple[str, str]]:
    """Lower-case names and values; a line that begins with a blank continues the one before."""
    lines = head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    pairs = (line.partition(":") for line in lines[1:])
    return [(name.lower(), value[1:] if value[:1] == " " else value) for name, sep, value in pairs if sep]


def _parsed(file: str, head: bytes, block: bytes, with_payload: bool) -> tuple:
    pairs = _headers(head)
    own = dict(reversed(pairs))
    links = [value.strip() for name, value in pairs if name == "warc-concurrent-to"]
    kind, http, payload, said = own.get("warc-type"), None, block, own.get("warc-payload-digest", "")
    fields = None
    if own.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(BLANK.encode())
    elif own.get("content-type", "").startswith(FIELDS):
        fields = dict(_headers(b"\r\n" + block))
    size, digest, intact = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), True
    if kind == "revisit":  # the payload is elsewhere; its length stands in the head
        size, digest = dict(_headers(http or b"")).get("content-length", "").strip(), said.removeprefix("sha1:")
        size = int(size) if size.isdigit() else None
    elif said.startswith("sha1:"):
        intact = said == f"sha1:{digest}"
    return (file, own.get("warc-record-id"), kind, own.get("warc-target-uri"), own.get("warc-date"), links, own.get("warc-refers-to"),
            None if http is None else http.decode("utf-8", "replace"), size, digest, intact, fields, payload if with_payload else None)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row a record of the archives at ``path``, which must be compressed files (``.gz``).

    ``intact`` is false where a payload hasn't the digest that its record names. A file that ends inside a record, or
    in which one doesn't begin where the last has ended, raises ValueError.
    """
    blank = BLANK.encode()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, at, end = None, bytearray(), 0, None  # end: (of the head, of the record), once known

        def ended() -> None:
            if held[at:].strip():
                raise ValueError(f"{now} ends inside a record")

        for batch in small(batches, 4096):
            out: list[tuple] = []
            for file, piece in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                if file != now:
                    ended()
                    now, held, at, end = file, bytearray(), 0, None
                held += piece
                held += blank
                while True:
                    if end is None:
                        while held[at:at + 2] == b"\r\n":
                            at += 2
                        stop = held.find(blank, at)
                        if stop < 0:
                            break
                        if held[at:at + 5] != b"WARC/":
                            raise ValueError(f"no record begins at a record's end in {now}")
                        length = dict(reversed(_headers(bytes(held[at:stop])))).get("content-length", "").strip()
                        if not length.isdigit():
                            raise ValueError(f"a record without a length in {now}")
                        end = (stop, stop + 4 + int(length))
                    if len(held) < end[1] + 4:
                        break
                    out.append(_parsed(now, bytes(held[at:end[0]]), bytes(held[end[0] + 4:end[1]]), with_payload))
                    at, end = end[1] + 4, None
                if at:
                    del held[:at]
                    end = end and (end[0] - at, end[1] - at)
                    at = 0
                if len(out) >= 256:
                    yield record(RECORD, list(zip(*out)))
                    out = []
            if out:
                yield record(RECORD, list(zip(*out)))
        ended()

    pieces = spark.read.option("lineSep", BLANK).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary"))
    return arrow_map(pieces, task, RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """(capture_id, uri, date, response, request, metadata, n_requests, n_metadata): one nested row a capture.

    ``records`` must be written. A request or metadata record belongs to the response (or revisit, or resource) that it
    is linked with through concurrent-to, in either direction, directly or over one other record; of several the one with the
    smallest identifier. A capture that has several requests or metadata records shows the one with the smallest
    identifier and counts them. One that no link leads to a response is a row of its own without a response. Records of
    other kinds are left out; records of one identifier that are of one kind count once.
    """
    scratch = Scratch()
    known = records.filter(F.col("kind").isin(*CAPTURED, "request", "metadata"))
    main = F.col("kind").isin(*CAPTURED)
    narrow = scratch.saved(known.select("record_id", "kind", "concurrent_to").dropDuplicates(["record_id", "kind"]), "links")
    one_way = narrow.select(F.col("record_id").alias("own"), F.explode("concurrent_to").alias("other"))
    links = one_way.unionByName(one_way.select(F.col("other").alias("own"), F.col("own").alias("other")))
    links = scratch.saved(links.distinct(), "links")
    home = scratch.saved(narrow.filter(main).select(F.col("record_id").alias("other"), F.col("record_id").alias("home")).distinct(), "homes")
    for _ in range(2):
        found = lookup(links, "other", home, "own").filter("home IS NOT NULL").groupBy("own").agg(F.min("home").alias("home"))
        found = found.select(F.col("own").alias("other"), "home").join(home.select("other"), "other", "left_anti")
        home = scratch.saved(home.unionByName(found), "homes")
    cells = F.struct(*[c for c in records.columns if c not in ("kind", "concurrent_to")])
    side = known.filter(~main).join(home.withColumnRenamed("other", "record_id"), "record_id", "left")
    side = side.withColumns({"capture_id": F.coalesce("home", "record_id"), "cells": cells})

    def of(kind: str) -> list[Column]:
        mine = F.col("kind") == kind
        return [F.min_by(F.when(mine, F.col("cells")), F.when(mine, F.col("record_id"))).alias(kind),
                F.count_distinct(F.when(mine, F.col("record_id"))).alias(f"n_{kind}")]

    sides = side.groupBy("capture_id").agg(*of("request"), *of("metadata"))
    responses = known.filter(main).withColumn("response", F.struct("kind", *[c for c in records.columns if c not in ("kind", "concurrent_to")]))
    responses = responses.select(F.col("record_id").alias("capture_id"), "response").dropDuplicates(["capture_id"])
    whole = responses.join(sides, "capture_id", "full")
    uri = [F.coalesce(*[f"{part}.{name}" for part in ("response", "request", "metadata")]).alias(name) for name in ("uri", "date")]
    out = whole.select("capture_id", *uri, "response", "request", "metadata", F.coalesce("n_request", F.lit(0)).alias("n_requests"),
                       F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))
    out = saved(out, "captures")
    scratch.clear()
    return out


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, path = Scratch(), f"{workspace(spark)}/llm/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    captures = assemble(scratch.saved(read_records(spark, path, with_payload=False), "records"))
    cells = captures.select(
        "capture_id", F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), "response.payload_bytes", "response.payload_digest",
        F.col("response.kind").alias("record_type"), F.when(F.col("response.kind") == "revisit", F.col("response.refers_to")).alias("target"))
    cells = saved(cells, "pages")
    first = cells.filter("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"))
    scratch.clear()
    return lookup(cells, "target", first, "capture_id").drop("capture_id", "target")


#: Twin of ``op11_warc``. Four runs of 40 bits each give eight digits of base 32.
SQL = f"""
WITH captures AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hash FROM pages),
told AS (
  SELECT *, first_value(page_id) OVER same AS first_id, row_number() OVER same AS nth FROM captures
  WINDOW same AS (PARTITION BY hash ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('{BASE32}',
    1 + (((('0x' || substr(hash, (1 + 10 * (k // 8))::BIGINT, 10))::BIGINT) >> (35 - 5 * (k % 8))::BIGINT) & 31), 1)), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first_id END AS refers_to
FROM told"""
