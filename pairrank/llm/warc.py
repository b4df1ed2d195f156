"""From legacy ARC archives to WARC archives and back to rows.

An ARC record is one header line (its fields depend on the archive's version), then as
many bytes as the line declares. The converter makes a WARC record of each: record id,
timestamp, type and digest follow from what the ARC record says and holds.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.session import materialise, scratch_path

#: The header fields of both versions.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
END = "\r\n\r\n"


def arc_record(url: Column, date: Column, name: Column, body: Column) -> Column:
    """A version 2 ARC record (binary); blanks in fields are escaped, absent fields are a hyphen."""
    field = lambda c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.regexp_replace(c, r"[\s\x00-\x1F]", "%20")).otherwise("-")
    bytes_ = F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat_ws(
        " ", field(url), F.lit("0.0.0.0"), date, F.lit("text/html"), F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), field(name),
        F.octet_length(bytes_).cast("string"),
    )
    return F.concat(head.cast("binary"), F.lit("\n").cast("binary"), bytes_, F.lit("\n").cast("binary"))


@dataclass
class ArcRecord:
    fields: dict[str, str]
    body: bytes


def read_arc(data: bytes, version: int = 2) -> Iterator[ArcRecord]:
    """The records of an archive or a part of one.

    A ``filedesc:`` record states the version of those after it. The line's number of
    fields must fit the version and the declared length the bytes at hand; else an error
    names the place, since everything behind it would be misread.
    """
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # blank lines between records
            at += 1
            continue
        stop = data.find(b"\n", at)
        line = data[at : stop if stop >= 0 else len(data)].decode("utf-8", "replace").strip()
        parts = line.split(" ")
        names = FIELDS.get(version, ())
        if line.startswith("filedesc:"):
            names = FIELDS[1] if len(parts) == len(FIELDS[1]) else FIELDS[2]
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"no ARC version {version} header at byte {at}: {line[:80]!r}")
        fields, size = dict(zip(names, parts)), int(parts[-1])
        body = data[stop + 1 : stop + 1 + size] if stop >= 0 else b""
        if len(body) != size:
            raise ValueError(f"{size} bytes declared at byte {at}, {len(body)} there")
        if line.startswith("filedesc:"):
            version = int(body.split(b" ", 1)[0] or b"1")
        else:
            yield ArcRecord(fields, body)
        at = stop + 1 + size


def digest_of(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def warc_fields(record: ArcRecord) -> dict[str, str]:
    """Id, timestamp and digest of the WARC record that an ARC record becomes."""
    f, digest = record.fields, digest_of(record.body)
    d = (f["date"] + "0" * 14)[:14]
    seed = hashlib.sha1(" ".join((f["url"], f["date"], f.get("filename", "-"), digest)).encode()).digest()
    return {
        "id": f"<urn:uuid:{uuid.UUID(bytes=seed[:16], version=5)}>",
        "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "digest": digest,
        "url": f["url"],
        "name": f.get("filename", "-"),
        "mime": f["type"],
    }


CONVERTED = "name string, id string, date string, url string, mime string, digest string, bytes bigint, payload string"


def convert(arcs: DataFrame, column: str, payload: bool = True) -> DataFrame:
    """One row (``CONVERTED``) for every ARC record in the binary ``column``; payload null if not wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(0).to_pylist():
                for record in read_arc(data or b""):
                    body = record.body.decode("utf-8", "replace") if payload else None
                    rows.append(warc_fields(record) | {"bytes": len(record.body), "payload": body})
            names = [p.split()[0] for p in CONVERTED.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], pa.int64() if n == "bytes" else pa.string()) for n in names], names=names
            )

    return arcs.select(F.col(f"`{column}`")).mapInArrow(run, CONVERTED)


def warc_record() -> Column:
    """The record as text, without the blank lines behind it; a revisit has no payload but states its length."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.when(revisit, line("WARC-Refers-To", F.col("refers_id"))).otherwise(""),
        F.when(revisit, line("X-Refers-To-Name", F.coalesce("refers_to", F.lit("-")))).otherwise(""),
        line("X-Name", F.col("name")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.col("mime")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )


def read_warc(data: bytes) -> Iterator[dict]:
    """The records of an archive (plain or gzip): lower-cased header fields and ``body``."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or stop < 0:
            raise ValueError(f"no WARC header at byte {at}")
        head = data[at:stop].decode().split("\r\n")[1:]
        record = {k.lower(): v for k, v in (h.split(": ", 1) for h in head)}
        size = int(record["content-length"])
        record["body"] = data[stop + 4 : stop + 4 + size]
        if len(record["body"]) != size:
            raise ValueError(f"{size} bytes declared at byte {at}")
        yield record
        at = stop + 8 + size


def read_archives(archives: DataFrame) -> DataFrame:
    """(name, payload_bytes, payload_digest, record_type, refers_to) of every record of the ``content`` column.

    The digest of every payload that is there is computed anew; a wrong one is an error.
    """
    kinds = {"name": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for r in read_warc(data.as_py() or b""):
                    digest = r["warc-payload-digest"].removeprefix("sha1:")
                    if r["warc-type"] != "revisit" and digest_of(r["body"]) != digest:
                        raise ValueError(f"{r['warc-record-id']}: payload and digest differ")
                    rows.append((r["x-name"], int(r["x-payload-length"]), digest, r["warc-type"], r.get("x-refers-to-name")))
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))

    return archives.select("content").mapInArrow(run, "name string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")


def write_archives(pages: DataFrame, page_id: str, url: str, html: str, path: str, least: int = 0, volume_bytes: int = 16 << 20, date: str = "20240101000000") -> None:
    """Write ``pages``, by way of ARC records, to gzip WARC files under ``path``.

    Of records with equal payloads of ``least`` bytes at least, that with the smallest
    ``page_id`` is the response and the others are revisits that refer to it. Rows that
    repeat id and payload of a response are responses too. A null id counts as larger
    than all others, a null html as empty. The payloads are dealt by id and
    digest, so a group of equal ones spreads over all files of about ``volume_bytes``; the
    choice of the response moves digests and ids only, summed up map-side.
    """
    arcs = pages.select(
        arc_record(F.col(f"`{url}`"), F.lit(date), F.col(f"`{page_id}`").cast("string"), F.col(f"`{html}`")).alias("arc")
    )
    keys = materialise(convert(arcs, "arc", payload=False).select("name", "id", "digest", "bytes"), "warc-keys")
    order = F.struct(F.when(F.col("name") == "-", None).otherwise(F.col("name")).cast("bigint").isNull().alias("none"),
                     F.when(F.col("name") == "-", None).otherwise(F.col("name")).cast("bigint").alias("number"), "name", "id")
    first = keys.where(F.col("bytes") >= least).groupBy("digest").agg(F.min(order).alias("first")).select(
        F.col("digest").alias("of"), F.col("first.name").alias("refers_to"), F.col("first.id").alias("refers_id")
    )
    chosen = keys.join(first, F.col("digest") == F.col("of"), "left").select(
        F.concat_ws(" ", "name", "digest").alias("key"),
        F.when(F.col("refers_to") != F.col("name"), "revisit").otherwise("response").alias("record_type"), "refers_to", "refers_id",
    ).distinct()
    total = keys.agg(F.sum(F.col("bytes") + 600).alias("n")).first()["n"] or 0
    volumes = max(1, math.ceil(total / volume_bytes))
    records = convert(arcs, "arc").withColumn("key", F.concat_ws(" ", "name", "digest")).repartition(volumes, "key")
    records.join(chosen.repartition(volumes, "key"), "key").select(warc_record().alias("value")).write.option("lineSep", END).option(
        "compression", "gzip"
    ).text(path)


def round_trip(pages: DataFrame, page_id: str, url: str, html: str, least: int = 0) -> DataFrame:
    """Write the archives to the shared folder and read them back: what ``read_archives`` gives, with page ids."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, page_id, url, html, path, least)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    number = lambda c: F.when(F.col(c) == "-", None).otherwise(F.col(c)).cast("bigint")
    revisit = F.col("record_type") == "revisit"
    return read_archives(archives).select(
        number("name").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(revisit, number("refers_to")).alias("refers_to"),
    )
