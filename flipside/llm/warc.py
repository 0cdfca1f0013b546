"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own. Of records with equal payloads (by SHA-256 and length) of at least
``least`` bytes, the one with the largest id is a response and the others revisit it, without the payload. The
reader deals byte ranges of the files to tasks. A task looks for gzip's magic bytes in its range, takes a candidate
for a member when its content begins as a WARC header does and decompresses to the end with the right
checksum, and owns the records that start inside its range, wherever they end. The manifest, written by Spark, names
the files that count; files of task attempts that were lost or repeated are in no manifest.

Defined cases: a null payload is empty; a null URL leaves out its header; rows that share an id and a payload are
each a response if the id is the largest; a null id is written as empty and read as null; an empty table gives
an empty manifest and no records. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from flipside.llm.common import pieces, shared_folder, stored

MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20


def with_references(df: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """id, url, payload, refers_to: null for responses."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"),
                     F.sha2(payload, 256).alias("key"), F.octet_length(payload).alias("size"))
    leaders = rows.groupBy("key", "size").agg(F.max("id").alias("leader"))
    other = (F.col("size") >= least) & ~F.col("id").eqNullSafe(F.col("leader"))
    return rows.join(leaders, ["key", "size"]).select("id", "url", "payload", F.when(other, F.col("leader")).alias("refers_to"))


def _urn(number: int | None) -> str:
    return f"<urn:page:{'' if number is None else number}>"


def record(number: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One gzip member."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(number)}",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: {digest}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {_urn(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_warc(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", least: int = 0, date: str = "2000-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """The folder and the manifest: name, n_bytes, n_records."""
    folder = folder or shared_folder(df.sparkSession, "warc")

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        name, out, size, count = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for part in pieces(batch):
                out = out or store.open_output_stream(f"{base}/{name}", compression=None)
                for row in zip(*(part[c].to_pylist() for c in ("id", "url", "payload", "refers_to"))):
                    packed = record(*row, date)
                    out.write(packed)
                    size, count = size + len(packed), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "n_bytes": [size], "n_records": [count]})

    rows = with_references(df, id_col, url_col, payload_col, least)
    return folder, stored(rows.mapInArrow(run, "name string, n_bytes long, n_records long"), "warc-manifest")


def members(stream, start: int, end: int):
    """(offset, content) of the gzip members of WARC records that start in [start, end)."""
    stream.seek(start)
    held, at = b"", start  # bytes from file position ``at`` on
    while at < end:
        found = held.find(MAGIC)
        if found < 0:
            more = stream.read(READ)
            keep = held[-2:]
            at += len(held) - len(keep)
            held = keep + more
            if not more:
                return
            continue
        at, held = at + found, held[found:]
        if at >= end:
            return
        unpacker, content, fed = zlib.decompressobj(31), [], held
        good, size = True, 0
        while good and not unpacker.eof:
            try:
                content.append(unpacker.decompress(fed))
            except zlib.error:
                good = False
                break
            size += len(content[-1])
            if size >= 7 and not b"".join(content[:8])[:7] == b"WARC/1.":
                good = False
            elif not unpacker.eof:
                if not (fed := stream.read(READ)):
                    good = False
                held += fed
        if good and size >= 7:
            yield at, b"".join(content)
            used = len(held) - len(unpacker.unused_data)
        else:
            used = 1
        at, held = at + used, held[used:]


def parse(content: bytes) -> dict:
    """What a record says of its payload; a response's payload is checked against its digest."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload doesn't match its digest")
    number = lambda urn: int(x) if urn and (x := urn[len("<urn:page:"):-1]) else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
            "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")),
            "payload": payload if fields["WARC-Type"] == "response" else None}


RECORD = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string",
          "refers_to": "long", "payload": "binary"}


def read_warc(manifest: DataFrame, folder: str, split: int = 4 << 20, columns: tuple[str, ...] = tuple(RECORD)) -> DataFrame:
    """The records of the files that the manifest names, read in ranges of ``split`` bytes."""
    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start, end in zip(*(batch[c].to_pylist() for c in ("name", "start", "end"))):
                with store.open_input_file(f"{base}/{name}") as stream:
                    rows, size = [], 0
                    for _, content in members(stream, start, end):
                        rows.append(parse(content))
                        size += len(content)
                        if size > 8 << 20:
                            yield made(rows)
                            rows, size = [], 0
                    yield made(rows)

    schema = StructType.fromDDL(", ".join(f"{c} {RECORD[c]}" for c in columns))

    def made(rows):
        from pyspark.sql.pandas.types import to_arrow_schema

        return pa.RecordBatch.from_pydict({c: [r[c] for r in rows] for c in columns}, schema=to_arrow_schema(schema))

    ranges = manifest.select("name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.col("start") + split)
    n = max(1, int(manifest.agg(F.sum(F.ceil(F.col("n_bytes") / split))).first()[0] or 1))
    return ranges.repartition(n, "name", "start").mapInArrow(run, schema)
