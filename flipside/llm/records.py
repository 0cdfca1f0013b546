"""Token ids in length-delimited binary records, with an offset index.

A record is framed as a little-endian unsigned 64-bit length, the masked CRC-32C of those 8 bytes, the payload,
and the payload's masked CRC-32C (rotated right by 15, plus 0xA282EAD8). The payload is the document id as a
signed 64-bit integer, the width of the token ids in bytes as one (2 where the vocabulary allows it, or 4), and
the ids as unsigned integers, all little-endian. Beside each shard lies an
index of unsigned 64-bit offsets, one for each record, for shuffled reads. Shards follow one another in
ascending id order; a manifest table, written by Spark, names those that count: files of task attempts that were
lost or repeated are in no manifest.

Defined cases: null and empty texts are the end id alone; rows that share an id are records one after another,
ordered by text, null first; rows without an id are left out of the files, having no place in their order; an empty table
gives an empty manifest. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from flipside.llm.common import map_arrow, pieces, shared_folder, stored, texts
from flipside.llm.token_memo import token_memo

MASK = 0xA282EAD8


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What 16 low, and 16 high, bits of the register become over 32 bits of message (CRC-32C, reflected)."""
    one = np.arange(65536, dtype=np.uint32)
    tables = []
    for value, rounds in ((one, 32), (one << np.uint32(16), 32)):
        for _ in range(rounds):
            value = (value >> np.uint32(1)) ^ (np.uint32(0x82F63B78) * (value & np.uint32(1)))
        tables.append(value)
    return tables[0], tables[1]


def _advance(register: np.ndarray) -> np.ndarray:
    low, high = _tables()
    return low[register & np.uint32(0xFFFF)] ^ high[register >> np.uint32(16)]


@lru_cache(maxsize=4)
def _leap(words: int) -> tuple[np.ndarray, np.ndarray]:
    """As _tables, over ``words`` zero words: a linear map, built from the images of single bits."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(words):
        bits = _advance(bits)
    spread = lambda images: np.bitwise_xor.reduce(
        np.where((np.arange(65536)[:, None] >> np.arange(16)) & 1, images, 0).astype(np.uint32), axis=1)
    return spread(bits[:16]), spread(bits[16:])


def crc32c(messages: list[bytes], block: int = 512) -> np.ndarray:
    """CRC-32C of messages of at least 4 bytes, all blocks of all messages side by side. Zeros before a message
    don't change a register that starts at 0, so each is padded at its front to whole blocks."""
    if not messages:
        return np.empty(0, np.uint32)
    sizes = np.array([len(m) for m in messages])
    blocks = -(-sizes // block)
    ends = np.cumsum(blocks)
    laid = np.zeros(int(ends[-1]) * block, np.uint8)
    for message, end in zip(messages, ends):
        at = int(end) * block - len(message)
        laid[at:at + len(message)] = np.frombuffer(message, np.uint8)
        laid[at:at + 4] ^= 0xFF
    words = np.ascontiguousarray(laid.view("<u4").reshape(-1, block // 4).T)
    registers = np.zeros(words.shape[1], np.uint32)
    for word in words:
        registers = _advance(registers ^ word)
    low, high = _leap(block // 4)
    out = np.zeros(len(messages), np.uint32)
    starts = ends - blocks
    live = np.argsort(-blocks, kind="stable")
    for step in range(int(blocks.max())):
        live = live[: np.searchsorted(-blocks[live], -step, side="left")]
        held = out[live]
        out[live] = low[held & np.uint32(0xFFFF)] ^ high[held >> np.uint32(16)] ^ registers[starts[live] + step]
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads = masked(crc32c(lengths, 8)).astype("<u4")
    tails = masked(crc32c(payloads)).astype("<u4")
    return [b"".join((n, h.tobytes(), p, t.tobytes())) for n, h, p, t in zip(lengths, heads, payloads, tails)]


def read_frames(stream, together: int = 4 << 20):
    """Payloads of a shard, checked, one after another."""
    while True:
        lengths, heads, payloads, tails, size = [], [], [], [], 0
        while size < together and (head := stream.read(12)):
            (n,) = struct.unpack("<Q", head[:8])
            lengths.append(head[:8])
            heads.append(head[8:])
            payloads.append(stream.read(n))
            tails.append(stream.read(4))
            size += n
        if not payloads:
            return
        for messages, said, block in ((lengths, heads, 8), (payloads, tails, 512)):
            if masked(crc32c(messages, block)).astype("<u4").tobytes() != b"".join(said):
                raise ValueError("a record's checksum doesn't match")
        yield payloads


def payload(number: int, ids: bytes, wide: bool) -> bytes:
    """A record's payload of ids that are given as unsigned 32-bit integers."""
    return struct.pack("<qB", number, 4 if wide else 2) + (ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes())


def contents(record: bytes) -> tuple[int, np.ndarray]:
    """The document id and the token ids of a payload."""
    number, width = struct.unpack_from("<qB", record)
    return number, np.frombuffer(record, f"<u{width}", offset=9).astype("<u4")


def _write(folder: str, path: str, end_id: int, memo: int):
    def run(batches):
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        number, name = TaskContext.get().partitionId(), f"shard-{uuid.uuid4().hex}"
        encoder, end = token_memo(path, memo), struct.pack("<I", end_id)
        wide = max(end_id + 1, encoder.tokenizer.get_vocab_size(with_added_tokens=True)) > 1 << 16
        offsets, n_tokens, at = [], 0, 0
        out = None
        for batch in batches:
            for part in pieces(batch):
                out = out or store.open_output_stream(f"{base}/{name}.records", compression=None)
                gc.disable()  # as in map_arrow
                ids = [x + end for x in encoder.ids(texts(part, "text"))]
                gc.enable()
                n_tokens += sum(map(len, ids)) // 4
                for frame in frames([payload(i, x, wide) for i, x in zip(part["id"].to_pylist(), ids)]):
                    offsets.append(at)
                    at += len(frame)
                    out.write(frame)
        if out is not None:
            out.close()
            with store.open_output_stream(f"{base}/{name}.index", compression=None) as index:
                index.write(np.array(offsets, "<u8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": [number], "name": [name], "n_records": [len(offsets)],
                                              "n_tokens": [n_tokens], "n_bytes": [at]})

    return run


def write_records(df: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text", end_id: int = 0, memo: int = 1_000_000) -> tuple[str, DataFrame]:
    """Encodes, writes shards in ascending id order, and returns their folder and manifest: shard, name,
    n_records, n_tokens, n_bytes, start (tokens in all shards before it)."""
    folder = folder or shared_folder(df.sparkSession, "records")
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = docs.repartitionByRange("id").sortWithinPartitions("id", "text")
    made = ordered.mapInArrow(_write(folder, tokenizer_path, end_id, memo),
                              "shard long, name string, n_records long, n_tokens long, n_bytes long")
    made = stored(made, "manifest")
    before = F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")  # a row for each shard
    return folder, made.withColumn("start", before)


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (tokens before the document), n_tokens, ids_crc32 for each record of the shards."""
    schema = StructType.fromDDL("doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch["name"].to_pylist(), batch["start"].to_pylist()):
                with store.open_input_stream(f"{base}/{name}.records", compression=None, buffer_size=1 << 20) as stream:
                    for payloads in read_frames(stream):
                        found = [contents(p) for p in payloads]
                        counts = np.array([len(ids) for _, ids in found])
                        ends = start + np.cumsum(counts)
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": [i for i, _ in found], "start": ends - counts,
                            "n_tokens": counts, "ids_crc32": [zlib.crc32(ids) for _, ids in found]})
                        start = int(ends[-1])

    shards = manifest.select("shard", "name", "start")
    n = max(1, shards.count())
    return shards.repartition(n, "shard").mapInArrow(run, schema)


def read_at(folder: str, name: str, records: list[int]) -> list[np.ndarray]:
    """The token ids of some records of a shard, found through its index: a shuffled read."""
    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{base}/{name}.index") as index:
        offsets = np.frombuffer(index.read(), "<u8")
    out = []
    with store.open_input_file(f"{base}/{name}.records") as stream:
        for r in records:
            stream.seek(int(offsets[r]))
            (n,) = struct.unpack("<Q", stream.read(12)[:8])
            out.append(contents(stream.read(n))[1])
    return out
