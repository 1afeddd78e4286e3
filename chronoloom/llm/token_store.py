"""Token ids on disk as directly addressable codes.

An id is split into chunks of ``BITS`` bits, low chunk first. Level 0 holds the first
chunk of every id; a bit per entry says whether the id goes on in the next level, and a
directory of ones before every ``RANK_STEP`` bits finds its place there. Any token is
reached by one rank a level, with no block to decode.

A file (little-endian) is: magic, counts (documents, ids, levels) as three u64; document
ids as i64, their null flags as u8, local starts as u64 (one more than documents); then for
each level its entry count as u64, chunks as u8, continuation bits, rank directory as u32.
Files hold documents in ascending doc_id order; the manifest lists them in order.
"""

from __future__ import annotations

import posixpath
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import in_blocks, materialize, text_or_empty
from chronoloom.llm.tokens import encoder
from chronoloom.session import ship

MAGIC = b"DACTOK01"
BITS = 8
RANK_STEP = 512
#: Ids in one file; a longer document has a file of its own.
FILE_IDS = 4 << 20


class Level:
    """One level: chunks, continuation bits and the rank directory."""

    def __init__(self, chunks: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bits, self.ranks = chunks, bits, ranks

    @classmethod
    def build(cls, chunks: np.ndarray, more: np.ndarray) -> Level:
        bits = np.packbits(more, bitorder="little")
        steps = np.add.reduceat(more, np.arange(0, len(more), RANK_STEP), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        return cls(chunks, bits, np.concatenate([[0], np.cumsum(steps)]).astype(np.uint32))

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def rank_one(self, at: int) -> int:
        step = at // RANK_STEP
        first = step * (RANK_STEP // 8)
        word = int.from_bytes(self.bits[first : (at >> 3) + 1].tobytes(), "little")
        return int(self.ranks[step]) + (word & ((1 << (at - first * 8)) - 1)).bit_count()

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place: the directory, then the bits since its last entry."""
        step = at // RANK_STEP
        out = self.ranks[step].astype(np.int64)
        first = step * (RANK_STEP // 8)
        for k in range(RANK_STEP // 8):
            byte = first + k
            left = at - byte * 8
            live = left > 0
            if not live.any():
                break
            b = self.bits[np.minimum(byte, len(self.bits) - 1)]
            part = np.where(left < 8, b & ((1 << np.clip(left, 0, 8)) - 1).astype(np.uint8), b)
            out += np.where(live, np.bitwise_count(part), 0)
        return out


class TokenFile:
    """Random access to the ids of one file."""

    def __init__(self, doc_ids: np.ndarray, nulls: np.ndarray, starts: np.ndarray, levels: list[Level]):
        self.doc_ids, self.nulls, self.starts, self.levels = doc_ids, nulls, starts, levels

    @classmethod
    def build(cls, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> TokenFile:
        nulls = np.array([d is None for d in doc_ids], np.uint8)
        starts = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]).astype(np.uint64)
        levels, rest = [], ids.astype(np.uint32)
        while True:
            more = (rest >> BITS) > 0
            levels.append(Level.build((rest & ((1 << BITS) - 1)).astype(np.uint8), more))
            rest = rest[more] >> BITS
            if not len(rest):
                break
        return cls(np.array([d or 0 for d in doc_ids], np.int64), nulls, starts, levels)

    def to_bytes(self) -> bytes:
        out = [MAGIC, struct.pack("<3Q", len(self.doc_ids), int(self.starts[-1]), len(self.levels))]
        out += [self.doc_ids.astype("<i8").tobytes(), self.nulls.tobytes(), self.starts.astype("<u8").tobytes()]
        for x in self.levels:
            out += [struct.pack("<Q", len(x.chunks)), x.chunks.tobytes(), x.bits.tobytes(), x.ranks.astype("<u4").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> TokenFile:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n, _, n_levels = struct.unpack_from("<3Q", data, 8)
        at = 32

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        doc_ids, nulls, starts = take("<i8", n), take("u1", n), take("<u8", n + 1)
        levels = []
        for _ in range(n_levels):
            count = int(take("<u8", 1)[0])
            levels.append(Level(take("u1", count), take("u1", -(-count // 8)), take("<u4", -(-count // RANK_STEP) + 1)))
        return cls(doc_ids, nulls, starts, levels)

    def take(self, places) -> np.ndarray:
        """The ids at any places, in the order asked for."""
        at = np.asarray(places, np.int64)
        out = np.zeros(len(at), np.uint32)
        live = np.arange(len(at))
        for k, level in enumerate(self.levels):
            out[live] |= level.chunks[at].astype(np.uint32) << (BITS * k)
            more = level.bit(at) if len(at) else np.zeros(0, bool)
            live, at = live[more], at[more]
            if not len(live):
                break
            at = level.rank(at)
        return out

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids of a range: one rank a level, then the entries that follow."""
        out = np.zeros(max(0, end - start), np.uint32)
        live, first, count = np.arange(len(out)), start, len(out)
        for k, level in enumerate(self.levels):
            if not count:
                break
            out[live] |= level.chunks[first : first + count].astype(np.uint32) << (BITS * k)
            bits = np.unpackbits(level.bits[first >> 3 : (first + count + 7) >> 3], bitorder="little")[first & 7 : (first & 7) + count]
            live = live[bits > 0]
            first, count = level.rank_one(first), len(live)
        return out

    def document(self, i: int) -> np.ndarray:
        return self.slice(int(self.starts[i]), int(self.starts[i + 1]))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


def _write(uri: str, data: bytes, attempt: str) -> None:
    """Write under a name of the attempt, then rename: a rerun task replaces its file whole."""
    fs, path = _filesystem(uri)
    fs.create_dir(posixpath.dirname(path))
    with fs.open_output_stream(f"{posixpath.dirname(path)}/_{attempt}") as f:
        f.write(data)
    fs.move(f"{posixpath.dirname(path)}/_{attempt}", path)


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode whole texts, each followed by ``end_id``, into files under ``uri`` in ascending key order.

    Returns the manifest (file, n_docs, n_ids, base: ids in earlier files). Null and empty
    texts hold the end id alone; null keys come first; rows that share a key are ordered by
    text and stored each. ``uri`` names a folder in a store that pyarrow.fs can write.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    d = d.repartitionByRange("key").sortWithinPartitions("key", "text")
    end = end_id.to_bytes(4, "little")
    folder = uri.rstrip("/")

    def run(batches):
        context = TaskContext.get()
        encode = encoder(tokenizer).encode
        keys: list = []
        parts: list[bytes] = []
        made: list[tuple] = []
        held = 0

        def flush():
            nonlocal held
            data = TokenFile.build(keys, [len(p) // 4 for p in parts], np.frombuffer(b"".join(parts), "<u4")).to_bytes()
            name = f"part-{context.partitionId():07d}-{len(made):05d}.dac"
            _write(f"{folder}/{name}", data, f"{context.taskAttemptId()}-{len(made)}")
            made.append((name, len(keys), held))
            keys.clear()
            parts.clear()
            held = 0

        for batch in batches:
            for block in in_blocks(batch, pc.binary_length(batch.column(1)).to_pylist(), 4 << 20):
                for k, t in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                    ids = encode(t) + end
                    if keys and held + len(ids) // 4 > file_ids:
                        flush()
                    keys.append(k)
                    parts.append(ids)
                    held += len(ids) // 4
        if keys:
            flush()
        names, n_docs, n_ids = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n_docs, pa.int64()), pa.array(n_ids, pa.int64())], ["file", "n_docs", "n_ids"])

    files = materialize(d.mapInArrow(run, "file string, n_docs bigint, n_ids bigint"), "manifest")
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0).cast("long")))


def read_tokens(spark, uri: str, key: str = "doc_id") -> DataFrame:
    """Every document in the files under ``uri``: key, file, local_start, n_tokens, ids (little-endian unsigned 32-bit)."""
    ship(spark)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(uri).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = TokenFile.from_bytes(data.as_py())
                n = len(f.doc_ids)
                for a in range(0, n, 4096):
                    b = min(n, a + 4096)
                    starts = f.starts[a : b + 1].astype(np.int64)
                    ids = f.slice(int(starts[0]), int(starts[-1])).astype("<u4").tobytes()
                    cuts = (4 * (starts - starts[0])).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(f.doc_ids[a:b], pa.int64(), mask=f.nulls[a:b] > 0),
                            pa.array([path.rsplit("/", 1)[-1]] * (b - a), pa.string()),
                            pa.array(starts[:-1], pa.int64()),
                            pa.array(np.diff(starts), pa.int64()),
                            pa.array([ids[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                        ],
                        ["key", "file", "local_start", "n_tokens", "ids"],
                    )

    d = content.mapInArrow(run, "key bigint, file string, local_start bigint, n_tokens bigint, ids binary")
    return d.withColumnRenamed("key", key)


def document_starts(read: DataFrame, manifest: DataFrame) -> DataFrame:
    """``read`` with ``start``: the ids of all documents before it. Drop ``ids`` first: this joins by file."""
    return read.join(manifest.select("file", "base"), "file").withColumn("start", F.col("base") + F.col("local_start"))
