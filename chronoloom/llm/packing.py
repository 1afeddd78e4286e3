"""Bounded-space online packing of token sequences.

Each task keeps a fixed number of open windows. What is left of a document after its full
windows goes into the open window that it fits best. When none fits and no more may be
opened, the fullest is emitted: the head of the document fills its gap, unless that would
leave a tiny piece, and the rest goes on. Windows still open at the end of a task are
leftovers; those of a few neighbouring tasks are merged. The last, partly filled sequence
of a merge is cut into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chronoloom.llm.common import in_blocks, materialize, text_or_empty
from chronoloom.llm.tokens import encoder
from chronoloom.session import ship

PIECE = "start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, ids_crc32 bigint"
#: Bits of a sequence id below the task's or merge's number.
_TASK_BITS = 36


class Packer:
    """Places pieces (key, start, ids, doc_tokens); ``emit(window)`` gets each closed window."""

    def __init__(self, size: int, windows: int, min_cut: int, emit):
        self.size, self.windows, self.min_cut, self.emit = size, windows, min_cut, emit
        self.free: list[tuple[int, int]] = []  # (room, slot), least room first
        self.open: dict[int, list] = {}
        self.slot = 0

    def add(self, key, start: int, ids: bytes, total: int) -> None:
        n = len(ids) // 4
        while n >= self.size:
            self.emit([(key, start, ids[: 4 * self.size], total)])
            start, ids, n = start + self.size, ids[4 * self.size :], n - self.size
        while n:
            at = bisect_left(self.free, (n, -1))
            if at < len(self.free):
                room, slot = self.free.pop(at)
                self._put(slot, room, (key, start, ids, total), n)
                return
            if len(self.free) < self.windows:
                self.slot += 1
                self.open[self.slot] = []
                self._put(self.slot, self.size, (key, start, ids, total), n)
                return
            room, slot = self.free.pop(0)
            if room >= self.min_cut and n - room >= self.min_cut:
                self.open[slot].append((key, start, ids[: 4 * room], total))
                start, ids, n = start + room, ids[4 * room :], n - room
            self.emit(self.open.pop(slot))

    def _put(self, slot: int, room: int, piece: tuple, n: int) -> None:
        self.open[slot].append(piece)
        if room == n:
            self.emit(self.open.pop(slot))
        else:
            insort(self.free, (room - n, slot))

    def leftovers(self) -> list[list]:
        return [self.open[slot] for _, slot in self.free]


def merge(windows: list[list], size: int) -> list[list]:
    """Sequences of at most ``size`` from part-filled windows: all full, but the last few, whose lengths are powers of two.

    Large windows take the best-fitting smaller ones whole; what still has room is joined
    end to end and cut at the full length.
    """
    length = lambda w: sum(len(p[2]) // 4 for p in w)
    bins: list[tuple[int, int]] = []
    held: list[list] = []
    for n, i in sorted(((length(w), i) for i, w in enumerate(windows)), reverse=True):
        at = bisect_left(bins, (n, -1))
        if at < len(bins):
            room, k = bins.pop(at)
            held[k] += windows[i]
            insort(bins, (room - n, k))
        else:
            held.append(list(windows[i]))
            insort(bins, (size - n, len(held) - 1))
    out = [held[k] for room, k in bins if room == 0]
    loose = [p for room, k in reversed(bins) if room for p in held[k]]
    left = sum(len(p[2]) // 4 for p in loose)
    bounds = []
    while left:
        n = size if left >= size else 1 << (left.bit_length() - 1)
        bounds.append(n)
        left -= n
    pieces = iter(loose)
    piece = None
    for n in bounds:
        row = []
        while n:
            if piece is None:
                piece = next(pieces)
            key, start, ids, total = piece
            take = min(n, len(ids) // 4)
            row.append((key, start, ids[: 4 * take], total))
            piece = (key, start + take, ids[4 * take :], total) if 4 * take < len(ids) else None
            n -= take
        out.append(row)
    return out


def _rows(window: list, sequence_id: int):
    """The columns of PIECE, after the key, for each piece of a window."""
    offset = 0
    for key, start, ids, total in window:
        n = len(ids) // 4
        yield key, start, n, total, sequence_id, offset, ids, zlib.crc32(ids)
        offset += n


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    size: int = 2048,
    windows: int = 32,
    min_cut: int = 16,
    fan_in: int = 4,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pack every whole text, followed by ``end_id``, into sequences of at most ``size`` ids.

    One row a piece: the key, start (ids of its document before it), length, doc_tokens,
    sequence_id, offset (in the sequence, gapless from 0), ids (binary, little-endian
    unsigned 32-bit) and their crc32. Null and empty texts give the end id alone. Rows that
    repeat a key are packed each on its own. An empty table gives no rows. A task holds
    ``windows`` part-filled windows, a merge those of ``fan_in`` tasks.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    made = StructType.fromDDL(PIECE)
    schema = StructType([*d.schema.fields[:1], *made.fields])
    first = StructType([*schema.fields, *StructType.fromDDL("task int, loose boolean").fields])
    end = end_id.to_bytes(4, "little")
    arrow, arrow_first = to_arrow_schema(schema), to_arrow_schema(first)

    def run(batches):
        task = TaskContext.get().partitionId()
        texts = encoder(tokenizer)
        state = {"n": 0}
        rows: list[tuple] = []

        def emit(window, loose=False):
            rows.extend((*r, task, loose) for r in _rows(window, task << _TASK_BITS | state["n"]))
            state["n"] += 1

        def flush():
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(arrow_first)
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow_first, strict=True)], schema=arrow_first)
            rows.clear()
            return out

        packer = Packer(size, windows, min_cut, emit)
        for batch in batches:
            for block in in_blocks(batch, pa.compute.binary_length(batch.column(1)).to_pylist(), 4 << 20):
                for k, ids in zip(block.column(0).to_pylist(), texts.encode_all(block.column(1).to_pylist()), strict=True):
                    ids += end
                    packer.add(k, 0, ids, len(ids) // 4)
                yield flush()
        texts.forget()  # the worker goes on to other tasks and operators
        for window in packer.leftovers():
            emit(window, True)
        yield flush()

    placed = materialize(d.mapInArrow(run, first), "pieces")

    def close(part: pa.Table) -> pa.Table:
        group = (part.column("task")[0].as_py() // fan_in) if part.num_rows else 0
        open_windows: dict[int, list] = {}
        for r in sorted(part.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"])):
            open_windows.setdefault(r["sequence_id"], []).append((r["key"], r["start"], r["ids"], r["doc_tokens"]))
        rows = [
            r
            for i, window in enumerate(merge(list(open_windows.values()), size))
            for r in _rows(window, 1 << 62 | group << _TASK_BITS | i)
        ]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(arrow)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    names = [f.name for f in schema.fields]
    done = placed.where("not loose").select(*names)
    closed = placed.where("loose").groupBy(F.floor(F.col("task") / fan_in)).applyInArrow(close, schema)
    return done.unionByName(closed).withColumnRenamed("key", key)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of the documents."""
    from public_tokenizers import path

    return pack(docs.select("doc_id", "text"), path("byte_bpe_50k.json"), 1).drop("ids")
