"""Removal of near-duplicate lines by an exact set-similarity self-join.

A line is the set of its words. A later line goes if some earlier line of the corpus has
Jaccard similarity of at least 4/5 with it, judged on the input. Lines with equal sets are
folded first, with a partial aggregate. Words are ordered from rare to frequent by a count
sketch of fixed size over all texts; two similar sets then share a word among their first
few (prefix filter), their sizes lie within 4/5 of each other (length filter), and the
places of the shared word leave room for the overlap (positional filter). A parity
signature of each set bounds the size of the symmetric difference from below and prunes
most of the rest. A word's group is compared in the memory of one task. Of the earlier lines
that pass, the likeliest is verified on the words themselves; the next ones are looked at
only where it fails, and whole groups are read again only for lines with more than a few
candidates under a word. A word shared by very many prefixes is replaced by pairs, triples
and quadruples of a set's first shared words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import free, in_blocks, map_texts, materialize, text_or_empty
from chronoloom.session import ship

#: Counters of the sketch, and counters in one row of it.
SKETCH, SKETCH_ROW = 1 << 22, 1 << 16
#: Sets sharing a key that one task compares in pairs; more go to longer keys.
MOST_PAIRED = 1 << 16
LEVELS = 4
#: Lines with their words on either side of a cell.
MOST_HELD = 1000
#: Earlier lines that a line lists under a key; where more pass, the group may be read again.
MOST_LISTED = 8
#: Groups of at most this many rows are compared side by side, larger ones a block of rows at a time.
SMALL_GROUP = 32
#: Candidates of a row beyond which the nearest eighth of as many may do.
CROWD = 512
#: Rows that a task packs at once for the shuffle.
PACKED = 1 << 18
#: Words of a line above which its signature has 128 bits, and 256, in place of 64.
WIDER = (40, 160)
_SIGNS = ["sign", "s1", "s2", "s3"]


def words(line: bytes) -> list[bytes]:
    """Words of a line: A-Z lowered, split at ASCII white space."""
    return line.lower().split()


_BASE = 0x9E3779B97F4A7C15
_SPACE = np.array([c in b" \t\n\x0b\x0c\r" for c in range(256)])
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64, to at least ``n``; kept by the worker."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(n - 1, 1 << 19).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first byte) of every word of ``data``, whose letters are lowered: no string is made.

    A word's hash is a polynomial in its bytes, read off a running sum over all bytes, then mixed.
    """
    s = np.frombuffer(data, np.uint8)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _power_table(len(s) + 1)
    gap = _SPACE[s]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    first, end = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((s.astype(np.uint64) + np.uint64(1)) * up[: len(s)], dtype=np.uint64)])
        h = (sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h, first


def word_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Count sketch of all words of all texts: one counter a hash value, a bounded array for the driver.

    Counters stop at 2 ** 31. Tasks send theirs as packed rows, summed in two steps.
    """
    d = docs.select(text_or_empty(text).cast("binary").alias("text"))
    ship(docs.sparkSession)

    def count(batches):
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for block in in_blocks(batch, pc.binary_length(batch.column(0)).to_pylist(), 1 << 20):
                h, _ = word_hashes(b"\n".join(block.column(0).to_pylist()).lower())
                np.add.at(total, (h % np.uint64(SKETCH)).astype(np.int64), 1)
        rows = range(SKETCH // SKETCH_ROW)
        packed = [pa.compress(total[r * SKETCH_ROW : (r + 1) * SKETCH_ROW].astype(np.uint32).tobytes(), "zstd", asbytes=True) for r in rows]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task // 32] * len(packed), pa.int32()), pa.array(rows, pa.int32()), pa.array(packed, pa.binary())], ["wave", "row", "counts"])

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_ROW, np.int64)
        for x in part.column("counts"):
            total += np.frombuffer(pa.decompress(x.as_py(), SKETCH_ROW * 4, "zstd", asbytes=True), np.uint32)
        packed = [pa.compress(np.minimum(total, 1 << 31).astype(np.uint32).tobytes(), "zstd", asbytes=True)] if part.num_rows else []
        return pa.table([part.column("wave")[:1], part.column("row")[:1], pa.chunked_array([pa.array(packed, pa.binary())])], ["wave", "row", "counts"])

    kind = "wave int, row int, counts binary"
    waves = d.mapInArrow(count, kind).groupBy("wave", "row").applyInArrow(add, kind)
    total = np.zeros(SKETCH, np.uint32)
    for r in waves.withColumn("wave", F.lit(0)).groupBy("row").applyInArrow(add, kind).collect():
        total[r["row"] * SKETCH_ROW : (r["row"] + 1) * SKETCH_ROW] = np.frombuffer(pa.decompress(bytes(r["counts"]), SKETCH_ROW * 4, "zstd", asbytes=True), np.uint32)
    return total


def rarity_classes(counts: np.ndarray) -> np.ndarray:
    """0 for a counter at 1: such a word is in one line alone. Above, eight classes an octave."""
    return np.where(counts <= 1, 0, np.minimum(1 + 8 * np.log2(np.maximum(counts, 1)), 255)).astype(np.uint8)


def least_overlap(n: int) -> int:
    """The least overlap of a set of n with any set that is similar to it: ceil(4n / 5)."""
    return (4 * n + 4) // 5


def line_sets(docs: DataFrame, classes: np.ndarray, key: str, text: str) -> DataFrame:
    """One row for each line with a word: set_key, doc, line, n, sign, s1, s2, s3, prefix.

    A word's key sorts rare words first: rarity class over 55 bits of its hash. ``prefix``
    holds the first keys, as many as the prefix filter and the longer keys need. ``sign`` has
    the parity of 64 classes of words; lines of over ``WIDER`` words have 128 or 256 classes,
    whose further bits are in s1 to s3 (0 for shorter lines).
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    kind = "set_key binary, doc bigint, line int, n int, sign bigint, s1 bigint, s2 bigint, s3 bigint, prefix array<bigint>"
    names = ["set_key", "doc", "line", "n", *_SIGNS, "prefix"]
    d = docs.select(F.col(key).cast("long").alias("doc"), text_or_empty(text).cast("binary").alias("text"))

    def run(batches):
        rarity = shared.value
        for batch in batches:
            for block in in_blocks(batch, pc.binary_length(batch.column(1)).to_pylist(), 1 << 20):
                texts = block.column(1).to_pylist()
                data = b"\n".join(texts).lower()
                h, first = word_hashes(data)
                breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
                line = np.searchsorted(breaks, first)  # of the block
                k = (rarity[(h % np.uint64(SKETCH)).astype(np.int64)].astype(np.int64) << 55) | (h >> np.uint64(9)).astype(np.int64)
                order = np.argsort(k)
                order = order[np.argsort(line[order], kind="stable")]
                k, line = k[order], line[order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (line[1:] != line[:-1])
                k, line = k[new], line[new]
                held, begin, n = np.unique(line, return_index=True, return_counts=True)
                row = np.repeat(np.arange(len(held)), n)
                parity = np.bincount(row * 256 + (k & 255), minlength=256 * len(held)).reshape(len(held), 256) & 1
                w = np.packbits(parity.astype(np.uint8), axis=1, bitorder="little").view(np.int64)
                wide, widest = n > WIDER[0], n > WIDER[1]
                signs = [w[:, 0] ^ w[:, 1] ^ w[:, 2] ^ w[:, 3], (w[:, 1] ^ w[:, 3]) * wide, w[:, 2] * widest, w[:, 3] * widest]
                raw, ends = k.tobytes(), begin + n
                digest = xxhash.xxh128_digest
                keys = [digest(raw[8 * a : 8 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                size = np.where(n > 3, np.minimum(n - (4 * n + 4) // 5 + LEVELS, n), 0)
                within = np.arange(len(k)) - np.repeat(begin, n)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(k[within < np.repeat(size, n)]))
                lines_before = np.cumsum([0] + [t.count(b"\n") + 1 for t in texts])
                doc = np.searchsorted(lines_before, held, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.binary()), block.column(0).take(pa.array(doc)), pa.array((held - lines_before[doc]).astype(np.int32)),
                        pa.array(n.astype(np.int32)), *map(pa.array, signs), prefix,
                    ],
                    names,
                )

    ship(docs.sparkSession)
    return d.mapInArrow(run, kind)


#: A row of a key's group: where the line is, its size, the key's place in it and its signature.
_ROW = ["key", "doc", "line", "n", "i", *_SIGNS]
_LIKELY = "doc bigint, line int, others boolean, far int, a_doc bigint, a_line int"
_TYPES = {"key": np.int64, "doc": np.int64, "line": np.int32, "n": np.int32, "i": np.int32} | dict.fromkeys(_SIGNS, np.int64)


def _pack(columns: dict[str, np.ndarray]) -> bytes:
    """Rows in order of key as bytes: differences of keys, then the other columns, each with its bytes side by side."""
    parts = [np.diff(x, prepend=np.int64(0)) if c == "key" else x for c, x in columns.items()]
    raw = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in parts)
    return len(parts[0]).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    """The columns that ``_pack`` was given."""
    rows, at, out = int.from_bytes(data[:4], "little"), 0, {}
    raw = pa.decompress(data[4:], rows * sum(np.dtype(t).itemsize for t in _TYPES.values()), "zstd", asbytes=True)
    for c, t in _TYPES.items():
        width = np.dtype(t).itemsize
        x = np.frombuffer(raw, np.uint8, rows * width, at).reshape(width, rows)
        out[c] = np.ascontiguousarray(x.T).view(t).ravel()
        at += rows * width
    out["key"] = np.cumsum(out["key"])
    return out


def _grouped(rows: DataFrame, settle, kind: str) -> DataFrame:
    """``settle(table)`` of whole groups of equal key in order of (key, doc, line); the rows are shuffled in packed columns."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches):
        def flush(held):
            t = pa.Table.from_batches(held)
            columns = {c: t.column(c).to_numpy() for c in _ROW}
            with np.errstate(over="ignore"):
                part = ((columns["key"].view(np.uint64) * np.uint64(_BASE)) >> np.uint64(33)) % np.uint64(parts)
            order = np.lexsort((columns["key"], part))
            columns, part = {c: x[order] for c, x in columns.items()}, part[order]
            edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            blobs = [_pack({c: x[a:b] for c, x in columns.items()}) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "rows"])

        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= PACKED:
                yield flush(held)
                held, count = [], 0
        if count:
            yield flush(held)

    def run(batches):
        found = [_unpack(x) for batch in batches for x in batch.column(1).to_pylist()]
        if not found:
            return
        columns = {c: np.concatenate([x[c] for x in found]) for c in _ROW}
        del found
        order = np.lexsort((columns["line"], columns["doc"], columns["key"]))
        columns = {c: x[order] for c, x in columns.items()}
        first = np.concatenate([np.flatnonzero(np.diff(columns["key"], prepend=columns["key"][0] - 1)), [len(order)]])
        begin = 0
        while begin < len(order):
            end = int(first[min(np.searchsorted(first, begin + PACKED // 4), len(first) - 1)])
            yield settle(pa.table({c: x[begin:end] for c, x in columns.items()}))
            begin = end

    packed = rows.select(*_ROW).mapInArrow(pack, "part int, rows binary")
    return packed.repartitionById(parts, "part").mapInArrow(run, kind)


def _passing(n, i, signs, a, b, level) -> tuple[np.ndarray, np.ndarray]:
    """(whether the rows a and b pass the length, positional and signature filters, differing bits of their signatures)."""
    total = n[a] + n[b]
    bits = lambda x: np.bitwise_count(x.view(np.uint64)).astype(np.int64)
    d, d1, d2, d3 = (x[a] ^ x[b] for x in signs)
    least = np.minimum(n[a], n[b])
    far = np.where(least > WIDER[1], bits(d3) + bits(d2) + bits(d1 ^ d3) + bits(d ^ d1 ^ d2), np.where(least > WIDER[0], bits(d1) + bits(d ^ d1), bits(d)))
    ok = 5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])
    ok &= 9 * (level + np.minimum(n[a] - i[a], n[b] - i[b]) - 1) >= 4 * total
    return ok & (9 * far <= total), far


def _maybe(n, sign, before: slice, b: int) -> np.ndarray:
    """Indices of ``before`` that may pass with row b: a test of 64 bits, or of the lengths where these say nothing."""
    if n[b] <= 128:  # n[a] is at most 5 / 4 of n[b], so the bound is at most n[b] / 4
        ok = np.bitwise_count(sign[before] ^ sign[b]) <= n[b] // 4
    else:
        ok = (5 * n[before] >= 4 * n[b]) & (4 * n[before] <= 5 * n[b])
    return before.start + np.flatnonzero(ok)


def _nearest(t: pa.Table, level: int) -> pa.RecordBatch:
    """Pairs (b, a) of every row b with earlier rows a of its key that pass: the ``MOST_LISTED`` nearest by signature, and whether there are others; rows are in order of (key, doc, line)."""
    key, doc, line, n, i, *signs = (t.column(c).to_numpy() for c in _ROW)
    sign, half = signs[0].view(np.uint64), signs[1].view(np.uint64)
    other = sign ^ half
    most = np.minimum(n // 4, 255).astype(np.uint8)  # bits that may differ: n[a] is at most 5 / 4 of n[b]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    size = np.diff(edge)
    end = np.repeat(edge[1:], size)
    out = [[np.zeros(0, np.int64)] * 3]
    more = np.zeros(len(key), bool)

    def passing(a, b):
        wide = np.bitwise_count(half[a] ^ half[b]) + np.bitwise_count(other[a] ^ other[b])
        maybe = (n[b] <= 50) | (wide <= most[b])  # beyond 50, n[a] is over 40 and both have 128 bits
        a, b = a[maybe], b[maybe]
        ok, far = _passing(n, i, signs, a, b, level)
        ok &= (doc[a] != doc[b]) | (line[a] != line[b])
        return a[ok], b[ok], far[ok]

    live = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL_GROUP), size))
    for k in range(1, SMALL_GROUP):
        live = live[live + k < end[live]]
        if not len(live):
            break
        later = live + k
        maybe = np.bitwise_count(sign[live] ^ sign[later]) <= most[later]
        out.append(passing(live[maybe], later[maybe]))
    low, high = (4 * n + 4) // 5, 5 * n // 4
    waiting, count = [], 0

    def flush():
        a, b = (np.concatenate(x) for x in zip(*waiting, strict=True))
        out.append(passing(a, b))
        waiting.clear()

    for g in np.flatnonzero(size > SMALL_GROUP).tolist():
        first, last = int(edge[g]), int(edge[g + 1])
        b0 = first
        while b0 < last:
            b1 = min(last, b0 + max(1, min(64, (1 << 18) // (b0 - first + 64))))
            maybe = np.bitwise_count(sign[None, first:b1] ^ sign[b0:b1, None]) <= most[b0:b1, None]
            long = np.flatnonzero(n[b0:b1] > 80)  # 64 bits say little
            maybe[long] &= (n[None, first:b1] >= low[b0:b1][long, None]) & (n[None, first:b1] <= high[b0:b1][long, None])
            maybe[:, b0 - first :] &= np.tri(b1 - b0, k=-1, dtype=bool)
            row, a = np.nonzero(maybe)
            a, row = a + first, row + b0
            crowd = np.bincount(row - b0, minlength=b1 - b0) > CROWD
            for b in (b0 + np.flatnonzero(crowd)).tolist():  # near copies: the likeliest will do if they pass
                every = a[row == b]
                few = every[np.argpartition(np.bitwise_count(sign[every] ^ sign[b]), CROWD // 8)[: CROWD // 8]]
                found = passing(few, np.full(len(few), b))
                if len(found[0]) <= MOST_LISTED:
                    found = passing(every, np.full(len(every), b))
                near = np.lexsort((found[0], found[2]))[:MOST_LISTED]
                more[b] = len(found[0]) > MOST_LISTED
                out.append([x[near] for x in found])
            if crowd.any():
                a, row = a[~crowd[row - b0]], row[~crowd[row - b0]]
            waiting.append((a, row))
            count += len(a)
            if count > 1 << 18:
                flush()
                count = 0
            b0 = b1
    if waiting:
        flush()
    a, b, far = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((a, far, b))
    a, b, far = a[order], b[order], far[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1]) if len(b) else np.zeros(0, np.int64)
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
    more[b[place >= MOST_LISTED]] = True
    a, b, far = (x[place < MOST_LISTED] for x in (a, b, far))
    columns = [doc[b], line[b], more[b], far.astype(np.int32), doc[a], line[a]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "line", "others", "far", "a_doc", "a_line"])


def _by_group(dealt: DataFrame, by: list[str], settle, kind: str) -> DataFrame:
    """``settle(table)`` of whole groups of equal ``by``, in whose order the rows come; a batch and one group are held at most."""

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            if not t.num_rows:
                continue
            last = np.zeros(t.num_rows, bool)
            for c in by:
                x = t.column(c).to_numpy()
                last |= x != x[-1]
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield settle(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None:
            yield settle(held)

    return dealt.mapInArrow(run, kind)


def _far() -> Column:
    """Differing bits of the signatures of joined rows a and b."""
    d, d1, d2, d3 = (F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")) for c in _SIGNS)
    least = F.least("a.n", "b.n")
    wide = F.bit_count(d1) + F.bit_count(d.bitwiseXOR(d1))
    widest = F.bit_count(d3) + F.bit_count(d2) + F.bit_count(d1.bitwiseXOR(d3)) + F.bit_count(d.bitwiseXOR(d1).bitwiseXOR(d2))
    return F.when(least > WIDER[1], widest).when(least > WIDER[0], wide).otherwise(F.bit_count(d))


def _similar_enough(level: int) -> Column:
    """The same filters for joined rows a and b, a the earlier."""
    total = F.col("a.n") + F.col("b.n")
    return (
        (5 * F.least("a.n", "b.n") >= 4 * F.greatest("a.n", "b.n"))
        & (9 * (level + F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) - 1) >= 4 * total)
        & (9 * _far() <= total)
        & (F.struct("a.doc", "a.line") < F.struct("b.doc", "b.line"))
    )


def _keyed(sets: DataFrame, most_paired: int, levels: int, made: list) -> tuple[list[tuple[int, DataFrame]], DataFrame]:
    """([(level, rows of keys that at most ``most_paired`` rows share)], rows whose key is shared by more at the last level).

    Rows of a key that more share go to longer keys: the key with a later word of the prefix.
    A word in so many sets has a counter of at least as much, so level 1 counts such words alone.
    """
    rows = sets.where("n > 3").select("doc", "line", "n", *_SIGNS, "prefix", F.expr("posexplode(slice(prefix, 1, n - ceil(4 * n / 5) + 1)) as (i, key)"))
    rows = rows.where("shiftright(key, 55) <> 0")  # class 0: no other line has the word
    frequent = rows.where(F.shiftright("key", 55) >= int(rarity_classes(np.array([most_paired + 1]))[0]))
    out = []
    for level in range(1, levels + 1):
        shared = frequent.groupBy("key").agg(F.count("*").alias("shared")).where(F.col("shared") > most_paired).select("key")
        hot = materialize(shared, "hot-keys")
        made.append(hot)
        if hot.isEmpty():
            return [*out, (level, rows)], None
        out.append((level, rows.join(hot, "key", "left_anti")))
        many = rows.join(hot, "key")
        if level == levels:
            crowd = materialize(many.select(*_ROW), "crowds")
            made.append(crowd)
            return out, crowd
        later = f"explode(sequence(i + 1, greatest(i + 1, cast(n - ceil(4 * n / 5) + {level} as int)))) as j"
        rows = many.select("doc", "line", "n", *_SIGNS, "prefix", F.expr(later), F.col("key").alias("old")).where("j < size(prefix)")
        rows = rows.select("doc", "line", "n", *_SIGNS, "prefix", F.col("j").alias("i"), F.xxhash64("old", F.expr("get(prefix, j)")).alias("key"))
        frequent = rows = materialize(rows, "longer-keys")
        made.append(rows)


def _likely(keyed, crowd, levels: int) -> DataFrame:
    """(doc, line, others, a_doc, a_line, listed): for every line with an earlier one that passes the filters, the likeliest of these and the next ones. One row a line.

    ``others``: more than the listed ones pass.
    """
    found = []
    for level, rows in keyed:
        found.append(_grouped(rows, lambda t, level=level: _nearest(t, level), _LIKELY))
    if crowd is not None:  # sixteen early members of each stand for it
        place = F.struct("doc", "line", "n", *_SIGNS, "i")
        stars = crowd.groupBy("key", F.pmod(F.xxhash64("doc", "line"), F.lit(16)).alias("salt")).agg(F.min(place).alias("p")).select("key", "p.*")
        near = stars.alias("a").join(crowd.alias("b"), "key").where(_similar_enough(levels))
        found.append(near.select("b.doc", "b.line", F.lit(True).alias("others"), _far().alias("far"), F.col("a.doc").alias("a_doc"), F.col("a.line").alias("a_line")))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    one = every.groupBy("doc", "line").agg(
        F.max("others").alias("others"), F.min(F.struct("far", "a_doc", "a_line")).alias("best"),
        F.collect_set(F.struct("a_doc", "a_line")).alias("listed"),
    )
    return one.select("doc", "line", "others", "best.a_doc", "best.a_line", "listed")


def _line_words(docs: DataFrame, wanted: DataFrame, key: str, text: str, made: list) -> DataFrame:
    """(doc, line, words): the distinct words of the wanted lines (doc, line), between line breaks."""
    lists = materialize(wanted.distinct().groupBy("doc").agg(F.collect_list("line").alias("lines")), "wanted")
    made.append(lists)
    d = docs.select(F.col(key).cast("long").alias("doc"), text_or_empty(text).alias("text")).join(_small(lists), "doc")

    def run(batches):
        for batch in batches:
            for block in in_blocks(batch, pc.binary_length(batch.column(1)).to_pylist(), 1 << 20):
                out = []
                for doc, t, lines in zip(*(c.to_pylist() for c in block.columns), strict=True):
                    split = t.encode().split(b"\n")
                    out += [(doc, i, b"\n".join(sorted(set(words(split[i]))))) for i in sorted(set(lines)) if i < len(split)]
                a, b, c = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["doc", "line", "words"])

    return d.select("doc", "text", "lines").mapInArrow(run, "doc bigint, line int, words binary")


def _similar(a: bytes, b: bytes) -> bool:
    """Whether two lines' words, as ``_line_words`` gives them, have Jaccard similarity 4/5 or more."""
    x, y = set(a.split(b"\n")), set(b.split(b"\n"))
    return 9 * len(x & y) >= 4 * (len(x) + len(y))


def _verified(likely: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, line) of those whose earlier line (a_doc, a_line) is similar, by the words themselves."""
    made: list[DataFrame] = []
    wanted = likely.select("doc", "line").unionByName(likely.select(F.col("a_doc").alias("doc"), F.col("a_line").alias("line")))
    found = materialize(_line_words(docs, wanted, key, text, made), "words")
    a = found.select(F.col("doc").alias("a_doc"), F.col("line").alias("a_line"), F.col("words").alias("a_words"))
    both = likely.join(a, ["a_doc", "a_line"]).join(found, ["doc", "line"]).select("doc", "line", "a_words", "words")

    def run(batches):
        for batch in batches:
            ok = [_similar(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["doc", "line"])

    good = materialize(both.mapInArrow(run, "doc bigint, line int").distinct(), "settled")
    free(found, *made)
    return good


def _small(df: DataFrame, most: int = 1 << 19) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` rows of two or three numbers; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _rest(keyed, crowd, levels: int, left: DataFrame, docs: DataFrame, key: str, text: str, most_held: int, made: list) -> DataFrame:
    """(doc, line) of the lines ``left`` that are similar to any earlier line: each is compared with all that share a key with it.

    A key's group is dealt to cells of ``most_held`` rows on either side, so no task holds a
    whole crowd; a line found similar in a cell gives one row, whatever the number of its partners.
    """
    marked = _small(left.select("doc", "line", F.lit(True).alias("open")))
    names = [*_ROW, "level", "open"]
    kind = "key bigint, doc bigint, line int, n int, i int, sign bigint, s1 bigint, s2 bigint, s3 bigint, level int, open boolean"

    def involved(t):
        """Lines that are open, and earlier ones that pass the filters with one of these."""
        k, doc, line, n, i, *signs = (t.column(c).to_numpy() for c in _ROW)
        level, opened = (t.column(c).to_numpy(zero_copy_only=False) for c in ("level", "open"))
        first = np.searchsorted(k, k)
        keep = np.zeros(len(k), bool)
        sign = signs[0].view(np.uint64)
        for b in np.flatnonzero(opened).tolist():
            before = _maybe(n, sign, slice(int(first[b]), b), b)
            ok, _ = _passing(n, i, signs, before, np.full(len(before), b), level[b])
            ok &= (doc[before] != doc[b]) | (line[before] != line[b])
            keep[before[ok]] = True
            keep[b] |= bool(ok.any())
        return t.filter(pa.array(keep)).select(names).combine_chunks().to_batches()[0] if keep.any() else pa.RecordBatch.from_pylist([], t.select(names).schema)

    parts = []
    for level, rows, small in [*((level, rows, True) for level, rows in keyed), *([(levels, crowd, False)] if crowd is not None else [])]:
        rows = rows.select(*_ROW)
        wanted = materialize(rows.join(marked, ["doc", "line"], "left_semi").select("key").distinct(), "open-keys")
        made.append(wanted)
        group = rows.join(_small(wanted), "key", "left_semi").join(marked, ["doc", "line"], "left")
        group = group.select(*_ROW, F.lit(level).alias("level"), F.coalesce("open", F.lit(False)).alias("open"))
        if small:
            group = _by_group(group.repartition("key").sortWithinPartitions("key", "doc", "line"), ["key"], involved, kind)
        parts.append(group)
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    every = materialize(every, "open-groups")
    made.append(every)
    size = every.groupBy("key").agg(F.ceil(F.count("*") / most_held).cast("int").alias("p"))
    found = materialize(_line_words(docs, every.select("doc", "line"), key, text, made), "words")
    made.append(found)
    mine = F.pmod(F.xxhash64("doc", "line"), F.col("p")).cast("int")
    cells = F.expr("explode(array_distinct(concat(transform(sequence(0, p - 1), y -> mine * p + y), if(open, transform(sequence(0, p - 1), x -> x * p + mine), array())))) as cell")
    dealt = every.join(size, "key").withColumn("mine", mine).select("*", cells)
    dealt = dealt.select(*_ROW, "level", "cell", (F.floor(F.col("cell") / F.col("p")) == F.col("mine")).alias("is_a"), (F.col("open") & (F.col("cell") % F.col("p") == F.col("mine"))).alias("is_b"))
    dealt = dealt.join(found, ["doc", "line"]).repartition("key", "cell").sortWithinPartitions("key", "cell", "doc", "line")

    def settle(t):
        k, doc, line, n, i, *signs = (t.column(c).to_numpy() for c in _ROW)
        level, cell, is_a, is_b = (t.column(c).to_numpy(zero_copy_only=False) for c in ("level", "cell", "is_a", "is_b"))
        said = t.column("words").to_pylist()
        good = []
        edge = np.concatenate([[0], np.flatnonzero((np.diff(k) != 0) | (np.diff(cell) != 0)) + 1, [len(k)]])
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            a = np.arange(lo, hi)[is_a[lo:hi]]
            for b in (np.arange(lo, hi)[is_b[lo:hi]]).tolist():
                before = a[: np.searchsorted(a, b)]
                before = before[(doc[before] != doc[b]) | (line[before] != line[b])]
                ok, far = _passing(n, i, signs, before, np.full(len(before), b), level[b])
                before = before[ok][np.argsort(far[ok], kind="stable")]
                if any(_similar(said[x], said[b]) for x in before.tolist()):
                    good.append(b)
        return pa.RecordBatch.from_arrays([pa.array(doc[good], pa.int64()), pa.array(line[good], pa.int32())], ["doc", "line"])

    return _by_group(dealt, ["key", "cell"], settle, "doc bigint, line int").distinct()


def later_matches(sets: DataFrame, docs: DataFrame, key: str, text: str, most_paired: int = MOST_PAIRED, levels: int = LEVELS) -> DataFrame:
    """(doc, line) of the sets that are similar to an earlier one.

    First the likeliest earlier line of each is verified on the words, then, for lines that it
    doesn't settle, the next ones. Lines that are still open and have more candidates are then
    compared with all of these.
    """
    made: list[DataFrame] = []
    keyed, crowd = _keyed(sets, most_paired, levels, made)
    likely = materialize(_likely(keyed, crowd, levels), "likely")
    gone = _verified(likely, docs, key, text)
    listed = likely.where("size(listed) > 1").join(gone, ["doc", "line"], "left_anti")
    listed = listed.select("doc", "line", F.struct("a_doc", "a_line").alias("best"), F.explode("listed").alias("next"))
    listed = materialize(listed.where("next <> best").select("doc", "line", "next.*"), "next")
    if not listed.isEmpty():
        gone = _with(gone, _verified(listed, docs, key, text))
    left = likely.where("others").select("doc", "line")
    left = left if crowd is None else left.unionByName(crowd.select("doc", "line")).distinct()
    left = materialize(left.join(gone, ["doc", "line"], "left_anti"), "left")
    if not left.isEmpty():
        gone = _with(gone, materialize(_rest(keyed, crowd, levels, left, docs, key, text, min(most_paired, MOST_HELD), made), "settled"))
    free(likely, listed, left, *made)
    return gone


def _with(one: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of two written tables in one; the two go."""
    both = materialize(one.unionByName(other), "settled")
    free(one, other)
    return both


def kept_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, lines): of every document, the numbers of lines that stay, among those with a word."""
    counts = word_counts(docs, text)
    rows = line_sets(docs, rarity_classes(counts), key, text)
    first = F.min(F.struct("doc", "line", "n", *_SIGNS, "prefix")).alias("f")
    sets = materialize(rows.groupBy("set_key").agg(first).select("f.*"), "sets")
    gone = later_matches(sets.where("doc is not null"), docs, key, text)
    stay = sets.select("doc", "line").join(gone, ["doc", "line"], "left_anti")
    stay = materialize(stay.groupBy("doc").agg(F.collect_list("line").alias("lines")), "stay")
    free(sets, gone)
    return stay


MADE = "new_text string, n_lines bigint, n_removed bigint"


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add new_text (later near-duplicate lines left out), n_lines (lines with a word) and n_removed.

    Lines without a word stay where they are. Null and empty texts give an empty new_text.
    Earlier means a smaller (key, line number). Rows that repeat a key are one document:
    equal lines at the same place don't remove each other. Lines of rows with a null key are
    folded with their equals, coming first, and take no part in the similarity join.
    """
    carry = docs.columns if carry is None else carry
    stay = kept_lines(docs, key, text).withColumnRenamed("lines", "__lines")
    wide = docs.withColumn("__text", text_or_empty(text)).withColumn("__doc", F.col(key).cast("long"))
    d = wide.join(stay.withColumnRenamed("doc", "__key"), F.col("__doc").eqNullSafe(F.col("__key")), "left")
    kept = [c for c in carry if c not in ("new_text", "n_lines", "n_removed")]
    packed = d.select(*kept, F.to_json(F.struct(F.coalesce("__lines", F.array().cast("array<int>")).alias("l"))).alias("__l"), F.col("__text"))
    packed = packed.withColumn("__both", F.concat(F.col("__l"), F.lit("\n"), F.col("__text")))

    def factory():
        import json

        def run(texts):
            out: dict[str, list] = {"new_text": [], "n_lines": [], "n_removed": []}
            for t in texts:
                head, _, body = t.partition(b"\n")
                stays = set(json.loads(head)["l"])
                lines = body.split(b"\n")
                full = [bool(x.split()) for x in lines]
                left = [x for i, x in enumerate(lines) if not full[i] or i in stays]
                out["new_text"].append(b"\n".join(left).decode())
                out["n_lines"].append(sum(full))
                out["n_removed"].append(sum(f and i not in stays for i, f in enumerate(full)))
            return out

        return run

    return map_texts(packed, kept, MADE, factory, text="__both")


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with the later near-duplicate lines left out; every document stays."""
    d = dedup_lines(docs)
    d = d.withColumn("text", F.col("new_text")).withColumn("n_chars", F.length("new_text").cast("long"))
    return d.select(*docs.columns)
