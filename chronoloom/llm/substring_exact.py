"""Removal of repeated byte strings across documents by suffix arrays over shards.

Every string of ``LENGTH`` bytes belongs to the place of its least hash of ``GRAM`` bytes,
its anchor, which depends on the string alone; equal strings have equal anchors, so one
shard per range of anchor hashes sees them together. The strings of one anchor occurrence
form one stretch of text, its context.

1. Contexts go by hash only. Equal contexts fold to the earliest; all others are repeated
   whole. Folding starts inside each task, so a passage in every document costs one row a
   block before the shuffle.
2. Anchors that have one context left are done. For the others, the contexts' bytes are
   fetched and sharded by anchor, and each shard is sorted by induced sorting; neighbours
   in suffix order whose common prefix reaches ``LENGTH`` hold equal strings.
3. An anchor with very many different contexts doesn't go to a shard: its strings are
   grouped by hash, one row a string, with partial aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import in_blocks, map_texts, materialize, text_or_empty
from chronoloom.llm.suffix_array import permuted_lcp, suffix_array
from chronoloom.session import ship

LENGTH = 100
GRAM = 24
#: Bytes of contexts in a shard, and contexts of one anchor that a shard takes.
SHARD_BYTES = 2 << 20
MOST_CONTEXTS = 4000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(s: np.ndarray, gram: int) -> np.ndarray:
    """Mixed 64-bit hash of every ``gram`` bytes of ``s``, by doubling."""
    h = s.astype(np.uint64) + np.uint64(1)
    width, power = 1, _BASE
    out, out_width = None, 0
    with np.errstate(over="ignore"):
        rest = gram
        while True:
            if rest & 1:
                if out is None:
                    out, out_width = h, width
                else:
                    # out covers the first bytes, h the next ones.
                    m = len(h) - out_width
                    out = out[:m] * power + h[out_width : out_width + m]
                    out_width += width
            rest >>= 1
            if not rest:
                break
            m = len(h) - width
            h = h[:m] * power + h[width : width + m]
            power, width = power * power, width * 2
        out = out[: len(s) - gram + 1].copy()
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def _sliding_argmin(h: np.ndarray, window: int) -> np.ndarray:
    """Place of the leftmost least value in each window, by doubling."""
    at = np.arange(len(h), dtype=np.int32)
    width = 1
    while width < window:
        step = min(width, window - width)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        width += step
    return at


def contexts(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first string start, number of strings) of each context of one text."""
    if len(text) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(np.frombuffer(text, np.uint8), gram)
    at = _sliding_argmin(h, length - gram + 1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return h[at[first]], first, np.diff(np.concatenate([first, [len(at)]]))


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """Context rows, folded within blocks of a task; repeated ones are marked as such."""
    ship(docs.sparkSession)
    names = ["anchor", "context", "doc", "start", "n", "repeated"]

    def fold(rows):
        a, c, d, s, n = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((s, d, c, a))
        a, c, d, s, n = a[order], c[order], d[order], s[order], n[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        head = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
        again = ~first & ((d != d[head]) | (s != s[head]))
        keep = first | again
        # Repeats of one document that touch make one row.
        columns = [a.view(np.int64), c.view(np.int64), d, s, n.astype(np.int32), again]
        own = keep & ~again
        out = [x[own] for x in columns]
        i = np.flatnonzero(again)
        if len(i):
            i = i[np.lexsort((s[i], d[i]))]
            e = s[i] + n[i]
            new = np.ones(len(i), bool)
            new[1:] = (d[i][1:] != d[i][:-1]) | (s[i][1:] > np.maximum.accumulate(e)[:-1]) | (s[i][1:] != e[:-1])
            head = np.flatnonzero(new)
            tail = np.concatenate([head[1:], [len(i)]]) - 1
            merged = [a[i][head].view(np.int64), c[i][head].view(np.int64), d[i][head], s[i][head], (e[tail] - s[i][head]).astype(np.int32), np.ones(len(head), bool)]
            out = [np.concatenate(x) for x in zip(out, merged, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for block in in_blocks(batch, pc.binary_length(batch.column(1)).to_pylist(), 4 << 20):
                for doc, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                    a, s, n = contexts(text, length)
                    if len(a):
                        digest = xxhash.xxh3_64_intdigest
                        ends = (s + n + length - 1).tolist()
                        c = np.array([digest(text[x:y]) for x, y in zip(s.tolist(), ends, strict=True)], np.uint64)
                        rows.append((a, c, np.full(len(a), doc, np.int64), s, n))
                        held += len(text)
                if held > 12 << 20:
                    yield fold(rows)
                    rows, held = [], 0
        if rows:
            yield fold(rows)

    return docs.mapInArrow(run, "anchor bigint, context bigint, doc bigint, start bigint, n int, repeated boolean")


def _fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted contexts (anchor, doc, start, n, sharing)."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "n", "sharing")).alias("wanted"))

    def run(batches):
        for batch in batches:
            for block in in_blocks(batch, pc.binary_length(batch.column(1)).to_pylist(), 4 << 20):
                out = [
                    (w["anchor"], doc, w["start"], w["n"], w["sharing"], text[w["start"] : w["start"] + w["n"] + length - 1])
                    for doc, text, wants in zip(*(c.to_pylist() for c in block.columns), strict=True)
                    for w in wants
                ]
                columns = zip(*out, strict=True) if out else [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "doc", "start", "n", "sharing", "bytes"])

    joined = docs.join(lists, "doc").select("doc", "text", "wanted")
    return joined.mapInArrow(run, "anchor bigint, doc bigint, start bigint, n int, sharing bigint, bytes binary")


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Intervals joined where they touch or overlap, in one document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if len(doc):
        reach = np.maximum.accumulate(end + np.cumsum(np.concatenate([[0], np.diff(doc) != 0])) * (1 << 40)) - np.cumsum(np.concatenate([[0], np.diff(doc) != 0])) * (1 << 40)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
        head = np.flatnonzero(new)
        doc, start, end = doc[head], start[head], reach[np.concatenate([head[1:], [len(doc)]]) - 1]
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc", "start", "end"])


def repeated_in_shard(rows: list[tuple[int, int, int, bytes]], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of every string of ``length`` bytes that a row holds and an earlier place holds too.

    ``rows`` are (doc, start, number of strings, bytes).
    """
    data = b"\xff".join(r[3] for r in rows)
    sizes = np.array([len(r[3]) for r in rows], np.int64)
    offsets = np.cumsum(sizes + 1) - sizes - 1
    row = np.repeat(np.arange(len(rows)), sizes + 1)[: len(data)]
    inside = np.arange(len(data)) - offsets[row]
    n = np.array([r[2] for r in rows], np.int64)
    held = inside < n[row]  # a string of this row starts here
    doc = np.array([r[0] for r in rows], np.int64)[row]
    place = np.array([r[1] for r in rows], np.int64)[row] + inside
    sa = suffix_array(data)
    group = np.cumsum(permuted_lcp(data, sa)[sa] < length)
    sa, group = sa[held[sa]], group[held[sa]]
    order = np.lexsort((place[sa], doc[sa], group))
    sa, group = sa[order], group[order]
    first = np.ones(len(sa), bool)
    first[1:] = group[1:] != group[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(sa)), 0)) if len(sa) else first
    later = ~first & ((doc[sa] != doc[sa[head]]) | (place[sa] != place[sa[head]]))
    return doc[sa[later]], place[sa[later]]


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(doc, start, end): byte intervals that repeat earlier text; they may overlap. Rows with a null key are left out."""
    d = docs.select(F.col(key).cast("long").alias("doc"), text_or_empty(text).cast("binary").alias("text")).where("doc is not null")
    rows = materialize(_anchors(d, length), "contexts")
    place = F.struct("doc", "start")
    dealt = rows.where("not repeated").repartition("anchor")
    same = Window.partitionBy("anchor", "context")
    group = Window.partitionBy("anchor")
    seen = dealt.withColumn("first", F.min(place).over(same)).withColumn("low", F.min("context").over(group)).withColumn("high", F.max("context").over(group))
    seen = seen.withColumn("later", place != F.col("first")).where("later or low != high")
    seen = seen.withColumn("sharing", F.count(F.when(~F.col("later"), 1)).over(group)).select("anchor", "doc", "start", "n", "later", "sharing")
    seen = materialize(seen, "seen")
    span = [F.col("doc"), F.col("start"), (F.col("start") + F.col("n") + (length - 1)).alias("end")]
    whole = rows.where("repeated").select(*span).unionByName(seen.where("later").select(*span))
    wanted = seen.where("not later").select("anchor", "doc", "start", "n", "sharing").distinct()
    found = materialize(_fetch(d, wanted, length), "bytes")
    total = found.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def sort_shard(part: pa.Table) -> pa.Table:
        rows = list(zip(*(part.column(c).to_pylist() for c in ("doc", "start", "n", "bytes")), strict=True))
        doc, start = repeated_in_shard(rows, length)
        return pa.Table.from_batches([_joined(doc, start, start + length)])

    kind = "doc bigint, start bigint, end bigint"
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    sorted_ = found.where(F.col("sharing") <= most_contexts).groupBy(shard).applyInArrow(sort_shard, kind)
    sorted_ = materialize(sorted_, "sorted")
    crowded = found.where(F.col("sharing") > most_contexts)

    def strings(batches):
        for batch in batches:
            for block in in_blocks(batch, pc.binary_length(batch.column(2)).to_pylist(), 1 << 20):
                doc, start, data = (c.to_pylist() for c in block.columns)
                out = [(xxhash.xxh128_digest(b[i : i + length]), x, s + i) for x, s, b in zip(doc, start, data, strict=True) for i in range(len(b) - length + 1)]
                a, b, c = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["string", "doc", "start"])

    out = whole.unionByName(sorted_)
    if crowded.limit(1).count():
        each = materialize(crowded.select("doc", "start", "bytes").mapInArrow(strings, "string binary, doc bigint, start bigint"), "strings")
        least = each.groupBy("string").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
        late = each.join(least, "string").where(place != F.col("first"))
        out = out.unionByName(late.select("doc", "start", (F.col("start") + length).alias("end")))
    return out


MADE = "kept binary, n_bytes bigint, n_removed bigint, n_spans bigint"


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, carry: list[str] | None = None, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """Add kept (the bytes left), n_bytes, n_removed and n_spans (maximal removed runs).

    A byte goes if a string of ``length`` bytes over it also starts earlier: at a smaller
    key, or in the same text further left; overlaps count, and the input decides. Null and
    short texts keep all they have. Rows with a null key stay whole and count for no other
    row. Rows that repeat a key count as one place: equal text at the same place is no
    repeat, and a span found in one of them goes from each that reaches so far.
    """
    carry = docs.columns if carry is None else carry
    kept = [c for c in carry if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    spans = repeated_spans(docs, key, text, length, most_contexts)
    spans = materialize(spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans")), "spans")
    wide = docs.select(*kept, F.col(key).cast("long").alias("__doc"), text_or_empty(text).cast("binary").alias("__text"))
    d = wide.join(spans.withColumnRenamed("doc", "__doc"), "__doc", "left")
    packed = d.select(*kept, F.concat(F.to_json(F.struct(F.coalesce("__spans.start", F.array()).alias("a"), F.coalesce("__spans.end", F.array()).alias("b"))).cast("binary"), F.lit("\n").cast("binary"), F.col("__text")).alias("__both"))

    def factory():
        import json

        def run(texts):
            out: dict[str, list] = {"kept": [], "n_bytes": [], "n_removed": [], "n_spans": []}
            for t in texts:
                head, _, body = t.partition(b"\n")
                spans = json.loads(head)
                parts, at, runs = [], 0, 0
                for a, b in zip(spans["a"], spans["b"], strict=True):
                    b = min(b, len(body))
                    if a >= b:
                        continue
                    if a > at or not runs:
                        parts.append(body[at:a])
                        runs += 1
                    at = max(at, b)
                parts.append(body[at:])
                left = b"".join(parts)
                out["kept"].append(left)
                out["n_bytes"].append(len(body))
                out["n_removed"].append(len(body) - len(left))
                out["n_spans"].append(runs)
            return out

        return run

    return map_texts(packed, kept, MADE, factory, text="__both")
