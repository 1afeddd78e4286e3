"""Benchmark decontamination with a stored, distributed positional inverted index.

The index is a table of postings: for each term of each text the sorted places of the term.
Every task writes segments sorted by term, so that looking terms up reads the row groups that
hold them. A phrase of the test set is looked up from its rarest term in the whole corpus:
that list, moved back by the term's offset, gives the candidate starts; the list of the second
rarest is intersected with them by a join, and what is left meets all other lists, text by
text. Proximity queries go through the same lists. Texts are named by 128 bits of hash and
terms by 64: copies share their postings, and one task keeps a text only once.
The test set goes through in blocks of bounded size, whatever its total.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import free, in_blocks, map_texts, materialize, text_or_empty
from chronoloom.llm.line_dedup import _by_group, word_hashes
from chronoloom.session import ship

WINDOW = 13
#: Bytes of test texts looked up at a time; the terms and windows of a block are what is broadcast.
ITEM_BYTES = 4 << 20

#: Upper case to lower case, and every byte that is no part of a word to a space.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; matches [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+."""
    return text.translate(_TABLE).split()


def terms(text: bytes) -> np.ndarray:
    """The words of a text, in order, as signed 64-bit hashes."""
    return word_hashes(text.translate(_TABLE))[0].view(np.int64)


_KEY = ["k1", "k2"]


def _named(text: str) -> list:
    """The two hashes that name a text."""
    body = text_or_empty(text)
    return [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit("second"), F.length(body), body).alias("k2")]


def build_index(docs: DataFrame, text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """The stored postings (term, k1, k2, n, places) of all texts; a row with a null term gives a text's number of words.

    No shuffle: a task writes the segment of its own texts, block by block, each in order of term.
    """
    ship(docs.sparkSession)
    d = docs.select(*_named(text), text_or_empty(text).cast("binary").alias("text"))
    names = ["term", "k1", "k2", "n", "places"]

    def run(batches):
        seen = set()
        for batch in batches:
            for block in in_blocks(batch, pc.binary_length(batch.column(2)).to_pylist(), block_bytes):
                k1, k2 = (block.column(i).to_numpy() for i in range(2))
                fresh = []
                for i, k in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
                    if k not in seen:
                        seen.add(k)
                        fresh.append(i)
                if not fresh:
                    continue
                k1, k2, texts = k1[fresh], k2[fresh], block.column(2).take(pa.array(fresh)).to_pylist()
                h, first = word_hashes(b" ".join(texts).translate(_TABLE))
                ends = np.cumsum([len(t) + 1 for t in texts])
                doc = np.searchsorted(ends, first, "right")
                count = np.bincount(doc, minlength=len(texts))
                place = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
                order = np.argsort(h.view(np.int64), kind="stable")
                h, doc, place = h.view(np.int64)[order], doc[order], place[order].astype(np.int32)
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.concatenate([at, [len(h)]])).astype(np.int32)
                offsets = np.concatenate([at, [len(h)]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(k1[doc[at]]), pa.array(k2[doc[at]]), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(place))], names)
                none = np.zeros(len(texts) + 1, np.int32)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), pa.array(k1), pa.array(k2), pa.array(count.astype(np.int32)), pa.ListArray.from_arrays(pa.array(none), pa.array([], pa.int32()))], names)

    return materialize(d.mapInArrow(run, "term bigint, k1 bigint, k2 bigint, n int, places array<int>"), "postings")


def _item_blocks(benchmark: DataFrame, item_bytes: int):
    """Blocks of (item, text) of about ``item_bytes``, one at a time."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), text_or_empty().cast("binary").alias("t")).distinct()
    total = b.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // item_bytes) or 1
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"], bytes(r["t"])) for r in part.collect()]


def _counts(index: DataFrame, asked: np.ndarray) -> dict[int, int]:
    """How often each of the asked terms occurs in the whole corpus."""
    spark = index.sparkSession
    held = F.broadcast(spark.createDataFrame(asked[:, None].tolist() if len(asked) else [], "term bigint"))
    rows = index.select("term", "n").join(held, "term").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {r["term"]: r["n"] for r in rows}


def _by_rarity(asked: list[tuple[int, ...]], index: DataFrame) -> list[list[tuple[int, int]]]:
    """For each asked sequence of terms its (term, offset), rarest first; an empty list where the corpus lacks a term."""
    count = _counts(index, np.unique(np.array([t for a in asked for t in a], np.int64)))
    return [sorted(((t, i) for i, t in enumerate(a)), key=lambda p: (count[p[0]], p[1])) if all(t in count for t in a) else [] for a in asked]


def _starts(index: DataFrame, ranked: list[list[tuple[int, int]]], depth: int = 2) -> DataFrame:
    """(k1, k2, w, start): places in texts where the ``depth`` rarest terms of asked sequence w stand at their offsets."""
    spark = index.sparkSession
    found = None
    for r in range(depth):
        rows = [(w, a[r][0], a[r][1], len(a) > r + 1) for w, a in enumerate(ranked) if len(a) > r]
        here = F.broadcast(spark.createDataFrame(rows, "w int, term bigint, off int, more boolean"))
        lists = index.select("term", *_KEY, "places")
        if found is None:
            found = lists.join(here, "term").select(*_KEY, "w", "more", F.explode("places").alias("p"), "off").select(*_KEY, "w", (F.col("p") - F.col("off")).alias("start"), "more").where("start >= 0")
            continue
        lists = lists.join(F.broadcast(spark.createDataFrame(sorted({(t,) for _, t, _, _ in rows}), "term bigint")), "term", "left_semi")
        met = found.where("more").drop("more").join(here, "w").join(lists, ["term", *_KEY]).where(F.array_contains("places", F.col("start") + F.col("off")))
        found = found.where("not more").unionByName(met.select(*_KEY, "w", "start", "more"))
    return found.select(*_KEY, "w", "start").distinct()


def _small(df: DataFrame, most: int = 1 << 19) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` short rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _windows(items: list[tuple[str, bytes]], window: int) -> tuple[list[tuple[int, ...]], list[list[str]]]:
    """The distinct windows of a block of items, and the items that hold each."""
    found: dict[tuple, set] = {}
    for name, text in items:
        t = terms(text).tolist()
        n = min(window, len(t))
        for i in range(len(t) - n + 1 if n else 0):
            found.setdefault(tuple(t[i : i + n]), set()).add(name)
    return list(found), [sorted(s) for s in found.values()]


_HITS = "k1 bigint, k2 bigint, n_words int, spans array<struct<start:int,end:int>>, item_ids array<string>"


def matches(index: DataFrame, items: list[tuple[str, bytes]], window: int = WINDOW) -> DataFrame:
    """(k1, k2, n_words, spans, item_ids): texts with an occurrence of a window of a block of test items."""
    spark = index.sparkSession
    asked, holders = _windows(items, window)
    ranked = _by_rarity(asked, index)
    live = [i for i, a in enumerate(ranked) if a]
    if not live:
        return spark.createDataFrame([], _HITS)
    asked, holders, ranked = ([x[i] for i in live] for x in (asked, holders, ranked))
    shared = spark.sparkContext.broadcast((asked, holders))
    found = materialize(_starts(index, ranked), "starts")
    texts = _small(found.select(*_KEY).distinct())
    every = F.broadcast(spark.createDataFrame(sorted({(t,) for a in asked for t in a}), "term bigint"))
    lists = index.join(every, "term", "left_semi").select(*index.columns).unionByName(index.where("term is null")).join(texts, _KEY, "left_semi")
    rows = lists.select(*_KEY, "term", "n", "places", F.lit(None).cast("int").alias("w"), F.lit(None).cast("int").alias("start"))
    none = F.lit(None)
    rows = rows.unionByName(found.select(*_KEY, none.cast("bigint").alias("term"), none.cast("int").alias("n"), none.cast("array<int>").alias("places"), "w", "start"))
    dealt = rows.repartition(*_KEY).sortWithinPartitions(*_KEY)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def settle(t):
        asked, holders = shared.value
        k1, k2 = (t.column(c).to_numpy() for c in _KEY)
        edge = np.concatenate([[0], np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1, [len(k1)]])
        term, n, places, w, start = (t.column(c).to_pylist() for c in ("term", "n", "places", "w", "start"))
        out = []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            held = {term[i]: set(places[i]) for i in range(lo, hi) if term[i] is not None}
            size = next((n[i] for i in range(lo, hi) if term[i] is None and w[i] is None), 0)
            hit = [(start[i], w[i]) for i in range(lo, hi) if w[i] is not None and all(start[i] + k in held.get(x, ()) for k, x in enumerate(asked[w[i]]))]
            if hit:
                names = sorted({h for _, x in hit for h in holders[x]})
                spans: list[list[int]] = []
                for a, b in sorted((s, s + len(asked[x])) for s, x in hit):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                out.append((k1[lo], k2[lo], size, [{"start": a, "end": b} for a, b in spans], names))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        types = [pa.int64(), pa.int64(), pa.int32(), kind, pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(columns, types, strict=True)], ["k1", "k2", "n_words", "spans", "item_ids"])

    hits = materialize(_by_group(dealt, _KEY, settle, _HITS), "hits")
    free(found)
    return hits


def _all_matches(index: DataFrame, benchmark: DataFrame, item_bytes: int) -> DataFrame:
    """The matches of all blocks of the test set: spans merged, items in order, with n_hit and contaminated."""
    every = None
    for items in _item_blocks(benchmark, item_bytes):
        part = matches(index, items)
        every = part if every is None else every.unionByName(part)
    merged = F.expr(
        "aggregate(array_sort(s), cast(array() as array<struct<start:int,end:int>>), (a, x) -> "
        "if(size(a) > 0 and x.start <= element_at(a, -1).end, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))), "
        "concat(a, array(x))))"
    )
    d = every.groupBy(*_KEY).agg(F.max("n_words").alias("size"), F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    d = d.withColumn("spans", merged).withColumn("n_hit", F.expr("aggregate(spans, 0L, (t, x) -> t + x.end - x.start)"))
    return materialize(d.select(*_KEY, "n_hit", "item_ids", "spans", F.expr("n_hit > 0 and 20 * n_hit >= size").alias("contaminated")), "matches")


_MADE = ["n_words", "n_hit", "item_ids", "spans", "contaminated"]


def find_contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, text: str = "text", item_bytes: int = ITEM_BYTES, only_clean: bool = False) -> DataFrame:
    """Every row of ``docs`` with the words that windows of test items cover.

    New columns: n_words, n_hit, item_ids (sorted), spans (word intervals), contaminated
    (n_hit > 0 and at least 5 % of the words); carried columns of their names give way. Null texts
    have no words and are clean; so is every row if the test set is empty. Repeated rows are judged
    alike. Test rows that share an item_id are one item; a null item_id is called "null".
    ``only_clean`` returns the clean rows alone, with the carried columns.
    """
    carry = docs.columns if carry is None else carry
    index = build_index(docs, text)
    found = _all_matches(index, benchmark, item_bytes)
    free(index)
    named = dict(zip(("__k1", "__k2"), _named(text), strict=True))
    same = lambda d, f: [d["__k1"] == f["__f1"], d["__k2"] == f["__f2"]]
    if only_clean:
        bad = _small(found.where("contaminated").select(F.col("k1").alias("__f1"), F.col("k2").alias("__f2")))
        d = docs.withColumns(named)
        return d.join(bad, same(d, bad), "left_anti").select(*carry)
    kept = [c for c in carry if c not in _MADE]

    def factory():
        return lambda texts: {"__words": [int(len(word_hashes(t.translate(_TABLE))[0])) for t in texts]}

    d = map_texts(docs.withColumns(named), [*kept, *named], "__words bigint", factory, text)
    f = found.withColumnsRenamed({"k1": "__f1", "k2": "__f2", **{c: f"__m_{c}" for c in _MADE[1:]}})
    both = d.join(f, same(d, f), "left")
    none = {"n_hit": F.lit(0).cast("long"), "item_ids": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<start:int,end:int>>"), "contaminated": F.lit(False)}
    return both.select(*kept, F.col("__words").alias("n_words"), *[F.coalesce(f"__m_{c}", v).alias(c) for c, v in none.items()])


def find_near(docs: DataFrame, queries: DataFrame, span: int, key: str = "doc_id", text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Rows (key, item_id): texts that hold all words of a query within ``span`` words of one place of its rarest word.

    Queries without words match nothing. Each further term's list is intersected by a join, from the rarest on.
    """
    spark = docs.sparkSession
    index = build_index(docs, text)
    parts = []
    for items in _item_blocks(queries, item_bytes):
        named = [(name, tuple(dict.fromkeys(terms(t).tolist()))) for name, t in items]
        ranked = _by_rarity([a for _, a in named], index)
        live = [(named[i][0], a) for i, a in enumerate(ranked) if a]
        if not live:
            continue
        found = None
        for r in range(max(len(a) for _, a in live)):
            rows = [(w, name, a[r][0], len(a) > r + 1) for w, (name, a) in enumerate(live) if len(a) > r]
            here = F.broadcast(spark.createDataFrame(rows, "w int, item_id string, term bigint, more boolean"))
            lists = index.select("term", *_KEY, "places")
            if found is None:
                found = lists.join(here, "term").select(*_KEY, "w", "item_id", "more", F.explode("places").alias("at"))
                continue
            met = found.where("more").drop("more", "item_id").join(here, "w").join(lists, ["term", *_KEY]).where(F.exists("places", lambda p: F.abs(p - F.col("at")) <= span))
            found = materialize(found.where("not more").unionByName(met.select(*_KEY, "w", "item_id", "more", "at")), "near")
        parts.append(materialize(found.select(*_KEY, "item_id").distinct(), "near"))
    free(index)
    d = docs.select(F.col(key), *_named(text))
    if not parts:
        return d.select(key, F.lit("").alias("item_id")).limit(0)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return d.join(every, _KEY).select(key, "item_id").distinct()


def items_digest(item_ids: list[str]) -> str:
    """sha256 of the sorted, comma-joined item ids."""
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that aren't contaminated."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_contamination(docs, benchmark, only_clean=True).select(*docs.columns)
