"""Each operator against a brute-force version, and on awkward tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from chronoloom.llm import decontaminate, line_crf, line_dedup, packing, passages, quality_rules, simhash, substring_exact, suffix_array, token_store, warc
from chronoloom.llm.common import new_path
from chronoloom.llm.queries import tokenizer_file
from chronoloom.llm.tokens import Encoder
from tests.llm.conftest import SF, prose

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def ids_of(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    return [t.encode(x, add_special_tokens=False).ids + [end] for x in texts]


def pack_bytes(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_encoder(name):
    e, rnd = Encoder(tokenizer_file(name), most=50), random.Random(1)
    letters = [*"abAB'stélre ìß\n\t  .,!|0½²9\x1c\x85\xa0 Σσ̀日ª", "'ll", "<|endoftext|>", "\r\n", "  ", " \n"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    for text, ids in zip(texts, ids_of(name, texts, 7), strict=True):
        assert e.encode(text) == pack_bytes(ids[:-1]), text


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_encoder_on_many_texts(name):
    e, rnd = Encoder(tokenizer_file(name), most=300), random.Random(2)
    letters = [*"aaeeithsnoABß é½²9ªµ.,!|-\xad\u2019日", "'s", "'", " ", " ", "\n", "ing", "x" * 70]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + ["a<|endoftext|> b", "  two", "end ", "o'clock it's ''s 'sabc"]
    want = [pack_bytes(x[:-1]) for x in ids_of(name, texts, 0)]
    assert [*e.encode_all(texts)] == want
    e.forget()
    assert not (e.units or e.first or e.spaced or e.spaced.older)
    assert [*e.encode_all(texts[::-1])] == want[::-1]
    if name == BYTES:  # new words are merged together, not one by one
        e.forget()
        e.tokenize = None
        words = "ordinary prose, of many words; none is known yet\nnor seen " + " ".join(f"w{i}x{i * 7}" for i in range(2000))
        e.first["ordinary"] = e._whole("ordinary")
        assert [*e.encode_all([words])] == [pack_bytes(x[:-1]) for x in ids_of(name, [words], 0)]


def test_packing_leaves_no_caches_in_a_worker(spark):
    """A worker is used again by other operators; what the encoder remembered must not stay in it."""

    path = tokenizer_file(BYTES)

    def held(batches):
        from chronoloom.llm.tokens import _ENCODERS

        for _ in batches:
            pass
        n = [len(e.spaced) + len(e.spaced.older) + len(e.units) + len(e.first) for p, e in _ENCODERS.items() if p == path]
        yield pa.RecordBatch.from_arrays([pa.array([len(n)]), pa.array([sum(n)])], ["encoders", "remembered"])

    docs = spark.range(400, numPartitions=8).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 50), i -> concat('w', id * i))) as text")
    assert packing.pack(docs, tokenizer_file(BYTES), 1).count() >= 400
    left = spark.range(64, numPartitions=64).mapInArrow(held, "encoders bigint, remembered bigint").collect()
    assert max(r.encoders for r in left) == 1 and max(r.remembered for r in left) == 0


def test_packing(spark, awkward, none):
    rows = packing.pack(awkward.repartition(5), tokenizer_file(BYTES), 1, size=256, windows=3).collect()
    want = Counter(zlib.crc32(pack_bytes(x)) for x in ids_of(BYTES, [r.text or "" for r in awkward.collect()], 1))
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding <= 0.03 * sum(r.length for r in rows)
    got = Counter(zlib.crc32(b"".join(b for _, b in sorted(x))) for k, x in documents.items() if k[0] not in (33, 34, None))
    assert not got - want
    assert sum(r.length for r in rows) == sum(len(x) for x in ids_of(BYTES, [r.text or "" for r in awkward.collect()], 1))
    assert packing.pack(none, tokenizer_file(BYTES), 1).count() == 0


def test_merge():
    rnd = random.Random(2)
    windows = [[(i, 0, pack_bytes(range(rnd.randint(1, 99))), 1)] for i in range(30)]
    out = packing.merge([list(w) for w in windows], 128)
    sizes = [sum(len(p[2]) // 4 for p in w) for w in out]
    assert all(n == 128 or n & (n - 1) == 0 for n in sizes) and sum(sizes) == sum(len(w[0][2]) // 4 for w in windows)


def test_scan_marginals():
    rnd = np.random.default_rng(0)
    counts = np.array([3, 1, 0, 5])
    good, a = rnd.normal(size=9), rnd.normal(size=(2, 2))
    p, pair = line_crf.marginals(good, counts, a)
    at = 0
    for n in counts:
        ways = []
        for bits in range(1 << n):
            y = [bits >> i & 1 for i in range(n)]
            ways.append((y, np.exp(sum(good[at + i] * y[i] for i in range(n)) + sum(a[y[i], y[i + 1]] for i in range(n - 1)))))
        z = sum(w for _, w in ways)
        for i in range(n):
            assert p[at + i] == pytest.approx(sum(w for y, w in ways if y[i]) / z)
            if i:
                assert pair[at + i, 0, 1] == pytest.approx(sum(w for y, w in ways if (y[i - 1], y[i]) == (0, 1)) / z)
        at += n


def test_classifier(spark, awkward, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = line_crf.fit(docs, labels)
    r = line_crf.score(docs, model, ["doc_id"]).withColumn("h", line_crf.held_out()).join(labels, "doc_id").where("h").collect()
    assert sum(x.predicted == x.quality for x in r) >= 0.93 * len(r)
    out = line_crf.score(awkward, model).collect()
    assert len(out) == awkward.count() and all(0 <= x.score <= 1 for x in out) and "lang" in out[0].asDict()
    assert line_crf.score(none, model).count() == 0
    untrained = line_crf.fit(none, labels)
    assert all(0 <= x.score <= 1 for x in line_crf.score(awkward, untrained).collect())


def exact_passages(docs, n=50):
    first, out = {}, set()
    for k, text in docs:
        w = text.lower().split()
        for i in range(len(w) - n + 1):
            f = first.setdefault(tuple(w[i : i + n]), k)
            if f != k:
                out.add(k)
    return out


def test_passages(spark, plain, awkward, none):
    rows = passages.near_passages(plain[0]).collect()
    docs = {k: t.encode().lower().split() for k, t in plain[1]}
    assert exact_passages(plain[1]) <= {r.doc_id for r in rows}
    for r in rows:
        a, b = docs[r.doc_id][r.start : r.end], docs[r.match_id][r.match_start : r.match_end]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert r.match_id < r.doc_id and len(a) >= 50 and len(x & y) >= 0.6 * len(x | y)
    assert {r.doc_id for r in rows} <= {20, 21, 28, 29}
    passages.near_passages(awkward).count()
    assert passages.near_passages(none).count() == 0


def edited(rnd, text, at):
    w = text.split()
    for i in at:
        w[i] = prose(rnd, 1) + "x" + str(rnd.random())
    return " ".join(w)


def unmatched(docs, rows, similar=0.8):
    """(passages with a similar one in an earlier text, those of them that no row covers), by brute force."""
    sets = {k: [{tuple(w[i + j : i + j + 5]) for j in range(46)} for i in range(len(w) - 49)] for k, w in docs.items()}
    want = {
        (b, t) for b, y in sets.items() for t in range(len(y))
        if any(len(p & y[t]) >= similar * len(p | y[t]) for a, x in sets.items() if a < b for p in x)
    }
    return want, {(b, t) for b, t in want if not any(r.doc_id == b and r.start <= t and t + 50 <= r.end for r in rows)}


def passages_of(spark, docs):
    df = spark.createDataFrame(sorted(docs.items()), "doc_id bigint, text string").coalesce(1)
    return passages.near_passages(df).collect(), {k: t.encode().lower().split() for k, t in docs.items()}


def test_passage_of_a_later_partner(spark):
    """Variants come before and after their original: each is near the original alone."""
    rnd = random.Random(3)
    original = prose(rnd, 50)
    docs = {1: edited(rnd, original, [10]), 5: original, 6: edited(rnd, original, [25]), 7: edited(rnd, original, [40]), 8: edited(rnd, original, [32])}
    rows, found = passages_of(spark, docs)
    want, lost = unmatched(found, rows)
    assert {b for b, _ in want} == {5, 6, 7, 8} and not lost and all(r.jaccard >= 0.8 for r in rows)


def test_passages_against_brute_force(spark):
    """A near copy of a passage that a long text holds forty times, and copies with edits: nearly all starts at 0.8 or more are found."""
    rnd = random.Random(12)
    passage, base = prose(rnd, 52), prose(rnd, 110)
    docs = {1: " ".join(passage + " " + prose(rnd, 3) for _ in range(40)), 2: edited(rnd, passage, [26]), 3: base}
    docs |= {k: edited(rnd, base, [rnd.randrange(0, 50), rnd.randrange(55, 110)]) for k in range(4, 9)}
    rows, found = passages_of(spark, docs)
    want, lost = unmatched(found, rows)
    assert 2 in {b for b, _ in want} and len(want) > 100 and len(lost) <= 0.02 * len(want)


def test_passage_links_to_every_earlier_text(spark):
    """Five texts that are all near one another, none a copy: each is linked to all before it, not to the nearest alone."""
    rnd = random.Random(21)
    base = prose(rnd, 50)
    docs = {1: base, 2: edited(rnd, base, [0]), 3: edited(rnd, base, [49]), 4: edited(rnd, base, [1]), 5: edited(rnd, base, [48])}
    rows, _ = passages_of(spark, docs)
    assert {(r.match_id, r.doc_id) for r in rows} == {(a, b) for b in docs for a in docs if a < b}


def test_passages_of_equal_sets_are_one_class(spark):
    """Two runs of words, each time of other lengths: all have the same shingles and are linked to the first text, not all to all."""
    rows, _ = passages_of(spark, {k: " ".join(["of"] * (10 + k) + ["the"] * (40 - k)) for k in range(1, 16)})
    assert {(r.match_id, r.doc_id) for r in rows} == {(1, k) for k in range(2, 16)} and all(r.jaccard == 1 for r in rows)


def test_passages_of_a_crowd(spark):
    """More variants of one passage than are compared with one another outright: still all links, and the same ones in cells."""
    rnd = random.Random(5)
    base = prose(rnd, 50)
    docs = {k: edited(rnd, base, rnd.sample([0, 1, 2, 25, 47, 48, 49], rnd.randrange(1, 3))) for k in range(1, 31)}
    rows, words = passages_of(spark, docs)
    sets = {k: {tuple(w[i : i + 5]) for i in range(46)} for k, w in words.items()}
    want = {(a, b) for a in docs for b in docs if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(r.match_id, r.doc_id) for r in rows}
    assert got <= want and len(want) > 50 and len(got) >= 0.98 * len(want)
    d = spark.createDataFrame([(k, t.encode()) for k, t in docs.items()], "doc bigint, text binary").coalesce(1)
    assert {(r.a, r.b) for r in passages.verified(d, most_held=7).collect()} == got


def test_passages_around_a_shared_one(spark):
    """Texts that hold one passage, each in its own surroundings: those that reach beyond its ends are linked to few texts, not all to all."""
    rnd = random.Random(8)
    shared = prose(rnd, 68)
    rows, words = passages_of(spark, {k: " ".join([prose(rnd, 20), shared, prose(rnd, 20)]) for k in range(1, 25)})
    pairs = {(r.match_id, r.doc_id) for r in rows}
    assert {(1, k) for k in range(2, 25)} <= pairs and len(pairs) <= 3 * 24
    want, lost = unmatched(words, rows)
    assert len(want) > 23 * 25 and len(lost) <= 0.02 * len(want)


def simhash_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash(spark, awkward, none):
    out = simhash.near_duplicates(awkward, carry=["doc_id", "text"]).collect()
    assert all(int(r.fingerprint, 16) == simhash_of(r.text or "") for r in out) and len(out) == awkward.count()
    by = {r.doc_id: r.component_id for r in out if r.doc_id not in (33, None)}
    assert by[20] == by[21] == by[0] == 0 and by[22] == by[23] == by[24] == 22 and by[26] == 25
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_keeps_rows(spark):
    """Repeated, null and near keys and clashing names: as many rows out as in, components as union-find names them."""
    rnd = random.Random(6)
    base = [prose(rnd, 60) for _ in range(6)]
    texts = [*base, *base, *(t + " x" for t in base), *(t.replace(" ", "  ") for t in base), None, "", "one"]
    rows = [(rnd.choice([None, 1, 2, 3, 40, 50, 60]), rnd.choice(texts)) for _ in range(150)] + [(7, "same"), (7, "other text"), (None, "lone text of no key"), (None, "second such")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("clash")).withColumn("fingerprint", F.lit(1)).withColumn("fp", F.lit("kept"))
    out = simhash.near_duplicates(df, carry=df.columns).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows) and all(r.fp == "kept" for r in out)
    prints = {t: simhash_of(t or "") for _, t in rows}
    group = {f: f for f in prints.values()}
    for _ in group:
        for f in group:
            group[f] = min(group[g] for g in group if (f ^ g).bit_count() <= 2)
    least = defaultdict(lambda: None)
    for k, t in rows:
        g = group[prints[t]]
        least[g] = k if least[g] is None else least[g] if k is None else min(k, least[g])
    assert all(r.component_id == least[group[prints[r.text]]] for r in out)


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_links_and_components(spark, most):
    rnd = random.Random(9)
    fps = set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 30])):
            fps.add(x)
            for _ in range(rnd.randint(0, 3)):
                x ^= 1 << rnd.randrange(64)
    fps = sorted(fps)
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 2:
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x), i) for i, x in enumerate(fps)], "node long, rank long")
    edges = simhash.links(nodes.select(F.col("node").alias("fp")), most_paired=most)
    got = {r.node: r.label for r in simhash.components(nodes, edges).collect()}
    assert all(got.get(signed(x), i) == fps.index(root(x)) for i, x in enumerate(fps))


def test_token_store(spark, awkward, none):
    uri = new_path(spark, "test-tokens")
    manifest = token_store.write_tokens(awkward, uri, tokenizer_file(WORDS), 2, file_ids=500)
    rows = token_store.document_starts(token_store.read_tokens(spark, uri), manifest).collect()
    docs = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in awkward.collect()))
    want = ids_of(WORDS, [t for _, _, t in docs], 2)
    rows.sort(key=lambda r: r.start)
    at = 0
    for r, (has, key, _), ids in zip(rows, docs, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (key if has else None, at, len(ids), pack_bytes(ids))
        at += len(ids)
    assert token_store.write_tokens(none, new_path(spark, "no-tokens"), tokenizer_file(WORDS), 2).count() == 0


def test_codes():
    g = np.random.default_rng(0)
    ids = np.concatenate([g.integers(0, 300, 3000), g.integers(0, 2**32, 3000), g.integers(0, 70000, 3000), [0, 255, 256, 2**32 - 1]]).astype(np.uint32)
    g.shuffle(ids)
    f = token_store.TokenFile.from_bytes(token_store.TokenFile.build([1, None, 5], [1000, 0, len(ids) - 1000], ids).to_bytes())
    places = g.integers(0, len(ids), 4000)
    assert (f.take(places) == ids[places]).all() and len(f.take([])) == 0
    assert (f.slice(777, 8888) == ids[777:8888]).all() and (f.document(2) == ids[1000:]).all() and not len(f.document(1))
    empty = token_store.TokenFile.from_bytes(token_store.TokenFile.build([], [], np.zeros(0, np.uint32)).to_bytes())
    assert not len(empty.slice(0, 0))
    with pytest.raises(ValueError):
        token_store.TokenFile.from_bytes(b"nothing like it, at all")


def test_suffix_array():
    rnd = random.Random(3)
    for _ in range(400):
        letters = rnd.choice([b"a", b"ab", b"abc", bytes(range(256))])
        d = bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) * rnd.randint(1, 3)
        sa = suffix_array.suffix_array(d)
        order = sorted(range(len(d)), key=lambda i: d[i:])
        assert sa.tolist() == order
        lcp = suffix_array.permuted_lcp(d, sa)
        for a, b in zip(order, order[1:]):
            k = 0
            while k < len(d) - max(a, b) and d[a + k] == d[b + k]:
                k += 1
            assert lcp[b] == k


def repeats(docs, n=100):
    seen, out = set(), {}
    for k, text in docs:
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if b[i : i + n] in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(b[i : i + n])
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[k] = (bytes(x for x, g in zip(b, gone, strict=True) if not g), len(b), sum(gone), runs)
    return out


@pytest.mark.parametrize("most", [0, 4000])
def test_repeats(spark, plain, awkward, none, most):
    out = substring_exact.remove_repeats(plain[0], most_contexts=most).collect()
    assert {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in out} == repeats(plain[1])
    if most:
        every = substring_exact.remove_repeats(awkward, carry=["doc_id", "lang"]).collect()
        assert len(every) == awkward.count() and all(r.n_removed == 0 for r in every if r.doc_id is None)
        assert substring_exact.remove_repeats(none).count() == 0


def kept_text(docs):
    seen, out = [], {}
    for k, text in docs:
        lines = []
        for line in text.split("\n"):
            s = set(line.encode().lower().split())
            if not s or not any(5 * len(s & t) >= 4 * len(s | t) for t in seen):
                lines.append(line)
            if s:
                seen.append(s)
        out[k] = "\n".join(lines)
    return out


def near_lines(spark):
    rnd = random.Random(4)
    base = [prose(rnd, rnd.randint(1, 25)).split() for _ in range(15)]
    rows = []
    for k in range(40):
        lines = []
        for _ in range(4):
            w = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = prose(rnd, 1)
            lines.append(" ".join(w))
        rows.append((k, "\n".join(lines)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), rows


@pytest.mark.parametrize("most", [2, 400])
def test_lines(spark, plain, awkward, none, most, monkeypatch):
    monkeypatch.setattr(line_dedup.later_matches, "__defaults__", (most, line_dedup.LEVELS))
    df, rows = near_lines(spark)
    assert {r.doc_id: r.new_text for r in line_dedup.dedup_lines(df).collect()} == kept_text(rows)
    if most == 400:
        assert {r.doc_id: r.new_text for r in line_dedup.dedup_lines(plain[0]).collect()} == kept_text(plain[1])
        assert line_dedup.dedup_lines(awkward).count() == awkward.count() and line_dedup.dedup_lines(none).count() == 0


def test_crowd_of_strangers(spark, monkeypatch):
    """Lines of 16 common words and 4 of 120: two are similar if they share 2 of these; the early members of a crowd share mostly 1."""
    monkeypatch.setattr(line_dedup.later_matches, "__defaults__", (20, 1))
    rnd = random.Random(8)
    core, pool = [f"core{i}" for i in range(16)], [f"pool{i}" for i in range(120)]
    rows = [(i, " ".join(core + rnd.sample(pool, 4))) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.new_text for r in line_dedup.dedup_lines(df).collect()} == kept_text(rows)


def test_crowd_keeps_its_words(spark):
    """A word that 1500 lines share stays one key a line: no longer keys, whose number grows with the square of a prefix."""
    rnd = random.Random(9)
    core, pool = [f"core{i}" for i in range(16)], [f"pool{i}" for i in range(120)]
    rows = [(i, " ".join(core + rnd.sample(pool, 4))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = line_dedup.line_sets(df, line_dedup.rarity_classes(line_dedup.word_counts(df)), "doc_id", "text")
    frequent = sets.withColumn("prefix", F.expr("transform(prefix, (x, i) -> if(i = 0, shiftleft(200L, 55), x))"))
    keyed, crowd = line_dedup._keyed(frequent, line_dedup.MOST_PAIRED, line_dedup.LEVELS, [])
    assert crowd is None and len(keyed) == 1 and keyed[0][1].count() == 1500 * 5


def test_nearest(monkeypatch):
    """Packed rows come back as they were; the nearest of each row are those of a plain double loop, in small and large groups."""
    rng = np.random.default_rng(3)
    size = [1, 2, 5, 30, 64, 65, 700]
    key = np.repeat(np.arange(len(size)) * 1000 - 2000, size)
    rows = len(key)
    base = rng.integers(0, 1 << 62, (4, 4))
    pick = rng.integers(0, 4, rows)
    t = {"key": key, "doc": np.arange(rows) // 2, "line": (np.arange(rows) % 2).astype(np.int32), "n": rng.integers(15, 60, rows).astype(np.int32), "i": rng.integers(0, 2, rows).astype(np.int32)}
    for j, c in enumerate(["sign", "s1", "s2", "s3"]):
        t[c] = base[pick, j] ^ (np.int64(1) << rng.integers(0, 62, rows))
    t["n"][pick == 0] = rng.integers(170, 200, (pick == 0).sum())
    t["s1"][t["n"] <= 40] = 0
    t["s2"][t["n"] <= 160] = t["s3"][t["n"] <= 160] = 0
    back = line_dedup._unpack(line_dedup._pack(t))
    assert all((back[c] == x).all() and back[c].dtype == x.dtype for c, x in t.items())
    signs = [t[c] for c in ["sign", "s1", "s2", "s3"]]
    expected = {}
    for b in range(rows):
        a = np.flatnonzero(key[:b] == key[b])
        ok, far = line_dedup._passing(t["n"], t["i"], signs, a, np.full(len(a), b), 1)
        expected[b] = sorted(zip(far[ok].tolist(), a[ok].tolist(), strict=True))
    for most, small, crowd in ((8, 64, 512), (1, 1, 16), (10**6, 64, 512), (10**6, 8, 10**6)):
        monkeypatch.setattr(line_dedup, "MOST_LISTED", most)
        monkeypatch.setattr(line_dedup, "SMALL_GROUP", small)
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
        got, more = {}, set()
        for r in line_dedup._nearest(pa.table(t), 1).to_pylist():
            b = 2 * r["doc"] + r["line"]
            got.setdefault(b, []).append((r["far"], 2 * r["a_doc"] + r["a_line"]))
            if r["others"]:
                more.add(b)
        assert set(got) == {b for b, x in expected.items() if x} and more == {b for b, x in expected.items() if len(x) > most}
        for b, found in got.items():
            assert set(found) <= set(expected[b]) and len(found) == min(most, len(expected[b]))
            if crowd > 16:
                assert sorted(found) == expected[b][:most]


def test_word_hashes():
    h, first = line_dedup.word_hashes(b" ab\tcd ab\n\x0bab cdx")
    assert first.tolist() == [1, 4, 7, 11, 14] and h[0] == h[2] == h[3] and len(set(h.tolist())) == 3
    assert line_dedup.word_hashes(b"")[0].size == 0


def counts_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(g)
    hit = {j for i, x in enumerate(g) if c[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_rules(spark, awkward, none):
    out = quality_rules.quality_rules(awkward, carry=["doc_id", "text", "lang"]).collect()
    assert len(out) == awkward.count()
    for r in out:
        c = counts_of(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0]) and (not r.kept or not r.base_failed)
    assert quality_rules.quality_rules(none).count() == 0
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = quality_rules.quality_rules(docs, carry=["doc_id"]).join(labels, "doc_id").where("not base_failed").collect()
    assert all(x.kept for x in r if x.quality == 1)
    bad = [x.kept for x in r if x.quality == 0]
    assert sum(bad) <= 0.35 * len(bad)


def test_em_recovers_accuracies():
    rnd = random.Random(1)
    patterns = Counter()
    for _ in range(4000):
        good = rnd.random() < 0.8
        patterns[tuple((1 if rnd.random() < 0.9 else 0) if good else rnd.choice([1, 0, -1, -1]) for _ in quality_rules.RULES)] += 1
    model = quality_rules.fit(sorted(patterns.items()))
    assert abs(model["prior"] - 0.8) < 0.03 and all(w[-1] < 0 < w[1] for w in model["weights"])


def test_warc(spark):
    t = lambda s: s if s is None else dict(s)
    rows = [
        (1, "response", "http://www.A.org:80/x/?b=2&a=1&utm_source=q#f", 10, t({"etag": '"1"', "date": "d1", "x": "y"}), "D1", 5),
        (2, "revisit", "https://a.org/x?a=1&b=2", 20, t({"etag": 'W/"1"', "date": "d2", "x": "z"}), None, None),
        (3, "response", "https://a.org/x?a=1&b=2", 20, t({"etag": '"3"'}), "D3", 6),
        (4, "revisit", "https://a.org/x/?a=1&b=2", 30, t({"etag": '"1"'}), None, None),
        (5, "revisit", "https://a.org/x/?a=1&b=2", 5, None, None, None),
        (6, "revisit", None, 30, t({}), None, None),
        (7, "revisit", "a.org/x?a=1&b=2", 30, t({"vary": "v"}), None, None),
        (8, "revisit", "a.org/x?a=1&b=2", 31, t({}), "D3", None),
        (9, None, "a.org/x?a=1&b=2", 31, t({}), "D3", None),
        (8, "revisit", "a.org/x?a=1&b=2", 31, t({}), "D3", None),
    ]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, headers map<string,string>, digest string, n_bytes long").withColumn("status", F.lit("clash"))
    out = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert {k: (r.original_id, r.status) for k, r in out.items()} == {
        2: (1, "resolved"), 4: (3, "changed"), 5: (None, "missing"), 6: (None, "missing"), 7: (3, "unchecked"), 8: (3, "resolved"),
    }
    assert out[2].headers == {"etag": 'W/"1"', "date": "d2", "x": "y"} and out[2].digest == "D1" and out[7].headers == {"etag": '"3"', "vary": "v"}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def contamination(docs, items, n=13):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    windows = defaultdict(set)
    for name, text in items:
        w = find(low(text))
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(name)
    out = {}
    for k, text in docs:
        w, hit, held = find(low(text)), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    held |= windows[tuple(w[i : i + size])]
        out[k] = (len(w), len(hit), sorted(held), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("item_bytes", [200, 1 << 20])
def test_contamination(spark, plain, awkward, none, item_bytes):
    texts = dict(plain[1])
    items = [("b", " ".join(texts[3].split()[5:30])), ("a", "ONE"), ("c", " ".join(texts[28].split()[10:24])), ("d", ""), ("b", "sen-Ru ka"), ("e", " ".join(texts[3].split()[10:40]))]
    bench = spark.createDataFrame([*items, (None, None)], "item_id string, text string")
    out = decontaminate.find_contamination(plain[0], bench, item_bytes=item_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in out} == contamination(plain[1], items)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in out)
    clean = decontaminate.find_contamination(awkward, bench, item_bytes=item_bytes, only_clean=True)
    assert {r.doc_id for r in clean.collect()} >= {22, 23, 24, None} and "lang" in clean.columns
    assert not decontaminate.find_contamination(awkward, bench.limit(0)).where("contaminated").count()
    assert decontaminate.find_contamination(none, bench).count() == 0


def test_near(spark):
    docs = spark.createDataFrame([(1, "alpha one two beta"), (2, "alpha " + "x " * 30 + "beta"), (3, None), (4, "beta alpha")], "doc_id long, text string")
    asked = spark.createDataFrame([("q", "Alpha BETA"), ("e", "")], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_near(docs, asked, 5).collect()} == {(1, "q"), (4, "q")}


def test_digest():
    assert decontaminate.items_digest(["b", "a"]) == hashlib.sha256(b"a,b").hexdigest()


def test_registered_queries(spark):
    from chronoloom.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert queries.QUERIES["op10_decontaminate"](spark, SF).count() == 200
    assert queries.QUERIES["op8_quality_rules"](spark, SF).count() == 200
