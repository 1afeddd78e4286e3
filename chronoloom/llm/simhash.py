"""SimHash near-duplicates with the pigeonring filter, and connected components.

A 64-bit fingerprint is cut into a ring of ``SEGMENTS`` segments. If two fingerprints differ
in at most ``tau`` bits, then from some segment on every run of l consecutive segments
differs in at most l * tau / SEGMENTS bits. The first runs, with a budget under one bit,
must be equal: they are the join key. Longer runs are checked against their budgets before
the full distance. Keys shared by many fingerprints take an exact way that never forms
pairs: two fingerprints within two bits of each other meet in a common value at most one
bit from both, so grouping every value one bit away from each finds all their links.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import free, map_texts, materialize

SEGMENTS = 5
TAU = 2
#: Column of a fingerprint while other columns are carried along.
FP = "__fp"
#: Fingerprints sharing a key that are still compared in pairs.
MOST_PAIRED = 48


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text: A-Z lowered, ASCII white space splits, XXH64 with seed 42 of each shingle."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    digest = xxhash.xxh64_digest
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    h = np.frombuffer(b"".join([digest(g, 42) for g in grams]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, carry: list[str], text: str = "text", shingle: int = 3) -> DataFrame:
    """Add ``__fp``, the fingerprint's bits as a signed long; null and word-less texts have 0."""

    def factory():
        def run(texts):
            values = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            return {FP: values.view(np.int64)}

        return run

    return map_texts(docs, carry, f"{FP} bigint", factory, text)


def ring_bounds(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(first bit, width) of each segment of the ring."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _run_mask(start: int, length: int, segments: int) -> int:
    mask = 0
    for k in range(length):
        a, n = ring_bounds(segments)[(start + k) % segments]
        mask |= ((1 << n) - 1) << a
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _differences(mask: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(mask)))


def links(fps: DataFrame, tau: int = TAU, segments: int = SEGMENTS, most_paired: int = MOST_PAIRED) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints ``fp`` at most ``tau`` bits apart.

    Complete up to connection: two fingerprints within ``tau`` bits are linked, or joined by
    a path of such links. ``tau`` must be 2 where a key can be shared by more than
    ``most_paired`` fingerprints.
    """
    equal = max(length for length in range(1, segments + 1) if length * tau < segments)
    masks = F.array(*[F.lit(_run_mask(i, equal, segments)) for i in range(segments)])
    keyed = fps.select("fp", F.posexplode(masks).alias("turn", "mask")).select(
        "fp", F.col("turn").cast("tinyint").alias("turn"), F.col("fp").bitwiseAND(F.col("mask")).alias("key")
    )
    shared = keyed.groupBy("turn", "key").agg(F.count("*").alias("n"))
    shared = materialize(shared.where("n > 1"), "ring-keys")
    few = keyed.join(shared.where(F.col("n") <= most_paired).select("turn", "key"), ["turn", "key"])
    few = materialize(few, "ring-members")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["turn", "key"]).where("a < b")
    # The chain: each run from this turn's segment on, against its budget, then the whole ring.
    for length in range(equal + 1, segments):
        passes = F.lit(False)
        for turn in range(segments):
            passes = passes | ((F.col("turn") == turn) & (_differences(_run_mask(turn, length, segments)) <= length * tau // segments))
        pairs = pairs.where(passes)
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau).select("a", "b")
    many = keyed.join(shared.where(F.col("n") > most_paired).select("turn", "key"), ["turn", "key"]).select("fp").distinct()
    near = F.expr("concat(array(0L), transform(sequence(0, 63), i -> shiftleft(1L, i)))")
    met = many.select("fp", F.explode(near).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("meet"))
    # At most 65 fingerprints meet in a value. All are within two bits of each other.
    groups = met.groupBy("meet").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("members")).where("size(members) > 1")
    stars = groups.select("a", F.explode("members").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) with label the least ``rank`` reachable; nodes: (node, rank) with distinct nodes, edges: (a, b) of nodes.

    A label is a rank and the node that holds it, so equal ranks of different nodes stay apart.
    Each round takes the least label among neighbours, then the label of that label's node, until
    none moves: labels only fall, so that it ends. Every round is written to the shared folder;
    a lost executor costs one round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    linked = both.select(F.col("a").alias("node")).distinct()
    own = F.struct("rank", "node").alias("label")
    old = materialize(nodes.join(linked, "node", "left_semi").select("node", own), "labels")
    while True:
        offered = both.join(old.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("offer"))
        new = old.join(offered.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "offer").alias("next"))
        new = materialize(new, "offers")
        jump = new.select(F.col("node").alias("of"), F.col("next").alias("further"))
        done = new.join(jump, F.col("next.node") == F.col("of")).select("node", F.least("next", "further").alias("label"), (F.least("next", "further") < F.col("label")).alias("moved"))
        done = materialize(done, "labels")
        free(old, new)
        old = done
        if not done.where("moved").limit(1).count():
            break
    free(both)
    return old.select("node", F.col("label.rank").alias("label"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, carry: list[str] | None = None) -> DataFrame:
    """Add fingerprint (16 hex digits) and component_id, the least key reachable by links; one row out for each row in.

    Fingerprints link at 2 or fewer differing bits, 0 among them: texts without words share
    fingerprint zero and link like others. Null keys take no part in naming a component and
    get a null one only if no other key reaches them. Rows that repeat a key share its
    component only if their fingerprints do. Carried columns of the two names give way.
    """
    carry = [key] if carry is None else [c for c in carry if c not in ("fingerprint", "component_id")]
    d = materialize(fingerprints(docs, list(dict.fromkeys([*carry, key])), text, shingle), "fingerprints")
    # A group of copies may hold a third of all rows: the partial aggregate folds it first.
    distinct = materialize(d.groupBy(F.col(FP).alias("fp")).agg(F.min(key).alias("least")), "distinct")
    edges = links(distinct.select("fp"))
    # Fingerprints under null keys alone come last.
    ranked = distinct.select(F.col("fp").alias("node"), F.struct(F.col("least").isNull().alias("none"), "least").alias("rank"))
    labels = components(ranked, edges)
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    named = materialize(named.select(F.col("fp").alias(FP), F.coalesce(F.col("label.least"), "least").alias("component_id")), "named")
    free(distinct)
    # Skewed by copies of one text: one row on the right, so adaptive execution splits the left (spark.sql.adaptive.skewJoin.enabled, on by default).
    out = d.join(named, FP)
    return out.select(*carry, F.lpad(F.lower(F.hex(FP)), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document with the least doc_id of each component.

    It follows op4's rule: three-word shingles and at most 2 of 64 bits; nearness of 0.8 is not looked for.
    Rows without a doc_id stay if any such row has a component of its own.
    """
    named = near_duplicates(docs.select("doc_id", "text"))
    kept = named.where("doc_id = component_id or component_id is null").select("doc_id").distinct()
    return docs.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi").select(*docs.columns)
