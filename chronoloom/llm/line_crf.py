"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad. Its features are binned measures of the
line and of the lines before and after it. Marginals come from forward-backward, computed
as a parallel scan over 2 x 2 matrices, so a text of a million lines takes twenty steps.
A document's quality is the mean of its lines' marginals weighted by their length, then
calibrated on the training documents.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import FUNCTION_WORDS, map_texts

#: The function words as bytes.
_FUNCTION = frozenset(w.encode() for w in FUNCTION_WORDS)
#: measure -> upper edges of its bins.
BINS = {
    "words": (1.5, 2.5, 4.5, 8.5, 16.5, 40.5, 100.5),
    "word_bytes": (2.0, 3.0, 4.0, 5.0, 6.5, 8.5, 12.0),
    "symbols": (0.001, 0.05, 0.2, 0.6, 1.5),
    "capitals": (0.005, 0.04, 0.1, 0.3, 0.6),
    "digits": (0.001, 0.05, 0.2),
    "function": (0.001, 0.05, 0.12, 0.2, 0.35),
    "distinct": (0.1, 0.3, 0.5, 0.7, 0.9),
    "same_as_last": (0.001, 0.1, 0.4),
    "shouts": (0.001, 0.1, 0.5),
    "stops": (0.001, 0.03, 0.1, 0.3),
    "ends": (0.5,),
    "repeats": (0.5,),
    "lines": (1.5, 3.5, 10.5, 40.5),
}
_EDGES = [np.array(e) for e in BINS.values()]
_SIZES = np.array([len(e) + 1 for e in _EDGES])
_FIRST = np.concatenate([[0], np.cumsum(_SIZES)])
#: Features: bins of the line, of the line before and after, and "no such line" for those two.
PER_LINE = int(_FIRST[-1])
N_FEATURES = 3 * PER_LINE + 2


def line_measures(text: bytes) -> tuple[list[tuple], list[int]]:
    """One tuple of measures, in the order of BINS, and the byte length, for each line with a word."""
    rows, lengths, seen = [], [], set()
    for line in text.split(b"\n"):
        w = line.split()
        n = len(w)
        if not n:
            continue
        size = sum(map(len, w))
        rows.append(
            (
                n,
                size / n,
                (len(line) - len(line.translate(None, b"#*$%&|<>"))) / n,
                (len(line) - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / size,
                (len(line) - len(line.translate(None, b"0123456789"))) / size,
                sum(map(_FUNCTION.__contains__, w)) / n,
                len(set(w)) / n,
                sum(map(eq, w, w[1:])) / n,
                line.count(b"!") / n,
                (line.count(b".") + line.count(b"?")) / n,
                float(line.rstrip()[-1:] in (b".", b"?", b"!", b":", b'"')),
                float(line in seen),
                0.0,
            )
        )
        lengths.append(len(line))
        seen.add(line)
    return rows, lengths


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(active feature numbers by line, byte length by line, lines by text)."""
    measured = [line_measures(t) for t in texts]
    counts = np.array([len(r) for r, _ in measured], np.int64)
    total = int(counts.sum())
    values = np.array([r for rows, _ in measured for r in rows], np.float64).reshape(total, len(BINS))
    values[:, -1] = np.repeat(counts, counts)
    lengths = np.array([n for _, ls in measured for n in ls], np.float64)
    own = np.empty(values.shape, np.int64)
    for j, edges in enumerate(_EDGES):
        own[:, j] = _FIRST[j] + np.searchsorted(edges, values[:, j])
    first, last = bounds(counts, total)
    none = 3 * PER_LINE
    before = np.where(first[:, None], none, PER_LINE + np.roll(own, 1, axis=0))
    after = np.where(last[:, None], none + 1, 2 * PER_LINE + np.roll(own, -1, axis=0))
    return np.concatenate([own, before, after], axis=1).astype(np.int32), lengths, counts


def bounds(counts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line is the first, and the last, of its text."""
    held = counts[counts > 0]
    ends = np.cumsum(held)
    first, last = np.zeros(total, bool), np.zeros(total, bool)
    first[ends - held] = True
    last[ends - 1] = True
    return first, last


def _scan(m: np.ndarray, steps: int, ahead: bool) -> np.ndarray:
    """Running products of 2 x 2 matrices, from the left or, with ``ahead``, from the right; scaled."""
    out = m.copy()
    for k in range(steps):
        d = 1 << k
        if d >= len(out):
            break
        got = out.copy()
        a, b = (out[:-d], out[d:])
        p = np.einsum("nij,njk->nik", a, b)
        p /= p.max(axis=(1, 2), keepdims=True)
        if ahead:
            got[:-d] = p
        else:
            got[d:] = p
        out = got
    return out


def marginals(good: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line is good) and the pair marginals of neighbouring lines (zero for a first line).

    ``good`` is each line's score for good, that for bad being 0; ``transition`` holds log weights.
    """
    n = len(good)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    first, _ = bounds(counts, n)
    top = np.maximum(good, 0)
    psi = np.stack([np.exp(-top), np.exp(good - top)], axis=1)
    a = np.exp(transition - transition.max())
    # A first line's matrix has equal rows: what lies before it has no effect.
    m = np.where(first[:, None, None], 1.0, a[None]) * psi[:, None, :]
    m /= m.max(axis=(1, 2), keepdims=True)
    steps = int(counts.max()).bit_length() + 1
    alpha = _scan(m, steps, False)[:, 0, :]
    alpha /= alpha.sum(axis=1, keepdims=True)
    beta = np.ones((n, 2))
    beta[:-1] = _scan(m, steps, True)[1:].sum(axis=2)
    beta /= beta.sum(axis=1, keepdims=True)
    p = alpha * beta
    pair = np.zeros((n, 2, 2))
    x = alpha[:-1, :, None] * a[None] * (psi[1:] * beta[1:])[:, None, :]
    pair[1:] = x / np.maximum(x.sum(axis=(1, 2), keepdims=True), 1e-300)
    pair[first] = 0
    return p[:, 1] / p.sum(axis=1), pair


def train(active: np.ndarray, lengths: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 90, rate: float = 0.1, ridge: float = 0.3) -> dict:
    """Adam on the documents' penalised likelihood, each line carrying its document's label."""
    counts, labels = np.asarray(counts), np.asarray(labels, np.float64)
    if not len(active) or labels.min() == labels.max():
        p = min(max(float(labels.mean()) if len(labels) else 0.5, 0.01), 0.99)
        return {"weights": np.zeros(N_FEATURES), "transition": np.zeros((2, 2)), "slope": 0.0, "bias": math.log(p / (1 - p)), "empty": p}
    y = np.repeat(labels, counts)
    weight = np.repeat(1 / np.sqrt(np.maximum(counts, 1)), counts)
    first, _ = bounds(counts, len(active))
    seen = np.zeros((2, 2))
    w_inner = weight[~first]
    y_inner = y[~first].astype(int)
    np.add.at(seen, (y_inner, y_inner), w_inner)
    theta = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        p, pair = marginals(theta[:N_FEATURES][active].sum(axis=1), counts, theta[N_FEATURES:].reshape(2, 2))
        grad = np.concatenate(
            [
                np.bincount(active.ravel(), np.repeat((y - p) * weight, active.shape[1]), N_FEATURES),
                (seen - (pair * weight[:, None, None]).sum(axis=0)).ravel(),
            ]
        )
        grad = (grad - ridge * theta) / len(counts)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = {"weights": theta[:N_FEATURES], "transition": theta[N_FEATURES:].reshape(2, 2), "slope": 1.0, "bias": 0.0, "empty": 0.5}
    some = counts > 0
    raw = raw_scores(model, active, lengths, counts)[some]
    slope, bias, z, t = 1.0, 0.0, np.log(raw / (1 - raw)), labels[some]
    for _ in range(200):
        g = 1 / (1 + np.exp(-(slope * z + bias))) - t
        slope, bias = slope - 0.05 * float((g * z).mean()), bias - 0.2 * float(g.mean())
    none = labels[~some]
    return model | {"slope": max(slope, 0.05), "bias": bias, "empty": (float(none.sum()) + 0.1) / (len(none) + 1.0)}


def raw_scores(model: dict, active: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the line marginals by text; 0.5 for a text without lines."""
    p, _ = marginals(model["weights"][active].sum(axis=1), counts, model["transition"])
    doc = np.repeat(np.arange(len(counts)), counts)
    total = np.bincount(doc, lengths, len(counts))
    mean = np.bincount(doc, lengths * p, len(counts)) / np.maximum(total, 1)
    return np.clip(np.where(counts > 0, mean, 0.5), 1e-4, 1 - 1e-4)


def scores(model: dict, texts: list[bytes]) -> np.ndarray:
    active, lengths, counts = features(texts)
    raw = raw_scores(model, active, lengths, counts)
    out = 1 / (1 + np.exp(-(model["slope"] * np.log(raw / (1 - raw)) + model["bias"])))
    return np.where(counts > 0, out, model["empty"])


def held_out(key: str = "doc_id"):
    """crc32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = 3000) -> dict:
    """Train on at most ``sample`` labelled rows outside the held-out fifth.

    Those with the least hash of their key are taken; rows without a key or label don't
    count, and of a key's several labels the least. Their texts are taken whole. The bound
    keeps the chosen keys small enough to broadcast and the features small enough for the driver.
    """
    chosen = labels.select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y")).dropna().groupBy("__k").agg(F.min("__y").alias("__y"))
    chosen = chosen.where(~held_out("__k")).orderBy(F.xxhash64("__k"), "__k").limit(sample)
    d = docs.select(F.col(key).alias("__k"), F.col(text).alias("text")).join(F.broadcast(chosen), "__k")

    def factory():
        def run(texts):
            out: dict[str, list] = {"active": [], "lengths": [], "n": []}
            for t in texts:
                active, lengths, counts = features([t])
                out["active"].append(active.astype("<i4").tobytes())
                out["lengths"].append(lengths.tobytes())
                out["n"].append(int(counts[0]))
            return out

        return run

    rows = map_texts(d, ["__k", "__y"], "active binary, lengths binary, n int", factory).collect()
    rows.sort(key=lambda r: (r["__k"], bytes(r["lengths"])))
    width = 3 * len(BINS)
    active = np.frombuffer(b"".join(bytes(r["active"]) for r in rows), "<i4").reshape(-1, width)
    lengths = np.frombuffer(b"".join(bytes(r["lengths"]) for r in rows), np.float64)
    return train(active, lengths, np.array([r["n"] for r in rows], np.int64), np.array([r["__y"] for r in rows]))


def score(docs: DataFrame, model: dict, carry: list[str] | None = None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from ``threshold`` on) to every row.

    Null texts and texts without words take the share of good ones among such training
    rows. Repeated rows score alike; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        m = shared.value

        def run(texts):
            s = scores(m, texts)
            return {"score": s.tolist(), "predicted": (s >= threshold).astype(int).tolist()}

        return run

    return map_texts(docs, docs.columns if carry is None else carry, "score double, predicted int", factory, text)
