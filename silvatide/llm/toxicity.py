"""Toxicity by a linear-chain conditional random field over words.

Labels are given for documents, so tokens are labelled first: among the features
of words (the word, and its first 3 to 6 bytes), those are chosen, greedily by
how many toxic documents they newly explain, that hardly occur in documents of
label 0. Words of toxic documents with a chosen feature are tagged 1, all others
0. A chain of two tags is fitted to windows of tagged words. Forward-backward
marginals then give offending words, whose noisy-or is the document's score.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import arrow_map, filtered, only, table
from .textops import ALNUM, Words, chunks, column, text_buffer

#: At most so many labelled ids of each label, and rows of them, are learned from, the first by a hash of the ids (and of the texts, where ids repeat), of at most so many characters each.
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 100_000
PREFIXES = (3, 4, 5, 6)
#: A feature is chosen if it newly explains so many toxic documents, and at least this share of documents with it is toxic.
LEAST_GAIN = 3
LEAST_SHARE = 0.95
REACH = 8
FOLDS, HELD_FOLD = 5, 0
THRESHOLD = 0.5


def _features(w: Words) -> np.ndarray:
    """A column of feature hashes for the word and one for each prefix; 0 where the word is no longer than the prefix."""
    out = [w.hashes()]
    size = w.end - w.start
    for k in PREFIXES:
        # A salt for each kind keeps a prefix apart from a whole word of the same bytes.
        out.append(np.where(size > k, w.hashes(k) ^ np.uint64(0xA5A5A5A5A5A5A5A5 + k), np.uint64(0)))
    return np.stack(out, 1)


def _words_of(text: str) -> Words:
    raw = text.encode()
    return Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)


@dataclass
class Model:
    """Weights of known features (sorted by hash), a bias for tag 1, and tag-to-tag weights."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def __post_init__(self) -> None:
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def known(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words with a known feature, and the sum of the weights of each."""
        f = _features(w)
        row, col = np.nonzero(self.near[(f >> np.uint64(48)).astype(np.int64)])
        h = f[row, col]
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        ok = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        words, back = np.unique(row[ok], return_inverse=True)
        return words, np.bincount(back, self.weights[at[ok]], len(words)) if len(words) else np.zeros(0)

    def marginals(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words with a known feature, and the probability of tag 1 of each in the chain of its whole document."""
        at, gain = self.known(w)
        if not len(at):
            return at, gain
        row = np.searchsorted(w.first, at, "right") - 1
        return at, sparse_marginals(at - w.first[row], row, np.diff(w.first), gain, self.bias, self.trans)


def _powers_of(step: np.ndarray, n: np.ndarray) -> np.ndarray:
    """step ** n for each n, each up to a factor, by squaring."""
    out = np.repeat(np.eye(2)[None], len(n), 0)
    while n.any():
        odd = n & 1 != 0
        out[odd] = out[odd] @ step
        out /= out.sum((1, 2), keepdims=True)
        step = step @ step
        step, n = step / step.sum(), n >> 1
    return out


def sparse_marginals(at: np.ndarray, chain: np.ndarray, size: np.ndarray, gain: np.ndarray, bias: float, trans: np.ndarray) -> np.ndarray:
    """Probability of tag 1 of the words at positions `at` (rising) of chains `chain` (rising) of `size` words, whose scores are gain + bias;
    all other words have the score `bias`. Between two such words the message goes through a power of one matrix, so a chain
    takes as many steps as it has such words, and the result is that of the whole chain."""
    move = np.exp(trans - trans.max())
    potential = lambda x: np.stack([np.exp(np.minimum(-x, 0)), np.exp(np.minimum(x, 0))], -1)
    plain = potential(np.float64(bias))
    through = move * plain  # over one plain word
    first = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
    count = np.diff(np.append(first, len(at)))
    last = first + count - 1
    gap = np.concatenate([[0], at[1:] - at[:-1] - 1])
    gap[first] = 0
    known, back = np.unique(gap, return_inverse=True)
    into = (_powers_of(through, known) @ move)[back]
    # Before the first known word of a chain, and after the last.
    lead = at[first]
    start = np.where((lead > 0)[:, None], np.einsum("j,njk->nk", plain, _powers_of(through, np.maximum(lead - 1, 0)) @ move), 1.0)
    end = _powers_of(through, size[chain[last]] - at[last] - 1).sum(2)
    e = potential(gain + bias)
    order = np.argsort(-count, kind="stable")
    first, last, start, end = first[order], last[order], start[order], end[order]
    steps = np.arange(int(count.max()))
    live = np.searchsorted(-count[order], -steps, "left")  # chains with more than t known words
    a, b = np.empty((len(at), 2)), np.empty((len(at), 2))
    x = start * e[first]
    a[first] = x / x.sum(1, keepdims=True)
    for t in steps[1:].tolist():
        i = first[: live[t]] + t
        x = np.einsum("nj,njk->nk", a[i - 1], into[i]) * e[i]
        a[i] = x / x.sum(1, keepdims=True)
    b[last] = end / end.sum(1, keepdims=True)
    for t in steps[:-1].tolist()[::-1]:
        i = first[: live[t + 1]] + t  # those with a known word after this one
        x = np.einsum("njk,nk->nj", into[i + 1], e[i + 1] * b[i + 1])
        b[i] = x / x.sum(1, keepdims=True)
    m = a * b
    return m[:, 1] / np.maximum(m.sum(1), 1e-300)


def _padded(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(c) for c in chains])
    order = np.argsort(-size, kind="stable")
    grid = np.zeros((len(chains), int(size[order[0]])))
    for r, k in enumerate(order):
        grid[r, : size[k]] = chains[k]
    return order, size[order], grid


def forward_backward(chains: list[np.ndarray], trans: np.ndarray, pairs: np.ndarray | None = None) -> list[np.ndarray]:
    """Probability of tag 1 along each chain of tag-1 scores. All chains take a step together. pairs: gets the expected transitions."""
    order, size, grid = _padded(chains)
    n, steps = grid.shape
    live = np.array([int((size > t).sum()) for t in range(steps)])
    move = np.exp(trans - trans.max())
    # Scores are shifted so that the larger potential of a word is 1.
    e = np.stack([np.exp(np.minimum(-grid, 0)), np.exp(np.minimum(grid, 0))], 2)
    a, b = np.zeros((steps, n, 2)), np.ones((steps, n, 2))
    a[0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for t in range(1, steps):
        k = live[t]
        x = (a[t - 1, :k] @ move) * e[:k, t]
        a[t, :k] = x / x.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        k = live[t + 1]
        x = (b[t + 1, :k] * e[:k, t + 1]) @ move.T
        b[t, :k] = x / x.sum(1, keepdims=True)
    m = a * b
    p = m[..., 1] / np.maximum(m.sum(2), 1e-300)
    if pairs is not None:
        for t in range(1, steps):
            k = live[t]
            x = a[t - 1, :k, :, None] * move * (b[t, :k] * e[:k, t])[:, None, :]
            pairs += (x / x.sum((1, 2), keepdims=True)).sum(0)
    out: list[np.ndarray] = [np.zeros(0)] * n
    for r, k in enumerate(order):
        out[k] = p[: size[r], r]
    return out


def choose_features(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """docs: the distinct features of each. Greedy cover of the toxic documents by features that clean ones lack."""
    toxic = [d for d, y in zip(docs, labels, strict=True) if y]
    clean = [d for d, y in zip(docs, labels, strict=True) if not y]
    if not toxic:
        return np.zeros(0, np.uint64)
    rest, against = np.unique(np.concatenate(clean), return_counts=True) if clean else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    every = np.concatenate(toxic)
    found, holders = np.unique(every, return_counts=True)
    at = np.minimum(np.searchsorted(rest, found), max(len(rest) - 1, 0))
    n_clean = np.where(rest[at] == found, against[at], 0) if len(rest) else np.zeros(len(found), np.int64)
    scale = len(toxic) / max(1, len(clean))  # shares are judged as if both labels were equally common
    fits = (holders >= LEAST_GAIN) & (holders >= LEAST_SHARE * (holders + n_clean * scale))
    found = found[fits]
    # Of each toxic document the fitting features, and of each feature its documents.
    own = [np.searchsorted(found, d[np.isin(d, found)]) for d in toxic]
    doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
    flat = np.concatenate(own) if own else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    doc_of, bounds = doc[order], np.searchsorted(flat[order], np.arange(len(found) + 1))
    gain = np.diff(bounds)
    covered, chosen = np.zeros(len(toxic), bool), []
    while len(gain) and gain.max() >= LEAST_GAIN:
        best = int(gain.argmax())
        chosen.append(best)
        for k in doc_of[bounds[best] : bounds[best + 1]].tolist():
            if not covered[k]:
                covered[k] = True
                gain[own[k]] -= 1
    return np.sort(found[chosen])


def train(rows: list[tuple[str, int]], rounds: int = 120, l2: float = 1e-3) -> Model:
    """rows: text and label. Without documents of both labels, or without a telling feature, an empty model: it scores 0."""
    feats, labels = [], []
    seen = set()
    for text, label in rows:
        if text in seen:  # copies would make rare words look telling
            continue
        seen.add(text)
        w = _words_of(text)
        if len(w):
            feats.append(_features(w))
            labels.append(int(label))
    chosen = choose_features([np.unique(f[f != 0]) for f in feats], np.array(labels))
    if not len(chosen):
        return Model()
    # Windows around tagged words; of clean documents, around words that share a feature with tagged ones, and around any.
    rng = np.random.default_rng(7)
    tags = [np.isin(f, chosen).any(1) & bool(y) for f, y in zip(feats, labels, strict=True)]
    shared = np.unique(np.concatenate([f[t].ravel() for f, t in zip(feats, tags, strict=True)]))
    shared = shared[shared != 0]
    windows: list[tuple[np.ndarray, np.ndarray]] = []
    for f, y, t in zip(feats, labels, tags, strict=True):
        centres = np.flatnonzero(t if y else np.isin(f, shared).any(1)).tolist()
        if not y:
            centres = sorted([*centres, *rng.integers(0, len(f), 3).tolist()])
        done = -1
        for c in centres:
            lo, hi = max(done, c - REACH, 0), min(len(f), c + REACH + 1)
            if hi > lo:
                windows.append((f[lo:hi], t[lo:hi].astype(float)))
                done = hi
    # Known features are those of words that have a feature seen on a tagged word.
    keys = np.unique(np.concatenate([f[np.isin(f, shared).any(1)].ravel() for f, _ in windows]))
    keys = keys[keys != 0]
    ids = [np.where(keys[np.minimum(np.searchsorted(keys, f), len(keys) - 1)] == f, np.searchsorted(keys, f), len(keys)) for f, _ in windows]
    flat = np.concatenate(ids)
    gold = np.concatenate([t for _, t in windows])
    cuts = np.cumsum([len(t) for _, t in windows])[:-1]
    gold_pairs = np.zeros((2, 2))
    for _, t in windows:
        np.add.at(gold_pairs, (t[:-1].astype(int), t[1:].astype(int)), 1)
    theta, trans, bias = np.zeros(len(keys) + 1), np.zeros((2, 2)), 0.0
    g2, t2, b2 = np.full(len(keys) + 1, 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(rounds):
        pairs = np.zeros((2, 2))
        score = theta[flat].sum(1) + bias
        p = np.concatenate(forward_backward(np.split(score, cuts), trans, pairs))
        gap = gold - p
        g = np.bincount(flat.ravel(), np.repeat(gap, flat.shape[1]), len(keys) + 1) - l2 * theta * len(windows) / 100
        g[-1] = 0
        gt = gold_pairs - pairs - l2 * trans * len(windows)
        gb = gap.sum()
        g2, t2, b2 = g2 + g * g, t2 + gt * gt, b2 + gb * gb
        theta, trans, bias = theta + 0.5 * g / np.sqrt(g2), trans + 0.2 * gt / np.sqrt(t2), bias + 0.5 * gb / np.sqrt(b2)
    return Model(keys, theta[:-1], float(bias), trans)


def fold(id_col: F.Column) -> F.Column:
    """crc32 of the id as text, mod 5; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from a bounded sample: for each label the first `rows` ids by hash outside the held fold, and of their rows the first `rows`. Rows
    without an id or a label are left out; ids with both labels count for both. Without
    labelled documents the model knows nothing and scores 0."""
    known = only(labels, "doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != HELD_FOLD)).distinct()
    parts = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    picked = parts[0].unionByName(parts[1]).collect()
    if not picked:
        return Model()
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r.doc_id, r.toxic) for r in picked], "doc_id long, toxic int")
    sample = only(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id").filter(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text", "toxic")
    first = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    sample = sample.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= rows).drop("_rn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(row for b in batches for row in zip(*(column(b, c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([(t, y) for _, t, y in got]))], pa.binary())], names=["model"])

    # The sample is bounded, so one task learns from it; only the model comes to the driver.
    made = arrow_map(sample.repartition(1), run, "model binary").collect()
    return pickle.loads(made[0].model) if made else Model()


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """score and spans (start and end byte of each word with marginal 0.5 or more) for every row, beside the id and the columns in `keep`.

    The score is 1 - product of (1 - marginal) over the words with known features, 0 without any: so for null and empty
    texts. Repeated rows are each scored; an empty table gives none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = [id_col, *keep]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried) + ", score double, spans array<struct<start:long,end:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, off = text_buffer(column(b, "text"))
            for i, j in chunks(off):
                w = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], ALNUM)
                at, p = m.marginals(w)
                row = np.searchsorted(w.first, at, "right") - 1
                clean = np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), j - i) if len(at) else np.zeros(j - i)
                spans: list[list[dict]] = [[] for _ in range(j - i)]
                for r, k in zip(row[p >= THRESHOLD].tolist(), at[p >= THRESHOLD].tolist(), strict=True):
                    base = int(off[i + r] - off[i])
                    spans[r].append({"start": int(w.start[k]) - base, "end": int(w.end[k]) - base})
                cols = [column(b, c).slice(i, j - i) for c in carried]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(-np.expm1(clean) + 0.0, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=[*carried, "score", "spans"],
                )

    return arrow_map(only(docs, *dict.fromkeys([*carried, "text"])), run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with all their columns. Null and empty texts score 0 and stay, repeated rows are each
    judged, and an empty table gives no rows."""
    model = fit(docs, labels)
    return filtered(docs, lambda d, keep: score_documents(d, model, keep=keep), F.col("score") < THRESHOLD)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; what score_documents says of nulls, empty and repeated rows and empty tables holds. A null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold(F.col("doc_id")) == HELD_FOLD, F.lit(False))
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), offsets.alias("offending"))


def held_out(doc_id: int) -> bool:
    """The fold rule in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_FOLD
