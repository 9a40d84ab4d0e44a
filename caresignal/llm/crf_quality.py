"""Quality classifier (operator 6): a linear-chain conditional random field over lines.

Every line with a word is a position; its features are character and word statistics of
the line and of both neighbours, cut into bins. The chain has two labels (good, bad),
learned from documents whose label all their lines inherit. Forward-backward gives each
line's probability of being good; their mean, weighted by line length, is the document's
quality, mapped to a probability by a logistic curve fitted on training documents that
the chain was not fitted on.

Only fitting is bounded: at most TRAIN_DOCS labelled documents of the training folds, taken
in the order of a hash of the id, without documents of over TRAIN_LINES lines, and only as
many of them as hold TRAIN_TOTAL lines together: the driver fits on about 1.2 kB a line.
Scoring is one pass over the whole texts with no shuffle. Ids, sources, languages and labels
are no inputs of a score.

Defined cases: null, empty and wordless texts are one empty line and get a score like any
other; repeated rows get equal scores; without usable labels of both kinds every score
is the share of good labels (0.5 without labels).
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Bounds of the sample that the model is fitted on.
TRAIN_DOCS, TRAIN_LINES, TRAIN_TOTAL = 6_000, 2_000, 300_000
#: Texts whose features a task holds at once while it reads the sample.
SLICE = 64
BINS = 10
ITERATIONS = 150
L2 = 2e-4
#: Folds of crc32(doc_id as text) mod 4; this one is held out.
FOLDS, HELD_OUT = 4, 2
PREDICT_AT = 0.7

FEATURES = ("log_length", "log_words", "punct", "upper", "digit", "symbol", "distinct", "same_as_last", "word_length",
            "bare_punct", "odd_ends", "seen_before", "sentence_end", "commonest")
_KINDS = np.full(256, 5, np.uint8)  # 0 space, 1 upper, 2 lower, 3 digit, 4 punctuation, 5 other bytes, 6 symbol
for _b in range(128):
    _c = chr(_b)
    _KINDS[_b] = (0 if _c in " \t\r\x0b\x0c\n" else 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit() else
                  6 if _c in "#*$%&|<>" else 4 if _c.isprintable() else 5)


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) of the worded lines of a text: one row of FEATURES and one length each."""
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()] or [""]
    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
    size = np.array([len(r) for r in raw])
    out = np.zeros((len(lines), len(FEATURES)))
    joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    kind = _KINDS[joined]
    count = [np.add.reduceat((kind == k).astype(np.int32), starts) for k in range(7)]
    letters = np.maximum(count[1] + count[2] + count[5], 1)
    out[:, 0] = np.log2(size + 1)
    out[:, 2] = count[4] / np.maximum(size, 1)
    out[:, 3] = count[1] / letters
    out[:, 4] = count[3] / np.maximum(size, 1)
    out[:, 5] = count[6] / np.maximum(size, 1)
    seen: set[bytes] = set()
    for i, r in enumerate(raw):
        words = r.split()
        n = len(words)
        if not n:
            continue
        alike = {}
        for w in words:
            alike[w] = alike.get(w, 0) + 1
        tails = [w[-2:] for w in words if len(w) > 2]
        odd = sum(1 for t in tails if not t.isalnum() and t[:1] < b"0")
        out[i, 1] = math.log2(n + 1)
        out[i, 6] = len(alike) / n
        out[i, 7] = sum(map(bytes.__eq__, words, words[1:])) / max(n - 1, 1)
        out[i, 8] = size[i] / n
        out[i, 9] = sum(1 for w in words if len(w) <= 2 and not w.isalnum() and w[0] < 128) / n
        out[i, 10] = odd / n
        out[i, 11] = r in seen
        out[i, 12] = r.rstrip()[-1:] in (b".", b"!", b"?")
        out[i, 13] = max(alike.values()) / n if n >= 5 else 0.0
        seen.add(r)
    return out, np.maximum(size, 1).astype(float)


@dataclass
class Crf:
    edges: np.ndarray      # (features, BINS - 1): bin limits
    weights: np.ndarray    # (3 * features * (BINS + 1),): previous, own and next line; bin BINS is "no neighbour"
    trans: np.ndarray      # (2, 2) log potentials
    curve: tuple[float, float]
    share: float           # of good labels; the score when nothing could be fitted
    fitted: bool = True

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Active weight of each (line, neighbour, feature)."""
        nf = x.shape[1]
        own = np.empty(x.shape, np.int64)
        for f in range(nf):
            own[:, f] = np.searchsorted(self.edges[f], x[:, f], side="right")
        none = np.full((1, nf), BINS)
        at = np.concatenate([np.concatenate([none, own[:-1]]), own, np.concatenate([own[1:], none])], axis=1)
        return at + np.arange(3 * nf) * (BINS + 1)

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """Probability of "good" for each line."""
        s = np.clip(self.weights[self.bins(x)].sum(axis=1), -30, 30)
        return forward_backward(s.tolist(), np.exp(self.trans).tolist())

    def raw(self, text: str | None) -> float:
        x, w = line_features(text)
        m = self.marginals(x)
        return float((m * w).sum() / w.sum())

    def score(self, text: str | None) -> float:
        if not self.fitted:
            return self.share
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a * _logit(self.raw(text)) + b))))


def _logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p / (1 - p))


def forward_backward(s: list[float], t: list[list[float]]) -> np.ndarray:
    """Marginals of label 1 in a two-label chain; s: log odds of each position, t: potentials."""
    n = len(s)
    e = [math.exp(v) for v in s]
    a = [0.0] * n
    p = e[0] / (1 + e[0])
    a[0] = p
    for i in range(1, n):
        one = e[i] * ((1 - p) * t[0][1] + p * t[1][1])
        zero = (1 - p) * t[0][0] + p * t[1][0]
        p = one / (one + zero)
        a[i] = p
    out = np.empty(n)
    b1, b0 = 0.5, 0.5
    for i in range(n - 1, -1, -1):
        good, bad = a[i] * b1, (1 - a[i]) * b0
        out[i] = good / (good + bad) if good + bad > 0 else a[i]
        n1 = t[1][1] * e[i] * b1 + t[1][0] * b0
        n0 = t[0][1] * e[i] * b1 + t[0][0] * b0
        b1, b0 = n1 / (n1 + n0), n0 / (n1 + n0)
    return out


def _batch_fb(s: np.ndarray, lens: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (docs, steps, 2) and pair expectations (docs, 2, 2); rows sorted by length, longest first."""
    d, n = s.shape
    t = np.exp(trans)
    pot = np.stack([np.ones_like(s), np.exp(np.clip(s, -30, 30))], axis=2)
    alpha, beta = np.zeros((d, n, 2)), np.full((d, n, 2), 0.5)
    alpha[:, 0] = pot[:, 0] / pot[:, 0].sum(-1, keepdims=True)
    live = [(lens > k).sum() for k in range(n)]
    for k in range(1, n):
        m = live[k]
        x = (alpha[:m, k - 1] @ t) * pot[:m, k]
        alpha[:m, k] = x / x.sum(-1, keepdims=True)
    pairs = np.zeros((d, 2, 2))
    for k in range(n - 1, 0, -1):
        m = live[k]
        x = (pot[:m, k] * beta[:m, k]) @ t.T
        beta[:m, k - 1] = x / x.sum(-1, keepdims=True)
        y = alpha[:m, k - 1, :, None] * t * (pot[:m, k] * beta[:m, k])[:, None, :]
        pairs[:m] += y / y.sum((1, 2), keepdims=True)
    marg = alpha * beta
    return marg / np.maximum(marg.sum(-1, keepdims=True), 1e-300), pairs


def _length_classes(lens: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of documents, longest first, whose lengths differ by less than a factor of two: padding at most doubles them."""
    starts = [0]
    for k, n in enumerate(lens):
        if 2 * n <= lens[starts[-1]]:
            starts.append(k)
    return list(zip(starts, [*starts[1:], len(lens)], strict=True))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, iterations: int = ITERATIONS) -> Crf:
    """Fit on (features, line lengths) of documents with 0/1 labels.

    Three quarters fit the chain (conditional likelihood per line, each document with the
    same weight up to its square root of lines), one quarter the final curve.
    """
    share = float(labels.mean()) if len(labels) else 0.5
    nf = len(FEATURES)
    empty = Crf(np.zeros((nf, BINS - 1)), np.zeros(3 * nf * (BINS + 1)), np.zeros((2, 2)), (1.0, 0.0), share, False)
    if len(labels) < 8 or share in (0.0, 1.0):
        return empty
    every = np.concatenate([x for x, _ in docs])
    edges = np.stack([np.quantile(every[:, f], np.arange(1, BINS) / BINS) for f in range(nf)])
    # bins of equal counts see nothing of a rare value: the upper limits follow the tail
    tail = np.stack([np.quantile(every[:, f], [0.98, 0.995]) for f in range(nf)])
    edges[:, -2:] = np.maximum(edges[:, -2:], tail)
    model = Crf(np.sort(edges, axis=1), empty.weights, empty.trans, (1.0, 0.0), share)
    order = np.arange(len(docs))
    to_curve = order % 4 == 3
    train = [k for k in order[~to_curve]]
    train.sort(key=lambda k: -len(docs[k][0]))
    lens = np.array([len(docs[k][0]) for k in train])
    y = labels[train].astype(int)
    active = np.concatenate([model.bins(docs[k][0]) for k in train])
    row = np.repeat(np.arange(len(train)), lens)
    col = np.concatenate([np.arange(n) for n in lens])
    weight = 1 / np.sqrt(lens)
    balance = np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
    weight = weight * np.sqrt(balance)
    total = weight.sum()
    theta = np.zeros(len(model.weights) + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    own_pairs = np.zeros((len(train), 2, 2))
    own_pairs[np.arange(len(train)), y, y] = lens - 1
    classes, first = _length_classes(lens), np.concatenate([[0], np.cumsum(lens)])
    good, pairs = np.empty(len(row)), np.empty((len(train), 2, 2))
    for step in range(1, iterations + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        for a, b in classes:
            at = slice(first[a], first[b])
            s = np.zeros((b - a, lens[a]))
            s[row[at] - a, col[at]] = w[active[at]].sum(axis=1)
            marg, pairs[a:b] = _batch_fb(s, lens[a:b], trans)
            good[at] = marg[row[at] - a, col[at], 1]
        res = (y[row] - good) * weight[row]
        g = np.bincount(active.ravel(), weights=np.repeat(res, active.shape[1]), minlength=len(w))
        gt = ((own_pairs - pairs) * weight[:, None, None]).sum(0)
        grad = np.concatenate([g, gt.ravel()]) / total - L2 * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        theta += 0.08 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    model.weights, model.trans = theta[:-4], theta[-4:].reshape(2, 2)
    z, t = [], []
    for k in order[to_curve]:
        x, ln = docs[k]
        m = model.marginals(x)
        z.append(_logit(float((m * ln).sum() / ln.sum())))
        t.append(labels[k])
    model.curve = _logistic(np.array(z), np.array(t, float))
    return model


def _logistic(z: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, Newton with a small ridge; targets drawn in by the usual (n + 1) / (n + 2)."""
    pos, neg = t.sum(), len(t) - t.sum()
    y = np.where(t == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        g = np.array([((p - y) * z).sum() + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * b])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          max_docs: int = TRAIN_DOCS, max_total: int = TRAIN_TOTAL) -> Crf:
    """Fit on labelled documents outside the held-out fold. The sampled ids (at most `max_docs`) are broadcast; executors
    compute line statistics, and those of at most `max_total` lines come to the driver. Of rows with one id the text of
    the least features counts."""
    lab = (labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y"))
           .filter("doc_id IS NOT NULL AND y IN (0, 1)")
           .withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).filter(F.col("h") % FOLDS != HELD_OUT)
           .groupBy("doc_id").agg(F.min("y").alias("y"), F.min("h").alias("h")))
    picked = lab.select("doc_id", "y", F.xxhash64("h", "doc_id").alias("o")).orderBy("o", "doc_id").limit(max_docs)
    sample = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(picked), "doc_id")
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = (sample.select("doc_id", "y", "o", "text").mapInArrow(_sample_features, f"doc_id {kind}, y int, o bigint, x binary, n binary")
            .filter("x IS NOT NULL").groupBy("doc_id", "y", "o").agg(F.min(F.struct("x", "n")).alias("v")).persist())
    try:
        sizes = rows.select("o", (F.length("v.n") / 8).cast("long").alias("lines")).collect()
        total, last = 0, None
        for o, lines in sorted(tuple(r) for r in sizes):
            total += lines
            if total > max_total:
                break
            last = o
        got = rows.filter(F.col("o") <= F.lit(last)).select("doc_id", "y", "v.x", "v.n").collect() if last is not None else []
    finally:
        rows.unpersist()
    # an order that no schedule changes
    got.sort(key=lambda r: r["doc_id"])
    rng = np.random.default_rng(11)
    got = [got[k] for k in rng.permutation(len(got))]
    data = [(np.frombuffer(r["x"], "<f8").reshape(-1, len(FEATURES)), np.frombuffer(r["n"], "<f8")) for r in got]
    return fit(data, np.array([r["y"] for r in got], float))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and line lengths of sampled texts, null for those of over TRAIN_LINES lines; some texts at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            b = whole.slice(at, SLICE)
            xs, ls = [], []
            for t in b.column(3):
                x, n = line_features(t.as_py())
                small = len(x) <= TRAIN_LINES
                xs.append(x.astype("<f8").tobytes() if small else None)
                ls.append(n.astype("<f8").tobytes() if small else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(xs, pa.binary()), pa.array(ls, pa.binary())], names=["doc_id", "y", "o", "x", "n"])


def score(docs: DataFrame, model: Crf, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t.as_py()) for t in b.column(1)], pa.float64())],
                                          names=["doc_id", "score"])
    out = map_batches(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), run, f"doc_id {kind}, score double")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    return out.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def keep_documents(docs: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """The rows of `docs` predicted good, same columns: scored where they lie, no join."""
    at = docs.columns.index(text)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array([model.score(t.as_py()) >= PREDICT_AT for t in b.column(at)], pa.bool_()))
    return map_batches(docs, run, docs.schema)
