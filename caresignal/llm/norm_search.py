"""Ranked lexical search (operator 13): all documents for each stated item, LEMP-style.

A document's impact vector holds, per term of the items, (1000000000 * tf) div
(1000 * tf + 8 * m); an item's vector holds the weights of its terms; the score is their
inner product. Each task takes its documents a group at a time and

1. orders the impact vectors by length and cuts them into buckets;
2. skips a bucket for every item whose k-th best score so far is above the Cauchy-Schwarz
   bound (weights' length times the bucket's longest vector), or above the bound of the
   bucket's largest impact at each of the item's coordinates;
3. inside a bucket, takes the item's heaviest (rarest) terms as focus coordinates, whose
   postings are short: a vector stays if its focus part plus the Cauchy-Schwarz bound of
   the rest (lengths without the focus coordinates) can still reach the k-th best score;
4. scores what is left exactly in 64-bit integers, and keeps the best k per item.

Bounds are doubles with slack upwards, so nothing that could enter is lost. A task sends
at most k rows per item on; a window over (item) keeps the best k of those.

Items are a stated query set: they go to the tasks in blocks of bounded size (BLOCK_ITEMS
rows and BLOCK_CHARS characters on average; a single item is never split), each block with
its own pass over the documents. The corpus statistics N, L and df cover all documents.

Defined cases: null or term-free texts are no documents (they count nowhere); documents and
items that repeat rank once per distinct row of an item and once per row of a document;
equal scores by ascending doc_id, a null doc_id last; items without a term give no row.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import checkpointed

TOP = 10
BLOCK_ITEMS = 5_000
BLOCK_CHARS = 8_000_000
#: Documents that a task orders by length at a time, and of a bucket.
GROUP = 16_384
BUCKET = 1_024
#: Focus coordinates of an item: its heaviest terms, as many as hold this share of the squared weights.
FOCUS = 0.6
_SLACK = 1 + 1e-9
#: Bytes of a text that are split at a time.
_STRETCH = 4 << 20
#: bytes to lower-cased term bytes, everything else to a space
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in stretches."""
    t, at = raw.translate(_TERM), 0
    while at < len(t):
        end = t.find(b" ", at + _STRETCH) if len(t) - at > _STRETCH else -1
        end = len(t) if end < 0 else end
        yield t[at:end].split()
        at = end


class Items:
    """A block of items: terms numbered over the block, each item's distinct terms."""

    def __init__(self, texts: list[bytes]):
        self.number: dict[bytes, int] = {}
        own = [sorted({self.number.setdefault(w, len(self.number)) for part in terms_of(t) for w in part}) for t in texts]
        self.terms = [np.array(x, np.int64) for x in own]


class Weighted:
    """Items with weights, their terms heaviest first, cut into focus and rest."""

    def __init__(self, items: Items, weight: np.ndarray):
        self.size = len(weight)
        self.weight = weight
        self.items = [(q, x[np.argsort(-weight[x], kind="stable")]) for q, x in enumerate(items.terms)]
        self.items = [(q, x) for q, x in self.items if len(x) and weight[x[0]] > 0]
        self.flat = np.concatenate([x for _, x in self.items]) if self.items else np.zeros(0, np.int64)
        self.cuts = np.cumsum([0, *[len(x) for _, x in self.items]])[:-1]
        self.length, self.focus = np.zeros(len(self.items)), []
        for k, (_, x) in enumerate(self.items):
            squares = weight[x].astype(float) ** 2
            self.length[k] = math.sqrt(squares.sum())
            n = int(np.searchsorted(np.cumsum(squares), FOCUS * squares.sum())) + 1
            self.focus.append((x[:n], math.sqrt(squares[n:].sum())))


class Ranker:
    """Best k documents of every item among those seen."""

    def __init__(self, items: Weighted, n_docs: int, n_terms: int, top: int):
        self.items, self.n_docs, self.n_terms, self.top = items, n_docs, n_terms, top
        self.best: list[list[tuple]] = [[] for _ in items.items]
        self.least = np.zeros(len(items.items))
        self._own = np.zeros(items.size, np.int64)

    def add(self, ids: list, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        """Documents: ids, lengths, how many (term, tf) entries each has."""
        if not len(self.items.items) or not len(terms):
            return
        m = np.array([10 + 90 * int(x) * self.n_docs // self.n_terms for x in n], np.int64)
        row = np.repeat(np.arange(len(ids)), counts)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        length = np.sqrt(np.bincount(row, impact.astype(float) ** 2, len(ids)))
        first = np.concatenate([[0], np.cumsum(counts)])
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        for lo in range(0, len(order), BUCKET):
            docs = order[lo:lo + BUCKET]
            size = counts[docs]
            ends = np.cumsum(size)
            at = np.repeat(first[docs] - (ends - size), size) + np.arange(ends[-1])
            self._bucket([ids[k] for k in docs], length[docs], ends - size, np.repeat(np.arange(len(docs)), size), terms[at], impact[at])

    def _bucket(self, ids: list, length: np.ndarray, first: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        items = self.items
        alive = items.length * length[0] * _SLACK >= self.least
        if not alive.any():
            return
        by = np.argsort(term, kind="stable")
        posted, rows, values = term[by], row[by], impact[by]
        most = np.zeros(items.size, np.int64)
        np.maximum.at(most, term, impact)
        bound = np.add.reduceat(most[items.flat] * items.weight[items.flat], items.cuts)
        ends = np.append(first[1:], len(term))
        for k in np.flatnonzero(alive & (bound >= np.maximum(self.least, 1))):
            _, own = items.items[k]
            focus, rest = items.focus[k]
            lo, hi = np.searchsorted(posted, focus), np.searchsorted(posted, focus, side="right")
            size = hi - lo
            at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            d = values[at].astype(float)
            part = np.bincount(rows[at], np.repeat(items.weight[focus], size) * d, len(ids))
            square = np.bincount(rows[at], d * d, len(ids))
            reach = part + rest * np.sqrt(np.maximum(length * length * _SLACK - square, 0))
            left = np.flatnonzero(reach * _SLACK >= max(self.least[k], 1))
            if len(left):
                self._score(k, own, left, ids, first, ends, term, impact)

    def _score(self, k: int, own: np.ndarray, left: np.ndarray, ids: list, first: np.ndarray, ends: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """Exact scores of the vectors `left`, merged into the best of item k."""
        size = ends[left] - first[left]
        cut = np.cumsum(size) - size
        at = np.repeat(first[left] - cut, size) + np.arange(size.sum())
        self._own[own] = self.items.weight[own]
        score = np.add.reduceat(self._own[term[at]] * impact[at], cut)
        self._own[own] = 0
        floor = max(int(self.least[k]), 1)
        if (score >= floor).sum() > self.top:
            floor = max(floor, int(np.partition(score, -self.top)[-self.top]))
        new = [(-int(score[j]), ids[left[j]] is None, ids[left[j]]) for j in np.flatnonzero(score >= floor)]
        if new:
            best = sorted([*self.best[k], *new], key=lambda x: x[:2] if x[1] else x)[:self.top]
            self.best[k] = best
            if len(best) == self.top:
                self.least[k] = -best[-1][0]


def _index(docs: DataFrame, items, doc_id: str, text: str) -> DataFrame:
    """doc_id, n, terms, tfs (the items' terms only) of every document with a term."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = items.value.number.get
        for b in batches:
            keep, n, sizes, terms, tfs = [], [], [], [], []
            for k, raw in enumerate(b.column(1)):
                total, found = 0, []
                for words in terms_of(raw.as_py()):
                    total += len(words)
                    found += [x for w in words if (x := get(w)) is not None]
                if total:
                    x, c = np.unique(np.array(found, np.int32), return_counts=True)
                    keep.append(k)
                    n.append(total)
                    sizes.append(len(x))
                    terms.append(x)
                    tfs.append(c.astype(np.int64))
            if keep:
                cut = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(keep)), pa.array(n, pa.int64()), pa.ListArray.from_arrays(cut, pa.array(np.concatenate(terms))),
                     pa.ListArray.from_arrays(cut, pa.array(np.concatenate(tfs)))], names=["doc_id", "n", "terms", "tfs"])
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>")


def _weights(index: DataFrame, n_docs: int, size: int) -> np.ndarray:
    """Weight of each of the block's terms; at most `size` rows reach the driver."""
    df = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    for t, n in zip(df["t"].to_pylist(), df["df"].to_pylist(), strict=True):
        out[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
    return out


def _rank_block(docs: DataFrame, block: pa.Table, top: int, doc_id: str, text: str) -> DataFrame:
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    items = Items([x or b"" for x in block["text"].to_pylist()])
    index = checkpointed(_index(docs, spark.sparkContext.broadcast(items), doc_id, text))
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sent = spark.sparkContext.broadcast(Weighted(items, _weights(index, n_docs, len(items.number))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker, held, size, id_type = Ranker(sent.value, n_docs, n_terms, top), [], 0, None

        def done() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            terms, tfs = t["terms"].combine_chunks(), t["tfs"].combine_chunks()
            ranker.add(t["doc_id"].to_pylist(), t["n"].to_numpy(), np.diff(terms.offsets.to_numpy()).astype(np.int64),
                       terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy())
        for b in batches:
            id_type = b.schema.field(0).type
            held.append(b)
            size += b.num_rows
            if size >= GROUP:
                done()
                held, size = [], 0
        if held:
            done()
        rows = [(q, x[2], -x[0]) for (q, _), best in zip(sent.value.items, ranker.best, strict=True) for x in best]
        if rows:
            q, ids, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids, id_type), pa.array(score, pa.int64())], names=["q", "doc_id", "score"])
    found = index.where(F.size("terms") > 0).mapInArrow(run, f"q int, doc_id {kind}, score bigint")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame(pa.table({"q": pa.array(range(block.num_rows), pa.int32()), "item_id": block["item_id"]}))
    return best.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")  # names: one block of items


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of every item with a score above 0."""
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    n, chars = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return reduce(DataFrame.unionAll, [_rank_block(docs, asked.where(part == k).toArrow(), top, doc_id, text) for k in range(blocks)])
