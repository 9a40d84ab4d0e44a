"""Packing (operator 3): vector bin packing with the dot-product heuristic.

Examples are placed into sequences under three limits at once: tokens, segments (pieces)
and loss-bearing tokens. Among the pending pieces that fit an open sequence, the one
whose demand vector has the largest dot product with the sequence's remaining capacity is
placed, every dimension in units of its limit. Pieces may be cut: an example longer than a
sequence fills whole sequences first, and when no pending piece fits, one is cut to fill
the gap. What is left at a partition's end, and a window full of pieces too small to fill
a sequence, and a sequence that a limit closes before it is full, are cut into sequences whose
lengths are powers of two, which need no padding.

Each task packs its own partition in a window of bounded size: no shuffle, nothing on the
driver, and a lost task repeats the same result. A partition's rows only share sequences
with each other; sequence_id holds the partition number in its upper bits.

Defined cases: null text is empty (the end token alone); an example without tokens has no
piece; repeated rows are packed once each.
"""
from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_stream import CACHED_CHUNK, Bpe, blocks, byte_symbols

#: Limits of one sequence for plain documents, where every token after a piece's first bears loss.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 256, 2048
#: Pieces that wait to be placed, at most, and the rows of one output batch.
WINDOW = 512
OUT_ROWS = 8192
#: Texts taken from a batch, and characters encoded, at a time.
SLICE = 256
GROUP_CHARS = 1 << 20
_CACHE = 400_000
_ODD = re.compile("[\x1c-\x1f]")


@dataclass
class Piece:
    key: object
    start: int
    ids: np.ndarray
    total: int
    #: running count of loss-bearing tokens, one entry more than ids; None: all but a piece's first
    loss: np.ndarray | None = None

    def n_loss(self) -> int:
        return max(0, len(self.ids) - 1) if self.loss is None else int(self.loss[-1] - self.loss[0])

    def cut(self, n: int) -> tuple[Piece, Piece]:
        a = Piece(self.key, self.start, self.ids[:n], self.total, None if self.loss is None else self.loss[:n + 1])
        b = Piece(self.key, self.start + n, self.ids[n:], self.total, None if self.loss is None else self.loss[n:])
        return a, b

    def longest(self, tokens: int, loss: int) -> int:
        """Most tokens from the front within both limits."""
        n = min(tokens, len(self.ids))
        if self.loss is None:
            return min(n, loss + 1)
        return min(n, int(np.searchsorted(self.loss, self.loss[0] + loss, side="right")) - 1)


class Packer:
    """Streaming packer: `add` pieces, take finished sequences; `finish` lays out the rest."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, window: int = WINDOW):
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("limits must be positive")
        self.cap = np.array([max_tokens, max_segments, max_loss])
        self.window = window
        self.pending: list[Piece] = []

    def add(self, p: Piece) -> Iterator[list[Piece]]:
        """Cut `p` into whole sequences and a remainder that waits."""
        t, _, lo = (int(x) for x in self.cap)
        while len(p.ids) > t or p.n_loss() > lo:
            head, p = p.cut(p.longest(t, lo))
            if len(head.ids) == t:
                yield [head]
            else:
                self.pending.append(head)
        if len(p.ids):
            self.pending.append(p)
        while len(self.pending) > self.window:
            waiting = len(self.pending)
            yield from self._drain(self.window // 2)
            if len(self.pending) == waiting:  # a window of tiny pieces holds less than a sequence
                yield from self._drain(self.window // 2, rest=True)

    def _drain(self, down_to: int, rest: bool = False) -> Iterator[list[Piece]]:
        """Fill sequences until at most `down_to` pieces wait (and only while they fill a sequence, unless `rest`)."""
        items, self.pending = self.pending, []
        need = np.array([(len(p.ids), 1, p.n_loss()) for p in items], dtype=np.int64).reshape(-1, 3)
        alive = np.ones(len(items), bool)
        left, tokens = len(items), int(need[:, 0].sum())
        while left > down_to and (rest or tokens >= self.cap[0]):
            room, seq = self.cap.copy(), []
            while left and room.min() >= 0 and room[0] > 0 and room[1] > 0:
                score = np.where(alive & (need <= room).all(axis=1), need @ (room / (self.cap * self.cap)), -1.0)
                k = int(score.argmax())
                if score[k] < 0:
                    # nothing fits whole: cut the piece with the most tokens to fill the gap
                    k = int(np.where(alive, need[:, 0], -1).argmax())
                    n = items[k].longest(int(room[0]), int(room[2]))
                    if n < 1 or n >= len(items[k].ids):
                        break
                    head, items[k] = items[k].cut(n)
                    need[k] = len(items[k].ids), 1, items[k].n_loss()
                    took = np.array([n, 1, head.n_loss()])
                else:
                    head, took = items[k], need[k].copy()
                    alive[k] = False
                    left -= 1
                seq.append(head)
                room -= took
                tokens -= int(took[0])
            if not seq:
                break
            yield from self._even(seq)
        self.pending = [p for p, a in zip(items, alive, strict=True) if a]

    def finish(self) -> Iterator[list[Piece]]:
        """The waiting pieces."""
        yield from self._drain(0, rest=True)

    def _even(self, seq: list[Piece]) -> Iterator[list[Piece]]:
        """A sequence that is not full, cut into sequences whose lengths are powers of two."""
        n = sum(len(p.ids) for p in seq)
        if n == self.cap[0]:
            yield seq
            return
        seq = list(seq)
        while n:
            size, part, got = 1 << (n.bit_length() - 1), [], 0
            while got < size:
                p = seq.pop(0)
                if len(p.ids) > size - got:
                    p, q = p.cut(size - got)
                    seq.insert(0, q)
                part.append(p)
                got += len(p.ids)
            yield part
            n -= size


def _pack_partition(rows: Iterator[Piece], limits: tuple[int, int, int], key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    ctx = TaskContext.get()
    first = (ctx.partitionId() if ctx else 0) << 40
    packer, n_seq = Packer(*limits), 0
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "n_loss", "sequence_id", "offset"]
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=names)

    def sequences() -> Iterator[list[Piece]]:
        for p in rows:
            yield from packer.add(p)
        yield from packer.finish()
    for seq in sequences():
        at = 0
        for p in seq:
            out.append((p.key, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, p.n_loss(), first + n_seq, at))
            at += len(p.ids)
        n_seq += 1
        if len(out) >= OUT_ROWS:
            yield batch()
    if out:
        yield batch()


class ChunkEncoder:
    """Ids of the tokenizers library, with bounded caches of white-space separated chunks and of pre-tokens.

    The file's normaliser and pattern work within chunks (white space separates and is
    dropped), so a text's ids are its chunks' ids in order, and a chunk's ids those of its
    pre-tokens, which the library's model merges once each. Chunks with special tokens,
    long chunks and texts with x1C-x1F go to the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.merge = self.t.model.tokenize
        self.rules = Bpe(path, merging=False)
        #: does lower() normalise ASCII, and does "<" stand in all special tokens?
        self.plain = self.rules.lower
        self.marked = all("<" in t for t in self.rules.special)
        symbols = byte_symbols()
        self.symbols = {b: symbols[b] for b in range(256)}
        # chunks and pre-tokens in two generations each: when the newer is full, the older goes
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pretokens: dict[str, bytes] = {}
        self.older_pretokens: dict[str, bytes] = {}

    def forget(self) -> None:
        for held in (self.cache, self.older, self.pretokens, self.older_pretokens):
            held.clear()

    def _whole(self, text: str) -> bytes:
        return array("I", self.t.encode(text, add_special_tokens=False).ids).tobytes()

    def _pretoken(self, p: str) -> bytes:
        got = self.pretokens.get(p)
        if got is None:
            got = self.older_pretokens.get(p)
            if got is None:
                s = p if p.isascii() and p.isalpha() else p.encode().decode("latin-1").translate(self.symbols)
                got = array("I", [x.id for x in self.merge(s)]).tobytes()
            if len(self.pretokens) >= _CACHE:
                self.older_pretokens, self.pretokens = self.pretokens, {}
            self.pretokens[p] = got
        return got

    def _chunk(self, c: str) -> bytes:
        if len(c) > CACHED_CHUNK or ((not self.marked or "<" in c) and self.rules.holds_special(c)):
            return self._whole(c)
        p = c.lower() if self.plain and c.isascii() else self.rules.normal(c)
        if p.isascii() and p.isalpha():
            return self._pretoken(p)
        return b"".join(map(self._pretoken, self.rules.pattern.findall(p)))

    def _known(self, c: str) -> bytes:
        """A chunk that is not among the newer ones."""
        got = self.older.get(c)
        if got is None:
            got = self._chunk(c)
        if len(c) <= CACHED_CHUNK:
            if len(self.cache) >= _CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[c] = got
        return got

    def _some(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if _ODD.search(t):
                out.append(self._whole(t))
                continue
            cs = t.split()
            got = list(map(self.cache.get, cs))
            if None in got:
                for k, x in enumerate(got):
                    if x is None:
                        got[k] = self.cache.get(cs[k]) or self._known(cs[k])
            out.append(b"".join(got))
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids (unsigned, little-endian, 32 bits) of each text; long texts in stretches that end at white space."""
        some, size = [], 0
        for t in texts:
            if len(t) > GROUP_CHARS and not _ODD.search(t):
                yield from self._some(some)
                some, size = [], 0
                yield b"".join(x for b in blocks(t, GROUP_CHARS) for x in self._some([b]))
                continue
            some.append(t)
            size += len(t)
            if size > GROUP_CHARS:
                yield from self._some(some)
                some, size = [], 0
        yield from self._some(some)


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


_SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, n_loss bigint, sequence_id bigint, offset bigint"


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text",
                   limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS)) -> DataFrame:
    """One row per piece of every document (ids of its whole text, then `end_id`)."""
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, tail = _encoder(path), np.array([end_id], "<u4").tobytes()
        it = iter(batches)
        head = next(it, None)
        if head is None:
            return

        def rows() -> Iterator[Piece]:
            b = head
            while b is not None:
                for at in range(0, b.num_rows, SLICE):  # few texts at a time as Python strings
                    some = b.slice(at, SLICE)
                    for k, raw in zip(some.column(0).to_pylist(), enc.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                        ids = np.frombuffer(raw + tail, "<u4")
                        yield Piece(k, 0, ids, len(ids))
                b = next(it, None)
        try:
            yield from _pack_partition(rows(), limits, head.schema.field(0).type)
        finally:
            enc.forget()  # the worker may go on with other stages
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        run, f"doc_id {kind.simpleString()}, {_SCHEMA}")


def pack_examples(examples: DataFrame, example_id: str = "example_id", ids: str = "ids", loss: str | None = "loss_mask",
                  limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS)) -> DataFrame:
    """Instruction data: `ids` array<int> and, if named, `loss` array<boolean> of the same length (shorter or
    null masks count as false beyond their end). One row per piece, example_id in doc_id."""
    kind = examples.schema[example_id].dataType
    cols = [F.col(f"`{example_id}`").alias("doc_id"), F.col(f"`{ids}`").cast("array<bigint>").alias("ids")]
    cols.append(F.col(f"`{loss}`").alias("loss") if loss else F.lit(None).cast("array<boolean>").alias("loss"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = iter(batches)
        head = next(it, None)
        if head is None:
            return

        def rows() -> Iterator[Piece]:
            b = head
            while b is not None:
                for k, x, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    a = np.array([v or 0 for v in x or ()], "<u4")
                    if not len(a):
                        continue
                    run_loss = None
                    if loss:
                        bits = np.zeros(len(a), np.int64)
                        got = [bool(v) for v in (m or ())][:len(a)]
                        bits[:len(got)] = got
                        run_loss = np.concatenate([[0], np.cumsum(bits)])
                    yield Piece(k, 0, a, len(a), run_loss)
                b = next(it, None)
        yield from _pack_partition(rows(), limits, head.schema.field(0).type)
    return examples.select(*cols).mapInArrow(run, f"doc_id {kind.simpleString()}, {_SCHEMA}")
