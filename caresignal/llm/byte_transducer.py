"""Byte-level BPE by a lazily determinised finite-state transducer (operator 11).

Compiling the merges. A token list is the BPE encoding of its bytes exactly when every
token and every neighbouring pair is the encoding of its own bytes: merges that never
cross a boundary run on both sides as they would alone, and the first merge that did cross
would do so in the pair alone as well. `Merges` keeps, per token, the merges that build it
in order; `holds(a, b)` replays both lists in step and asks whether the boundary pair ever
comes first. So a piece's encoding is the one path through a non-deterministic transducer
that reads bytes along the vocabulary's trie and may end a token `b` after `a` where
`holds(a, b)`.

Determinising. After i bytes every boundary j <= i whose bytes j..i begin some token is
still possible, each with the one valid token list up to j. A state of the deterministic
machine is that set, as (tokens not yet emitted, trie node), plus the last emitted token.
What all members agree on is emitted, so a token leaves as soon as no later byte can change
it. Boundaries stay possible for less than the longest token and lists that share a stretch
agree before it, so the wait is bounded by the vocabulary; `longest_wait` reports the
longest one met in bytes. States are made when first reached and forgotten together beyond
a bound, as in lazy automata; results do not depend on it.

Pieces are the matches of the splitting pattern; each is encoded on its own, and a piece
that is itself in the vocabulary is that token. Short pieces go through a bounded cache, a
piece of any length streams through the machine with constant memory. Texts are split in
blocks that end between a character and white space, where no match can continue.

Decoding adds each token's bytes to an incremental UTF-8 state machine that holds back an
unfinished character.

Defined cases: null text counts as empty (0 tokens, hashes of the empty string); repeated
rows give one row each; any id type passes through; unknown ids add nothing when decoded.
"""
from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Characters split at a time; a block ends in front of white space.
BLOCK = 1 << 18
#: Pieces up to this many characters are cached, in two generations of this many entries: when the newer
#: is full, the older goes.
CACHED_PIECE = 64
CACHE = 200_000
#: States and pair answers kept before they are forgotten.
MAX_STATES = 300_000
MAX_PAIRS = 1_000_000
_NEVER = 1 << 60
_NONE = np.zeros(0, np.uint32)


class Merges:
    """A rank file: pairs of symbols merge by the rank of their joined bytes, least rank first, leftmost first."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.raw = {i: t for t, i in self.ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"no token for the bytes {missing[:8]}")
        self._built: dict[int, tuple] = {}
        self._pairs: dict[int, bool] = {}

    def built(self, token: int) -> tuple[list[int], list[bytes], list[bytes], bool]:
        """(ranks of the merges that the token's bytes undergo, first symbol and last symbol after 0, 1, ... of
        them, whether the token itself comes out)."""
        got = self._built.get(token)
        if got is None:
            raw, get = self.raw[token], self.ranks.get
            s = [raw[k:k + 1] for k in range(len(raw))]
            when, first, last = [], [s[0]], [s[-1]]
            found = [get(a + b, _NEVER) for a, b in zip(s, s[1:], strict=False)]
            while found and (best := min(found)) < _NEVER:
                k = found.index(best)
                s[k:k + 2] = [s[k] + s[k + 1]]
                del found[k]
                if k:
                    found[k - 1] = get(s[k - 1] + s[k], _NEVER)
                if k < len(found):
                    found[k] = get(s[k] + s[k + 1], _NEVER)
                when.append(best)
                first.append(s[0])
                last.append(s[-1])
            got = self._built[token] = (when, first, last, len(s) == 1)
        return got

    def holds(self, a: int, b: int) -> bool:
        """Is [a, b] the encoding of its bytes? Both tokens must come out of their own bytes."""
        key = a << 32 | b
        got = self._pairs.get(key)
        if got is None:
            got = self._replay(a, b)
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            self._pairs[key] = got
        return got

    def _replay(self, a: int, b: int) -> bool:
        a_when, _, a_last, _ = self.built(a)
        b_when, b_first, _, _ = self.built(b)
        get, i, j, m, n = self.ranks.get, 0, 0, len(a_when), len(b_when)
        while True:
            left = a_when[i] if i < m else _NEVER
            right = b_when[j] if j < n else _NEVER
            across = get(a_last[i] + b_first[j], _NEVER)
            # of equal ranks the leftmost comes first: a's own, then the one across, then b's
            if across < left and across <= right:
                return False
            if left == right == _NEVER:
                return True
            if left <= right:
                i += 1
            else:
                j += 1


class Transducer:
    """Lazily determinised: `feed` bytes, take tokens; `finish` gives what is left."""

    def __init__(self, merges: Merges, max_states: int = MAX_STATES):
        self.merges = merges
        self.max_states = max_states
        self.longest_wait = 0
        self._child: dict[int, int] = {}
        ends, inner, n = {}, set(), 1
        for raw, token in merges.ranks.items():
            node = 0
            for x in raw:
                inner.add(node)
                node, at = self._child.get(node << 8 | x), node
                if node is None:
                    node = self._child[at << 8 | x] = n
                    n += 1
            ends[node] = token
        self._ends, self._inner = ends, inner
        self._sound: dict[int, bool] = {}
        self._forget()

    def _comes_out(self, token: int) -> bool:
        """Is the token the encoding of its own bytes?"""
        got = self._sound.get(token)
        if got is None:
            got = self._sound[token] = self.merges.built(token)[3]
        return got

    def _forget(self) -> None:
        self._members: list[tuple] = []
        self._number: dict[tuple, int] = {}
        self._moves: dict[int, tuple[int, tuple]] = {}
        self.start = self._state((-1, (((), 0),)))

    def _state(self, members: tuple) -> int:
        got = self._number.get(members)
        if got is None:
            got = self._number[members] = len(self._members)
            self._members.append(members)
        return got

    def _move(self, state: int, byte: int) -> tuple[int, tuple]:
        last, members = self._members[state]
        child, ends, inner, holds = self._child.get, self._ends.get, self._inner, self.merges.holds
        after, whole = [], None
        for path, node in members:
            node = child(node << 8 | byte)
            if node is None:
                continue
            if whole is None and (token := ends(node)) is not None and self._comes_out(token):
                before = path[-1] if path else last
                if before < 0 or holds(before, token):
                    whole = (*path, token)
            if node in inner:
                after.append((path, node))
        after.append((whole, 0))  # the one valid list up to here always exists
        first, agreed = after[0][0], 0
        while agreed < len(first):
            token = first[agreed]
            for p, _ in after:
                if len(p) <= agreed or p[agreed] != token:
                    break
            else:
                agreed += 1
                continue
            break
        out = first[:agreed]
        if agreed:
            last = out[-1]
            after = [(p[agreed:], node) for p, node in after]
        # members in order of their boundary: only the first can start right behind the last emitted token,
        # and the last token matters only there
        key = (last if not after[0][0] else -2, tuple(after))
        if len(self._members) >= self.max_states:
            self._forget()
            return self._state(key), out
        if len(after[-1][0]) > 1:
            self.longest_wait = max(self.longest_wait, sum(len(self.merges.raw[t]) for t in after[-1][0]))
        got = self._moves[state << 8 | byte] = (self._state(key), out)
        return got

    def run(self, parts: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one piece that arrives in parts."""
        state = self.start
        for part in parts:
            for byte in part:
                got = self._moves.get(state << 8 | byte) or self._move(state, byte)
                state, out = got
                if out:
                    yield from out
        yield from self._members[state][1][-1][0]

    def piece(self, raw: bytes) -> list[int]:
        """Tokens of a short piece."""
        got, state, moves = [], self.start, self._moves
        for byte in raw:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
                moves = self._moves
            state, out = move
            if out:
                got += out
        got += self._members[state][1][-1][0]
        return got


class ByteBpe:
    """Encoder and decoder of one rank file; `pattern` splits texts into pieces. Ids travel as little-endian uint32."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.merges = Merges(path)
        self.machine = Transducer(self.merges)
        self.pattern = regex.compile(pattern)
        self._gap = regex.compile(r"(?<=\S)\s")
        raw = self.merges.raw
        top = max(raw) + 1
        #: bytes of each id, and its decimal digits with a space behind them; nothing for ids without a token
        self.raw = pa.array([raw.get(i, b"") for i in range(top)], pa.large_binary())
        self.spelled = pa.array([b"%d " % i if i in raw else b"" for i in range(top)], pa.large_binary())
        self._widest = max(map(len, self.merges.ranks))
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _blocks(self, text: str, size: int) -> Iterator[str]:
        at = 0
        while at < len(text):
            m = self._gap.search(text, at + size) if at + size < len(text) else None
            end = m.start() if m else len(text)
            yield text[at:end]
            at = end

    def _long(self, piece: str) -> Iterator[int]:
        if len(piece) <= self._widest and (own := self.merges.ranks.get(piece.encode())) is not None:
            yield own
        else:
            yield from self.machine.run(piece[k:k + 4096].encode() for k in range(0, len(piece), 4096))

    def _short(self, piece: str) -> bytes:
        got = self._old.get(piece)
        if got is None:
            raw = piece.encode()
            own = self.merges.ranks.get(raw)
            ids = [own] if own is not None else self.machine.piece(raw)
            got = array("I", ids).tobytes()
        if len(self._new) >= CACHE:
            self._old, self._new = self._new, {}
        self._new[piece] = got
        return got

    def encode(self, text: str | None, block: int = BLOCK) -> Iterator[np.ndarray]:
        """Ids of the whole text in stretches."""
        for b in self._blocks(text or "", block):
            pieces = self.pattern.findall(b)
            got = list(map(self._new.get, pieces))
            if None in got:
                done = 0
                for k, x in enumerate(got):
                    if x is not None:
                        continue
                    p = pieces[k]
                    if len(p) <= CACHED_PIECE:
                        got[k] = self._new.get(p) or self._short(p)
                    else:
                        yield np.frombuffer(b"".join(got[done:k]), "<u4")
                        tokens = self._long(p)
                        while some := list(islice(tokens, 4096)):
                            yield np.array(some, "<u4")
                        done = k + 1
                got = got[done:]
            yield np.frombuffer(b"".join(got), "<u4")

    def bytes_of(self, ids: np.ndarray, table: pa.Array | None = None) -> memoryview:
        """What the ids' entries of a table (by default their bytes) add up to; unknown ids add nothing."""
        table = self.raw if table is None else table
        ids = ids[ids < len(table)]
        return memoryview(table.take(pa.array(ids)).buffers()[2] or b"") if len(ids) else memoryview(b"")

    def decode(self, stretches: Iterable[np.ndarray]) -> Iterator[str]:
        """Text as it becomes complete; bytes that form no character become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in stretches:
            if out := machine.decode(self.bytes_of(ids)):
                yield out
        if out := machine.decode(b"", True):
            yield out

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(tokens, sha256 of the decimal ids joined by a space, sha256 of the decoded bytes)."""
        n, ids_sha, out_sha = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.encode(text):
            if len(ids):
                ids_sha.update(b" " if n else b"")
                ids_sha.update(self.bytes_of(ids, self.spelled)[:-1])
                out_sha.update(self.bytes_of(ids))
                n += len(ids)
        return n, ids_sha.hexdigest(), out_sha.hexdigest()


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def _columns(df: DataFrame, doc_id: str, value: str, name: str) -> tuple[DataFrame, str]:
    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{value}`").alias(name)), df.schema[doc_id].dataType.simpleString()


def encode_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text. One pass, no shuffle."""
    rows, kind = _columns(docs, doc_id, text, "text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        n, ids, out = zip(*[bpe.digest(t.as_py()) for t in b.column(1)], strict=True)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(out)],
                                          names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return map_batches(rows, run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every whole text."""
    rows, kind = _columns(docs, doc_id, text, "text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        ids = pa.array([np.concatenate([_NONE, *bpe.encode(t.as_py())]).astype(np.int32) for t in b.column(1)], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])
    return map_batches(rows, run, f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text; null ids decode to the empty text."""
    rows, kind = _columns(tokens, doc_id, ids, "ids")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        text = pa.array(["".join(bpe.decode([np.array([i for i in x.as_py() or () if i is not None and i >= 0], np.int64)])) for x in b.column(1)], pa.string())
        return pa.RecordBatch.from_arrays([b.column(0), text], names=["doc_id", "text"])
    return map_batches(rows, run, f"doc_id {kind}, text string")
