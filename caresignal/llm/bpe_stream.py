"""BPE encoding and decoding (operator 4): a bounded-lookahead streaming transducer.

Encoding reads a text in blocks and keeps a constant amount of state:

* White space always separates pre-tokens, normalisation never composes across it and
  special tokens hold none, so a stretch without white space (a chunk) is encoded on its
  own. Short chunks go through a bounded cache.
* Inside a long chunk, text is normalised block by block (cut in front of characters
  that never compose with what precedes), pre-tokens are emitted once no later character
  can extend them, and a pre-token of any length is merged in a window: a token is
  emitted once it ends `lookahead` symbols before the window's end.
* `lookahead` is computed from the merge list (see `sufficient_lookahead`).

Decoding is a state machine over token ids: each token adds bytes, an incremental UTF-8
decoder holds back an unfinished character, and text leaves as soon as it is complete.

Defined cases: null text counts as empty (0 tokens, hashes of the empty string).
"""
from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Characters read at a time; a block ends at the next white space.
BLOCK = 1 << 16
#: Chunks up to this length are cached, longer ones streamed.
CACHED_CHUNK = 256
#: Entries of the cache, which is emptied when full.
CACHE = 300_000
#: White space of the pattern's \\s; str.split() also splits at x1C-x1F.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPACE = re.compile(f"[{_SPACES}]+")
_ODD = re.compile("[\x1c-\x1f]")
_NOTHING = (0, b"", b"")


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """Pieces of `text` that end at white space; together the whole text."""
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + size) if at + size < len(text) else None
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def chunks(block: str) -> list[str]:
    """The stretches without white space, in order."""
    if _ODD.search(block):
        return [c for c in _SPACE.split(block) if c]
    return block.split()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that
    print stand for themselves, the others for U+0100 onwards in byte order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Symbols beyond a token's end that can still change it or anything before it.

    merges: (left, right, result) by rank. A token x is only taken from its right by a merge
    (x, y), which needs y formed and not itself taken from its right earlier. `taken[x]` is
    the farthest symbol past x's end that decides this among the merges seen so far,
    `formed[x]` the farthest one that decides whether x comes about. Going through the
    merges by rank makes every value final before it is used.
    """
    taken: dict[int, int] = {}
    formed: dict[int, int] = {}
    for x, y, z in merges:
        beyond = max(formed.get(y, 0), taken.get(y, 0))
        formed[z] = max(formed.get(z, 0), beyond)
        taken[x] = max(taken.get(x, 0), length[y] + beyond)
    return max([0, *taken.values(), *formed.values()])


class Bpe:
    """A tokenizer file of the byte-level BPE family: optional NFC and lower-casing, one splitting
    pattern without lookaround, optional end-of-word suffix, special tokens matched in raw text."""

    def __init__(self, path: str, merging: bool = True):
        """merging=False: normalising and splitting only, without the merge table."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        norm = spec.get("normalizer") or {}
        kinds = [n["type"] for n in norm.get("normalizers", [norm] if norm else [])]
        pre = spec["pre_tokenizer"]
        split = next(p for p in pre.get("pretokenizers", [pre]) if p["type"] == "Split")
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self._special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        if not merging:
            return
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        back = {c: b for b, c in enumerate(byte_symbols())}
        #: the bytes that each token adds to the decoded text
        self._raw = {i: bytes(back[c] for c in t) if self.byte_decoder and t not in self.special else t.encode() for i, t in self.tokens.items()}
        #: what stands between tokens: without a byte decoder in the file, they are joined by a space
        self.gap = b"" if self.byte_decoder else b" "
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        symbols = list(back)
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.suffix] for s in symbols]
        width = {i: max(1, len(t[:-len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t)) for t, i in self.vocab.items()}
        self.lookahead = sufficient_lookahead([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs], width)
        self.width = width
        self._cache: dict[str, tuple[int, bytes, bytes]] = {}
        self._pretokens: dict[str, list[int]] = {}

    # -- merging

    def _merge_short(self, s: list[int]) -> list[int]:
        """The leftmost pair of least rank again and again; only the two pairs around it are looked up anew."""
        get, none = self.merges.get, (1 << 60, -1)
        found = [get(p, none) for p in zip(s, s[1:], strict=False)]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            s[i:i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((s[i - 1], best[1]), none)
            if i < len(found):
                found[i] = get((best[1], s[i + 1]), none)
        return s

    def _merge_long(self, s: list[int]) -> list[int]:
        """The same result with a heap over a linked list, n log n."""
        get, n = self.merges.get, len(s)
        s, nxt, prv = list(s), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], s[i], s[i + 1]) for i in range(n - 1) if (m := get((s[i], s[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, z, a, b = heapq.heappop(heap)
            j = nxt[i] if s[i] == a else n
            if j >= n or s[j] != b:
                continue
            s[i], s[j] = z, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if m := get((z, s[nxt[i]])):
                    heapq.heappush(heap, (m[0], i, m[1], z, s[nxt[i]]))
            if prv[i] >= 0 and (m := get((s[prv[i]], z))):
                heapq.heappush(heap, (m[0], prv[i], m[1], s[prv[i]], z))
        return [x for x in s if x >= 0]

    def _merge(self, s: list[int]) -> list[int]:
        return self._merge_short(s) if len(s) <= 48 else self._merge_long(s)

    def _pretoken(self, p: str) -> list[int]:
        got = self._pretokens.get(p)
        if got is None:
            raw = p.encode("utf-8", "surrogatepass")
            s = [self.inner[b] for b in raw]
            s[-1] = self.last[raw[-1]]
            got = self._merge(s)
            if len(p) <= CACHED_CHUNK:
                if len(self._pretokens) >= CACHE:
                    self._pretokens.clear()
                self._pretokens[p] = got
        return got

    def holds_special(self, s: str) -> bool:
        return self._special is not None and self._special.search(s) is not None

    def _short_chunk(self, c: str) -> list[int]:
        """A chunk that is at hand as a whole and holds no special token."""
        p = self.normal(c)
        if p.isascii() and p.isalpha():
            return self._pretoken(p)
        return [t for m in self.pattern.findall(p) for t in self._pretoken(m)]

    def _run(self, parts: Iterable[str]) -> Iterator[int]:
        """Tokens of one pre-token of any length that arrives in parts; the window holds a block
        and the lookahead. The last byte is held back: at the end it takes the suffix."""
        window: list[int] = []
        raw_last, room = None, self.lookahead + 1
        for part in parts:
            for at in range(0, len(part), 1024):
                raw = part[at:at + 1024].encode("utf-8", "surrogatepass")
                if raw:
                    window += [self.inner[b] for b in raw]
                    raw_last = raw[-1]
                if len(window) > 2 * room + 1024:
                    end = 0
                    for t in self._merge_long(window):
                        if end + self.width[t] > len(window) - room:
                            break
                        end += self.width[t]
                        yield t
                    del window[:end]
        if window:
            window[-1] = self.last[raw_last]
            yield from self._merge(window)

    # -- normalising and splitting

    @staticmethod
    def _composes(c: str) -> bool:
        """May `c` compose with what precedes it?"""
        return c >= "̀" and (unicodedata.category(c)[0] == "M" or "ᅠ" <= c <= "ᇿ" or "\U00016d40" <= c <= "\U00016d7f")

    def normal(self, s: str) -> str:
        if self.nfc and not s.isascii():
            s = unicodedata.normalize("NFC", s)
        if self.lower:
            # character by character: no special final sigma
            s = s.replace("Σ", "σ").lower()
        return s

    def _normal_parts(self, s: str, size: int) -> Iterator[str]:
        at = 0
        while at < len(s):
            end = min(at + size, len(s))
            while end < len(s) and self._composes(s[end]):
                end += 1
            yield self.normal(s[at:end])
            at = end

    def _segment(self, s: str, size: int) -> Iterator[int]:
        """Tokens of a stretch without white space and special tokens."""
        parts = self._normal_parts(s, size)
        held = ""
        for part in parts:
            held += part
            found = list(self.pattern.finditer(held))
            done = 0
            # a later character may extend the last match or complete a short alternative before it
            for m in found[:-1]:
                if m.start() >= len(held) - 4:
                    break
                yield from self._pretoken(m.group())
                done = m.end()
            held = held[done:]
            first = self.pattern.match(held) if held else None
            if first and first.end() == len(held) and len(held) >= 16 and len(set(self._kind(c) for c in held[-2:])) == 1 and self._kind(held[0]) == self._kind(held[-1]) != "N":
                rest = yield from self._long(held, parts)
                held = rest
        if held:
            for m in self.pattern.finditer(held):
                yield from self._pretoken(m.group())

    @staticmethod
    def _kind(c: str) -> str:
        k = unicodedata.category(c)[0]
        return k if k in "LN" else "-"

    def _long(self, start: str, parts: Iterator[str]) -> Iterator[int]:
        """A run of one kind that fills the buffer: merged as it arrives. Returns what follows it."""
        kind, rest = self._kind(start[0]), ""

        def run() -> Iterator[str]:
            nonlocal rest
            yield start
            for part in parts:
                n = next((i for i, c in enumerate(part) if self._kind(c) != kind), len(part))
                yield part[:n]
                if n < len(part):
                    rest = part[n:]
                    return
        yield from self._run(run())
        return rest

    def _chunk(self, c: str, size: int = 4096) -> Iterator[int]:
        at = 0
        for m in self._special.finditer(c) if self._special else ():
            if m.start() > at:
                yield from self._segment(c[at:m.start()], size)
            yield self.special[m.group()]
            at = m.end()
        if at < len(c):
            yield from self._segment(c[at:], size)

    # -- the transducer's interface

    def encode(self, text: str | None, block: int = BLOCK) -> Iterator[int]:
        for b in blocks(text or "", block):
            for c in chunks(b):
                if len(c) <= CACHED_CHUNK and not (self.holds_special(c)):
                    yield from self._short_chunk(c)
                else:
                    yield from self._chunk(c)

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes complete: an incremental state machine from bytes to characters."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        ids, lead = iter(ids), b""
        while some := list(islice(ids, 4096)):
            if raw := self._bytes(some):
                if out := machine.decode(lead + raw):
                    yield out
                lead = self.gap
        if out := machine.decode(b"", True):
            yield out

    def _bytes(self, ids: list[int]) -> bytes:
        """What tokens add to the decoded text; unknown ids add nothing."""
        return self.gap.join([raw for i in ids if (raw := self._raw.get(i)) is not None])

    def parts(self, text: str | None) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of tokens, decimal ids joined by a space, bytes that the tokens add to the decoded text) of
        consecutive stretches of the text."""
        for b in blocks(text or ""):
            cs = chunks(b)
            got = list(map(self._cache.get, cs))
            if None in got:
                for k, x in enumerate(got):
                    if x is None:
                        if len(cs[k]) > CACHED_CHUNK:
                            yield from self._joined(got[:k])
                            yield from self._stretches(cs[k])
                            got[:k + 1] = [_NOTHING] * (k + 1)
                        else:
                            got[k] = self._cached(cs[k])
            yield from self._joined(got)

    def _joined(self, got: list[tuple[int, bytes, bytes]]) -> Iterator[tuple[int, bytes, bytes]]:
        some = [x for x in got if x[0]]
        if some:
            n, ids, out = zip(*some, strict=True)
            yield sum(n), b" ".join(ids), self.gap.join(out)

    def _cached(self, c: str) -> tuple[int, bytes, bytes]:
        got = self._cache.get(c)
        if got is None:
            ids = list(self._chunk(c)) if self.holds_special(c) else self._short_chunk(c)
            got = self._spelled(ids)
            if len(self._cache) >= CACHE:
                self._cache.clear()
            self._cache[c] = got
        return got

    def _spelled(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        return len(ids), " ".join(map(str, ids)).encode(), self._bytes(ids)

    def _stretches(self, c: str) -> Iterator[tuple[int, bytes, bytes]]:
        tokens = self._chunk(c)
        while ids := list(islice(tokens, 4096)):
            yield self._spelled(ids)


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def digest(bpe: Bpe, text: str | None) -> tuple[int, str, str]:
    """(tokens, sha256 of the ids, sha256 of the decoded text), stretch by stretch."""
    n, ids, out, lead, gap = 0, hashlib.sha256(), hashlib.sha256(), b"", b""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for k, x, y in bpe.parts(text):
        n += k
        ids.update(lead + x)
        out.update(machine.decode(gap + y).encode())
        lead, gap = b" ", bpe.gap
    out.update(machine.decode(b"", True).encode())
    return n, ids.hexdigest(), out.hexdigest()


def encode_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text. One pass, no shuffle."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        got = [digest(bpe, t.as_py()) for t in b.column(1)]
        n, i, d = zip(*got, strict=True)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i), pa.array(d)],
                                          names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return map_batches(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), run,
                       f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        ids = pa.array([list(bpe.encode(t.as_py())) for t in b.column(1)], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])
    return map_batches(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), run,
                       f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text."""
    kind = tokens.schema[doc_id].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        text = pa.array(["".join(bpe.decode(x.as_py() or ())) for x in b.column(1)], pa.string())
        return pa.RecordBatch.from_arrays([b.column(0), text], names=["doc_id", "text"])
    return map_batches(tokens.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{ids}`").alias("ids")), run, f"doc_id {kind}, text string")
