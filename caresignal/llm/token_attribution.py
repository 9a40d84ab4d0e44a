"""Token counts (operator 2): offset-mapped attribution of tokens to fields or sections.

A whole document is encoded once. Token spans in the text come from the tokens' byte
lengths (a byte-level vocabulary spells the text exactly), sections are spans of the same
text, and both are joined as intervals inside the task that holds the row. A token that
crosses a boundary is allocated by an explicit rule:

* "majority": to the section that holds most of its bytes, the earlier one on a tie;
* "start": to the section that holds its first byte;
* "split": in parts, by bytes (tokens column is then fractional).

Sections are [start, end) spans in code points, given per row as an array; where spans
overlap, the earlier span (by start, end, position) owns the shared text. Tokens that
touch no section are counted in a row with section null. Defined cases: null text is
empty; empty texts and sections give zero counts; spans beyond the text are clipped;
null spans and spans with null bounds own nothing; a reversed span is empty. Repeated
rows give repeated results.
"""
from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

RULES = ("majority", "start", "split")
_SCHEMA = "section int, start bigint, end bigint, tokens double, whole_tokens bigint, crossing_tokens bigint, doc_tokens bigint"
#: Text encoded at a time: a stretch ends before white space that starts a new pre-token.
_STRETCH = 1 << 20
_CUT = re.compile(r"(?<=[^\s])(?= [^\s])")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        width[i] = len(token)
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), width


def token_ends(text: str, path: str) -> np.ndarray:
    """End of each token of a whole text, in UTF-8 bytes."""
    enc, width = _encoding(path)
    if len(text) <= _STRETCH:
        return np.cumsum(width[np.array(enc.encode_ordinary(text), np.int64)])
    out, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + _STRETCH)
        end = m.start() if m else len(text)
        out.append(width[np.array(enc.encode_ordinary(text[at:end]), np.int64)])
        at = end
    return np.cumsum(np.concatenate(out))


def disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans with shared text left to the earlier one, in the order given. An earlier span
    that reaches past a later one keeps all of it."""
    out: list[tuple[int, int]] = [(0, 0)] * len(spans)
    reach = 0
    for k in sorted(range(len(spans)), key=lambda k: (*spans[k], k)):
        a, b = max(spans[k][0], reach), spans[k][1]
        out[k] = (a, max(a, b))
        reach = max(reach, b)
    return out


def attribute(text: str, spans: list[tuple[int, int] | None], path: str, rule: str = "majority") -> tuple[np.ndarray, int]:
    """(per section: tokens, whole tokens, crossing tokens; the last row is "no section", number of tokens)."""
    n = len(text)
    clip = [(0, 0) if s is None or s[0] is None or s[1] is None else
            (min(max(int(s[0]), 0), n), min(max(int(s[1]), int(s[0]), 0), n)) for s in spans]
    ends = token_ends(text, path)
    total = len(ends)
    out = np.zeros((len(spans) + 1, 3))
    if not total:
        return out, 0
    starts = np.concatenate([[0], ends[:-1]])
    if text.isascii():
        at = None
    else:  # byte offset of each character
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    own = [(k, a, b) for k, (a, b) in enumerate(disjoint(clip)) if b > a]
    # the text as consecutive stretches, those of no section included
    edge, who, reach = [0], [], 0
    last = int(ends[-1])
    for k, a, b in sorted(own, key=lambda x: x[1]):
        a, b = (a, b) if at is None else (int(at[a]), int(at[b]))
        if a > reach:
            edge.append(a)
            who.append(len(spans))
        edge.append(b)
        who.append(k)
        reach = b
    if reach < last:
        edge.append(last)
        who.append(len(spans))
    edge, who = np.array(edge), np.array(who)
    first = np.searchsorted(edge, starts, side="right") - 1
    final = np.searchsorted(edge, ends, side="left") - 1
    whole = first == final
    out[:, 1] = np.bincount(who[first[whole]], minlength=len(out))
    out[:, 0] = out[:, 1]
    for t in np.flatnonzero(~whole):
        parts: dict[int, int] = {}
        for e in range(first[t], final[t] + 1):
            parts[who[e]] = parts.get(who[e], 0) + int(min(ends[t], edge[e + 1]) - max(starts[t], edge[e]))
        for k in parts:
            out[k, 2] += 1
        if rule == "split":
            for k, v in parts.items():
                out[k, 0] += v / int(ends[t] - starts[t])
        else:
            out[who[first[t]] if rule == "start" else max(parts, key=parts.__getitem__), 0] += 1
    return out, total


def attribute_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                     spans: str | Callable[[str], list[tuple[int, int]]] = "spans", rule: str = "majority") -> DataFrame:
    """One row per document and section, and one with section null where tokens lie outside all sections or a
    document has no section. `tokens` sums to doc_tokens.

    spans: a column (array of structs with start and end), or a function of the text, called in the same task."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema[doc_id].dataType.simpleString()
    if callable(spans):
        plain = F.lit(None).cast("array<array<bigint>>")
    else:
        plain = F.transform(F.col(f"`{spans}`"), lambda x: F.array(x["start"].cast("bigint"), x["end"].cast("bigint")))

    def run(b: pa.RecordBatch) -> pa.Table:
        row, cols = [], [[], [], [], [], [], [], []]
        for i, (t, sp) in enumerate(zip(b.column(1), b.column(2).to_pylist(), strict=True)):
            t = t.as_py() or ""
            sp = spans(t) if callable(spans) else [None if x is None else (x[0], x[1]) for x in sp or []]
            got, total = attribute(t, sp, path, rule)
            keep = len(sp) + (not sp or got[-1].any())
            row += [i] * keep
            cols[0] += [*range(len(sp)), None][:keep]
            cols[1] += [*(None if x is None else x[0] for x in sp), None][:keep]
            cols[2] += [*(None if x is None else x[1] for x in sp), None][:keep]
            for c, v in zip(cols[3:6], got[:keep].T, strict=True):
                c += v.tolist()
            cols[6] += [total] * keep
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, pa.float64()).cast(k) if j in (4, 5) else pa.array(c, k) for j, (c, k) in enumerate(zip(cols, kinds, strict=True))]
        names = ["section", "start", "end", "tokens", "whole_tokens", "crossing_tokens", "doc_tokens"]
        return pa.Table.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *arrays], names=["doc_id", *names])
    return map_batches(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), plain.alias("spans")),
                       run, f"doc_id {kind}, {_SCHEMA}")


def line_sections(text: str) -> list[tuple[int, int]]:
    """Each line with its line feed as a section; together the whole text."""
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        out.append((at, end))
        at = end
    return out
