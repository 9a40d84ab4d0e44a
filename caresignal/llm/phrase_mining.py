"""Phrase collocation mining (operator 12) by top-order marginalisation.

Every word occurrence gives one window: itself and, as lead columns, the next two words of
its piece, padded where the piece ends. Only these longest windows are counted; n-grams are
never exploded order by order. A word starts exactly one window, so the windows that begin
with a phrase are its occurrences: f of three words is the count of their window, and
Spark's ROLLUP sums the windows to f of two words and of one.

Windows are formed and counted a stretch of text at a time in the map tasks, with whole
columns (`window_counts`), so a frequent window leaves a stretch as one row, and no prefix
gathers more than one row per task and longest window.

Words are counted first (n is the sum of a lang's counts). A window is also padded in front
of a word with fewer than `min_count` occurrences and dropped where it starts with one: no
candidate and none of its parts holds such a word. The words that remain are sent to the
tasks as a dictionary and windows travel as numbers. That table is broadcast only up to MAX_WORDS rows and
MAX_WORD_BYTES; a corpus beyond either has its windows counted as texts without it, which
gives the same rows.

A phrase's cuts and the drop rule need counts of shorter and longer phrases. Those joins
only see phrases with at least `min_count` occurrences, and spread each looked-up row over
`SALTS` copies, so that no frequent word gathers its candidates in one task.

Arithmetic: counts are long, products decimal(38, 0), the quotient is exact and rounds down.

Defined cases: null text is empty; null lang is `und`; repeated rows count each time; a
language without candidates has no row.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import checkpointed, map_batches, small_enough

ORDER = 3
MIN_COUNT = 10
TOP = 2000
#: Bytes of text counted together in a map task.
STRETCH = 4 << 20
#: Copies of a looked-up row in the joins of candidates.
SALTS = 8
#: Bounds of the broadcast dictionary.
MAX_WORDS = 2_000_000
MAX_WORD_BYTES = 64 << 20
_WORD, _SPACE, _CUT = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _CUT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

def _words(raw: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, piece number of each, text number of each) of texts that lie one after the other in `raw`."""
    kind = _KIND[raw]
    word = kind == _WORD
    begins = starts[starts < len(raw)]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    first[begins] = word[begins]
    last[:-1] &= ~word[1:]
    before = begins[begins > 0] - 1
    last[before] = word[before]
    at, end = np.flatnonzero(first), np.flatnonzero(last)
    offsets = np.concatenate([[0], np.cumsum(end - at + 1)])
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[word]]))
    owner = np.searchsorted(starts, at, side="right") - 1
    return words, np.searchsorted(np.flatnonzero(kind == _CUT), at) + owner, owner


def _group(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a position of each distinct column of `keys`, its number of columns), in order of the keys."""
    by = np.lexsort(keys[::-1])
    keys = keys[:, by]
    new = np.ones(len(by), bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    head = np.flatnonzero(new)
    return by[head], np.diff(np.append(head, len(by)))


def _leads(w: np.ndarray, pieces: np.ndarray) -> list[np.ndarray]:
    """The next words of the same piece, 0 beyond its end."""
    out = []
    for k in range(1, ORDER):
        nxt = np.zeros(len(w), w.dtype)
        if len(w) > k:
            nxt[:-k] = np.where(pieces[k:] == pieces[:-k], w[k:], 0)
        out.append(nxt)
    return out


class Stretch:
    """Words of a stretch of texts: codes (from 1) of the sorted distinct `words`, with piece and lang numbers."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
        found, self.pieces, owner = _words(np.frombuffer(b"".join(texts), np.uint8), starts)
        coded = found.dictionary_encode()
        order = np.asarray(pc.sort_indices(coded.dictionary))
        self.words = coded.dictionary.take(pa.array(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        self.codes = rank[np.asarray(coded.indices)]
        self.langs, at = np.unique(np.array(langs, object), return_inverse=True)
        self.lang = at[owner]


def _batches(n: int, columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, n, 65536):
        yield pa.RecordBatch.from_arrays([c.slice(lo, 65536) for c in columns], names=names)


def word_counts(s: Stretch) -> Iterator[pa.RecordBatch]:
    """lang, word, n of a stretch."""
    at, n = _group(np.stack([s.lang, s.codes]))
    cols = [pa.array(s.langs[s.lang[at]], pa.string()), s.words.take(pa.array(s.codes[at] - 1)).cast(pa.string()), pa.array(n, pa.int64())]
    yield from _batches(len(at), cols, ["lang", "word", "n"])


def text_windows(s: Stretch) -> Iterator[pa.RecordBatch]:
    """lang, w1, w2, w3, n of a stretch with words as texts, '' as padding."""
    parts = [s.codes, *_leads(s.codes, s.pieces)]
    at, n = _group(np.stack([s.lang, *parts]))
    spelled = pa.concat_arrays([pa.array([""], s.words.type), s.words])
    cols = [spelled.take(pa.array(p[at])).cast(pa.string()) for p in parts]
    yield from _batches(len(at), [pa.array(s.langs[s.lang[at]], pa.string()), *cols, pa.array(n, pa.int64())], ["lang", "w1", "w2", "w3", "n"])


class Dictionary:
    """Frequent words of each lang, numbered from 1 over all langs, sorted; the langs numbered from 0."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("lang", "ascending"), ("word", "ascending")])
        lang = rows["lang"].to_pylist()
        cuts = [k for k in range(len(lang)) if k == 0 or lang[k] != lang[k - 1]]
        self.names = [lang[k] for k in cuts]
        self.bounds = {lang[a]: (k, a, b) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(lang)], strict=False))}
        self.words = pa.array(rows["word"].to_pylist(), pa.string())

    def numbers(self, lang: str, words: pa.Array) -> tuple[int, np.ndarray]:
        """(number of the lang, number of each word, 0 where it is not among the frequent ones)."""
        if lang not in self.bounds:
            return 0, np.zeros(len(words), np.int32)
        k, a, b = self.bounds[lang]
        found = pc.index_in(words, value_set=self.words.slice(a, b - a))
        return k, np.asarray(pc.fill_null(found, -a - 1)) + a + 1

    def phrases(self, words: list[np.ndarray]) -> pa.Array:
        """The words of each row joined by a space, without the padding."""
        spelled = pa.concat_arrays([pa.array([""]), self.words])
        out = [spelled.take(pa.array(w)) for w in words]
        return pc.utf8_rtrim(pc.binary_join_element_wise(*out, " "), " ")


def number_windows(s: Stretch, known: Dictionary) -> Iterator[pa.RecordBatch]:
    """lang, w1, w2, w3, n of a stretch with numbers for the frequent words, 0 as padding."""
    ids, langs = np.zeros(len(s.codes), np.int32), np.zeros(len(s.codes), np.int32)
    for k, name in enumerate(s.langs):
        mine = np.flatnonzero(s.lang == k)
        used, back = np.unique(s.codes[mine], return_inverse=True)
        number, found = known.numbers(name, s.words.take(pa.array(used - 1)).cast(pa.string()))
        ids[mine], langs[mine] = found[back], number
    w2, w3 = _leads(ids, s.pieces)
    w3[w2 == 0] = 0
    keep = np.flatnonzero(ids)
    if not len(keep):
        return
    cols = np.stack([langs, ids, w2, w3])[:, keep]
    at, n = _group(cols)
    yield from _batches(len(at), [*[pa.array(c[at], pa.int32()) for c in cols], pa.array(n, pa.int64())], ["lang", "w1", "w2", "w3", "n"])


def _parts(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about `size` bytes that end at a piece's end."""
    at = 0
    while len(text) - at > size:
        raw = np.frombuffer(text, np.uint8, offset=at)
        ends = np.flatnonzero(_KIND[raw[size:]] == _CUT)
        if not len(ends):
            break
        end = at + size + int(ends[0]) + 1
        yield text[at:end]
        at = end
    yield text[at:]


def _per_stretch(docs: DataFrame, lang: str, text: str, count, schema: str) -> DataFrame:
    """`count` on the words of each stretch of text; rows repeat between stretches."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("binary").alias("text"))
    rows = rows.where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs, size = [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if size:
                s = Stretch(langs, texts)
                if len(s.codes):
                    yield from count(s)
        for b in batches:
            for name, value in zip(b.column(0), b.column(1), strict=True):
                name = name.as_py()
                for part in _parts(value.as_py(), STRETCH):
                    texts.append(part)
                    langs.append(name)
                    size += len(part)
                    if size >= STRETCH:
                        yield from done()
                        texts, langs, size = [], [], 0
        yield from done()
    return rows.mapInArrow(run, schema)


def _word_sums(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return _per_stretch(docs, lang, text, word_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def _dictionary(frequent: DataFrame) -> Dictionary | None:
    """The frequent words, where their table is within its bounds."""
    if not small_enough(frequent, MAX_WORDS):
        return None
    if (frequent.agg(F.sum(F.octet_length("word") + F.octet_length("lang"))).first()[0] or 0) > MAX_WORD_BYTES:
        return None
    return Dictionary(frequent.select("lang", "word").toArrow())


def phrase_counts(docs: DataFrame, sent: Broadcast | None, min_count: int = MIN_COUNT, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, w1, w2, w3, f of the phrases of 1 to 3 words with f >= min_count, padded beyond their end: numbers of
    the dictionary `sent`, or texts without it."""
    keys = ["lang", "w1", "w2", "w3"]
    if sent is None:
        kind, pad = "string", F.lit("")
        windows = _per_stretch(docs, lang, text, text_windows, "lang string, w1 string, w2 string, w3 string, n bigint")
    else:
        kind, pad = "int", F.lit(0)
        windows = _per_stretch(docs, lang, text, lambda s: number_windows(s, sent.value), "lang int, w1 int, w2 int, w3 int, n bigint")
    windows = windows.groupBy(*keys).agg(F.sum("n").alias("f"))
    sums = docs.sparkSession.sql("SELECT lang, w1, w2, sum(f) AS f, grouping_id() AS level FROM {windows} GROUP BY lang, w1, ROLLUP(w2)", windows=windows)
    sums = (sums.where((F.col("f") >= min_count) & ((F.col("level") > 0) | (F.col("w2") != pad)))
            .select("lang", "w1", F.coalesce("w2", pad).cast(kind).alias("w2"), pad.cast(kind).alias("w3"), "f"))
    # one condition on f and w3 together: a filter on w3 alone would move below the exchange that both branches share
    least = F.when(F.col("w3") != pad, F.lit(min_count)).otherwise(F.lit(1 << 62))
    return sums.union(windows.where(F.col("f") >= least).select(*keys, "f"))


def _floor_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)); at most 1000000, as neither factor is below a."""
    big = lambda c: c.cast("decimal(18,0)")
    over = (big(a) * big(a)).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), (big(left) * big(right)).cast("decimal(38,0)")).cast("bigint")


def _look_up(phrases: DataFrame, table: DataFrame, on: dict[str, str], value: str, name: str, how: str = "left") -> DataFrame:
    """`phrases` with `name` = the table's `value` at lang and the phrase's words; hot words are spread over SALTS keys."""
    salted = table.select("lang", *[F.col(c).alias(f"_{c}") for c in on], F.col(value).alias(name),
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")).withColumnRenamed("lang", "_lang")
    mine = phrases.withColumn("_own", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(SALTS)).cast("int"))
    cond = (F.col("lang") == F.col("_lang")) & (F.col("_own") == F.col("_salt"))
    for theirs, own in on.items():
        cond &= F.col(own) == F.col(f"_{theirs}")
    return mine.join(salted, cond, how).drop("_lang", "_own", "_salt", *[f"_{c}" for c in on])


def _spelled(phrases: DataFrame, sent: Broadcast | None) -> DataFrame:
    """lang and phrase as texts."""
    numbers = ["a", "l", "r", "score"]
    if sent is None:
        return phrases.select("lang", F.array_join(F.filter(F.array("w1", "w2", "w3"), lambda x: x != ""), " ").alias("phrase"), *numbers)

    def spell(b: pa.RecordBatch) -> pa.RecordBatch:
        known = sent.value
        langs = pa.array(known.names, pa.string()).take(b.column(0))
        return pa.RecordBatch.from_arrays([langs, known.phrases([np.asarray(b.column(k)) for k in (1, 2, 3)]), *b.columns[4:]],
                                          names=["lang", "phrase", *numbers])
    return map_batches(phrases.select("lang", "w1", "w2", "w3", *numbers), spell, "lang string, phrase string, a bigint, l bigint, r bigint, score bigint")


def mine_phrases(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, lang: str = "lang", text: str = "text") -> DataFrame:
    """Per lang the `top` phrases by score descending, a descending, phrase ascending:
    lang, rank, phrase, a, l, r, n, score."""
    words = _word_sums(docs, lang, text)
    # the words that matter, and each lang's number of words under the empty word
    words = checkpointed(words.where(F.col("f") >= min_count).union(words.groupBy("lang").agg(F.lit("").alias("word"), F.sum("f").alias("f"))))
    known = _dictionary(words.where("word <> ''"))
    sent = None if known is None else docs.sparkSession.sparkContext.broadcast(known)  # within the dictionary's bounds
    counts = checkpointed(phrase_counts(docs, sent, min_count, lang, text))
    pad = F.lit("") if sent is None else F.lit(0)
    one = counts.where((F.col("w1") != pad) & (F.col("w2") == pad))
    two = counts.where((F.col("w2") != pad) & (F.col("w3") == pad))
    three = counts.where(F.col("w3") != pad)
    # the lower of a triple's two cuts; the first one on a tie
    t = _look_up(three, one, {"w1": "w1"}, "f", "l1")
    t = _look_up(t, two, {"w1": "w2", "w2": "w3"}, "f", "r1")
    t = _look_up(t, two, {"w1": "w1", "w2": "w2"}, "f", "l2")
    t = _look_up(t, one, {"w1": "w3"}, "f", "r2")
    t = t.withColumn("s1", _floor_score(F.col("f"), F.col("l1"), F.col("r1"))).withColumn("s2", _floor_score(F.col("f"), F.col("l2"), F.col("r2")))
    pick = lambda x, y: F.when(F.col("s2") < F.col("s1"), F.col(y)).otherwise(F.col(x))
    keys = ["lang", "w1", "w2", "w3"]
    t = t.select(*keys, F.col("f").alias("a"), pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))
    # the largest count of a triple that holds a pair
    inside = three.select("lang", "f", F.explode(F.array(F.struct(F.col("w1").alias("a"), F.col("w2").alias("b")),
                                                         F.struct(F.col("w2").alias("a"), F.col("w3").alias("b")))).alias("p"))
    longest = inside.groupBy("lang", F.col("p.a").alias("w1"), F.col("p.b").alias("w2")).agg(F.max("f").alias("longer"))
    p = two.join(longest, ["lang", "w1", "w2"], "left").where("longer IS NULL OR 100 * longer < 50 * f")
    p = _look_up(p.select(*keys, "f"), one, {"w1": "w1"}, "f", "l")
    p = _look_up(p, one, {"w1": "w2"}, "f", "r")
    p = p.select(*keys, F.col("f").alias("a"), "l", "r", _floor_score(F.col("f"), F.col("l"), F.col("r")).alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    best = _spelled(t.unionByName(p), sent).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    n = words.where("word = ''").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
