"""MinHash near-dedup (operator 5): HyperMinHash registers, banding, collision-corrected
estimates, verification on full shingle sets.

1. Each document's distinct word shingles are hashed once to 64 bits. A part of the hash
   picks one of `BUCKETS` buckets; the smallest remaining value of a bucket is kept as a
   16-bit register: leading-zero count and the MANTISSA bits after the first one.
2. Documents with the same shingle set (128-bit fingerprint and size) are one class.
3. Candidates share a key. Sets of at most SMALL shingles, and the sizes that can be their
   partners, have the first n - ceil(0.8 n) + 1 of their shingles as keys, common shingles
   last and else by hash: in one order for all sets, two sets of similarity 0.8 always
   share one of those. Larger sets have bands of neighbouring registers (`LEVELS`): from
   80 shingles on 32 bands of 5, which two sets of similarity 0.8 miss all with 3e-6;
   below, 20 bands of 8, more than the differences of two such sets.
4. Candidates are grouped by their registers: pairs with a set of at most SMALL by the
   number of unequal registers, which is never above the number of differing shingles;
   others by the estimated Jaccard similarity (equal registers less the expected chance
   collisions of compressed ones, MARGIN below the threshold). First every member of a key
   meets one head, then, in keys that still span several groups, block meets block. Only
   spanning edges leave a task, never all pairs, and every plausible pair ends up in one group.
5. Within each group full sets are compared, block against block; again only spanning
   links come out. Connected components of the links give the answer.

Defined cases: null and wordless texts have size 0 and link with nothing; fewer words
than a shingle form one shingle; a null id links with nothing and is kept; of rows with one
id and different texts, the least fingerprint stands for the id and all rows of the id
get its component.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, map_batches, map_groups, maybe_broadcast, shuffle_partitions

BUCKETS = 160
#: Sets of up to so many shingles are found by their shingles, not by bands.
SMALL = 63
#: Numbers of bands, by the size of the larger set of a pair: the least that exceeds size / 4; the last also beyond.
LEVELS = (20, 32)
MANTISSA = 10
EMPTY = 0xFFFF
#: Pairs estimated below threshold - MARGIN are not verified (8 standard deviations at 160 registers).
MARGIN = 0.25
#: Rows of one side of a block.
BLOCK = 256
#: Columns of the shingle matrix at a time.
COLUMNS = 4096
#: Candidate ids are broadcast up to this many rows (12 MB), joined by a shuffle beyond.
BROADCAST_IDS = 500_000
_WORD_CACHE = 200_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)


class _Words(dict):
    """Word -> 64-bit hash; emptied when full, so memory stays bounded."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text, A-Z lower-cased
    (bytes.lower and bytes.split touch ASCII only: exactly A-Z and x20, x09-x0D)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        acc = _mix(acc * _M1 + h[i:len(h) - k + 1 + i])
    return np.unique(acc)


def registers(s: np.ndarray) -> np.ndarray:
    """BUCKETS 16-bit registers of a shingle set; EMPTY where no shingle fell."""
    out = np.full(BUCKETS, EMPTY, "<u2")
    if len(s):
        b = ((s >> np.uint64(32)) * np.uint64(BUCKETS) >> np.uint64(32)).astype(np.int64)
        v = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
        # the hash anew: independent of the bits that chose the bucket
        np.minimum.at(v, b, _mix(s + _M1) >> np.uint64(1))
        got = np.bincount(b, minlength=BUCKETS) > 0
        f = np.maximum(v[got], np.uint64(1))
        bits = np.frexp(f.astype(np.float64))[1].astype(np.int64)  # position of the first one; rounding up is alike on both sides
        bits = np.minimum(bits, 63)
        low = np.maximum(bits - 1 - MANTISSA, 0).astype(np.uint64)
        mant = (f >> low) & np.uint64((1 << MANTISSA) - 1)
        out[got] = np.minimum(63 - bits, 62).astype(np.uint64) * np.uint64(1 << MANTISSA) + mant
    return out


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate of register rows x and y (broadcast together).

    Equal filled registers over registers filled on either side, less the expected number
    of unequal minima whose compressed registers agree: a pair of buckets with minima of
    different shingles agrees in its leading-zero count with probability about 1/3 and in
    the mantissa with 2**-MANTISSA.
    """
    fx, fy = x != EMPTY, y != EMPTY
    union = np.maximum((fx | fy).sum(-1), 1)
    same = ((x == y) & fx).sum(-1)
    chance = (fx & fy).sum(-1) / 3.0 / (1 << MANTISSA)
    return np.clip((same - chance * (1 - same / union)) / union, 0.0, 1.0)


def _agreement(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every row of x with every row of y: equal filled registers, registers filled on either side, on both sides."""
    fx, fy = (x != EMPTY).astype(np.float32), (y != EMPTY).astype(np.float32)
    both = fx @ fy.T
    union = np.maximum(fx.sum(1)[:, None] + fy.sum(1)[None, :] - both, 1)
    same = np.empty(both.shape, np.float32)
    for k in range(len(x)):
        same[k] = np.count_nonzero(x[k] == y, axis=1)
    same -= BUCKETS - (fx.sum(1)[:, None] + fy.sum(1)[None, :] - both)  # registers empty on both sides
    return same, union, both


def _corrected(same: np.ndarray, union: np.ndarray, both: np.ndarray) -> np.ndarray:
    chance = both / 3.0 / (1 << MANTISSA)
    return np.clip((same - chance * (1 - same / union)) / union, 0.0, 1.0)


def estimate_matrix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`estimate` of every row of x with every row of y."""
    return _corrected(*_agreement(x, y))


def few_unequal(unequal: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of `sizes` shingles together can reach `percent` with so many unequal registers: a differing
    shingle makes at most one register unequal, and (100 - percent) / (100 + percent) of the sizes may differ."""
    return unequal * (100 + percent) <= sizes * (100 - percent)


def signatures(docs: DataFrame, size: int, doc_id: str, text: str, most: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), regs (binary), few (the set, if of at most `most` shingles)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, f1, f2, regs, few = [], [], [], [], []
        for t in b.column(1):
            s = shingle_set(t.as_py(), size)
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            n.append(len(s))
            f1.append((d & (2**64 - 1)) - 2**63)
            f2.append((d >> 64) - 2**63)
            regs.append(registers(s).tobytes())
            few.append(s.tobytes() if 0 < len(s) <= most else None)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                                           pa.array(regs, pa.binary()), pa.array(few, pa.binary())],
                                          names=["doc_id", "n_shingles", "f1", "f2", "regs", "few"])
    return map_batches(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), run,
                       f"doc_id {kind}, n_shingles bigint, f1 bigint, f2 bigint, regs binary, few binary")


def levels(n: int) -> list[int]:
    """Numbers of bands under which a set of n shingles meets its partners: those of its own size and of every
    larger size up to n / 0.8."""
    at = lambda m: next((k for k in LEVELS if k > m // 4), LEVELS[-1])
    low, high = at(n), at(int(n / 0.8) + 1)
    return [k for k in LEVELS if low <= k <= high]


def band_keys(regs: bytes, n: int) -> list[int]:
    """64-bit keys of the filled bands of a set under each of its levels."""
    out = []
    for k in levels(n):
        width = 2 * BUCKETS // k
        blank = b"\xff" * width
        for i in range(k):
            part = regs[i * width:(i + 1) * width]
            if part != blank:
                out.append(xxhash.xxh3_64_intdigest(part, seed=k * 64 + i) - 2**63)
    return out


def _shingle_keys(classes: DataFrame, percent: int) -> DataFrame:
    """(rep, key): the first n - ceil(percent n / 100) + 1 shingles of each class that has its set in `few`, in the
    order of (count if above BLOCK, hash), so that shingles of many sets seldom are keys."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.column(1).to_numpy()
        at = pa.array(np.repeat(np.arange(len(n)), n), pa.int64())
        h = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(h)], names=["rep", "n", "h"])
    s = map_batches(classes.filter("few IS NOT NULL").select("rep", "n", "few"), run, "rep bigint, n bigint, h bigint")
    often = checkpointed(s.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > BLOCK))
    s = s.join(maybe_broadcast(often, BROADCAST_IDS), "h", "left")
    s = s.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "h"))).alias("s"))
    first = F.expr(f"slice(s, 1, int(n - ({percent} * n + 99) div 100 + 1))")
    return s.select("rep", F.explode(first).alias("x")).select("rep", F.col("x.h").alias("key"))


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and registers do not rule the threshold out."""
    regs = classes.select(F.col("rep").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na"))
    j = pairs.join(regs, "a").join(regs.select(F.col("a").alias("b"), F.col("ra").alias("rb"), F.col("na").alias("nb")), "b")
    j = j.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u2").reshape(-1, BUCKETS)
        y = np.frombuffer(b"".join(b.column(3).to_pylist()), "<u2").reshape(-1, BUCKETS)
        nx, ny = b.column(4).to_numpy(), b.column(5).to_numpy()
        # registers empty on both sides are equal
        few = few_unequal((x != y).sum(-1), nx + ny, percent)
        return b.select([0, 1]).filter(pa.array(np.where(np.minimum(nx, ny) <= SMALL, few, estimate(x, y) >= percent / 100 - MARGIN)))
    return map_batches(j.select("a", "b", "ra", "rb", "na", "nb"), run, "a bigint, b bigint")


def spanning(adj: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id reachable) that join what a boolean matrix of left x right rows connects."""
    big = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        b2 = np.minimum(b, np.where(adj, a[:, None], big).min(axis=0, initial=big))
        a2 = np.minimum(a, np.where(adj, b2[None, :], big).min(axis=1, initial=big))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    ids, root = np.concatenate([left, right]), np.concatenate([a, b])
    return ids[ids != root], root[ids != root]


def _blocks(rows: DataFrame, key: str, size: str) -> DataFrame:
    """`rows` with blk, i, j: a key of m rows is cut into ceil(m / BLOCK) blocks by hash, and each row goes to every
    pair of blocks that its own block is in, so a task holds two blocks at most."""
    m = rows.withColumn("nb", F.ceil(F.col(size) / BLOCK).cast("int"))
    m = m.withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return m.withColumn("i", F.least("blk", "other")).withColumn("j", F.greatest("blk", "other")).drop("nb", "other", size)


def _edges(a: np.ndarray, b: np.ndarray) -> dict:
    return {"a": np.asarray(a, np.int64), "b": np.asarray(b, np.int64)}


def _sides(g: dict) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of both blocks of a group."""
    return np.flatnonzero(g["blk"] == g["i"][0]), np.flatnonzero(g["blk"] == g["j"][0])


def _plausible_blocks(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Spanning edges (a, b) of the plausible pairs across groups within each key. members: key, rep, comp, size."""
    m = _blocks(members.join(classes.select("rep", "regs", "n"), "rep").select("key", "size", "rep", "comp", "regs", "n"), "key", "size")

    def run(g: dict) -> dict:
        left, right = _sides(g)
        if not len(left) or not len(right) or (g["comp"] == g["comp"][0]).all():
            return _edges([], [])
        regs = np.frombuffer(b"".join(g["regs"]), "<u2").reshape(-1, BUCKETS)
        x, y, nx, ny = regs[left], regs[right], g["n"][left], g["n"][right]
        adj = g["comp"][left][:, None] != g["comp"][right][None, :]
        adj &= 100 * np.minimum(nx[:, None], ny) >= percent * np.maximum(nx[:, None], ny)
        some = np.flatnonzero(adj.any(axis=1))  # rows without a partner to try are left out
        if not len(some):
            return _edges([], [])
        same, union, both = _agreement(x[some], y)
        few = few_unequal(union - same, nx[some][:, None] + ny, percent)
        near = _corrected(same, union, both) >= percent / 100 - MARGIN
        adj[some] &= np.where(np.minimum(nx[some][:, None], ny) <= SMALL, few, near)
        return _edges(*spanning(adj, g["rep"][left], g["rep"][right]))
    return map_groups(m, ["key", "i", "j"], run, "a bigint, b bigint", shuffle_partitions(m.sparkSession)).distinct()


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of every set of x with every set of y, a stretch of shared shingles at a time."""
    cx, cy = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(cx, cy)
    rx, ry = np.repeat(np.arange(len(x)), [len(s) for s in x]), np.repeat(np.arange(len(y)), [len(s) for s in y])
    out = np.zeros((len(x), len(y)), np.float64)
    if not len(shared):
        return out

    def at(c: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        col = np.minimum(np.searchsorted(shared, c), len(shared) - 1)
        hit = shared[col] == c
        col, r = col[hit], r[hit]
        order = np.argsort(col, kind="stable")
        return col[order], r[order]
    (colx, rowx), (coly, rowy) = at(cx, rx), at(cy, ry)
    for lo in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - lo)
        m = []
        for col, row, k in ((colx, rowx, len(x)), (coly, rowy, len(y))):
            a, b = np.searchsorted(col, [lo, lo + width])
            d = np.zeros((k, width), np.float32)
            d[row[a:b], col[a:b] - lo] = 1
            m.append(d)
        out += m[0] @ m[1].T
    return out


def _linked_blocks(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Spanning links (a, b) within each group, on full sets. groups: comp, rep, size."""
    m = _blocks(groups.join(sets.select(F.col("doc_id").alias("rep"), "s"), "rep").select("comp", "size", "rep", "s"), "comp", "size")

    def run(g: dict) -> dict:
        left, right = _sides(g)
        if not len(left) or not len(right):
            return _edges([], [])
        sets = [np.frombuffer(v, np.uint64) for v in g["s"]]
        if len(sets) == 2 and len(left) == len(right) == 2:  # most groups are a pair
            both = len(sets[0]) + len(sets[1]) - len(np.union1d(*sets))
            if 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both):
                return _edges([g["rep"].max()], [g["rep"].min()])
            return _edges([], [])
        x = [sets[k] for k in left]
        y = x if g["i"][0] == g["j"][0] else [sets[k] for k in right]
        both = common_counts(x, y)
        union = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None, :] - both
        return _edges(*spanning(100 * both >= percent * union, g["rep"][left], g["rep"][right]))
    return map_groups(m, ["comp", "i", "j"], run, "a bigint, b bigint", shuffle_partitions(m.sparkSession)).distinct()


def _full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, s): full shingle sets of the documents in `ids`, from their whole texts.

    `ids` (doc_id, f1, f2) are class representatives; of rows that repeat an id, the one
    with the class's fingerprint counts."""
    wanted = docs.join(maybe_broadcast(ids, BROADCAST_IDS), "doc_id")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t.as_py(), size) for t in b.column(1)]
        d = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
        hit = [(x & (2**64 - 1)) - 2**63 == f1 and (x >> 64) - 2**63 == f2
               for x, f1, f2 in zip(d, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        out = pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "s"])
        return out.filter(pa.array(hit, pa.bool_()))
    return map_batches(wanted.select("doc_id", "text", "f1", "f2"), run, "doc_id bigint, s binary").dropDuplicates(["doc_id"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable by
    links of at least `percent` per cent similarity), kept (doc_id = component_id)."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sig = checkpointed(signatures(docs, shingle, "doc_id", "text", SMALL * 100 // max(percent, 1)))
    ids = (sig.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id")
           .agg(F.min(F.struct("f1", "f2", F.col("n_shingles").alias("n"), "regs", "few")).alias("m")).select("doc_id", "m.*"))
    classes = checkpointed(ids.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "regs", "few")).alias("m"))
                           .select("f1", "f2", "n", F.col("m.doc_id").alias("rep"), F.col("m.regs").alias("regs"), F.col("m.few").alias("few")))

    def keyed(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = [band_keys(r, n) for r, n in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
        rep = b.column(0).take(pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]), pa.int64()))
        return pa.RecordBatch.from_arrays([rep, pa.array([x for k in keys for x in k], pa.int64())], names=["rep", "key"])
    bands = map_batches(classes.filter(F.col("n") > SMALL).select("rep", "n", "regs"), keyed, "rep bigint, key bigint")
    bands = bands.unionByName(_shingle_keys(classes, percent))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("head")).filter("size > 1")
    members = checkpointed(bands.join(shared, "key"))  # small: keys that only one class has are gone
    some = checkpointed(classes.drop("few").join(members.select("rep").distinct(), "rep"))
    # groups of plausible pairs
    near = checkpointed(_plausible(members.filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), some, percent))
    group = connected_components(near).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    # in a band of two the head has met the other already
    m = members.select("key", "rep", "size").filter("size > 2").join(group, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = m.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    rest = checkpointed(_plausible_blocks(m.join(mixed, "key"), some, percent))
    if not rest.isEmpty():
        near = near.union(rest)
        group = connected_components(near).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    # links on full sets
    group = checkpointed(group)
    wanted = some.join(group.select("rep"), "rep").select(F.col("rep").alias("doc_id"), "f1", "f2")
    sizes = group.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    sets = checkpointed(_full_sets(docs, checkpointed(wanted), shingle))
    links = checkpointed(_linked_blocks(group.join(sizes, "comp"), sets, percent))
    comp = connected_components(links).select(F.col("node").alias("rep"), "component")
    by_id = ids.join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"]).select("doc_id", "rep")
    by_id = by_id.join(comp, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    cid = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return (sig.select("doc_id", "n_shingles").join(by_id, "doc_id", "left")
            .select("doc_id", "n_shingles", cid.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one_per_group(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) whose document stands for its group, same columns."""
    gone = near_duplicates(docs, "doc_id", "text", shingle, percent).filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    gone = maybe_broadcast(checkpointed(gone), BROADCAST_IDS)
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
