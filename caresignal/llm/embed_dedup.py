"""Embedding near-dedup (operator 1): spherical k-means cells, blocked cosine products.

1. Vectors equal in label and bytes are one class with a count, so a vector that fills a
   third of the table is one row from here on.
2. Spherical k-means on a bounded sample (SAMPLE vectors; the only thing fitted) gives at
   most MAX_CELLS centroids. Every class goes to its nearest cell. Cells never lose a
   pair: with unit vectors, cosine >= t means a distance of at most d = sqrt(2 - 2t), so a
   partner in another cell lies within d of the hyperplane between both centroids; a
   class is therefore also a guest of each lower-numbered cell whose hyperplane is that
   near.
3. Rows of one (label, dimension, cell) are cut into blocks of about BLOCK rows by hash;
   a task multiplies two blocks in double precision and returns, per row, its number of
   links and one spanning edge: nothing grows with the number of pairs.
4. Link counts are summed, edges go through distributed connected components.

The representative kept of a group is its smallest id. Defined cases: vectors that are
null, empty, zero or hold null or non-finite components, and null labels, link with
nothing (n_links 0, kept); different dimensions never link; repeated rows count as
vectors of their own that link with each other; a null id takes no part and is kept.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, map_batches, map_groups, shuffle_partitions

#: Vectors the k-means is fitted on, at most; every vector is assigned.
SAMPLE = 10_000
CELL_ROWS = 4_000
MAX_CELLS = 1_024
BLOCK = 1_024
ITERATIONS = 12


def _valid(v: pa.Array) -> list[np.ndarray | None]:
    out = []
    for x in v:
        a = None if not x.is_valid else x.values
        if a is None or len(a) == 0 or a.null_count:
            out.append(None)
            continue
        n = a.to_numpy(zero_copy_only=False)
        w = n.astype(np.float64)
        out.append(n if np.isfinite(w).all() and w.any() else None)
    return out


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps the squares of very large or small components in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centroids(sample: np.ndarray, k: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Spherical k-means on unit rows: farthest-first seeding, then mean directions."""
    k = min(k, len(sample))
    seeds, near = [0], sample @ sample[0]
    while len(seeds) < k:
        seeds.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[seeds[-1]])
    c = sample[seeds].copy()
    for _ in range(iterations):
        home = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, sample)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def cells_of(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, guest) of every home and guest assignment of unit rows `x`."""
    sim = x @ c.T
    home = sim.argmax(axis=1)
    d = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    gap = np.sqrt(np.maximum(2 - 2 * np.clip(c @ c.T, -1, 1), 0))[home]
    margin = sim[np.arange(len(x)), home][:, None] - sim
    guest = (margin <= d * gap + 1e-9) & (np.arange(len(c))[None, :] < home[:, None])
    r, g = np.nonzero(guest)
    rows = np.concatenate([np.arange(len(x)), r])
    return rows, np.concatenate([home, g]), np.concatenate([np.zeros(len(x), bool), np.ones(len(r), bool)])


def _roots(adj: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable from each row of a boolean adjacency matrix."""
    root = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        new = np.minimum(root, np.where(adj, root[None, :], big).min(axis=1, initial=big))
        if (new == root).all():
            return root
        root = new


def link_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                 threshold: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    element = df.schema[vector].dataType.elementType.simpleString()
    kind = {"float": "<f4", "double": "<f8"}[element]
    src = df.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"),
                    F.col(f"`{vector}`").alias("v"))

    def to_bytes(b: pa.RecordBatch) -> pa.RecordBatch:
        got = _valid(b.column(2))
        ok = pc.and_(b.column(0).is_valid(), b.column(1).is_valid()).to_pylist()
        raw = [x.astype(kind).tobytes() if x is not None and y else None for x, y in zip(got, ok, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["vec_id", "label", "raw"])
    rows = map_batches(src, to_bytes, "vec_id bigint, label string, raw binary")
    rows = rows.select("vec_id", "label", "raw", F.xxhash64("raw", "label").alias("f1"), F.xxhash64(F.lit(1), "label", "raw").alias("f2"))
    rows = checkpointed(rows)
    live = rows.filter("raw IS NOT NULL")
    classes = checkpointed(live.groupBy("f1", "f2").agg(F.min(F.struct("vec_id", "label", "raw")).alias("m"), F.count(F.lit(1)).alias("mult"))
                           .select("f1", "f2", F.monotonically_increasing_id().alias("cls"), F.col("m.vec_id").alias("rep"),
                                   F.col("m.label").alias("label"), F.col("m.raw").alias("raw"), F.octet_length("m.raw").alias("dim"), "mult"))
    n = classes.count()
    if n == 0:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # bounded sample of the commonest dimension, chosen by hash of the content
    dim = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()["dim"]
    picked = (classes.filter(F.col("dim") == dim).orderBy(F.xxhash64("f1", "f2"), "rep").limit(SAMPLE).select("raw")
              if n <= 4 * SAMPLE else
              classes.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("f1", "f2"), F.lit(2**31)) < F.lit(int(2**31 * SAMPLE / n)))).limit(2 * SAMPLE).select("raw"))
    sample = _unit([r["raw"] for r in picked.collect()], kind)
    centroids = fit_centroids(sample, max(1, min(MAX_CELLS, n // CELL_ROWS)))

    def assign(b: pa.RecordBatch) -> pa.Table:
        raw, dims = b.column("raw").to_pylist(), b.column("dim").to_numpy()
        at = np.flatnonzero(dims == dim)
        other = np.flatnonzero(dims != dim)
        row, cell, guest = (cells_of(_unit([raw[i] for i in at], kind), centroids, threshold) if len(at)
                            else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)))
        row = np.concatenate([at[row], other])
        cell, guest = np.concatenate([cell, np.full(len(other), -1)]), np.concatenate([guest, np.zeros(len(other), bool)])
        t = pa.Table.from_batches([b]).take(pa.array(row, pa.int64()))
        return t.append_column("cell", pa.array(cell, pa.int32())).append_column("guest", pa.array(guest, pa.bool_()))
    placed = checkpointed(map_batches(classes.select("cls", "rep", "label", "raw", "dim", "mult"), assign,
                                      "cls bigint, rep bigint, label string, raw binary, dim int, mult bigint, cell int, guest boolean"))
    cell_key = ["label", "dim", "cell"]
    sizes = placed.groupBy(*cell_key).agg(F.count_if(~F.col("guest")).alias("homes"), F.count_if("guest").alias("guests"))
    nb = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    # home blocks are 0 .. nh-1, guest blocks nh .. nh+ng-1; a pair of blocks is (home block i, block j >= i)
    m = placed.join(sizes.select(*cell_key, nb("homes").alias("nh"), F.when(F.col("guests") > 0, nb("guests")).otherwise(0).alias("ng")), cell_key)
    m = m.withColumn("blk", F.when(F.col("guest"), F.col("nh") + F.pmod(F.xxhash64("cls"), F.greatest("ng", F.lit(1))))
                     .otherwise(F.pmod(F.xxhash64("cls"), F.col("nh"))).cast("int"))
    partner = F.when(F.col("guest"), F.sequence(F.lit(0), F.col("nh") - 1)).otherwise(F.sequence(F.lit(0), F.col("nh") + F.col("ng") - 1))
    m = m.withColumn("other", F.explode(partner))
    m = m.select(*cell_key, F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "cls", "rep", "raw", "mult")

    def compare(g: dict) -> dict:
        i, j, blk = g["i"][0], g["j"][0], g["blk"]
        ids, none = g["cls"], np.empty(0, np.int64)
        if len(ids) < 2 or (i != j and (blk == blk[0]).all()):
            return {"cls": none, "links": none, "up": none}
        x = _unit(g["raw"], kind)
        adj = x @ x.T >= threshold
        np.fill_diagonal(adj, False)
        if i != j:
            adj &= blk[:, None] != blk[None, :]
        links = adj @ g["mult"]
        hit = links > 0
        return {"cls": ids[hit], "links": links[hit], "up": _roots(adj, ids)[hit]}
    found = checkpointed(map_groups(m, [*cell_key, "i", "j"], compare, "cls bigint, links bigint, up bigint", shuffle_partitions(df.sparkSession)))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("cls").alias("a"), F.col("up").alias("b")))
    named = (classes.select("f1", "f2", "cls", "rep", "mult").join(links, "cls", "left")
             .join(comp.select(F.col("node").alias("cls"), F.col("component").alias("root")), "cls", "left")
             .withColumn("root", F.coalesce("root", "cls")))
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    named = named.join(least, "root").select("f1", "f2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), "least")
    out = rows.withColumn("live", F.col("raw").isNotNull()).select("vec_id", "live", "f1", "f2").join(named, ["f1", "f2"], "left")
    return out.select("vec_id", F.when(F.col("live"), F.col("links")).otherwise(0).cast("bigint").alias("n_links"),
                      F.when(F.col("live"), F.col("least")).otherwise(F.col("vec_id")).alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
