"""Helpers shared by the corpus operators: shared-folder checkpoints, Arrow map
wrappers, and distributed connected components.

Every operator takes DataFrames and returns a DataFrame. Extra input columns never
clash: operators select the columns they need by name first.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` once to the cluster's shared checkpoint folder and read it from there:
    later passes and lost executors do not recompute what is above it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch], schema: str) -> DataFrame:
    """`mapInArrow` with one output per input batch. Nothing is kept between batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                else:
                    yield out
    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[dict], dict], schema: str, partitions: int) -> DataFrame:
    """`fn` on each group of equal `keys`: rows are dealt to `partitions` tasks by the keys, sorted, and read as a
    stream; a task holds one batch and one group. For many small groups this costs far less than a call each.

    fn gets {column: numpy array, or list for binary columns} and returns {column: array} (equal lengths)."""
    names = [f.split()[0] for f in schema.split(",")]

    def columns(b: pa.RecordBatch) -> dict:
        return {n: c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False)
                for n, c in zip(b.schema.names, b.columns, strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # parts of the group that the last batch ended in
        last, out, size = None, [], 0

        def done(parts: list[dict]) -> None:
            nonlocal size
            whole = parts[0] if len(parts) == 1 else {
                n: sum((p[n] for p in parts), []) if isinstance(parts[0][n], list) else np.concatenate([p[n] for p in parts]) for n in parts[0]}
            got = fn(whole)
            if len(got[names[0]]):
                out.append(got)
                size += len(got[names[0]])

        def emit() -> pa.RecordBatch:
            nonlocal size
            b = pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[n] for o in out])) for n in names], names=names)
            out.clear()
            size = 0
            return b
        for b in batches:
            if not b.num_rows:
                continue
            c = columns(b)
            change = np.zeros(b.num_rows, bool)
            for k in keys:
                change[1:] |= c[k][1:] != c[k][:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = {n: v[lo:hi] for n, v in c.items()}
                own = tuple(v[lo] for v in (c[k] for k in keys))
                if held and own != last:
                    done(held)
                    held = []
                held.append(part)
                last = own
            if size >= 20_000:
                yield emit()
        if held:
            done(held)
        if out:
            yield emit()
    dealt = df.repartition(partitions, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, limit: int) -> bool:
    """Size check behind every explicit broadcast: does `df` have at most `limit` rows?"""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast hint when the checked row count allows it; otherwise the plain frame, joined by a shuffle."""
    return F.broadcast(df) if small_enough(df, limit) else df


#: Row hashes are broadcast up to this many (8 MB), joined by a shuffle beyond.
BROADCAST_HASHES = 1_000_000


def drop_repeated_rows(df: DataFrame) -> DataFrame:
    """`df` with one of all rows that are equal in every column (nulls are equal to each other).

    Rows are found by their hash, which alone is shuffled; only rows whose hash stands twice are grouped by all
    columns, copies collapsing in the map tasks, and all others stay where they are."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    twice = checkpointed(df.select(row.alias("__h")).groupBy("__h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__h"))
    if twice.isEmpty():
        return df
    twice = maybe_broadcast(twice, BROADCAST_HASHES)
    alone = df.join(twice, row == F.col("__h"), "left_anti")
    return alone.unionAll(df.join(twice, row == F.col("__h"), "left_semi").dropDuplicates())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node reachable.

    Contraction on the edge table. In a round every node takes its smallest neighbour as
    parent, parent chains are shortened by two pointer jumps, and edges are rewritten to
    the nodes' ancestors; where a chain is not yet at its end, the edge to the rest of it
    stays. Rounds end when no edge is left; the nodes then follow the rounds' parents.
    All steps are joins and partially aggregated groupings, two checkpoints a round in the
    shared folder; the driver only asks whether an edge is left. Star-shaped edges, as
    spanning edges mostly are, take one or two rounds.
    """
    ordered = lambda x, y: [F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")]
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y").select(*ordered("x", "y")).distinct()
    e = checkpointed(e)
    member = e.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    for _ in range(max_rounds):
        if e.isEmpty():
            return member.select("node", F.col("root").alias("component"))
        up = e.groupBy(F.col("hi").alias("child")).agg(F.min("lo").alias("up"))
        for _ in range(2):
            over = up.select(F.col("child").alias("up"), F.col("up").alias("up2"))
            up = up.join(over, "up", "left").select("child", F.coalesce("up2", "up").alias("up"))
        up = checkpointed(up)
        member = member.join(up.select(F.col("child").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        hi, lo = (up.select(F.col("child").alias(c), F.col("up").alias(c + "2")) for c in ("hi", "lo"))
        moved = (e.join(hi, "hi", "left").join(lo, "lo", "left")
                 .select(F.coalesce("hi2", "hi").alias("x"), F.coalesce("lo2", "lo").alias("y")))
        on = up.select(F.col("up").alias("x")).distinct().join(up.select(F.col("child").alias("x"), F.col("up").alias("y")), "x")
        e = checkpointed(moved.union(on).filter("x <> y").select(*ordered("x", "y")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
